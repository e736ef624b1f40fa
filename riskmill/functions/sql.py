"""The engine's functions and results under SQL names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskmill.functions.hashing import canonical_json, hmac_pads


def register_functions(spark: SparkSession, hmac_key: str | None = None) -> None:
    """Session functions for SQL users; all but ``canonical_json`` stay on the JVM.

    With ``hmac_key`` there is also ``hmac_sha256(body)``, its key fixed inside.
    """
    if hmac_key is not None:
        inner, outer = (pad.hex() for pad in hmac_pads(hmac_key))
        spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION hmac_sha256(body STRING) RETURNS STRING RETURN sha2(concat("
            f"X'{outer}', unhex(sha2(concat(X'{inner}', CAST(body AS BINARY)), 256))), 256)"
        )
    spark.udf.register("canonical_json", canonical_json)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION content_hash(content STRING, id STRING) RETURNS STRING "
        "RETURN substring(sha2(coalesce(content, id), 256), 1, 16)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION rupees_in(paise BIGINT) RETURNS DOUBLE RETURN paise / 100.0D"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION code_tokens(text STRING) RETURNS ARRAY<STRING> "
        "RETURN transform(regexp_extract_all(text, '[A-Za-z0-9_]+', 0), t -> lower(t))"
    )


def register_views(**frames: DataFrame) -> None:
    """Results as temporary views, e.g. ``register_views(**scan_corpus(files))``."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def register_scan(spark: SparkSession, files: DataFrame) -> None:
    """The stages of a scan over files(repo_id, path, content) as views: code_units, rule_hits, findings."""
    from riskmill.plans.scan import scan_corpus

    stages = scan_corpus(files)
    register_views(code_units=stages["units"], rule_hits=stages["hits"], findings=stages["findings"])
