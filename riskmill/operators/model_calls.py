"""Model output and call accounting: validation, cache split, costs, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions import textops as T
from riskmill.functions.hashing import request_key
from riskmill.operators.sequences import trailing_window

ANALYSIS_SCHEMA = (
    "findings array<struct<defect_class:string,confidence:double,explanation:string,"
    "evidence_lines:array<int>,scenario_ids:array<string>>>, analysis_notes string, _bad string"
)


def parse_analyses(responses: DataFrame, text: str = "response") -> DataFrame:
    """Parse model answers; one bad finding rejects the whole answer.

    Adds ``findings``, ``analysis_notes`` and ``valid``. Answers that do not parse keep an empty
    list and the note PARSE_ERROR.
    """
    parsed = F.from_json(
        T.extract_json(F.col(text)),
        ANALYSIS_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
    )
    staged = responses.withColumn("_p", parsed)
    found = F.coalesce("_p.findings", F.array().cast("array<struct<defect_class:string,confidence:double,explanation:string,evidence_lines:array<int>,scenario_ids:array<string>>>"))

    def good(f: Column) -> Column:
        return (
            F.coalesce(f.defect_class.isin(*C.EVAL_CLASSES), F.lit(False))
            & F.coalesce(f.confidence.between(0.0, 1.0), F.lit(False))
            & f.explanation.isNotNull()
        )

    valid = F.col("_p").isNotNull() & F.col("_p._bad").isNull() & F.forall(found, good)
    valid = F.coalesce(valid, F.lit(False))
    staged = staged.withColumn("valid", valid)
    return staged.withColumns(
        {
            "findings": F.when(F.col("valid"), found).otherwise(F.slice(found, 1, 0)),
            "analysis_notes": F.when(F.col("valid"), F.coalesce("_p.analysis_notes", F.lit(""))).otherwise("PARSE_ERROR"),
        }
    ).drop("_p")


def explode_findings(analyses: DataFrame, *keys: str) -> DataFrame:
    """One row per model finding; missing lists become empty ones."""
    rows = analyses.select(*keys, F.posexplode("findings").alias("finding_pos", "_f"))
    return rows.select(
        *keys,
        "finding_pos",
        "_f.defect_class",
        "_f.confidence",
        "_f.explanation",
        F.coalesce("_f.evidence_lines", F.array().cast("array<int>")).alias("evidence_lines"),
        F.coalesce("_f.scenario_ids", F.array().cast("array<string>")).alias("scenario_ids"),
    )


def with_request_key(requests: DataFrame) -> DataFrame:
    """Cache key; the system prompt is not part of it."""
    return requests.withColumn(
        "cache_key",
        request_key(
            *[F.col(c) for c in ("provider", "base_url", "model", "temperature", "prompt_version", "user_prompt")]
        ),
    )


def split_cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Mark each request as hit or miss. ``cache`` has one row per cache_key."""
    known = cache.select("cache_key", F.lit(True).alias("hit"))
    return requests.join(known, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def calls_to_make(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct missing keys: equal requests are sent once."""
    return (
        requests.join(cache.select("cache_key"), "cache_key", "left_anti")
        .groupBy("cache_key")
        .agg(F.min("request_id").alias("request_id"), F.count(F.lit(1)).alias("n_requests"))
    )


def call_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """USD from the price table; an unknown model costs nothing."""
    price_in = T.lookup({m: p[0] for m, p in C.PRICES_USD_PER_1M.items()}, model, 0.0)
    price_out = T.lookup({m: p[1] for m, p in C.PRICES_USD_PER_1M.items()}, model, 0.0)
    return (input_tokens * price_in + output_tokens * price_out) / F.lit(1_000_000.0)


def call_costs(ledger: DataFrame) -> DataFrame:
    """Calls, tokens, cost and success per provider and model."""
    priced = ledger.withColumn("cost_usd", F.round(call_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")), 6))
    return priced.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
        F.count_if("cached").alias("cache_hits"),
        F.round(F.avg(F.col("success").cast("double")), 4).alias("success_rate"),
    )


def quota_usage(ledger: DataFrame, time_us: str = "ts_us", keys=("provider",), span_seconds: int = C.QUOTA_WINDOW_SECONDS, chunk_seconds: int = 3600) -> DataFrame:
    """Requests and tokens in the half-open minute that ends at each call."""
    return trailing_window(
        ledger,
        list(keys),
        time_us,
        span_seconds * 1_000_000,
        {"requests": F.count(F.lit(1)), "tokens_used": F.sum("tokens")},
        chunk_seconds * 1_000_000,
    )


def quota_breaches(ledger: DataFrame, rpm: int, tpm: int, **options) -> DataFrame:
    used = quota_usage(ledger, **options)
    return used.filter((F.col("requests") > rpm) | (F.col("tokens_used") > tpm))
