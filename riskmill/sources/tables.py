"""Sinks and the readers that go with them: manifests, reports and append-only ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.operators.evaluation import latest_reports
from riskmill.schemas import CHUNKS


def write_chunk_manifest(chunks: DataFrame, path: str) -> None:
    """JSON lines, range-partitioned and sorted by id, so equal content gives equal files."""
    chunks.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(path)


def read_chunk_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Chunks and distinct samples per tier."""
    return chunks.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("sample_id").alias("n_samples")
    )


def append_run(metrics: DataFrame, path: str) -> None:
    """One row per evaluation run; macro metrics are left out when the model was unavailable."""
    blank = F.col("llm_status") == "UNAVAILABLE"
    rows = metrics.withColumns(
        {c: F.when(~blank, F.col(c)) for c in ("macro_precision", "macro_recall", "macro_f1")}
    )
    rows.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Reports go to ``kind=test`` for the frozen split and to ``kind=dev`` for all others."""
    kind = F.when(F.col("split") == "test", "test").otherwise("dev")
    report.withColumn("kind", kind).write.mode("append").partitionBy("kind").parquet(path)


def render_report(per_class: DataFrame) -> DataFrame:
    """Markdown table per (system, threshold); at most one line per evaluated class."""

    def number(name: str):
        return F.coalesce(F.format_string("%.4f", F.col(name)), F.lit("N/A"))

    def count(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("N/A"))

    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ",
            "defect_class",
            *[count(c) for c in ("tp", "fp", "fn", "tn")],
            *[number(c) for c in ("precision", "recall", "f1")],
        ),
        F.lit(" |"),
    )
    head = "| Class | TP | FP | FN | TN | Precision | Recall | F1 |\n|---|---|---|---|---|---|---|---|\n"
    return per_class.groupBy("system", "tau").agg(
        F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("markdown")
    )


def latest_report(spark: SparkSession, path: str, kind: str = "test") -> DataFrame:
    return latest_reports(spark.read.parquet(path).filter(F.col("kind") == kind).drop("kind"))


def append_call_ledger(calls: DataFrame, path: str) -> None:
    """Calls that reached the model, partitioned by day; cache hits are not logged."""
    fresh = calls.filter(~F.col("cached")).withColumn("day", F.to_date("ts"))
    fresh.write.mode("append").partitionBy("day").parquet(path)


def freeze_manifest(manifest: DataFrame, path: str) -> None:
    """Written once: a second freeze to the same path is an error."""
    manifest.write.mode("errorifexists").parquet(path)
