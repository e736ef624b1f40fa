"""Lists, pages, counts and feeds over scans, findings, verifications and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions import textops as T
from riskmill.functions.scoring import severity_rank
from riskmill.operators.sequences import lag_across_buckets


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of an ordered list; ``order`` must end in a unique column."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def filter_findings(
    findings: DataFrame,
    scan_id=None,
    state: str | None = None,
    severity: str | None = None,
    defect_class: str | None = None,
) -> DataFrame:
    """Equality filters that are set, all together; an empty value is no filter."""
    wanted = {"scan_id": scan_id, "state": state, "severity": severity, "defect_class": defect_class}
    for column, value in wanted.items():
        if value is not None and value != "":
            findings = findings.filter(F.col(column) == value)
    return findings


def findings_page(findings: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Newest findings with title and the total number that match."""
    wanted = filter_findings(findings, **filters)
    total = wanted.agg(F.count(F.lit(1))).scalar()
    rows = page(wanted, [F.desc("created_at"), F.col("finding_id")], limit, offset)
    return rows.withColumns(
        {"title": T.title_for(F.col("rule_ids"), F.col("defect_class")), "total": total}
    )


def list_scans(scans: DataFrame, repositories: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans with their repository and number of findings."""
    counts = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_findings"))
    return (
        scans.join(repositories.select("repository_id", "locator"), "repository_id")
        .join(counts, "scan_id", "left")
        .withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    )


def finding_detail(
    findings: DataFrame, repositories: DataFrame, verifications: DataFrame, remediations: DataFrame
) -> DataFrame:
    """Findings with everything attached, one row per attached record.

    Kept flat on purpose: nesting would collect all records of a finding into one value. The
    section is ``verification`` or ``remediation``; a finding without records has one row with
    section ``none``.
    """
    records = verifications.select(
        "finding_id",
        F.lit("verification").alias("section"),
        F.col("verification_id").cast("string").alias("record_id"),
        "status",
        "measured_impact_paise",
    ).unionByName(
        remediations.select(
            "finding_id",
            F.lit("remediation").alias("section"),
            F.col("remediation_id").cast("string").alias("record_id"),
            "status",
            F.lit(None).cast("long").alias("measured_impact_paise"),
        )
    )
    return (
        findings.join(repositories.select("repository_id", "locator"), "repository_id", "left")
        .join(records.withColumnRenamed("status", "record_status"), "finding_id", "left")
        .withColumns(
            {
                "section": F.coalesce("section", F.lit("none")),
                "title": T.title_for(F.col("rule_ids"), F.col("defect_class")),
                "scenario": F.coalesce(F.try_element_at("scenario_ids", F.lit(1)), F.lit("UNKNOWN")),
            }
        )
    )


def scan_summary(findings: DataFrame, first_n: int | None = None) -> DataFrame:
    """Counts by state per scan.

    ``first_n=50`` counts states over the 50 oldest findings only, as the reference's page does;
    the total always counts all.
    """
    totals = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_findings"))
    counted = findings
    if first_n is not None:
        order = Window.partitionBy("scan_id").orderBy("created_at", "finding_id")
        counted = findings.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= first_n)
    states = counted.groupBy("scan_id").agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in ("ADVISORY", "VERIFIED", "EXCEPTION")]
    )
    return totals.join(states, "scan_id")


def scan_kpis(scans: DataFrame, findings: DataFrame) -> DataFrame:
    done = F.col("state").isin(*C.SCAN_TERMINAL_STATES)
    found = findings.agg(F.count(F.lit(1))).scalar()
    return scans.agg(
        F.count(F.lit(1)).alias("total_scans"),
        F.count_if(~done).alias("active_scans"),
        F.count_if(F.col("state") == "DONE").alias("done_scans"),
    ).withColumn("total_findings", found)


def queue_status(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count_if(F.col("status") == "PENDING").alias("pending_jobs"),
        F.max(F.when(F.col("status") == "DONE", F.col("created_at"))).alias("last_job_at"),
    )


def exception_queue(findings: DataFrame) -> DataFrame:
    """Exceptions first, then advisories."""
    rank = T.lookup({"EXCEPTION": 0, "ADVISORY": 1}, F.col("state"))
    return findings.filter(F.col("state").isin("EXCEPTION", "ADVISORY")).withColumn("queue_rank", rank)


def by_severity(findings: DataFrame) -> DataFrame:
    """Most severe first, then most confident; the id settles ties."""
    return findings.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "finding_id")


def recent(df: DataFrame, order: Sequence[Column], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def preflight(files: DataFrame, ignore_case: bool = True, fall_back_to_json: bool = False) -> DataFrame:
    """Per repository: does it mention the provider, how many Python files, how many units to expect.

    Scan creation uses the case-sensitive form and also looks into ``.json`` files.
    """
    name = F.col("content") if not ignore_case else F.lower("content")
    is_py, is_json = F.col("path").endswith(".py"), F.col("path").endswith(".json")
    mentions = name.contains(C.PROVIDER)
    evidence = (is_py & mentions) | (is_json & mentions if fall_back_to_json else F.lit(False))
    return files.groupBy("repo_id").agg(
        F.bool_or(evidence).alias("manifest_present"),
        F.count_if(is_py).alias("file_count"),
        (F.count_if(is_py & mentions) * 2).alias("payment_units_estimated"),
    )


def scan_statistics(files: DataFrame, units: DataFrame, hits: DataFrame, model: DataFrame, findings: DataFrame) -> DataFrame:
    """Stage counts per repository, one aggregation over all stages."""
    zero = F.lit(0)

    def part(df: DataFrame, **flags) -> DataFrame:
        names = ("py_files", "js_files", "n_units", "n_static_hits", "n_llm_findings", "n_findings")
        return df.select("repo_id", *[flags.get(n, zero).cast("long").alias(n) for n in names])

    one = F.lit(1)
    suffix = F.regexp_extract("path", r"\.([^./]+)$", 1)
    stages = part(
        files, py_files=suffix.isin(*C.PY_SUFFIXES).cast("int"), js_files=suffix.isin(*C.JS_SUFFIXES).cast("int")
    )
    for df, name in ((units, "n_units"), (hits, "n_static_hits"), (model, "n_llm_findings"), (findings, "n_findings")):
        stages = stages.unionByName(part(df, **{name: one}))
    return stages.groupBy("repo_id").agg(*[F.sum(c).cast("long").alias(c) for c in stages.columns[1:]])


def model_status(calls: DataFrame, enabled: Column) -> DataFrame:
    """OFF, FAILED, DEGRADED or OK per scan from its calls(scan_id, failed, n_findings)."""
    return calls.groupBy("scan_id").agg(
        F.bool_or("failed").alias("any_failed"),
        F.sum("n_findings").cast("long").alias("n_llm_findings"),
        F.bool_or(enabled).alias("enabled"),
    ).select(
        "scan_id",
        "n_llm_findings",
        F.when(~F.col("enabled"), "OFF")
        .when(F.col("any_failed") & (F.col("n_llm_findings") == 0), "FAILED")
        .when(F.col("any_failed"), "DEGRADED")
        .otherwise("OK")
        .alias("llm_status"),
    )


def state_changes(
    log: DataFrame,
    key: str,
    state: str,
    order: Sequence[str],
    bucket: Column,
    terminal: Sequence[str] = (),
) -> DataFrame:
    """Rows whose state differs from the one before, up to and including the first terminal state.

    ``bucket`` cuts the order into spans, so a key with very many rows is not one task's work.
    """
    rows = log
    if terminal:
        ends = log.filter(F.col(state).isin(*terminal)).groupBy(key).agg(F.min(F.struct(*order)).alias("_end"))
        rows = (
            log.join(ends, key, "left")
            .filter(F.col("_end").isNull() | (F.struct(*order) <= F.col("_end")))
            .drop("_end")
        )
    marked = lag_across_buckets(rows, [key], order, bucket, [state])
    return marked.filter(~F.col(state).eqNullSafe(F.col(f"prev_{state}")))
