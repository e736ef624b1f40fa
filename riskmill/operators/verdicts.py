"""Verdicts from evidence, and the gate that keeps measured money on verified findings only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill import config as C


def duplicate_effects(effects: DataFrame, key: str = "event_id", minimum: int = 2) -> DataFrame:
    """Events whose side effect happened more than once."""
    return (
        effects.groupBy(key).agg(F.sum("effects").cast("long").alias("effects")).filter(F.col("effects") >= minimum)
    )


def _delta() -> Column:
    return F.col("count_after") - F.col("count_before")


def _attach(df: DataFrame, status: Column, error: Column, amount: Column) -> DataFrame:
    verified = status == "VERIFIED"
    return df.withColumns(
        {"status": status, "error_code": error, "measured_impact_paise": F.when(verified, amount).cast("long")}
    )


def verdict_duplicate(evidence: DataFrame) -> DataFrame:
    """Same event delivered twice: two effects verify the defect, one refutes it.

    evidence(count_before, count_after, probe_available, order_amount_paise).
    """
    delta = _delta()
    unseen = ~F.col("probe_available") | delta.isNull()
    status = (
        F.when(unseen, "INCONCLUSIVE")
        .when(delta >= 2, "VERIFIED")
        .when(delta == 1, "NOT_REPRODUCED")
        .otherwise("INCONCLUSIVE")
    )
    error = F.when(unseen, "PROBE_UNAVAILABLE").when(delta < 1, "NO_STATE_CHANGE")
    return _attach(evidence, status, error, F.col("order_amount_paise"))


def verdict_forged(evidence: DataFrame, client_errors_only: bool = False) -> DataFrame:
    """A forged event: accepted with an effect verifies the defect, refused or no effect refutes it.

    ``client_errors_only`` is the older form, where only a 4xx answer refutes it and the missing
    effect does not.
    """
    delta, http = _delta(), F.coalesce(F.col("target_http_status"), F.lit(0))
    accepted = http.between(200, 299) & (delta >= 1)
    if client_errors_only:
        refused, unseen = http.between(400, 499), F.lit(False)
    else:
        refused, unseen = (http >= 400) | (delta == 0), ~F.col("probe_available") | delta.isNull()
    status = (
        F.when(unseen, "INCONCLUSIVE")
        .when(F.coalesce(accepted, F.lit(False)), "VERIFIED")
        .when(F.coalesce(refused, F.lit(False)), "NOT_REPRODUCED")
        .otherwise("INCONCLUSIVE")
    )
    error = F.when(unseen, "PROBE_UNAVAILABLE").when(status == "INCONCLUSIVE", "AMBIGUOUS_RESPONSE")
    amount = F.lit(None) if client_errors_only else F.col("order_amount_paise")
    return _attach(evidence, status, error, amount)


def verdict_denomination(evidence: DataFrame) -> DataFrame:
    """Order created for another amount than intended: the difference is the measured impact.

    evidence(order_amount_paise, actual_amount) with ``actual_amount`` as text.
    """
    expected = F.expr("order_amount_paise DIV 100") * 100
    raw = F.col("actual_amount").cast("string")
    actual = F.when(raw.rlike(r"^-?\d+$"), raw.try_cast("long"))
    status = (
        F.when(actual.isNull(), "INCONCLUSIVE").when(actual != expected, "VERIFIED").otherwise("NOT_REPRODUCED")
    )
    error = F.when(actual.isNull(), "NO_AMOUNT")
    return _attach(evidence, status, error, F.abs(expected - actual))


def retry_outcomes(attempts: DataFrame, max_attempts: int = C.MAX_ATTEMPTS) -> DataFrame:
    """Result of each call from its attempts(call_id, attempt, http_status, transport_error).

    5xx and transport errors may be tried again up to the budget; any other answer is final. Answers
    beyond the budget do not count, but every call is reported: with no attempt inside the budget
    it is an error after 0 attempts.
    """
    failed = F.col("transport_error") | (F.col("http_status") >= 500)
    inside = F.col("attempt") <= max_attempts
    answered = attempts.groupBy("call_id").agg(
        F.min_by("http_status", F.when(inside & ~failed, F.col("attempt"))).alias("http_status"),
        F.min(F.when(inside & ~failed, F.col("attempt"))).alias("answered_at"),
        F.coalesce(F.max(F.when(inside, F.col("attempt"))), F.lit(0)).alias("tried"),
    )
    return answered.select(
        "call_id",
        "http_status",
        F.coalesce("answered_at", "tried").cast("long").alias("attempts"),
        F.when(F.col("answered_at").isNotNull(), "ANSWERED").otherwise("ERROR").alias("status"),
        F.when(F.col("answered_at").isNull(), "GATEWAY_UNAVAILABLE").alias("error_code"),
    )


def scrub_outcomes(outcomes: DataFrame) -> DataFrame:
    """A measured amount survives on VERIFIED outcomes only, whatever the scenario attached."""
    return outcomes.withColumn(
        "measured_impact_paise", F.when(F.col("status") == "VERIFIED", F.col("measured_impact_paise"))
    )


def gate_measured(findings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Carry outcomes to findings: VERIFIED promotes state and amount, NOT_REPRODUCED demotes.

    outcomes(finding_id, finished_seq, status, measured_impact_paise); outcomes apply in the order
    of ``finished_seq``. Money comes from the last VERIFIED outcome, state from the last outcome
    that decides.
    """
    decisive = F.col("status").isin("VERIFIED", "NOT_REPRODUCED")
    verified = F.col("status") == "VERIFIED"
    latest = scrub_outcomes(outcomes).groupBy("finding_id").agg(
        F.max_by("status", F.when(decisive, F.struct("finished_seq", "status"))).alias("_status"),
        F.max_by("measured_impact_paise", F.when(verified, F.struct("finished_seq", "measured_impact_paise"))).alias("_measured"),
        F.bool_or(verified).alias("_proved"),
    )
    state = (
        F.when(F.col("_status") == "VERIFIED", "VERIFIED")
        .when(F.col("_status") == "NOT_REPRODUCED", "UNVERIFIED")
        .otherwise(F.col("state"))
    )
    kept = [c for c in findings.columns if c not in ("state", "exposure_measured_paise")]
    return findings.join(latest, "finding_id", "left").select(
        *kept,
        state.alias("state"),
        F.when(F.col("_proved"), F.col("_measured"))
        .otherwise(F.col("exposure_measured_paise"))
        .alias("exposure_measured_paise"),
    )


def smuggled_amounts(outcomes: DataFrame) -> DataFrame:
    """Outcomes that carry money without a VERIFIED verdict; must be empty after scrubbing."""
    return outcomes.filter((F.col("status") != "VERIFIED") & F.col("measured_impact_paise").isNotNull())
