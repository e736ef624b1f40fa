"""Scores, exposure and decision thresholds as plain arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions.textops import lookup


def heuristic_score(
    static_hit: Column,
    static_conf: Column,
    static_rules: Column,
    model_hit: Column,
    model_conf: Column,
    model_findings: Column,
    model_has_lines: Column,
    weights: dict | None = None,
) -> Column:
    w = {**C.SCORING_WEIGHTS, **(weights or {})}
    extra_rules = F.least(F.greatest(static_rules - 1, F.lit(0)), F.lit(C.MAX_EXTRA_RULES))
    extra_found = F.least(F.greatest(model_findings - 1, F.lit(0)), F.lit(C.MAX_EXTRA_FINDINGS))
    from_rules = F.when(
        static_hit,
        F.lit(w["static_hit"])
        + F.lit(w["static_max_confidence"]) * static_conf
        + F.lit(w["static_n_rules_bonus"]) * extra_rules,
    ).otherwise(0.0)
    from_model = F.when(
        model_hit,
        F.lit(w["llm_hit"])
        + F.lit(w["llm_max_confidence"]) * model_conf
        + F.lit(w["llm_n_findings_bonus"]) * extra_found
        + F.when(model_has_lines, F.lit(w["llm_evidence_lines_bonus"])).otherwise(0.0),
    ).otherwise(0.0)
    agreed = F.when(static_hit & model_hit, F.lit(w["both_agree_bonus"])).otherwise(0.0)
    return F.round(F.least(from_rules + from_model + agreed, F.lit(1.0)), 4)


def class_exposure(defect_class: Column) -> Column:
    return lookup(C.CLASS_EXPOSURE_PAISE, defect_class, C.DEFAULT_EXPOSURE_PAISE).cast("long")


def threshold_for(defect_class: Column) -> Column:
    return lookup(C.DECISION_THRESHOLDS, defect_class, C.DEFAULT_THRESHOLD)


def expected_loss(defect_class: Column, amount: Column) -> Column:
    """Estimated loss over the horizon. An estimate: never mix it with measured money."""
    base = C.EXPOSURE_DEFAULTS
    p = {k: v["p_incident_given_finding"] for k, v in C.EXPOSURE_BY_CLASS.items()}
    trigger = {k: v["trigger_fraction"] for k, v in C.EXPOSURE_BY_CLASS.items()}
    volume = float(base["expected_monthly_transactions"] * base["horizon_months"])
    return (
        lookup(p, defect_class, base["p_incident_given_finding"])
        * F.lit(volume)
        * lookup(trigger, defect_class, 1.0)
        * F.lit(base["loss_fraction"])
        * amount
    )


def severity_rank(severity: Column) -> Column:
    return lookup({s: i for i, s in enumerate(C.SEVERITY_ORDER)}, severity, 9)


def severity_name(rank: Column) -> Column:
    return lookup(dict(enumerate(C.SEVERITY_ORDER)), rank)
