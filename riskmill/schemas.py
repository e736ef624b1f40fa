"""Schemas of the tables the engine reads and writes, and checks of their value domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill import config as C

HITS = (
    "repo_id string, file string, unit_pos int, rule_pos int, rule_id string, defect_class string, "
    "severity string, confidence double, evidence_lines array<string>, explanation string, "
    "scenario_ids array<string>"
)
MODEL_FINDINGS = (
    "repo_id string, file string, call_pos int, finding_pos int, defect_class string, "
    "confidence double, explanation string, evidence_lines array<int>, scenario_ids array<string>"
)
SAMPLES_JSON = (
    "sample_id string, repo_id string, language string, framework string, source string, "
    "labels array<struct<defect_class:string,lines:array<array<int>>,scenario_ids:array<string>>>, "
    "hard_negative boolean, difficulty int, runnable boolean, manifest_path string, notes string, "
    "license string, static_detectable boolean, generator_model string, "
    "generation_prompt_id string, seed int, file string, _bad string"
)
CHUNKS = (
    "id string, text string, defect_class string, kind string, tier string, source string, "
    "sample_id string, hard_negative boolean, title string"
)
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)

DOMAINS = {
    "defect_class": [*C.EVAL_CLASSES, C.SUSPICIOUS_CONTENT],
    "severity": C.SEVERITY_ORDER,
    "detector_source": ["STATIC", "LLM", "BOTH"],
    "state": C.FINDING_STATES,
    "kind": C.UNIT_KINDS,
}


def domain_violations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose enumerated columns hold a value outside their domain."""
    bad: Column = F.lit(False)
    for column in columns or [c for c in df.columns if c in DOMAINS]:
        bad = bad | ~F.coalesce(F.col(column).isin(*DOMAINS[column]), F.lit(False))
    return df.filter(bad)
