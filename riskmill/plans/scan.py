"""The repository scan as one job: files, units, rule hits, merged and scored findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from riskmill.operators import fusion
from riskmill.operators.rules import BUILT_IN_RULES, Rule, apply_rules
from riskmill.operators.units import extract_code_units
from riskmill.schemas import MODEL_FINDINGS
from riskmill.sources.corpus import keep_source_files


def scan_corpus(
    files: DataFrame,
    model_findings: DataFrame | None = None,
    rules: Sequence[Rule] = BUILT_IN_RULES,
    weights: dict | None = None,
    evidence_cap: int | None = None,
) -> dict[str, DataFrame]:
    """All stages of a scan over files(repo_id, path, content).

    The findings are one pass over the files, with all their evidence unless ``evidence_cap`` is set.
    Stages are lazy, so write the units once when several stages are wanted, as the parser otherwise
    runs once per stage.
    """
    kept = keep_source_files(files)
    units = extract_code_units(kept)
    hits = apply_rules(units, rules)
    spans = units
    if model_findings is None:
        # Without model findings every finding has a hit, which carries the span of its file.
        model_findings, spans = files.sparkSession.createDataFrame([], MODEL_FINDINGS), None
    findings = fusion.score_findings(fusion.merge_findings(hits, model_findings, spans, evidence_cap=evidence_cap), weights)
    return {"files": kept, "units": units, "hits": hits, "model": model_findings, "findings": findings}
