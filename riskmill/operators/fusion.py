"""Merge rule hits and model findings into one scored finding per key.

Nothing collects a whole group: scalar picks are partial aggregates (``max_by`` with an explicit
position as tie break), and evidence is de-duplicated by a pre-aggregated ``groupBy`` and cut to its
cap by a ranked window that Spark limits before the shuffle. A file with very many hits therefore
costs each task at most its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions import scoring as S
from riskmill.functions.textops import lookup

KEYS = ("repo_id", "file", "defect_class")
_STATIC, _MODEL = 0, 1


def _strings(column: str) -> Column:
    """A list as strings; a missing list is an empty one."""
    return F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>"))


def tag_detections(hits: DataFrame, model_findings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both detectors in one shape; the position columns carry the order of the source lists."""
    none = F.lit(None).cast("int")
    spans = ("file_start_line", "file_end_line")
    static = hits.select(
        *keys,
        F.lit(_STATIC).alias("src"),
        F.col("unit_pos").cast("long").alias("a"),
        F.col("rule_pos").cast("long").alias("b"),
        F.col("confidence").cast("double").alias("confidence"),
        "explanation",
        _strings("evidence_lines").alias("evidence"),
        _strings("scenario_ids").alias("scenario_ids"),
        "rule_id",
        S.severity_rank(F.col("severity")).alias("rank"),
        none.alias("line_low"),
        none.alias("line_high"),
        *[(F.col(c) if c in hits.columns else none).alias(c) for c in spans],
    )
    positive = F.filter("evidence_lines", lambda n: n > 0)
    model = model_findings.select(
        *keys,
        F.lit(_MODEL).alias("src"),
        F.col("call_pos").cast("long").alias("a"),
        F.col("finding_pos").cast("long").alias("b"),
        F.col("confidence").cast("double").alias("confidence"),
        "explanation",
        _strings("evidence_lines").alias("evidence"),
        _strings("scenario_ids").alias("scenario_ids"),
        F.lit(None).cast("string").alias("rule_id"),
        none.alias("rank"),
        F.array_min(positive).cast("int").alias("line_low"),
        F.array_max(positive).cast("int").alias("line_high"),
        *[none.alias(c) for c in spans],
    )
    return static.unionByName(model)


def _features(static: Column, model: Column) -> list[Column]:
    return [
        F.bool_or(static).alias("static_hit"),
        F.coalesce(F.max(F.when(static, F.col("confidence"))), F.lit(0.0)).alias("static_max_confidence"),
        F.sort_array(F.collect_set("rule_id")).alias("rule_ids"),
        F.bool_or(model).alias("llm_hit"),
        F.coalesce(F.max(F.when(model, F.col("confidence"))), F.lit(0.0)).alias("llm_max_confidence"),
        F.count_if(model).alias("llm_n_findings"),
        F.bool_or(model & F.col("has_lines")).alias("llm_has_evidence_lines"),
    ]


def _with_derived(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {"static_n_rules": F.size("rule_ids"), "both_agree": F.col("static_hit") & F.col("llm_hit")}
    )


def feature_vectors(tagged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row of detector signals per key."""
    static, model = F.col("src") == _STATIC, F.col("src") == _MODEL
    rows = tagged.withColumn("has_lines", F.size("evidence") > 0)
    return _with_derived(rows.groupBy(*keys).agg(*_features(static, model)))


def score_features(features: DataFrame, weights: dict | None = None) -> DataFrame:
    """Attach the heuristic score, its evidence strings and the exposure label."""
    return features.withColumns(
        {
            "score": S.heuristic_score(
                F.col("static_hit"),
                F.col("static_max_confidence"),
                F.col("static_n_rules"),
                F.col("llm_hit"),
                F.col("llm_max_confidence"),
                F.col("llm_n_findings"),
                F.col("llm_has_evidence_lines"),
                weights,
            ),
            "risk_evidence": F.array_compact(
                F.array(
                    F.when(
                        F.col("static_hit"),
                        F.format_string("static:%s:n_rules=%d", "defect_class", "static_n_rules"),
                    ),
                    F.when(
                        F.col("llm_hit"),
                        F.format_string("llm:%s:n_findings=%d", "defect_class", "llm_n_findings"),
                    ),
                )
            ),
            "exposure_kind": F.lit("ESTIMATED"),
            "scorer_version": F.lit(C.SCORER_VERSION),
            "calibrated": F.lit(False),
        }
    )


def risk_records(features: DataFrame, weights: dict | None = None) -> DataFrame:
    """Risk per (sample, class); classes without any signal are dropped."""
    return score_features(features.filter("static_hit OR llm_hit"), weights).withColumn(
        "risk_confidence", F.greatest("static_max_confidence", "llm_max_confidence")
    )


def highest_risk(records: DataFrame, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """The defect with the highest score per sample; ties go to the earlier class."""
    order = lookup({c: i for i, c in enumerate([*C.EVAL_CLASSES, C.SUSPICIOUS_CONTENT])}, F.col("defect_class"), 99)
    return records.groupBy(*sample).agg(
        F.max_by("defect_class", F.struct(F.col("score"), -order)).alias("defect_class"),
        F.max("score").alias("score"),
    )


def last_unit_spans(units: DataFrame) -> DataFrame:
    """Line span of the last unit of each file."""
    span = F.max_by(F.struct("start_line", "end_line"), "unit_pos")
    return units.groupBy("repo_id", "file").agg(span.alias("span"))


def _signals(keys: Sequence[str]) -> list[Column]:
    """Aggregates that pick one value per key; all combine before the shuffle."""
    static, model = F.col("src") == _STATIC, F.col("src") == _MODEL
    best = F.struct(F.col("confidence"), -F.col("a"), -F.col("b"))
    return [
        F.min("rank").alias("best_rank"),
        F.max_by("explanation", F.when(static, best)).alias("static_explanation"),
        F.max_by("explanation", F.when(model, best)).alias("model_explanation"),
        F.min_by("explanation", F.when(model, F.struct("a", "b"))).alias("model_first"),
        F.min("line_low").alias("line_low"),
        F.max("line_high").alias("line_high"),
        F.max("file_start_line").alias("file_start_line"),
        F.max("file_end_line").alias("file_end_line"),
    ]


def _ordered_lists() -> list[Column]:
    def in_order(kind: str, name: str) -> Column:
        items = F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "value")))
        return F.transform(F.sort_array(items), lambda x: x.value).alias(name)

    return [in_order("evidence", "evidence"), in_order("scenario", "scenario_ids")]


def merge_findings(
    hits: DataFrame,
    model_findings: DataFrame,
    units: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    evidence_cap: int | None = None,
) -> DataFrame:
    """One finding per key from both detectors, with features attached for scoring.

    Both inputs are read once. Every detection becomes one row for its scalar signals and one per
    evidence line and scenario id; a first aggregation folds equal values, with ``evidence_cap`` a
    ranked window cuts evidence (default: all is kept), a second aggregation puts each key together. Line spans come with the
    hits; ``units`` is needed only for files that have model findings and no hits.
    """
    tagged = tag_detections(hits, model_findings, keys)
    items = F.concat(
        F.array(F.struct(F.lit("signal").alias("kind"), F.lit("").alias("value"), F.lit(0).alias("i"))),
        F.transform("evidence", lambda v, i: F.struct(F.lit("evidence").alias("kind"), v.alias("value"), i.alias("i"))),
        F.transform("scenario_ids", lambda v, i: F.struct(F.lit("scenario").alias("kind"), v.alias("value"), i.alias("i"))),
    )
    rows = tagged.select(
        *[c for c in tagged.columns if c not in ("evidence", "scenario_ids")],
        (F.size("evidence") > 0).alias("has_lines"),
        F.explode(items).alias("item"),
    ).select("*", "item.*").drop("item")

    # Folding equal values of one key: the signals of a repeated line are not needed, so they are
    # taken from the one signal row of each detection.
    is_signal = F.col("kind") == "signal"
    signal_only = [c for c in rows.columns if c not in (*keys, "kind", "value", "i", "a", "b", "src")]
    rows = rows.withColumns({c: F.when(is_signal, F.col(c)) for c in signal_only})
    static, model = F.col("src") == _STATIC, F.col("src") == _MODEL
    folded = rows.groupBy(*keys, "kind", "value").agg(
        F.min(F.struct("src", "a", "b", "i")).alias("pos"),
        *_features(static & is_signal, model & is_signal),
        *_signals(keys),
    )
    # Only evidence is capped: any other value is alone in its window partition.
    lane = F.when(F.col("kind") != "evidence", F.col("value"))
    order = Window.partitionBy(*keys, "kind", lane).orderBy("pos")
    first = folded
    if evidence_cap is not None:
        first = folded.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= evidence_cap).drop("rn")
    carried = [c for c in folded.columns if c not in (*keys, "kind", "value", "pos")]
    merged = first.groupBy(*keys).agg(
        *_ordered_lists(),
        *[F.max_by(c, F.when(is_signal, F.lit(1))).alias(c) for c in carried],
    )
    merged = _with_derived(merged)

    start, end = F.col("file_start_line"), F.col("file_end_line")
    if units is not None:
        merged = merged.join(last_unit_spans(units), ["repo_id", "file"], "left")
        start, end = F.coalesce(start, "span.start_line"), F.coalesce(end, "span.end_line")
    start, end = F.coalesce(start, F.lit(1)), F.coalesce(end, F.lit(1))
    own_lines = ~F.col("static_hit") & F.col("line_low").isNotNull()

    static_wins = F.col("static_hit") & (
        F.col("static_max_confidence") >= F.col("llm_max_confidence")
    )
    no_strings = F.array().cast("array<string>")
    default_scenario = lookup(C.CLASS_DEFAULT_SCENARIO, F.col("defect_class"))
    scenario_ids = F.coalesce("scenario_ids", no_strings)
    return merged.select(
        *keys,
        F.when(F.col("both_agree"), "BOTH").when(F.col("static_hit"), "STATIC").otherwise("LLM").alias("detector_source"),
        F.round(F.greatest("static_max_confidence", "llm_max_confidence"), 4).alias("confidence"),
        F.coalesce(
            S.severity_name(F.col("best_rank")),
            lookup(C.CLASS_SEVERITY, F.col("defect_class"), C.DEFAULT_SEVERITY),
        ).alias("severity"),
        F.coalesce("evidence", no_strings).alias("evidence_lines"),
        "rule_ids",
        F.when((F.size(scenario_ids) == 0) & default_scenario.isNotNull(), F.array(default_scenario))
        .otherwise(scenario_ids)
        .alias("scenario_ids"),
        F.when(static_wins, F.col("static_explanation")).otherwise(F.col("model_explanation")).alias("explanation"),
        F.when(static_wins, F.col("model_first")).otherwise(F.col("model_explanation")).alias("llm_reasoning"),
        F.when(own_lines, F.col("line_low")).otherwise(start).alias("start_line"),
        F.when(own_lines, F.col("line_high")).otherwise(end).alias("end_line"),
        F.lit("ADVISORY").alias("state"),
        S.class_exposure(F.col("defect_class")).alias("exposure_estimated_paise"),
        F.lit(None).cast("long").alias("exposure_measured_paise"),
        "static_hit",
        "static_max_confidence",
        "static_n_rules",
        "llm_hit",
        "llm_max_confidence",
        "llm_n_findings",
        "llm_has_evidence_lines",
        "both_agree",
    )


def score_findings(findings: DataFrame, weights: dict | None = None) -> DataFrame:
    return score_features(findings, weights)


def route_by_threshold(findings: DataFrame) -> DataFrame:
    """Optional routing of advisory findings by confidence; off unless called."""
    return findings.withColumn(
        "state",
        F.when(
            (F.col("state") == "ADVISORY") & (F.col("confidence") >= C.VERIFY_THRESHOLD),
            F.lit("QUEUED_FOR_VERIFICATION"),
        )
        .when(
            (F.col("state") == "ADVISORY") & (F.col("confidence") < C.ADVISORY_THRESHOLD),
            F.lit("EXCEPTION"),
        )
        .otherwise(F.col("state")),
    )
