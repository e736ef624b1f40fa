"""Detector evaluation: confusion counts, precision/recall/F1, macro averages, comparison.

Absent pairs count as negative, so the sample x class grid is never built: TP and FP come from the
predictions, and FN and TN follow from the number of positives per class and of samples. The work is
proportional to predictions, not to samples x classes x systems x thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions.textops import lookup

ZERO = "zero-division-0/active-classes"
ONE = "zero-division-1/all-classes"


def above_threshold(detections: DataFrame, tau: float) -> DataFrame:
    return detections.filter(F.col("confidence") >= tau)


def class_predictions(detections: DataFrame, classes: Sequence[str] = tuple(C.EVAL_CLASSES)) -> DataFrame:
    """Highest confidence per (system, sample, class): a threshold can be applied to it later."""
    return (
        detections.filter(F.col("defect_class").isin(*classes))
        .groupBy("system", "sample_id", "defect_class")
        .agg(F.max("confidence").alias("confidence"))
    )


def _also_as(predictions: DataFrame, condition: Column, name: str) -> DataFrame:
    """Repeat the rows that meet a condition under another system name, in one pass."""
    names = F.when(condition, F.array(F.col("system"), F.lit(name))).otherwise(F.array(F.col("system")))
    return predictions.withColumn("system", F.explode(names))


def union_systems(predictions: DataFrame, parts: Sequence[str], name: str) -> DataFrame:
    """Add a system that predicts whatever any of its parts predicts.

    A pair predicted by several parts appears once per part; ``class_predictions`` folds them.
    """
    return _also_as(predictions, F.col("system").isin(*parts), name)


def verified_system(predictions: DataFrame, base: str, verified: DataFrame, name: str) -> DataFrame:
    """Add a system that keeps predictions of ``base`` only where they were verified."""
    proved = verified.select("sample_id", "defect_class").distinct().withColumn("_proved", F.lit(True))
    marked = predictions.join(proved, ["sample_id", "defect_class"], "left")
    keep = (F.col("system") == base) & F.coalesce("_proved", F.lit(False))
    return _also_as(marked, keep, name).select(*predictions.columns)


def _ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(empty))


def with_prf(counts: DataFrame, convention: str = ZERO) -> DataFrame:
    empty = 0.0 if convention == ZERO else 1.0
    scored = counts.withColumns(
        {
            "p": _ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty),
            "r": _ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty),
        }
    )
    return scored.withColumn("f", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"), 0.0))


def _grid(spark, systems: Sequence[str], classes: Sequence[str], taus: Sequence[float]) -> DataFrame:
    """Every reported cell; its size is set by the arguments, never by the data."""
    rows = [(s, c, float(t)) for s in systems for c in classes for t in taus]
    return spark.createDataFrame(rows, "system string, defect_class string, tau double")


def confusion(
    predictions: DataFrame,
    truth: DataFrame,
    samples: DataFrame,
    systems: Sequence[str],
    taus: Sequence[float] = (C.DEFAULT_THRESHOLD,),
    classes: Sequence[str] = tuple(C.EVAL_CLASSES),
) -> DataFrame:
    """TP, FP, FN, TN per (system, class, threshold).

    predictions(system, sample_id, defect_class, confidence), truth(sample_id, defect_class),
    samples(sample_id) with one row per sample.
    """
    grid = F.broadcast(_grid(predictions.sparkSession, systems, classes, taus))
    scope = samples.select("sample_id")
    actual = (
        truth.filter(F.col("defect_class").isin(*classes))
        .select("sample_id", "defect_class")
        .distinct()
        .join(scope, "sample_id", "left_semi")
    )
    positives = actual.groupBy("defect_class").agg(F.count(F.lit(1)).alias("positives"))
    n_samples = scope.agg(F.count(F.lit(1))).scalar()

    predicted = (
        class_predictions(predictions.filter(F.col("system").isin(*systems)), classes)
        .join(scope, "sample_id", "left_semi")
        .join(actual.withColumn("is_true", F.lit(True)), ["sample_id", "defect_class"], "left")
    )
    levels = F.array(*[F.lit(float(t)) for t in taus])
    counted = (
        predicted.select(
            "system",
            "defect_class",
            F.coalesce("is_true", F.lit(False)).alias("is_true"),
            F.explode(F.filter(levels, lambda t: t <= F.col("confidence"))).alias("tau"),
        )
        .groupBy("system", "defect_class", "tau")
        .agg(F.count_if("is_true").alias("tp"), F.count_if(~F.col("is_true")).alias("fp"))
    )
    zero = F.lit(0).cast("long")
    cells = (
        grid.join(counted, ["system", "defect_class", "tau"], "left")
        .join(positives, "defect_class", "left")
        .select(
            "system",
            "defect_class",
            "tau",
            F.coalesce("tp", zero).alias("tp"),
            F.coalesce("fp", zero).alias("fp"),
            F.coalesce("positives", zero).alias("positives"),
        )
    )
    return cells.select(
        "system",
        "defect_class",
        "tau",
        "tp",
        "fp",
        (F.col("positives") - F.col("tp")).alias("fn"),
        (n_samples - F.col("positives") - F.col("fp")).alias("tn"),
    )


def class_metrics(counts: DataFrame, convention: str = ZERO) -> DataFrame:
    return with_prf(counts, convention).select(
        "system",
        "defect_class",
        "tau",
        "tp",
        "fp",
        "fn",
        "tn",
        F.round("p", 4).alias("precision"),
        F.round("r", 4).alias("recall"),
        F.round("f", 4).alias("f1"),
    )


def macro_metrics(counts: DataFrame, convention: str = ZERO) -> DataFrame:
    """Macro averages per (system, threshold).

    ``ZERO`` averages the classes that have positives (all of them when none has) and takes the
    harmonic mean of macro precision and recall; ``ONE`` averages all classes and their F1.
    """
    scored = with_prf(counts, convention)
    total_fp = F.sum("fp").alias("total_fp")
    if convention == ONE:
        return scored.groupBy("system", "tau").agg(
            F.round(F.avg("p"), 4).alias("precision"),
            F.round(F.avg("r"), 4).alias("recall"),
            F.round(F.avg("f"), 4).alias("f1"),
            total_fp,
        )
    active = (F.col("tp") + F.col("fn")) > 0
    macro = scored.groupBy("system", "tau").agg(
        F.coalesce(F.avg(F.when(active, F.col("p"))), F.avg("p")).alias("mp"),
        F.coalesce(F.avg(F.when(active, F.col("r"))), F.avg("r")).alias("mr"),
        total_fp,
    )
    return macro.select(
        "system",
        "tau",
        F.round("mp", 4).alias("precision"),
        F.round("mr", 4).alias("recall"),
        F.round(_ratio(2 * F.col("mp") * F.col("mr"), F.col("mp") + F.col("mr"), 0.0), 4).alias("f1"),
        "total_fp",
    )


def evaluate(
    predictions: DataFrame,
    truth: DataFrame,
    samples: DataFrame,
    systems: Sequence[str],
    taus: Sequence[float] = (C.DEFAULT_THRESHOLD,),
    convention: str = ZERO,
    unavailable: Sequence[str] = (),
) -> DataFrame:
    """Metrics per (system, class, threshold); a system that could not run is reported as N/A."""
    counts = confusion(predictions, truth, samples, systems, taus)
    missing = F.col("system").isin(*unavailable) if unavailable else F.lit(False)
    metrics = class_metrics(counts, convention)
    blanked = {
        c: F.when(~missing, F.col(c))
        for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1")
    }
    return metrics.withColumns(blanked).withColumns(
        {
            "llm_status": F.when(missing, F.lit("UNAVAILABLE")).otherwise(F.lit("OK")),
            "convention": F.lit(convention),
        }
    )


def compare_systems(
    macro: DataFrame, before: str, after: str, fp_cost: float = C.FALSE_POSITIVE_COST
) -> DataFrame:
    """Two systems side by side in one row per threshold."""

    def pick(system: str, column: str) -> Column:
        return F.max(F.when(F.col("system") == system, F.col(column)))

    out = []
    for column, name in (("precision", "precision"), ("recall", "recall"), ("f1", "f1"), ("total_fp", "fp")):
        out += [pick(before, column).alias(f"{name}_before"), pick(after, column).alias(f"{name}_after")]
    return (
        macro.groupBy("tau")
        .agg(*out)
        .withColumns(
            {
                "fp_cost_before": F.col("fp_before") * F.lit(fp_cost),
                "fp_cost_after": F.col("fp_after") * F.lit(fp_cost),
                "fp_cost_weight": F.lit(fp_cost),
            }
        )
    )


def error_costs(counts: DataFrame) -> DataFrame:
    """Estimated money lost to wrong answers: review time for FP, expected loss for FN."""
    per_fp = C.REVIEW_MINUTES_PER_FP / 60.0 * C.HOURLY_COST_USD
    return counts.groupBy("system", "tau").agg(
        F.round(F.sum("fp") * F.lit(per_fp), 2).alias("fp_review_usd"),
        F.sum(F.col("fn") * lookup(C.FN_LOSS_INR, F.col("defect_class"), 0)).cast("long").alias("fn_loss_inr"),
        F.lit("ESTIMATED").alias("kind"),
    )


def restrict_truth(truth: DataFrame, samples: DataFrame, static_detectable: bool) -> DataFrame:
    """Positives that static rules can, or cannot, see."""
    wanted = samples.filter(F.col("static_detectable") == static_detectable)
    return truth.join(wanted.select("sample_id"), "sample_id", "left_semi")


def latest_reports(reports: DataFrame) -> DataFrame:
    """Newest report per exact system name."""
    others = [c for c in reports.columns if c != "system"]
    newest = F.max_by(F.struct(*others), F.struct("generated_at", *[c for c in others if c != "generated_at"]))
    return reports.groupBy("system").agg(newest.alias("_r")).select("system", "_r.*")


def first_samples(samples: DataFrame, n: int) -> DataFrame:
    """The ``max_samples`` option of an evaluation run."""
    return samples.orderBy("sample_id").limit(n)
