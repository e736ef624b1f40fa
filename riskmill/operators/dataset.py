"""Labelled data sets: group split, frozen manifest, leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions.hashing import content_hash
from riskmill.session import reliable_checkpoint

_PREFIX = 4  # hex digits, so at most 65536 buckets


def dense_rank_by_hash(groups: DataFrame, column: str, seed: str = C.SPLIT_SEED) -> DataFrame:
    """Exact position of each distinct value in hash order, without a one-task sort of all of them.

    Values fall into at most 65536 hash buckets; only the bucket sizes are summed in one task.
    """
    hashed = groups.select(column).distinct().withColumn(
        "_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(column).cast("string")), 256)
    )
    hashed = hashed.withColumn("_bucket", F.conv(F.substring("_h", 1, _PREFIX), 16, 10).cast("int"))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy("_h", column)
    return (
        hashed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .select(column, (F.col("_offset") + F.col("_rn") - 1).alias("position"))
    )


def merge_groups_by_content(samples: DataFrame, group: str, content: str = "content_hash") -> DataFrame:
    """Map each group to the smallest group it is linked to through equal content.

    Connected components by minimum label over the bipartite graph group - content. Every round
    also follows the label of the label, so chains shrink quickly; each round is checkpointed. A
    content shared by very many groups is only ever aggregated to its minimum.
    """
    edges = reliable_checkpoint(samples.select(group, content).distinct())
    labels = edges.groupBy(group).agg(F.min(group).alias("root"))
    labels = reliable_checkpoint(labels)
    while True:
        by_content = (
            edges.join(labels, group).groupBy(content).agg(F.min("root").alias("root"))
        )
        nearest = edges.join(by_content, content).groupBy(group).agg(F.min("root").alias("near"))
        jumped = labels.select(F.col(group).alias("near"), F.col("root").alias("far"))
        moved = nearest.join(jumped, "near", "left").select(
            group, F.least("near", F.coalesce("far", "near")).alias("root")
        )
        moved = reliable_checkpoint(moved)
        stable = moved.join(labels.withColumnRenamed("root", "old"), group).filter("root <> old").isEmpty()
        labels = moved
        if stable:
            return labels


def group_split(
    samples: DataFrame,
    group: str = "repo_id",
    sample: str = "sample_id",
    seed: str = C.SPLIT_SEED,
    fractions: Sequence[float] = (C.TRAIN_FRACTION, C.VAL_FRACTION),
    pinned_prefix: str | None = C.PINNED_PREFIX,
    merge_identical: bool = False,
    content: str = "content_hash",
) -> DataFrame:
    """Assign whole groups to train, val or test; pinned samples always train.

    The order is that of a keyed hash, so any engine gets the same split from the same seed.
    """
    unit = group
    if merge_identical:
        roots = merge_groups_by_content(samples, group, content).withColumnRenamed("root", "_unit")
        samples = samples.join(roots, group)
        unit = "_unit"
    pinned = F.col(sample).startswith(pinned_prefix) if pinned_prefix else F.lit(False)
    pinned = F.coalesce(pinned, F.lit(False))
    ranked = dense_rank_by_hash(samples.filter(~pinned), unit, seed)
    total = ranked.agg(F.count(F.lit(1))).scalar()
    n_train = F.floor(total * F.lit(float(fractions[0])))
    n_val = F.floor(total * F.lit(float(fractions[1])))
    split = (
        F.when(F.col("position") < n_train, F.lit("train"))
        .when(F.col("position") < n_train + n_val, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    placed = ranked.select(unit, split.alias("_split"))
    return (
        samples.join(placed, unit, "left")
        .withColumn("split", F.when(pinned, F.lit("train")).otherwise(F.col("_split")))
        .drop("_split", "_unit")
    )


def split_statistics(split_samples: DataFrame, safe: Column) -> DataFrame:
    """Counts per split and, as the row ``all``, in total."""
    return (
        split_samples.rollup("split")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(safe).alias("safe"), F.count_if(~safe).alias("vulnerable"))
        .withColumn("split", F.coalesce("split", F.lit("all")))
    )


def with_content_hash(samples: DataFrame, content: str = "content", sample: str = "sample_id") -> DataFrame:
    return samples.withColumn("content_hash", content_hash(F.col(content), F.col(sample).cast("string")))


def test_manifest(split_samples: DataFrame) -> DataFrame:
    """Rows to freeze for the test split."""
    return split_samples.filter(F.col("split") == "test").select(
        "sample_id", "repo_id", "content_hash", "labels"
    )


test_manifest.__test__ = False  # a data set function, not a test


def manifest_diff(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """Status per sample: ADDED, REMOVED, CHANGED or OK."""
    now = current.select("sample_id", F.col("content_hash").alias("current_hash"))
    then = frozen.select("sample_id", F.col("content_hash").alias("frozen_hash"))
    status = (
        F.when(F.col("frozen_hash").isNull(), "ADDED")
        .when(F.col("current_hash").isNull(), "REMOVED")
        .when(F.col("current_hash") != F.col("frozen_hash"), "CHANGED")
        .otherwise("OK")
    )
    return now.join(then, "sample_id", "full_outer").withColumn("status", status)


def manifest_report(diff: DataFrame) -> DataFrame:
    """One row: is the test split unchanged, and if not, how many samples differ in which way."""
    counts = diff.agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("ADDED", "REMOVED", "CHANGED", "OK")]
    )
    same_ids = (F.col("added") == 0) & (F.col("removed") == 0)
    return counts.withColumns(
        {
            "valid": same_ids & (F.col("changed") == 0),
            "reason": F.when(~same_ids, "SET_CHANGED").when(F.col("changed") > 0, "CONTENT_CHANGED"),
        }
    )


def content_leakage(split_samples: DataFrame) -> DataFrame:
    """Contents that occur in more than one split."""
    return (
        split_samples.groupBy("content_hash")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.sort_array(F.collect_set("split")).alias("splits"),
        )
        .filter(F.size("splits") > 1)
    )


def leaked_ids(indexed: DataFrame, held_out: DataFrame) -> DataFrame:
    """Held-out samples that the index contains; must be empty."""
    return held_out.select("sample_id").distinct().join(indexed.select("sample_id"), "sample_id", "left_semi")


def id_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that appeared or disappeared."""
    old, new = before.select("sample_id"), after.select("sample_id")
    added = new.exceptAll(old).withColumn("change", F.lit("ADDED"))
    return added.unionByName(old.exceptAll(new).withColumn("change", F.lit("REMOVED")))
