"""Order-dependent columns without sending one hot key to one task.

A window partitioned only by a key puts all rows of that key into one task. Here rows are first cut
into buckets along the order (a span of time or of sequence numbers), windows run inside
(key, bucket), and what crosses a bucket border is carried by a small table with one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_across_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Sequence[str],
) -> DataFrame:
    """Add ``prev_<value>`` from the preceding row of the same key; null on the first row.

    ``bucket`` must not decrease along ``order``.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    packed = F.struct(*values)
    rows = rows.withColumn("_prev", F.lag(packed).over(inside))

    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    carries = ends.select(*keys, "_bucket", F.lag("_last").over(along).alias("_carry"))

    joined = rows.join(carries, [*keys, "_bucket"])
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    return joined.select(*df.columns, *[prev[v].alias(f"prev_{v}") for v in values])


def trailing_window(
    df: DataFrame,
    keys: Sequence[str],
    time_us: str,
    span_us: int,
    aggregates: dict[str, Column],
    chunk_us: int,
) -> DataFrame:
    """Aggregates over the half-open window ``(t - span, t]`` per key.

    Time is cut into chunks of ``chunk_us`` (at least ``span_us``). Rows of the last ``span_us`` of
    a chunk are also handed to the next chunk as context, so each window is complete in its chunk.
    """
    if chunk_us < span_us:
        raise ValueError("a chunk must be at least as long as the window")
    t = F.col(time_us)
    # Integer division keeps microseconds exact.
    chunk = F.expr(f"CAST({time_us} DIV {chunk_us} AS BIGINT)")
    near_end = F.pmod(t, F.lit(chunk_us)) >= F.lit(chunk_us - span_us)
    copies = F.when(
        near_end,
        F.array(
            F.struct(chunk.alias("chunk"), F.lit(True).alias("own")),
            F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own")),
        ),
    ).otherwise(F.array(F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))))
    spread = df.withColumn("_c", F.explode(copies)).select(*df.columns, "_c.*")
    window = (
        Window.partitionBy(*keys, "chunk").orderBy(time_us).rangeBetween(-(span_us - 1), 0)
    )
    out = spread.select(
        *df.columns, "own", *[agg.over(window).alias(name) for name, agg in aggregates.items()]
    )
    return out.filter("own").drop("own")
