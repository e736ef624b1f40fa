"""What several operators of this subpackage share: exact linking inside buckets and components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmill.session import reliable_checkpoint, scratch_path, shuffles_dropped


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: later uses do not recompute it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def crc_remainder(column: str, modulus: int):
    """crc32 of a number written as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) pairs: id, component (the smallest id reachable).

    Distributed union-find by alternating large-star and small-star steps: every step hangs
    neighbours on the smallest one known, so the graph becomes stars in O(log^2 n) rounds. Each
    round is two windows and one distinct; nothing of it is collected but a count and a checksum
    that tell whether the round changed anything.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links, state = _round(links)
    lowest = F.min("v").over(Window.partitionBy("u"))
    while state[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", lowest)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the link with the smallest neighbour stays, the others hang on it; links that come twice go at the end
        small = large.withColumn("m", lowest).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links, after = _round(small.distinct())
        if after == state:
            break
        state = after
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more (a, b) links: only the components that these join are looked at again."""
    for end in ("a", "b"):
        at = found.select(F.col("id").alias(end), F.col("component").alias(f"{end}_part"))
        links = links.join(at, end, "left").withColumn(end, F.coalesce(f"{end}_part", end)).drop(f"{end}_part")
    moved = components(links.select("a", "b"))
    places = found.join(moved.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
    return places.select("id", F.coalesce("now", "component").alias("component")).union(moved).distinct()


def _round(links: DataFrame):
    links = reliable_checkpoint(links)
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return links, tuple(row)


#: Tables of up to so many rows, by count, are sent to every task; larger ones are shuffled.
SENT = 1_000_000


def sent(table: DataFrame) -> DataFrame:
    """A narrow table for a join: broadcast if its counted size allows it, else left to a shuffle."""
    return F.broadcast(table) if table.count() <= SENT else table


def parity(hashes: str, n_bits: int = 256) -> list:
    """Aggregates of a hash column: a set's parity bits, in longs p0, p1, ...

    Two sets differ in at least as many elements as their parity bits differ.
    """
    place = F.pmod(F.col(hashes), F.lit(n_bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    return [
        F.bit_xor(F.when(F.floor(place / 64) == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"p{k}")
        for k in range(n_bits // 64)
    ]


def may_be_similar(parts: int, least: float):
    """Condition on n, p0.. and other_n, other_p0..: false only if the Jaccard similarity is below ``least``."""
    apart = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"other_p{k}"))) for k in range(parts)), F.lit(0))
    sizes = F.least("n", "other_n") >= least * F.greatest("n", "other_n")
    return sizes & (apart <= (1 - least) / (1 + least) * (F.col("n") + F.col("other_n")) + 1e-6)


def linked(buckets: DataFrame, prepare: Callable[[DataFrame], tuple], name: str, orders: int = 64) -> DataFrame:
    """Components of all verified links between members of a common bucket: id, component.

    ``buckets`` has bucket, id (both long, distinct rows). ``prepare`` gets the ids that share a bucket and
    returns (verify, features, possible): ``verify`` keeps the (a, b) pairs that are true links;
    ``features`` gets ids and returns id with columns that ``possible``, a condition on them and on
    the same columns with other_ in front, needs to refuse pairs that cannot be links.

    A bucket of any size is first linked to one member (the first in one of ``orders`` random orders of
    all ids, so a large group meets that many different centres through its many buckets): as many
    pairs as members. What these links leave in different components of the same bucket is compared
    further, so no link that could join two components is lost. A bucket in which that would take
    more than ``NEAR`` pairs a member gets ``CENTRES`` new centres, each first in a new order, and once more at most
    so many pairs a member; after ``TURNS`` such rounds, and in smaller buckets at once, every pair of different
    components is compared. Of all these pairs only those that ``possible`` does not refuse become rows and are verified. Members that are linked with each other join the
    growing component after a few centres, so a large group of copies never becomes a square of pairs.
    """
    with shuffles_dropped(buckets.sparkSession):
        return _linked(buckets, prepare, name, orders)


def _linked(buckets: DataFrame, prepare: Callable[[DataFrame], tuple], name: str, orders: int) -> DataFrame:
    inside = Window.partitionBy("bucket")
    mask = F.xxhash64(F.pmod("bucket", F.lit(orders)))
    groups = buckets.select(
        "bucket",
        "id",
        F.min(F.col("id").bitwiseXOR(mask)).over(inside).bitwiseXOR(mask).alias("centre"),
        F.count("*").over(inside).alias("size"),
    ).where("size > 1")
    groups = stored(groups, f"{name}-groups")
    verify, features, possible = prepare(stored(groups.select("id").distinct(), f"{name}-ids"))
    first = groups.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    first = stored(first.distinct(), f"{name}-first")
    found = stored(components(reliable_checkpoint(verify(first))), f"{name}-found")
    placed, known = groups.where("size > 2").select("bucket", "id"), None
    for turn in range(TURNS + 1):
        placed, crowded = _apart(placed, found, turn, name)
        if crowded is None:
            return found
        if known is None:  # later rounds have a part of these ids
            known = stored(features(placed.select("id").distinct()), f"{name}-known")
        if turn == TURNS or crowded.isEmpty():
            break
        # the new centres of a crowded bucket meet the members outside their components that are not refused
        others = known.select(*[F.col(c).alias("centre" if c == "id" else f"other_{c}") for c in known.columns])
        inside = _described(placed.join(sent(crowded.select("bucket").distinct()), "bucket", "left_semi"), known)
        centres = crowded.join(others, "centre")
        centres = F.broadcast(centres) if crowded.count() <= SENT // 16 else centres
        met = inside.join(centres, "bucket").where((F.col("part") != F.col("centre_part")) & possible)
        met = met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        links = reliable_checkpoint(verify(met.join(first, ["a", "b"], "left_anti")))
        if not links.isEmpty():
            found = stored(merged(found, links), f"{name}-found")
    left = _described(placed, known)
    right = left.select("bucket", *[F.col(c).alias(f"other_{c}") for c in left.columns if c != "bucket"])
    rest = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("id") < F.col("other_id")) & (F.col("part") != F.col("other_part")) & possible)
    rest = rest.select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = reliable_checkpoint(verify(rest))
    return found if more.isEmpty() else merged(found, more)


def _described(placed: DataFrame, known: DataFrame) -> DataFrame:
    """bucket, id, part with the columns of ``known``: an id meets them once, not once in each of its buckets."""
    members = placed.groupBy("id").agg(F.min("part").alias("part"), F.collect_list("bucket").alias("buckets"))
    return members.join(known, "id").withColumn("bucket", F.explode_outer("buckets")).drop("buckets")


#: Rounds of further centres, centres a round, and the pairs a member from which a bucket gets them.
TURNS, CENTRES, NEAR = 2, 4, 4


def _apart(placed: DataFrame, found: DataFrame, turn: int, name: str):
    """Members of buckets with several components: bucket, id, part; and centres of crowded ones: bucket, centre, centre_part.

    None in place of the centres if no bucket has several components.
    """
    placed = placed.select("bucket", "id").join(sent(found), "id", "left")
    placed = stored(placed.select("bucket", "id", F.coalesce("component", "id").alias("part")), f"{name}-placed")
    orders = []
    for k in range(CENTRES):
        place = F.col("id").bitwiseXOR(F.xxhash64(F.lit(turn * CENTRES + k)))
        orders.append(F.min(F.struct(place.alias("o"), F.col("id").alias("centre"), F.col("part").alias("centre_part"))).alias(f"c{k}"))
    parts = placed.groupBy("bucket", "part").agg(F.count("*").cast("double").alias("n"), *orders)
    buckets = parts.groupBy("bucket").agg(
        F.count("*").alias("parts"),
        F.sum("n").alias("members"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        *[F.min(f"c{k}").alias(f"c{k}") for k in range(CENTRES)],
    )
    pairs = (F.col("members") * F.col("members") - F.col("squares")) / 2
    buckets = buckets.where("parts > 1").select(
        "bucket",
        (pairs > NEAR * F.col("members")).alias("crowded"),
        F.array_distinct(F.array(*[F.struct(f"c{k}.centre", f"c{k}.centre_part") for k in range(CENTRES)])).alias("centres"),
    )
    buckets = stored(buckets, f"{name}-split")
    if buckets.isEmpty():
        return placed, None
    placed = placed.join(sent(buckets.select("bucket")), "bucket", "left_semi")
    return placed, buckets.where("crowded").select("bucket", F.inline("centres"))
