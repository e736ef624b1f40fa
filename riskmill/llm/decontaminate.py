"""Operator 6: benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Method: an item of n words has n - 4 shingles of 5 words (fewer words: itself as one), and a document is
looked at in windows of as many words as the item. Weights are multiplicities; the similarity of a
window and an item is the weighted Jaccard of their shingles, sum of minima over sum of maxima.
Windows of an item's size that start at a shingle of an item of that size are enough: moving a
window to the right until its first shingle is one of the item's never loses a common shingle, and
the last window of a text stands for all moves that its end stops. Each such window gets a 64-bit
SimHash of its weighted shingles, and so does each item. Fingerprints are cut into ``BLOCKS`` blocks;
an item is filed under every block value that differs in at most ``NEAR`` bits, so every pair within
``RADIUS`` bits meets in a block (RADIUS < BLOCKS * (NEAR + 1)). What meets and lies within the radius
is verified by the exact weighted similarity (``least`` or more).

Words are runs without ASCII white space, in lower case. A pair at the least similarity is about 11
bits apart (standard deviation 3), and a passage offers a window for each of its shingles.

Null and empty texts or items have no words and match nothing; items and documents of fewer than
5 words are one shingle. Rows without an id are left out. Repeated rows are reported once. Ties between
windows go to the first. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.llm.common import sent, stored

SIZE, LEAST = 5, 0.75
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
BLOCKS, NEAR, RADIUS = 8, 2, 22
_LANES = 0x0001000100010001
_WIDTH = 64 // BLOCKS
_NEAR_VALUES = [sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(_WIDTH), n)]


def _shingled(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, n_words and h: the hash of the shingle at every word (all words, if fewer than SIZE)."""
    plain = F.btrim(F.lower("text"), F.lit("".join(SPACES)))
    words = F.when(plain != "", F.split(plain, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))
    # named by a lambda, each step is computed once per text
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    both = F.transform(F.array(hashes), lambda w: F.struct(F.size(w).alias("n_words"), _runs(w).alias("h")))
    return df.where("text is not null").select(*keep, F.inline(both))


def _runs(w):
    """Hashes of all runs of SIZE elements of an array of hashes; of the whole, if it is shorter."""
    last = F.when(F.size(w) > 0, F.greatest(F.size(w) - (SIZE - 1), F.lit(1))).otherwise(0)
    return F.transform(F.slice(w, 1, last), lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(SIZE)]))


def _fingerprint(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, print: SimHash of the shingles of each key (column h, one row for each occurrence).

    Four counters of 16 bits share a number, so 16 sums count all 64 bits; a window is far shorter than
    a counter is wide.
    """
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES))).alias(f"s{j}") for j in range(16)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    bits = None
    for j in range(16):
        for lane in range(4):
            ones = F.shiftrightunsigned(f"s{j}", 16 * lane).bitwiseAND(F.lit(0xFFFF))
            bit = F.when(2 * ones > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), 16 * lane + j)).otherwise(F.lit(0).cast("bigint"))
            bits = bit if bits is None else bits.bitwiseOR(bit)
    return counted.select(*keys, bits.alias("print"))


def _shingles(size):
    return F.greatest(size - (SIZE - 1), F.lit(1))


def _block(value, b: int):
    return F.shiftrightunsigned(value, b * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1))


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, start (word), n_words, distance, similarity (of the best window)."""
    known = stored(_shingled(items.where("item_id is not null"), "item_id").where("n_words > 0"), "items")
    # distinct (shingle, size) of all items, whatever the corpus
    marks = known.select(F.explode("h").alias("g"), F.col("n_words").alias("size")).distinct()
    marks = stored(marks.groupBy("g").agg(F.collect_set("size").alias("sizes")), "marks")

    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("name"))
    places = _shingled(docs, "doc_id", "name").select("doc_id", "name", F.posexplode("h").alias("at", "g"))
    hits = stored(places.join(sent(marks), "g").select("doc_id", "name", "at", "sizes").distinct(), "hits")
    # what a text holds of the items: never more than its own words
    held = stored(hits.groupBy("doc_id", "name").agg(F.collect_list(F.struct("at", "sizes")).alias("hits")), "held")
    # only the narrow keys are sent; the texts that are left meet their hits by a shuffle
    few = docs.join(sent(held.select("doc_id", "name")), ["doc_id", "name"], "left_semi")
    texts = _shingled(few.join(held, ["doc_id", "name"]), "doc_id", "name", "hits")

    def at_most(start, size):  # a window that would pass the end becomes the text's last one of that size
        return F.least(start, F.greatest(F.size("h") - _shingles(size), F.lit(0)))

    starts = F.flatten(
        F.transform(
            "hits",
            lambda hit: F.transform(hit["sizes"], lambda z: F.struct(z.alias("size"), at_most(hit["at"], z).alias("start"))),
        )
    )
    cut = F.transform(
        F.array_distinct(starts), lambda w: F.struct(w["size"].alias("size"), w["start"].alias("start"), F.slice("h", w["start"] + 1, _shingles(w["size"])).alias("g"))
    )
    windows = texts.select("doc_id", "name", F.explode(cut).alias("w")).select("doc_id", "name", "w.*")
    windows = stored(windows.dropDuplicates(["doc_id", "name", "size", "start"]), "windows")
    opened = windows.select("doc_id", "name", "size", "start", F.explode("g").alias("h"))
    prints = _fingerprint(opened, "doc_id", "name", "size", "start")
    own = _fingerprint(known.select("item_id", F.col("n_words").alias("size"), F.explode("h").alias("h")), "item_id", "size")
    own = own.withColumnRenamed("print", "item_print")

    filed = own.select(
        "item_id",
        "size",
        "item_print",
        F.explode(
            F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("item_print"), b).bitwiseXOR(F.lit(x)).alias("value")) for b in range(BLOCKS) for x in _NEAR_VALUES])
        ).alias("k"),
    ).select("item_id", "size", "item_print", "k.b", "k.value")
    asked = prints.select(
        "doc_id",
        "name",
        "size",
        "start",
        "print",
        F.explode(F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("print"), b).alias("value")) for b in range(BLOCKS)])).alias("k"),
    ).select("doc_id", "name", "size", "start", "print", "k.b", "k.value")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    met = asked.join(filed, ["size", "b", "value"]).withColumn("distance", distance).where(F.col("distance") <= RADIUS)
    met = met.select("doc_id", "name", "size", "start", "item_id", "distance").distinct()

    pairs = met.join(windows, ["doc_id", "name", "size", "start"]).join(
        known.select("item_id", F.col("n_words").alias("size"), F.col("h").alias("own")), ["item_id", "size"]
    )
    common = F.aggregate(
        F.array_distinct(F.array_intersect("g", "own")),
        F.lit(0),
        lambda total, x: total + F.least(_times("g", x), _times("own", x)),
    )
    pairs = pairs.withColumn("common", common)
    pairs = pairs.withColumn("similarity", F.col("common") / (F.size("g") + F.size("own") - F.col("common")))
    best = F.max_by(
        F.struct("start", "distance", "similarity"), F.struct("similarity", -F.col("start"), -F.col("distance"))
    ).alias("best")
    found = pairs.where(F.col("similarity") >= least).groupBy("doc_id", "name", "item_id", F.col("size").alias("n_words")).agg(best)
    return found.select("doc_id", "item_id", "best.start", "n_words", "best.distance", "best.similarity")


def _times(array: str, value):
    return F.size(F.filter(F.col(array), lambda y: y == value))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def stage_decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fourth stage of the pipeline: documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    leaks = stored(contaminated(docs, items).select("doc_id").distinct(), "leaks")
    return docs.join(sent(leaks), "doc_id", "left_anti").select(docs.columns)
