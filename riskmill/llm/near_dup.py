"""Operator 4: near-duplicate documents by MinHash with tensored banding.

Method: a document's set is its distinct 5-word shingles (words: runs without ASCII white space, A-Z
lower-cased; fewer words: the whole text as one). Two collections of ``SIDE`` small keys each are
made, a key from ``ROWS`` MinHash values; a table's key combines one key of each collection, so
2 * SIDE * ROWS values serve SIDE * SIDE tables of 2 * ROWS rows. Documents of equal sets are one
class from the start; class representatives that share a table key are compared on their full sets
(100 * intersection >= 75 * union) as ``linked`` describes, and components are found by distributed
union-find. At the least similarity of 0.75 a pair shares a table with probability 0.997, at 0.8
with 0.9994; many-membered components have many chances.

Null and empty texts, and texts without words, are empty sets and linked with nothing. Repeated rows
of one doc_id are one document of that id if their sets agree. Ties go to the smallest doc_id. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.llm.common import linked, may_be_similar, sent, stored
from riskmill.llm.textbytes import chunks, mix, shingles, words

SIDE, ROWS, SIZE, PARITY = 8, 2, 5, 16
SIGNATURE = "doc_id bigint, n_shingles bigint, first bigint, second bigint, left array<bigint>, right array<bigint>"
_rng = np.random.default_rng(75)
_MULTIPLY = _rng.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**64 - 1, 2 * SIDE * ROWS, dtype=np.uint64)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    hashes, counts = words(texts)
    at = 0
    for n in counts.tolist():
        yield shingles(hashes[at : at + n], SIZE)
        at += n


def minhash(values: np.ndarray) -> np.ndarray:
    """The 2 * SIDE keys of one set: every key mixes ROWS minima of multiply-add permutations."""
    with np.errstate(over="ignore"):
        least = np.empty(len(_MULTIPLY), np.uint64)
        for lo in range(0, len(values), 1 << 14):
            part = values[lo : lo + (1 << 14)]
            now = np.array([(part * a + b).min() for a, b in zip(_MULTIPLY, _ADD)])
            least = now if lo == 0 else np.minimum(least, now)
        key = np.zeros(2 * SIDE, np.uint64)
        for row in least.reshape(2 * SIDE, ROWS).T:
            key = mix(key ^ row)
    return key


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, a 128-bit name of the set and the keys of both collections, per document."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, texts in chunks(batch):
                size, names, keys = [], [], []
                for values in _sets(texts):
                    size.append(len(values))
                    with np.errstate(over="ignore"):
                        names.append((values.sum(dtype=np.uint64), mix(values ^ np.uint64(75)).sum(dtype=np.uint64)))
                    keys.append(minhash(values).view(np.int64) if len(values) else None)
                name = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
                columns = [ids.slice(at, len(texts)), pa.array(size, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1])]
                for side in (slice(0, SIDE), slice(SIDE, 2 * SIDE)):
                    columns.append(pa.array([None if k is None else k[side] for k in keys], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "first", "second", "left", "right"])

    return docs.select("doc_id", "text").mapInArrow(signed, SIGNATURE)


def full_sets(docs: DataFrame) -> DataFrame:
    """id, n, its whole set of shingle hashes, and the set's parity bits p0.. (see ``may_be_similar``)."""
    bits = [f"p{k}" for k in range(PARITY)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, texts in chunks(batch):
                sets = list(_sets(texts))
                odd = np.array([np.bincount((v >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1 for v in sets])
                packed = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                columns = [ids.slice(at, len(texts)), pa.array([len(v) for v in sets], pa.int64())]
                columns.append(pa.array([v.view(np.int64) for v in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns + [pa.array(packed[:, k]) for k in range(PARITY)], names=["id", "n", "values", *bits])

    kind = "id bigint, n bigint, values array<bigint>, " + ", ".join(f"{b} bigint" for b in bits)
    return docs.select("doc_id", "text").mapInArrow(made, kind)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept."""
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("first", "second").agg(F.min("doc_id").alias("class"))
    classes = stored(classes, "classes")
    chosen = signed.join(classes, (signed["doc_id"] == classes["class"])).where(
        (signed["first"] == classes["first"]) & (signed["second"] == classes["second"])
    )
    chosen = chosen.select(F.col("class").alias("id"), "left", "right").dropDuplicates(["id"])
    table = chosen.select("id", F.posexplode("left").alias("i", "a"), "right").select(
        "id", "i", "a", F.posexplode("right").alias("j", "b")
    )
    buckets = table.select(F.xxhash64("i", "j", "a", "b").alias("bucket"), "id")

    def prepare(ids: DataFrame):
        asked = sent(ids.withColumnRenamed("id", "doc_id"))
        sets = stored(full_sets(docs.join(asked, "doc_id", "left_semi")).dropDuplicates(["id"]), "sets")

        def verify(pairs: DataFrame) -> DataFrame:
            left = sets.select(F.col("id").alias("a"), F.col("values").alias("x"))
            right = sets.select(F.col("id").alias("b"), F.col("values").alias("y"))
            common = F.size(F.array_intersect("x", "y"))
            both = pairs.join(left, "a").join(right, "b")
            return both.where((100 + percent) * common >= percent * (F.size("x") + F.size("y"))).select("a", "b")

        known = sets.drop("values")
        return verify, lambda ids: known.join(ids, "id", "left_semi"), may_be_similar(PARITY, percent / 100)

    parts = linked(buckets, prepare, "near")
    named = classes.join(parts, classes["class"] == parts["id"], "left").select(
        "first", "second", F.coalesce("component", "class").alias("part")
    )
    return (
        signed.join(named, ["first", "second"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("part")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def op4_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Third stage of the pipeline: one document of each component stays (empty ones are their own)."""
    gone = stored(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(sent(gone), "doc_id", "left_anti").select(docs.columns)
