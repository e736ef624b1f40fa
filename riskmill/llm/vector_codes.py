"""Operator 13: vector code compression by product quantisation with active-entry Lloyd rounds.

Method: a vector's components become integers, floor(``SCALE`` * x), and the vector is cut into
``PARTS`` equal consecutive parts, each with a codebook of at most ``ENTRIES`` entries that starts as
the parts of the least vec_ids. A Lloyd round assigns every part to the nearest entry (squared
Euclidean distance, ties to the lower index) and moves every used entry to the floor of its parts'
mean. Rows carry the entry and the exact distance of the last assignment, and the driver knows
which entries moved. A part whose entry stayed fixed compares only the moved entries with its stored
distance, since nothing else can have come nearer; a part whose entry moved scans the whole codebook. Both
keep the lower index at equal distance, so codes and distances are those of a full scan.

A round is one pass over the rows (read, assign, write) and one partial aggregate of sums and counts;
the driver sees codebooks and their sums, whose size is PARTS x ENTRIES x part width. A round's table is
dropped when the next is written. Arithmetic is exact: in doubles while every sum is below 2^53, else in longs.

Vectors that are null or hold a null or non-finite component are dropped. Shorter vectors, and widths
that PARTS does not divide, are taken as ending in zeros; an empty vector is all zeros. Integers whose
squared distances could not fit a long (beyond sqrt(2^61 / width) / 2) are taken as that bound; a label's
error that does not fit is null. Repeated rows are rows of their own; rows of one vec_id come in order of
their vectors, a null vec_id after all others. Fewer rows than ENTRIES make smaller codebooks; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.session import drop_scratch, scratch_path

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
SLICE = 4096


def integer_vectors(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label, v: the kept vectors as integers of one width that ``parts`` divides."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.where(F.col("embedding").isNotNull() & finite)
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(-(-width // parts), 1) * parts
    limit = F.lit(float(min(math.isqrt((1 << 61) // width) // 2, 1 << 30)))
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -limit), limit)).cast("int"))
    zeros = F.array_repeat(F.lit(0), width - F.size("embedding"))
    return rows.select("vec_id", "label", F.concat(whole, zeros).alias("v"))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The codebooks as they start: parts x entries x part width."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not least:
        return np.zeros((parts, 0, 1), np.int64)
    v = np.array([r["v"] for r in least], np.int64)
    return np.ascontiguousarray(v.reshape(len(v), parts, -1).transpose(1, 0, 2))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x entries."""
    span = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * span * span * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - book[:, k]) ** 2
    return out


def assign(x: np.ndarray, book: np.ndarray, code: np.ndarray, dist: np.ndarray, moved: np.ndarray | None) -> int:
    """Update the codes and distances of one part in place; returns the number of comparisons made."""
    scan = np.ones(len(x), bool) if moved is None else moved[code]
    work = 0
    at = np.flatnonzero(scan)
    if len(at):
        d = distances(x[at], book)
        best = d.argmin(axis=1)  # the first, so the lowest index
        code[at], dist[at] = best, d[np.arange(len(at)), best]
        work += d.size
    active = np.flatnonzero(moved) if moved is not None else np.zeros(0, np.int64)
    at = np.flatnonzero(~scan)
    if len(at) and len(active):
        d = distances(x[at], book[active])
        best = d.argmin(axis=1)
        near, entry = d[np.arange(len(at)), best], active[best]
        nearer = (near < dist[at]) | ((near == dist[at]) & (entry < code[at]))
        code[at[nearer]], dist[at[nearer]] = entry[nearer], near[nearer]
        work += d.size
    return work


def _numbers(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The rows with code and dist against ``books``; ``moved`` marks the entries that changed since the stored ones."""
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast((books, moved))  # PARTS x ENTRIES x part width numbers

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, changed = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                piece = batch.slice(lo, SLICE)
                x = _numbers(piece.column(2), np.int64).reshape(-1, parts, width)
                if changed is None:
                    code, dist = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
                else:
                    code, dist = _numbers(piece.column(3), np.int64), _numbers(piece.column(4), np.int64)
                for p in range(parts):
                    own = code[:, p].copy(), dist[:, p].copy()
                    assign(x[:, p], book[p], *own, None if changed is None else changed[p])
                    code[:, p], dist[:, p] = own
                offsets = pa.array(np.arange(len(x) + 1) * parts, pa.int32())
                made = [
                    pa.ListArray.from_arrays(offsets, pa.array(code.ravel(), pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(dist.ravel(), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], *made], names=["vec_id", "label", "v", "code", "dist"])

    label = rows.schema["label"].dataType.simpleString()
    number = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(step, f"vec_id {number}, label {label}, v array<int>, code array<int>, dist array<bigint>")


def means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every used entry at the floor of its parts' mean; unused entries as they are."""
    parts, entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _numbers(batch.column(0), np.int64).reshape(-1, parts, width)
            code = _numbers(batch.column(1), np.int64)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            offsets = pa.array(np.arange(len(part) + 1) * width, pa.int32())
            total = pa.ListArray.from_arrays(offsets, pa.array(sums[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), total],
                names=["part", "entry", "n", "total"],
            )

    kind = "part int, entry int, n bigint, total array<bigint>"
    tallies = rows.select("v", "code").mapInArrow(summed, kind)
    totals = [F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(width)]
    after = books.copy()
    for r in tallies.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # one row per used entry
        after[r["part"], r["entry"]] = [r[f"t{k}"] // r["n"] for k in range(width)]
    return after


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def quantise(
    vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, v, code array, dist array) of every kept vector, and the final codebooks."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "vectors")
    start = integer_vectors(vectors, scale, parts)
    start.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(start.schema).parquet(path)
    books, moved = first_books(rows, parts, entries), None
    for turn in range(rounds + 1):
        now = scratch_path(spark, f"codes-{turn}")
        table = assigned(rows, books, moved)
        table.write.option("compression", "zstd").parquet(now)
        rows = spark.read.schema(table.schema).parquet(now)
        drop_scratch(spark, path)
        path = now
        if turn < rounds:
            after = means(rows, books)
            moved, books = (after != books).any(axis=2), after
    return rows, books


def compressed(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    rows, books = quantise(vectors, **settings)
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    error = F.aggregate("dist", F.lit(0).cast("bigint"), lambda a, d: a + d)
    rows = rows.select("vec_id", "label", hexed.alias("code"), error.alias("error"))
    labels = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return rows.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
