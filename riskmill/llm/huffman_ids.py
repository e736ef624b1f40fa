"""Operator 5: token ids in canonical length-limited Huffman code, in independent blocks.

Method: texts are encoded once; their ids are dealt to runs of doc_id (bounds from the quantiles of
doc_id alone, so no text is encoded for a sample) and kept, in order, as plain ids.
Global counts of the ids (one row per id, bounded by the vocabulary) give code lengths by
package-merge, limited to ``LIMIT`` bits; canonical codes follow from the lengths alone. Each block
holds whole documents, is coded on its own and carries the bit offset of every ``STEP``-th id.
Decoding reads ``LIMIT`` bits at a time into a table of (id, length); the checkpoints let all
strides of a block be decoded side by side as array operations.

File format: a folder with ``codes`` (id, length: the canonical code book) and ``blocks`` (position,
doc_ids, lengths, n_ids, bits, checkpoints), both with Parquet files as containers, so that any store
Spark can write and its commit of whole files apply. Blocks in order of position hold the documents
in ascending order of doc_id.

Null and empty texts are documents of the end id alone. Repeated doc_ids stay next to each other, in
order of their ids' bytes. Null doc_ids come first. Extra columns are ignored; an empty table
gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmill.llm.common import stored
from riskmill.llm.textbytes import chunks
from riskmill.llm.word_encoder import encoder
from riskmill.session import scratch_path

LIMIT, STEP, BLOCK_IDS, PART_BITS = 20, 128, 1 << 17, 33
BLOCKS = "position bigint, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    weights, marks = leaves, [np.ones(n, bool)]  # marks: which items of a level's merged list are leaves
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        sort = np.argsort(both, kind="stable")
        weights = both[sort]
        marks.append(sort < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for mark in reversed(marks):
        used = int(mark[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, by length and then by position; ``lengths`` in order of ids, 0 for no code."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[i])
        if n:
            code <<= n - before
            codes[i] = code
            code += 1
            before = n
    return codes


class CodeBook:
    def __init__(self, ids: list[int], lengths: list[int]):
        size = max(ids, default=0) + 1
        self.lengths = np.zeros(size, np.int64)
        self.lengths[ids] = lengths
        self.codes = canonical(self.lengths)
        self.table_ids = np.zeros(1 << LIMIT, np.uint32)
        self.table_lengths = np.zeros(1 << LIMIT, np.uint8)
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        span = np.left_shift(1, LIMIT - self.lengths[used])
        self.table_ids[: span.sum()] = np.repeat(used, span)
        self.table_lengths[: span.sum()] = np.repeat(self.lengths[used], span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string (most significant bit first) and the bit offset of every STEP-th id."""
        n = self.lengths[ids]
        at = np.cumsum(n) - n
        total = int(n.sum())
        words = np.zeros(total // 64 + 2, np.uint64)
        word, inside = at >> 6, (at & 63)
        left = self.codes[ids] << (64 - n).astype(np.uint64)  # at the top of a word
        for place, value in (
            (word, left >> inside.astype(np.uint64)),
            (word + 1, np.where(inside > 0, left << ((64 - inside) & 63).astype(np.uint64), np.uint64(0))),
        ):
            if len(place):
                first = np.flatnonzero(np.diff(place, prepend=-1))
                words[place[first]] |= np.bitwise_or.reduceat(value, first)
        return words.astype(">u8").tobytes()[: total // 8 + 1], at[::STEP].copy()

    def decode(self, bits: bytes, checkpoints: np.ndarray, n_ids: int) -> np.ndarray:
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        out = np.zeros((len(checkpoints), STEP), np.uint32)
        at = checkpoints.astype(np.int64).copy()
        last = n_ids - (len(checkpoints) - 1) * STEP
        for k in range(STEP):
            live = slice(None) if k < last else slice(0, len(at) - 1)
            place = at[live]
            byte = place >> 3
            window = (raw[byte] << np.uint32(24)) | (raw[byte + 1] << np.uint32(16)) | (raw[byte + 2] << np.uint32(8)) | raw[byte + 3]
            window = (window << (place & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
            out[live, k] = self.table_ids[window]
            at[live] = place + self.table_lengths[window]
        return out.ravel()[:n_ids]


def _kind(tokenizer: str) -> str:
    return "<u2" if len(encoder(tokenizer).closing) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and the ids of each text with the end id, as little-endian unsigned integers of ``_kind``."""
    kind = _kind(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in chunks(batch, limit=1 << 20):
                ids, counts = tool.encode(texts)
                at = np.cumsum(counts)
                whole = np.insert(ids, at, end_id).astype(kind)
                ends = (at + np.arange(1, len(at) + 1)).tolist()
                rows = [whole[a:b].tobytes() for a, b in zip([0, *ends], ends)]
                columns = [names.slice(first, len(texts)), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def in_order(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` in ascending order of doc_id over all partitions, with ``position``: ascending, successive in a part."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc_id", cuts, 10 * parts).alias("cuts")).first()["cuts"] if cuts else None
    bounds = sorted(set(found or []))
    part = F.lit(0)
    if bounds:
        part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda cut: cut < F.col("doc_id"))), F.lit(0))
    dealt = rows.withColumn("part", part).repartitionById(len(bounds) + 1, "part").drop("part")
    return dealt.sortWithinPartitions("doc_id", "ids").withColumn("position", F.monotonically_increasing_id())


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Write all ids of all documents in ascending doc_id order into the format above, at ``path``."""
    spark, kind = docs.sparkSession, _kind(tokenizer)
    plain = stored(in_order(encoded(docs, tokenizer, end_id), docs.select("doc_id")), "ids")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0):
                now = np.bincount(np.frombuffer(value.as_py(), kind))
                if len(now) > len(total):
                    total, now = now, total
                total[: len(now)] += now
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = plain.select("ids").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = rows.orderBy("id").collect()  # at most one row for each entry of the vocabulary
    ids = [r["id"] for r in rows]
    lengths = code_lengths(np.array([r["n"] for r in rows], np.int64)).tolist()
    spark.createDataFrame(list(zip(ids, lengths)), "id bigint, length bigint").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((ids, lengths))  # bounded by the vocabulary

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = CodeBook(*shared.value)
        names, parts, size, first, after = [], [], 0, None, None

        def block():
            whole = np.concatenate(parts)
            bits, marks = book.encode(whole)
            row = [first, names, [len(p) for p in parts], len(whole), bits, marks.astype("<u8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW)], names=_NAMES)

        for batch in batches:
            for doc, value, position in zip(*batch.columns):
                position = position.as_py()
                if parts and (position != after or size >= BLOCK_IDS):
                    yield block()
                    names, parts, size = [], [], 0
                first = first if parts else position
                after = position + 1
                names.append(doc.as_py())
                parts.append(np.frombuffer(value.as_py(), kind))
                size += len(parts[-1])
        if parts:
            yield block()

    # a task reads runs of successive positions; a block ends where a run ends
    plain.select("doc_id", "ids", "position").mapInArrow(coded, BLOCKS).write.parquet(f"{path}/blocks")


_ARROW = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
_NAMES = [f.split()[0] for f in BLOCKS.split(", ")]


def read_ids(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Documents decoded from the files: doc_id, start, n_tokens, ids_crc32, ids (32-bit little-endian; null if not asked for)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").collect()
    shared = spark.sparkContext.broadcast(([r["id"] for r in codes], [r["length"] for r in codes]))
    sizes = blocks.select("position", F.shiftrightunsigned("position", PART_BITS).alias("part"), "n_ids")
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    per_part = per_part.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("position", "part", F.coalesce(inside, F.lit(0)).alias("ahead")).join(per_part, "part")
    starts = starts.select("position", (F.col("base") + F.col("ahead")).alias("start"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = CodeBook(*shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = book.decode(row["bits"], np.frombuffer(row["checkpoints"], "<u8"), row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["lengths"]).tolist()
                begins = [0, *ends[:-1]]
                parts = [ids[a:b].tobytes() for a, b in zip(begins, ends)]
                columns = [
                    pa.array([row["position"]] * len(parts), pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begins, pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(map(zlib.crc32, parts), pa.int64()),
                    pa.array(parts if with_ids else [None] * len(parts), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in kind.split(", ")])

    kind = "position bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    docs = blocks.mapInArrow(decoded, kind).join(starts, "position")
    return docs.select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op5_huffman_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "huffman")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    return read_ids(spark, path, with_ids=False).drop("ids")
