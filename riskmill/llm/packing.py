"""Operator 2: bounded-space online best-fit packing of token pieces into sequences.

Method: each task reads its rows once, in order. A fixed number of bins is open at a time; a bitset
has a bit for each free space that an open bin has, so the best fit for a piece (the least free
space that holds it) is one shift and one lowest set bit. If nothing fits and all bins are open,
the fullest is closed first. Memory is the open bins and one slice of texts, whatever the input.
Tasks pack independently; the price is at most ``open_bins`` unfilled sequences a task.

Nulls and empty texts are documents of the end id alone. Ties between bins of equal free space go
to the one opened last; repeated rows are packed as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.llm.textbytes import chunks
from riskmill.llm.word_encoder import encoder

PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, ids binary"
)


class OpenBins:
    """The open bins of one task: ``place`` returns (bin, offset) for a length of 1 to ``capacity``."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, open_bins, first
        self.mask, self.open = 0, 0
        self.bins: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        taken = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.open -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.next
            self.next += 1
            if self.open == self.most and length < free:
                self._take((self.mask & -self.mask).bit_length() - 1)
        left = free - length
        if left:
            self.bins[left].append(bin_id)
            self.mask |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    open_bins: int = 1024,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers (null if not asked
    for). A document is cut only if it is longer than ``capacity``; its last piece may be shorter.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        encode = encoder(tokenizer).encode
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for first, texts in chunks(batch, limit=1 << 20):
                ids, counts = encode(texts)
                rows, at = [], 0
                for k, n in enumerate(counts.tolist()):
                    whole = np.append(ids[at : at + n], np.uint32(end_id))
                    at += n
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity].astype("<u4").tobytes()
                        length = len(part) // 4
                        place = bins.place(length)
                        rows.append((names[first + k], piece, start, length, zlib.crc32(part), *place, part if with_ids else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=[f.split()[0] for f in PIECES.split(", ")]
                )

    return docs.select("doc_id", "text").mapInArrow(packed, PIECES)


_ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def stage_best_fit_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the kept documents as packed pieces."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return stage_best_fit_packing(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
