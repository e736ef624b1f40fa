"""Operator 10: token counts of whole texts, huge ones by overlapping chunks that are spliced.

Method: a text above ``chunk`` bytes is encoded in chunks that overlap. In the overlap of two chunks
a boundary is looked for that is proven stable: a place between two characters that stand side by
side in no token of the vocabulary (before a blank or a line end, as a rule, and inside CJK or base64
wherever the vocabulary allows it), where both encodings start a token. No merge can cross such a
place, so both sides are encoded there as in the whole text, and the chunks are cut at it. If there
is none, the overlap is doubled, at most up to the chunk's own first boundary; if the whole chunk has
none, its end is moved forward, by doubling, until one is found or the text ends.

Null and empty texts have no tokens. Ties do not occur; repeated rows are counted each; extra
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskmill.llm.textbytes import chunks

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
CHUNK, OVERLAP = 1 << 16, 1 << 10


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        held = {ord(x) << 32 | ord(y) for p in pieces for x, y in zip(p.replace("▁", " "), p.replace("▁", " ")[1:])}
        self.joined = np.array(sorted(held), np.int64)  # all pairs of characters that some token holds side by side
        self.widths = np.array(
            [1 if self.model.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(pieces)], np.int64
        )

    def starts(self, text: str, lead: int) -> np.ndarray:
        """Byte offsets in ``text`` where its tokens start; ``lead`` is the blank that the model puts in front."""
        widths = self.widths[np.array(self.model.encode(text), np.int64)]
        return np.cumsum(widths) - widths - lead

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        raw = text.replace("\u2581", " ").encode()  # the model's own sign for a blank, which it reads as one
        if len(raw) <= chunk:
            return len(self.model.encode(text))
        # a chunk is read from ``position`` to ``end``; its tokens count from ``first`` on, a proven boundary
        tokens, position, first, end, size = 0, 0, -1, _character(raw, chunk), chunk
        own = self.starts(raw[:end].decode(), 1)
        while end < len(raw):
            wide, common = overlap, None
            while common is None and (after := _character(raw, max(end - wide, 0))) > first + 1:
                proven = self._stable(raw, after, end)
                if len(proven := np.intersect1d(own, proven, assume_unique=True)):
                    stop = _character(raw, min(max(after + chunk, end + chunk // 2), len(raw)))
                    now = self.starts(raw[after:stop].decode(), 1) + after
                    proven = np.intersect1d(now, proven, assume_unique=True)
                    common = int(proven[0]) if len(proven) else None
                wide *= 2
            if common is None:  # nothing between ``first`` and ``end``: the same chunk, but longer
                size *= 2
                end = _character(raw, min(position + size, len(raw)))
                own = self.starts(raw[position:end].decode(), 1) + position
                own = own[np.searchsorted(own, first) :]
                continue
            tokens += int(np.searchsorted(own, common))
            position, first, end, size, own = after, common, stop, chunk, now[np.searchsorted(now, common) :]
        return tokens + len(own)

    def _stable(self, raw: bytes, low: int, high: int) -> np.ndarray:
        """All places inside ``low`` to ``high`` (starts of characters) that no token of the vocabulary can cross."""
        text = raw[low:high].decode()
        signs = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        pairs = signs[:-1] << 32 | signs[1:]
        known = self.joined[np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)] == pairs
        sizes = 1 + (signs >= 0x80) + (signs >= 0x800) + (signs >= 0x10000)
        return low + np.cumsum(sizes)[:-1][~known]


def _character(raw: bytes, at: int) -> int:
    """The nearest start of a character at or before ``at``."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(model)
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in chunks(batch, limit=1 << 20):
                sizes = [len(t) for t in texts]
                tokens = [0] * len(texts)
                small = [i for i, n in enumerate(sizes) if 0 < n <= chunk]
                for i, ids in zip(small, tool.model.encode([texts[i].decode() for i in small], num_threads=1)):
                    tokens[i] = len(ids)
                for i, n in enumerate(sizes):
                    if n > chunk:
                        tokens[i] = tool.count(texts[i].decode(), chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(first, len(texts)),
                        pa.array(sizes, pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(counted, COUNTS)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
