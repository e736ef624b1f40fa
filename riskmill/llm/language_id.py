"""Operator 9: language identification by prediction by partial matching.

Method: per language a tree of byte contexts of variable length (0 to ``ORDER``) with counts of
the next byte. Probabilities follow PPM: the longest known context predicts; an unseen byte costs
an escape (method C: the number of distinct followers over count plus that number), and shorter
contexts are asked with the bytes already refused excluded. Counts are frozen after learning, so
the code length of a byte depends on its ORDER bytes of context only. All 256 byte values are kept (A-Z
lower-cased). The trees are sparse: sorted tables of the contexts and bytes that were observed, with the
code length under each language; a byte never seen in a context costs that context's escape and is looked
up in the next shorter one. A text's code length is the sum over its bytes; the shortest wins.

Learning takes at most ``SAMPLE`` texts of each language (those of least hash of doc_id), and a tree
keeps at most about ``NODES`` of its longest runs, the most frequent ones: documented bounds, so the model's
size is bounded by the number of languages, not by the data.

Null text, or text without a letter: ``und``, score 0. Ties go to the language first in order of
name. Without any labelled row everything is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmill.llm.common import crc_remainder, stored
from riskmill.llm.textbytes import LOWER, chunks

ORDER = 3
BYTES = 256
ALPHABET = 40  # of the full listing in ``code_lengths``
SAMPLE = 400
NODES = 1 << 18
STEP = 1 << 18
RESULT = "doc_id bigint, lang_pred string, score double"


def sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, by least hash of their id."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.where("lang is not null and text is not null").select("doc_id", "lang")
    ids = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    texts = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    return texts.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")


def _context_codes(signs: np.ndarray, size: int) -> np.ndarray:
    """For every position the code of its ORDER signs of context and itself (before the start: sign 0)."""
    padded = np.concatenate([np.zeros(ORDER, np.int64), signs])
    code = np.zeros(len(signs), np.int64)
    for k in range(ORDER + 1):
        code *= size
        code += padded[k : k + len(signs)]
    return code


def learn(train: DataFrame, nodes: int = NODES) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Languages, and for each language the codes of (context, byte) with their counts.

    Counting runs in tasks; what reaches the driver is bounded by nodes and languages.
    """

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column(0).to_pylist())
            for first, texts in chunks(batch):
                own = languages[first : first + len(texts)]
                for lang in sorted(set(own.tolist())):
                    parts = [_context_codes(LOWER[np.frombuffer(t, np.uint8)], BYTES) for t, x in zip(texts, own) if x == lang]
                    code, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"]
                    )

    train = train.select("lang", "text")
    grams = train.mapInArrow(grams_of, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = _most_used(stored(grams, "grams"), nodes).toPandas()
    languages = sorted(found["lang"].unique())
    counts = [found[found["lang"] == x].sort_values("code") for x in languages]
    return languages, [(c["code"].to_numpy(np.int64), c["n"].to_numpy(np.int64)) for c in counts]


def _most_used(grams: DataFrame, nodes: int) -> DataFrame:
    """About ``nodes`` of each language's rows, those of the highest n; of the last n taken, a share by hash of the code."""
    sizes: dict = {}
    for r in grams.groupBy("lang", "n").agg(F.count("*").alias("rows")).collect():
        sizes.setdefault(r["lang"], []).append((r["n"], r["rows"]))
    kept = F.lit(True)
    for lang, steps in sizes.items():
        room = nodes
        for n, rows in sorted(steps, reverse=True):
            if rows > room:
                some = F.pmod(F.xxhash64("code"), F.lit(1 << 20)) < int(room / rows * (1 << 20))
                kept &= (F.col("lang") != lang) | (F.col("n") > n) | ((F.col("n") == n) & some)
                break
            room -= rows
    return grams.where(kept)


def _at(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and which are in it."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


class Trees:
    """Sparse context trees of all languages: per order the observed runs with their bits, and the contexts' escapes."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], size: int = BYTES):
        self.size, self.levels = size, []
        lower, shorter = np.zeros(0, np.int64), np.zeros((0, len(counts)))
        for order in range(ORDER + 1):
            base = size ** (order + 1)
            runs = np.unique(np.concatenate([np.zeros(0, np.int64), *[c % base for c, _ in counts]]))
            n = np.zeros((len(runs), len(counts)))
            for k, (codes, times) in enumerate(counts):
                n[:, k] = np.bincount(np.searchsorted(runs, codes % base), times, len(runs))
            contexts, of = np.unique(runs // size, return_inverse=True)
            before = shorter[_at(lower, runs % size**order)[0]] if order else np.full(n.shape, 1.0 / size)
            seen = n > 0
            kinds, total, mass = (self._sums(of, x, len(contexts)) for x in (seen, n, seen * before))
            left = np.where(mass < 1 - 1e-12, 1 - mass, 0.0)  # mass of the shorter context after exclusion
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds == 0, 1.0, np.where(left > 0, kinds / (total + kinds) / left, 0.0))
                # a context that has seen every sign needs no escape
                p = np.where(seen, n / (total + kinds * (left > 0))[of], escape[of] * before)
                bits, escapes = -np.log2(p), -np.log2(escape)
            self.levels.append((runs, bits.astype(np.float32), contexts, escapes.astype(np.float32)))
            lower, shorter = runs, p

    @staticmethod
    def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        columns = [np.bincount(of, values[:, k], n) for k in range(values.shape[1])]
        return np.stack(columns, axis=1) if columns else np.zeros((n, 0))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of every (context, sign) under every language."""
        out = np.zeros((len(codes), self.levels[0][1].shape[1]), np.float32)
        rest = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            runs, bits, contexts, escapes = self.levels[order]
            code = codes[rest] % self.size ** (order + 1)
            at, hit = _at(runs, code)
            out[rest[hit]] += bits[at[hit]]
            rest, code = rest[~hit], code[~hit]
            at, known = _at(contexts, code // self.size)
            out[rest[known]] += escapes[at[known]]
        out[rest] += np.float32(np.log2(self.size))
        return out


def code_lengths(codes: np.ndarray, counts: np.ndarray, size: int = ALPHABET) -> np.ndarray:
    """Bits of every sign after every context of ORDER signs, under one language: a full listing of a small alphabet."""
    return Trees([(codes, counts)], size).bits(np.arange(size ** (ORDER + 1))).ravel()


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Predictor:
    """A model as tasks use it: ``batch`` names the language and its score for every row of a batch."""

    def __init__(self, spark, model: tuple):
        self.key = uuid.uuid4().hex
        self.shared = spark.sparkContext.broadcast(model)  # bounded by nodes and languages

    def batch(self, batch: pa.RecordBatch) -> tuple[list[str], list[float]]:
        names, trees = _trees(self.key, self.shared)
        best, score = [], []
        for _, texts in chunks(batch):
            for text in texts:
                if not names or not _has_letter(text):
                    best.append("und")
                    score.append(0.0)
                    continue
                bits = np.zeros(len(names))
                for lo in range(0, len(text), STEP):
                    part = LOWER[np.frombuffer(text, np.uint8)[max(lo - ORDER, 0) : lo + STEP]]
                    bits += trees.bits(_context_codes(part, BYTES)[min(lo, ORDER) :]).sum(axis=0, dtype=np.float64)
                k = int(np.argmin(bits))
                best.append(names[k])
                score.append(float(1 / np.exp2(np.clip(bits[k] - bits, -1000, 0)).sum()))
        return best, score


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, lang_pred, score (the share of the best language in the sum of all likelihoods)."""
    predictor = Predictor(docs.sparkSession, model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = predictor.batch(batch)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            columns = [ids, pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predicted, RESULT)


_made: dict = {}


def _trees(key: str, shared):
    """The trees of a model, made once for each Python worker."""
    if key not in _made:
        languages, counts = shared.value
        _made.clear()
        _made[key] = (languages, Trees(counts))
    return _made[key]


def _model(docs: DataFrame):
    return learn(sample(docs.where(crc_remainder("doc_id", 4) != 2)))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, _model(docs))
    return found.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def stage_language_id(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """First stage of the pipeline: documents without a recognised language go, the rest stay as they are."""
    predictor = Predictor(spark, _model(docs))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = predictor.batch(batch)
            yield batch.filter(pa.array([b != "und" and s >= least for b, s in zip(best, score)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
