"""Operator 1: quality classifier, Naive Bayes support vectors.

Method: features are indicators of byte n-grams (1 to 3 bytes of the whole text as it stands, so
case and signs count), hashed into ``HASHED`` places, and of word runs by their form: how many words
repeat the one before, and what share of the words is distinct, in steps. Each indicator is scaled by its class
log-count ratio (smoothed Naive Bayes), and a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent (L2-regularised, L1 hinge). The weights are mixed with their
mean size as Naive Bayes support vectors prescribe, and a logistic curve fitted on rows kept out
of the descent turns margins into scores.

Learning takes at most ``SAMPLE`` labelled texts of each class, those of least hash of doc_id: a
documented bound. Scoring covers every whole text; a text's indicators are one flag array.

Null and empty texts have no n-gram and get the score of margin ``bias``. A missing label is not
learned from; several labels of a document count each. If only one class or none is labelled, every
score is the smoothed share of label 1. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmill.llm.common import crc_remainder
from riskmill.llm.textbytes import chunks, words

HASHED, STEPS = 1 << 17, 24
DIMENSIONS = HASHED + 2 * STEPS
SAMPLE = 2000
ALPHA, COST, MIXTURE, EPOCHS = 1.0, 0.1, 0.25, 15
THRESHOLD = 0.3


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct features of each text."""
    hashes, counts = words(texts)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        own = hashes[at : at + n]
        at += n
        yield np.concatenate([indicators(text), forms(own)])


def forms(hashes: np.ndarray) -> np.ndarray:
    """Indicators of the form of a run of words; every step includes those below, none for no words."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    repeats = np.count_nonzero(hashes[1:] == hashes[:-1]) / len(hashes)
    distinct = len(np.unique(hashes)) / len(hashes)
    steps = [int(np.ceil(repeats * STEPS)), int(np.ceil((1 - distinct) * STEPS))]
    return np.concatenate([HASHED + i * STEPS + np.arange(min(k, STEPS)) for i, k in enumerate(steps)])


def indicators(text: bytes) -> np.ndarray:
    """Sorted distinct byte n-gram features of a text."""
    flags = np.zeros(HASHED, bool)
    step = 1 << 20
    for lo in range(0, len(text), step):
        part = np.frombuffer(text, np.uint8)[lo : lo + step + 2].astype(np.uint32)
        code = part
        for n in range(1, 4):
            if n > 1:
                code = (code[:-1] << np.uint32(8)) | part[n - 1 :]
            flags[_place(code, n)] = True
    return np.flatnonzero(flags)


def _place(code: np.ndarray, n: int) -> np.ndarray:
    return ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - 17)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """At most ``per_class`` labelled texts of each class: doc_id, text, quality."""
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_class)
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id")


def learn(train: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias and the slope and shift of the score from a bounded sample of (text, quality)."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, quality = batch.column(0), batch.column(2)
            for first, texts in chunks(batch):
                rows = [f.astype("<i4").tobytes() for f in features(texts)]
                columns = [ids.slice(first, len(texts)), pa.array(rows, pa.binary()), quality.slice(first, len(texts))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "features", "quality"])

    kind = train.schema["quality"].dataType.simpleString()
    rows = train.select("doc_id", "text", "quality").mapInArrow(featured, f"doc_id bigint, features binary, quality {kind}")
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["quality"]))
    x = [np.frombuffer(r["features"], "<i4") for r in found]
    y = np.array([1.0 if r["quality"] == 1 else -1.0 for r in found])
    return fit(x, y)


def fit(x: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    weights = np.zeros(DIMENSIONS)
    share = (np.sum(y > 0) + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return weights, 0.0, 1.0, float(np.log(share / (1 - share)))
    counts = {c: np.full(DIMENSIONS, ALPHA) for c in (1.0, -1.0)}
    for row, c in zip(x, y):
        counts[c][row] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    kept_out = order[: max(len(x) // 5, 1)]
    used = order[len(kept_out) :] if len(x) > 20 else order
    bias = 0.0
    dual = np.zeros(len(x))
    scaled = [ratio[r] for r in x]
    norm = np.array([v @ v + 1.0 for v in scaled])
    balance = {c: len(used) / (2 * max(np.sum(y[used] == c), 1)) for c in (1.0, -1.0)}
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            gradient = y[i] * (weights[x[i]] @ scaled[i] + bias) - 1
            now = min(max(dual[i] - gradient / norm[i], 0.0), COST * balance[y[i]])
            change = (now - dual[i]) * y[i]
            if change:
                dual[i] = now
                weights[x[i]] += change * scaled[i]
                bias += change
    size = np.abs(weights).mean()
    weights = ((1 - MIXTURE) * size * np.sign(weights) * (weights != 0) + MIXTURE * weights) * ratio
    margin = np.array([weights[x[i]].sum() + bias for i in kept_out])
    return weights, bias, *_logistic(margin, y[kept_out] > 0)


def _logistic(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps on softened targets (Platt)."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.abs(margin).max() or 1.0
    m = np.stack([margin / scale, np.ones_like(margin)])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ m, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))) @ m.T + 1e-3 * np.eye(2), m @ (target - p) - 1e-3 * w)
        w = w + np.clip(step, -5, 5)
    return float(w[0] / scale), float(w[1])


def score(docs: DataFrame, model: tuple[np.ndarray, float, float, float]) -> DataFrame:
    """doc_id, score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, shift = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in chunks(batch):
                margin = np.array([weights[f].sum() + bias for f in features(texts)])
                value = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -700, 700)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(value)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id bigint, score double")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn(sample(docs, labels.where(crc_remainder("doc_id", 5) != 0)))
    return score(docs, model).select(
        "doc_id",
        (crc_remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
