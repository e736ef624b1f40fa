"""Rankings against brute force on small inputs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.operators import retrieval as R

DOCS = [(i, C.EVAL_CLASSES[i % 3], " ".join(f"w{(i * j) % 11} common" for j in range(1, i % 6 + 2))) for i in range(60)]
QUERIES = [(0, "w3 w3 common W5"), (1, "nothing here"), (2, "w0 w1-w2")]


def words(text):
    return [t.lower() for t in re.findall(r"[A-Za-z0-9_]+", text)]


def brute_bm25(query):
    bags = [words(t) for _, _, t in DOCS]
    n, avgdl = len(bags), sum(map(len, bags)) / len(bags)
    df = {}
    for bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    return [
        sum(idf.get(t, 0) * bag.count(t) * 2.5 / (bag.count(t) + 1.5 * (0.25 + 0.75 * len(bag) / avgdl)) for t in words(query)) for bag in bags
    ]


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "id int, defect_class string, text string").repartition(5)
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    want = set()
    for qid, text in QUERIES:
        scores = brute_bm25(text)
        for cls in C.EVAL_CLASSES:
            ranked = sorted((-round(s, 6), d[0]) for s, d in zip(scores, DOCS) if d[1] == cls)[:15]
            want |= {(qid, cls, i, rank, abs(s)) for rank, (s, i) in enumerate(ranked)}
    rows = R.bm25_topk(queries, docs, n=15).collect()
    assert {(r.query_id, r.defect_class, r.id, r["rank"], abs(r.score)) for r in rows} == want


def test_bm25_leaves_hopeless_ranges_unscored_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(R, "_RANGE_ROWS", 60)
    rng = np.random.default_rng(7)
    docs = []
    for i in range(600):
        size = int(rng.integers(1, 400))
        docs.append((i, C.EVAL_CLASSES[i % 3], " ".join(f"w{int(x)}" for x in rng.zipf(1.3, size) if x < 3000) + " common" * (i % 2)))
    asked = [(q, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 6) if x < 3000) + " common") for q in range(25)]
    monkeypatch.setitem(globals(), "DOCS", docs)
    frame = spark.createDataFrame(docs, "id long, defect_class string, text string").repartition(6)
    seen: list = []
    queries = spark.createDataFrame(asked, "query_id int, text string")
    R.bm25_best(queries, frame, C.EVAL_CLASSES, 5, pairs_seen=seen)
    got = {(r.query_id, r.defect_class, r["rank"]): (r.id, r.score) for r in R.bm25_topk(queries, frame, n=5).collect()}
    for q, text in asked:
        scores = brute_bm25(text)
        for cls in C.EVAL_CLASSES:
            for place, (score, i) in enumerate(sorted((-round(s, 6), d[0]) for s, d in zip(scores, docs) if d[1] == cls)[:5]):
                assert abs(got[q, cls, place][1] + score) < 2e-6
    first, rest, every = (frame.count() for frame in seen)
    assert first + rest < every


@pytest.mark.parametrize("exclude", [False, True])
def test_cosine_over_many_blocks(spark, monkeypatch, exclude):
    monkeypatch.setattr(R, "_BLOCK_ROWS", 7)
    monkeypatch.setattr(R, "_QUERY_ROWS", 5)
    monkeypatch.setattr(R, "_STRIPE", 2)
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.normal(size=6).round(2)] for _ in range(70)]
    for i in range(30):
        vectors[i] = vectors[0]  # a third of all vectors are copies
    docs = spark.createDataFrame([(i, "hot" if i < 50 else "cold", v) for i, v in enumerate(vectors)], "id int, defect_class string, vector array<float>")
    queries = docs.select(F.col("id").alias("query_id"), "vector").repartition(3)
    unit = np.array(vectors, dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    want = set()
    for q in range(70):
        for cls, ids in (("hot", range(50)), ("cold", range(50, 70))):
            ranked = sorted((-scores[q, i], i) for i in ids if not (exclude and i == q))[:9]
            want |= {(q, cls, i, rank) for rank, (_, i) in enumerate(ranked)}
    got = R.cosine_topk(queries, docs, n=9, exclude_self=exclude).collect()
    assert {(r.query_id, r.defect_class, r.id, r["rank"]) for r in got} == want


def test_clustered_vectors_leave_most_cells_unscored(spark, monkeypatch):
    monkeypatch.setattr(R, "_BLOCK_ROWS", 40)
    monkeypatch.setattr(R, "_QUERY_ROWS", 20)
    rng = np.random.default_rng(3)
    towards = rng.normal(size=(25, 16))
    vectors = [(towards[i % 25] * (0.2 if i % 3 else 9.0) + rng.normal(size=16) * 0.02 * (0.2 if i % 3 else 9.0)) for i in range(2000)]
    vectors += [np.zeros(16)] * 30
    rows = [(i, f"c{i % 2}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    docs = spark.createDataFrame(rows, "id long, defect_class string, vector array<double>").repartition(4)
    queries = docs.filter("id % 10 = 0 or id >= 2000").select(F.col("id").alias("query_id"), "vector")
    unit = np.array(vectors) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    seen: list = []
    got = {(r.query_id, r.defect_class, r["rank"]): (r.id, r.score) for r in R.cosine_topk(queries, docs, n=12, pairs_seen=seen).collect()}
    asked = [r.query_id for r in queries.collect()]
    assert len(got) == len(asked) * 2 * 12
    for q in asked:
        scores = np.round(unit @ unit[q], 9)
        for c in (0, 1):
            best = sorted((-scores[i], i) for i in range(c, len(vectors), 2))[:12]
            for place, (score, i) in enumerate(best):
                assert abs(got[q, f"c{c}", place][1] + score) < 2e-9, (q, c, place)
    scored = sum(p.count() for p in seen)
    every = len(asked) * 2 * 26
    assert scored < every / 2


def test_cosine_ranks_few_rows_however_many_blocks_there_are(spark, monkeypatch):
    # what is shuffled is n rows for each query and class from a task, not from each pair of blocks
    monkeypatch.setattr(R, "_BLOCK_ROWS", 8)
    monkeypatch.setattr(R, "_QUERY_ROWS", 20)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 6))
    docs = spark.createDataFrame([(i, "c", [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, defect_class string, vector array<double>")
    queries = docs.filter("id < 60").select(F.col("id").alias("query_id"), "vector")
    ranked, rank = [], R._rank
    monkeypatch.setattr(R, "_rank", lambda rows, n, *more: ranked.append(rows) or rank(rows, n, *more))
    got = {(r.query_id, r["rank"]): r.id for r in R.cosine_topk(queries, docs, n=6).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit[:60] @ unit.T, 9)
    assert got == {(q, k): i for q in range(60) for k, i in enumerate(sorted(range(400), key=lambda i: (-scores[q, i], i))[:6])}
    assert ranked[0].count() <= 60 * 6 * 10  # 50 blocks and more


def test_fusion_and_rule_guarantee(spark):
    def ranking(ids):
        return spark.createDataFrame([(0, "A", i, r) for r, i in enumerate(ids)], "query_id int, defect_class string, id string, rank int")

    tiers = spark.createDataFrame([(i, "RULE" if i.startswith("r") else "EXAMPLE", i == "h") for i in "abcdehr"], "id string, tier string, hard_negative boolean")
    fused = R.reciprocal_rank_fusion([ranking("abcder"), ranking("bah")], tiers)
    scores = {r.id: r.score for r in fused.collect()}
    assert scores["a"] == scores["b"] == round(1 / 60 + 1 / 61, 9)
    assert scores["h"] == round(1 / 62 + 0.5 / 60, 9)
    top = {r.place: r.id for r in R.top_with_rule(fused, 4).collect()}
    assert top == {1: "a", 2: "b", 3: "h", 4: "r"}
    assert {r.place: r.id for r in R.top_with_rule(fused, 7).collect()}[7] == "r"
    assert R.cited_rule(R.top_with_rule(fused, 4)).first().cited_rule == "r"
    no_rule = fused.filter("id <> 'r'")
    assert {r.place: r.id for r in R.top_with_rule(no_rule, 3).collect()} == {1: "a", 2: "b", 3: "h"}


def test_reference_block_and_chunks(spark):
    refs = spark.createDataFrame([(0, C.AMOUNT_CURRENCY, "x", 1), (0, C.DUPLICATE_PAYMENT, "y", 2), (0, C.DUPLICATE_PAYMENT, "x", 1)], "query_id int, defect_class string, id string, place int")
    chunks = spark.createDataFrame([("x", "RULE", "a \n  b" + "c" * 300), ("y", "SAFE_PATTERN", "z")], "id string, kind string, text string")
    text = R.reference_block(refs, chunks, C.REFERENCE_CHARS).first().references_text
    line = "- (RULE x) " + ("a b" + "c" * 300)[:200]
    assert text == f"[DUPLICATE_PAYMENT]\n{line}\n- (SAFE_PATTERN y) z\n[AMOUNT_CURRENCY]\n{line}"
    train = spark.createDataFrame(
        [("hn-dp-1", "code", [], False), ("s2", "x" * 2000, ["WEBHOOK_INTEGRITY"], True), ("s3", "  \n", [], False), ("plain", "c", [], False)],
        "sample_id string, content string, classes array<string>, hard_negative boolean",
    )
    got = {r.id: r for r in R.example_chunks(train, C.EXAMPLE_CHARS).collect()}
    assert set(got) == {"ex:hn-dp-1:DUPLICATE_PAYMENT:safe", "ex:s2:WEBHOOK_INTEGRITY", *[f"ex:plain:{c}:safe" for c in C.EVAL_CLASSES]}
    assert got["ex:s2:WEBHOOK_INTEGRITY"].text == "UNSAFE WEBHOOK_INTEGRITY example:\n" + "x" * 1600
    assert got["ex:hn-dp-1:DUPLICATE_PAYMENT:safe"].hard_negative and got["ex:s2:WEBHOOK_INTEGRITY"].hard_negative
