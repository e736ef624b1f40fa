"""Vector codes against a full-scan Lloyd in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from riskmill.llm import vector_codes

ROWS = "vec_id bigint, embedding array<float>, label int, code string, v int"


def brute(rows, entries, rounds, width):
    kept = [(i, e, lab) for i, e, lab, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e] + [0] * (width - len(e)), lab) for i, e, lab in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // 4
    books = [[r[1][p * w : p * w + w] for r in kept[:entries]] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(r[1][p * w : p * w + w], books[p]) for p in range(4)] for r in kept]
        for p in range(4) if turn < rounds else ():
            for j in range(len(books[p])):
                own = [r[1][p * w : p * w + w] for r, f in zip(kept, found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    totals = {}
    for r, f in zip(kept, found):
        totals[r[2]] = totals.get(r[2], 0) + sum(d for d, _ in f)
    return sorted((r[0] is None, r[0] or 0, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), totals[r[2]], sha) for r, f in zip(kept, found))


def vectors(n=300, width=10, seed=1, grid=None):
    rng = random.Random(seed)
    draw = (lambda: rng.gauss(0, 1)) if grid is None else (lambda: rng.randrange(grid) / 1024)
    rows = [(i * 3 % n, [draw() for _ in range(width)], rng.choice([0, 0, 0, 1, None]), "x", 9) for i in range(n)]
    rows += [rows[0], rows[1], (4000, None, 1, "", 0), (4001, [1.0, None], 1, "", 0), (4002, [float("nan")] * width, 0, "", 0)]
    rows += [(4003, [float("-inf")] * width, 0, "", 0), (4004, [], 0, None, 0), (4005, [-0.0001, 1.0], None, None, None)]
    return [*rows, (None, [0.5] * width, 1, "", 0), (7, [0.25] * width, 1, "", 0)]


def answer(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("entries,rounds,grid", [(16, 4, None), (256, 2, None), (24, 4, 3)])
def test_codes_equal_a_full_scan(spark, entries, rounds, grid):
    rows = vectors(grid=grid)  # with a small grid most distances tie
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert answer(vector_codes.compressed(df, entries=entries, rounds=rounds)) == brute(rows, entries, rounds, 12)


def test_active_entries_cost_less_and_change_nothing():
    rng = np.random.default_rng(5)
    x, book = rng.integers(0, 40, (500, 4)), rng.integers(0, 40, (64, 4))
    code, dist = np.zeros(500, np.int64), np.zeros(500, np.int64)
    full = vector_codes.assign(x, book, code, dist, None)
    moved = np.zeros(64, bool)
    moved[[3, 9]] = True
    book[moved] += 2
    want = vector_codes.distances(x, book)
    assert vector_codes.assign(x, book, code, dist, moved) < full / 8
    assert (code == want.argmin(axis=1)).all() and (dist == want.min(axis=1)).all()


def test_distances_are_exact_at_any_size():
    rng = np.random.default_rng(6)
    for top in (1 << 10, 1 << 26):
        x, book = rng.integers(-top, top, (9, 16)), rng.integers(-top, top, (7, 16))
        assert vector_codes.distances(x, book).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in book] for r in x]


def test_huge_components_and_empty_tables(spark):
    big = spark.createDataFrame([(1, [3e38, -3e38], 1, "", 0), (2, [-3e38, 3e38], 1, "", 0), (3, [0.0, 0.0], 1, "", 0)], ROWS)
    assert [r.error for r in vector_codes.compressed(big).collect()] == [0, 0, 0]
    assert vector_codes.compressed(spark.createDataFrame([], ROWS)).collect() == []


def test_query_keeps_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    found = vector_codes.op13_vector_codes(spark, sf).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found)
    assert got == brute(rows, 256, 4, 64)
