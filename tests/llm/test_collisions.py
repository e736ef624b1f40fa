"""Collisions are counted 64 vectors at a time, with the same outcome as one by one."""

import time

import numpy as np

from riskmill.llm import ann


def windows(n, queries, seed=4):
    rng = np.random.default_rng(seed)
    runs = rng.integers(0, ann.BUCKETS, (ann.PROJECTIONS, n)).astype(np.uint8)
    ends = np.sort(rng.integers(0, ann.BUCKETS + 1, (2, ann.PROJECTIONS, queries)), axis=0)
    return runs, ends[0], ends[1]


def plainly(runs, first, after, least):
    out = []
    for lo, hi in zip(first.T, after.T):
        out.append(((runs >= lo[:, None]) & (runs < hi[:, None])).sum(axis=0) >= least)
    return np.array(out)


def test_counts_in_words_equal_plain_counts():
    for n, least in ((1, 1), (63, 50), (64, 64), (1000, 53), (1000, 1), (1000, ann.PROJECTIONS)):
        runs, first, after = windows(n, 9)
        bits = ann._colliding(ann._below(runs), first, after, least).view(np.uint8)
        got = np.unpackbits(bits, axis=1, bitorder="little")
        assert (got[:, :n] == plainly(runs, first, after, least)).all() and not got[:, n:].any(), (n, least)


def test_counts_in_words_cost_a_part_of_plain_counts():
    runs, first, after = windows(8192, 128)
    below, seconds = ann._below(runs), []
    for count in (lambda: ann._colliding(below, first, after, 60), lambda: plainly(runs, first, after, 60)):
        start = time.process_time()
        count()
        seconds.append(time.process_time() - start)
    assert 3 * seconds[0] < seconds[1], seconds


def test_equal_vectors_are_all_found():
    rng = np.random.default_rng(5)
    x = np.vstack([np.ones((300, 8)), rng.standard_normal((700, 8))])
    (ids, scores), (own, _) = ann.BlockIndex(np.arange(1000), x).search(np.array([5, 400]), x[[5, 400]], 20)
    assert (np.diff(scores) <= 0).all() and len(ids) == 20
    score = x @ x[5]
    score[5] = -np.inf
    assert np.allclose(scores, np.sort(score)[::-1][:20]) and 400 not in own
    tied = ids[np.isclose(scores, 8)]
    assert tied.tolist() == [i for i in range(21) if i != 5][: len(tied)]
