"""Operator 8: approximate nearest neighbours by collision-counting hashing.

Method: nearness is the inner product, turned into distance by one more coordinate (a vector is
scaled by the largest norm and padded to length one, a query is scaled to length one and padded
with zero). The index sorts each block of vectors along each of ``PROJECTIONS`` random lines and cuts a line into
``BUCKETS`` runs of equally many. A query's window on each line is
centred on its own position and widened by virtual rehashing (``WIDEN`` times the radius each round, out to whole runs)
without building anything anew; a vector counts one collision for each line whose window holds it, 64 vectors at a time as bits. Vectors
with ``THRESHOLD`` collisions or more are verified on the original coordinates. A query stops
when it has verified ``enough`` vectors of the block (a multiple of k), so its best k are safe with
the documented recall; windows of the last round hold the block whole, so k are found if there are.

Scaling by a norm far above the others would squeeze all of them together, so vectors are dealt into
shells whose norms differ by a factor of ``SHELL`` at most. Each shell has its own index and scale, and
is searched from the longest to the shortest; a query leaves a shell out only if its k-th score so far
exceeds its own norm times the shell's largest, which nothing in the shell can pass. A block holds neighbouring
small shells, or a share (by hash of id) of a large one.

Blocks of queries meet blocks of vectors (the query set is stated, so this is a search in blocks, no
cross join of rows); each pair of blocks gives k rows a query, merged per query by rank. Blocks are
bounded by ``BLOCK`` rows whatever the input.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part. Ties go to the smaller id; repeated ids are one candidate each; extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD, BLOCK, QUERY_BLOCK = 160, 0.5, 24576, 1024
FIRST_RADIUS, WIDEN, SHARE, SHELL = 0.5, 1.12, 0.13, 1.15
BUCKETS, COUNTED = 64, 24576  # runs of a line; words of 64 bits that are counted at once
TINY = 1e-150  # norms whose squares vanish count as this
FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, v of the vectors that take part, in double precision."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull())
    return rows.where(v.isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _unit(v: np.ndarray, largest: float) -> np.ndarray:
    scaled = v / largest
    return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))])


class BlockIndex:
    """The projections of one block of vectors, each line cut into ``BUCKETS`` runs of equally many.

    For each line and cut a bit string tells which vectors lie below the cut, so a window is the difference of two of them.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, share: float = SHARE, seed: int = 8):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.largest = max(np.linalg.norm(self.vectors, axis=1).max(), TINY)
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((PROJECTIONS, vectors.shape[1] + 1))
        places = self.lines @ _unit(self.vectors, self.largest).T
        at = np.arange(1, BUCKETS) * len(ids) // BUCKETS
        self.cuts = np.sort(places, axis=1)[:, at]
        runs = np.array([np.searchsorted(c, p, "right") for c, p in zip(self.cuts, places)]).astype(np.uint8)
        self.below, self.some = _below(runs), _below(runs[:, ::8])
        self.share = share

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the best k found of each query; all queries widen their windows in step."""
        n, most = len(self.ids), len(queries)
        lengths = np.linalg.norm(queries, axis=1)
        centred = self.lines @ np.hstack([queries / lengths[:, None], np.zeros((most, 1))]).T
        enough = max(50 * k, int(self.share * n))
        found: list = [None] * most
        # on every eighth vector each query finds the radius at which the share is reached; the block is then
        # counted at that radius, and wider where it still holds too few
        radii = np.full(most, FIRST_RADIUS)
        self._widen(self.some, centred, radii, lambda i, close: np.bitwise_count(close).sum() >= self.share * n / 8)

        def settle(i: int, close: np.ndarray) -> bool:
            close = np.flatnonzero(np.unpackbits(close.view(np.uint8), count=n, bitorder="little"))
            close = close[self.ids[close] != query_ids[i]]
            verified = len(close)
            if verified > k:
                # a product in any order tells all but those near the k-th; their scores are summed in order
                rough = self.vectors[close] @ queries[i]
                doubt = 4e-16 * (queries.shape[1] + 8) * self.largest * lengths[i]
                close = close[~(rough < np.partition(rough, -k)[-k] - 2 * doubt)]
            score = _products(self.vectors[close], queries[i])
            best = np.lexsort((self.ids[close], -score))[:k]
            found[i] = (self.ids[close][best], score[best])
            return verified >= enough

        self._widen(self.below, centred, radii, settle)
        return found

    def _widen(self, below: np.ndarray, centred: np.ndarray, radii: np.ndarray, done) -> None:
        """Widen the windows of each query until ``done`` with the vectors of enough collisions, or all are inside."""
        least = int(np.ceil(THRESHOLD * PROJECTIONS))
        step = max(16, COUNTED // below.shape[2])
        waiting = np.arange(len(radii))
        while len(waiting):
            left = []
            for lo in range(0, len(waiting), step):
                some = waiting[lo : lo + step]
                c, r = centred[:, some], radii[some]
                # a window grows by whole runs: those that hold its ends are inside
                first = np.array([np.searchsorted(t, v - r, "right") for t, v in zip(self.cuts, c)])
                after = np.array([np.searchsorted(t, v + r, "right") + 1 for t, v in zip(self.cuts, c)])
                whole = (first.max(axis=0) == 0) & (after.min(axis=0) == BUCKETS)
                for i, all_in, close in zip(some.tolist(), whole, _colliding(below, first, after, least)):
                    if not done(i, close) and not all_in:
                        left.append(i)
            waiting = np.array(left, np.int64)
            radii[waiting] *= WIDEN


def _below(runs: np.ndarray) -> np.ndarray:
    """line, run, words of 64 bits: which vectors lie in an earlier run."""
    lines, n = runs.shape
    out = np.zeros((lines, BUCKETS + 1, -(-n // 64) * 8), np.uint8)
    before = np.arange(BUCKETS + 1, dtype=np.uint8)[:, None]
    for line in range(lines):
        out[line, :, : -(-n // 8)] = np.packbits(runs[line] < before, axis=1, bitorder="little")
    return out.view(np.uint64)


def _colliding(below: np.ndarray, first: np.ndarray, after: np.ndarray, least: int) -> np.ndarray:
    """Bits of the vectors that lie in the windows of ``least`` lines or more, for each query.

    64 vectors are counted at once: ``digits[k]`` holds bit strings that each count 2**k, and three of them
    become their sum's two binary digits.
    """
    digits: list[list[np.ndarray]] = [[]]
    for line in range(len(below)):
        inside = below[line].take(after[line], axis=0)
        inside ^= below[line].take(first[line], axis=0)
        digits[0].append(inside)
        k = 0
        while len(digits[k]) == 3:
            _carry(digits, k)
            k += 1
    k = 0
    while k < len(digits):
        while len(digits[k]) > 1:
            _carry(digits, k)
        k += 1
    nothing = np.zeros(first.shape[1:] + below.shape[2:], np.uint64)
    more, same = nothing.copy(), ~nothing
    for k in range(max(len(digits), least.bit_length()) - 1, -1, -1):
        digit = digits[k][0] if k < len(digits) and digits[k] else nothing
        if least >> k & 1:
            same &= digit
        else:
            more |= same & digit
            same &= ~digit
    return more | same


def _carry(digits: list[list[np.ndarray]], k: int) -> None:
    """Two or three bit strings of digit ``k`` become one of them and one of the next."""
    a, b, *rest = digits[k]
    either = a ^ b
    a &= b
    if rest:
        digits[k] = [either ^ rest[0]]
        either &= rest[0]
        a |= either
    else:
        digits[k] = [either]
    if k + 1 == len(digits):
        digits.append([])
    digits[k + 1].append(a)


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in order of the components: the same digits for any block or order."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * query[j]
    return total


def _shells(v: np.ndarray) -> np.ndarray:
    """The shell of each vector; norm 1 lies in the middle of shell 0, so that rounding does not split unit vectors."""
    return np.floor(np.log(np.maximum(np.linalg.norm(v, axis=1), TINY)) / np.log(SHELL) + 0.5).astype(np.int64)


def _search_block(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int, share: float) -> list:
    """Ids and scores of the best k found of each query in a block, shell by shell."""
    shells, lengths = _shells(vectors), np.linalg.norm(queries, axis=1)
    found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in asked]
    for shell in np.unique(shells)[::-1]:
        rows = np.flatnonzero(shells == shell)
        index = BlockIndex(ids[rows], vectors[rows], share)
        bounds = lengths * index.largest * (1 + 1e-9)
        open_ = [i for i, (_, s) in enumerate(found) if len(s) < k or s[k - 1] <= bounds[i]]
        if not open_:
            continue
        for i, (more, scores) in zip(open_, index.search(asked[open_], queries[open_], k)):
            more, scores = np.concatenate([found[i][0], more]), np.concatenate([found[i][1], scores])
            best = np.lexsort((more, -scores))[:k]
            found[i] = more[best], scores[best]
    return found


def _blocks(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """shell, first block, number of blocks: neighbouring shells share a block as long as it is not full."""
    out, block, held = [], -1, BLOCK
    for shell in sorted(counts):
        n = counts[shell]
        if held + n <= BLOCK:
            out.append((shell, block, 1))
            held += n
        else:
            parts = -(-n // BLOCK)
            out.append((shell, block + 1, parts))
            block, held = block + parts, n if parts == 1 else BLOCK
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. Inputs have id, v."""
    spark = vectors.sparkSession
    width = vectors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fits = F.size("v") == width["w"]
    asked = queries.where(fits).count()
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)), F.lit(TINY))
    rows = vectors.where(fits).withColumn("shell", F.floor(F.log(norm) / F.log(F.lit(SHELL)) + 0.5).cast("bigint"))
    # at most one row for each power of SHELL that a double can hold
    counts = {r["shell"]: r["count"] for r in rows.groupBy("shell").count().collect()}
    dealt = _blocks(counts)
    blocks, slices = max((b + n for _, b, n in dealt), default=0), max(-(-asked // QUERY_BLOCK), 1)
    places = F.broadcast(spark.createDataFrame(dealt, "shell bigint, base bigint, parts bigint"))
    rows = rows.join(places, "shell").select(
        F.col("id").alias("id"), F.col("v").alias("v"), (F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")
    )
    # every block of vectors meets every slice of queries
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asks = queries.where(fits).withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(slices)).cast("int"))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        right = right.sort_values("id")
        asked = right["id"].to_numpy()
        held = left["id"].to_numpy(), np.stack(left["v"].to_numpy())
        best = _search_block(*held, asked, np.stack(right["v"].to_numpy()), k, share)
        ids, scores = (np.concatenate(x) for x in zip(*best))
        return pd.DataFrame({"query_id": np.repeat(asked, [len(x) for x, _ in best]), "vec_id": ids, "score": scores})

    found = rows.groupBy("block", "slice").cogroup(asks.groupBy("block", "slice")).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return nearest(rows, rows.where("id % 20 = 0"))
