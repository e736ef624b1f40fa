"""Operator 3: language-model scores from an Elias-Fano n-gram trie in memory-mapped levels.

Method: words and one end sign per text are counted over all training texts. Level 1 is the sorted
vocabulary (64-bit word hashes); a word's id is its rank. Level 2 holds, for each word in order of
id, the sorted ids of the words seen after it at least ``least`` times (op3_lm_scores: 1, so all that
were seen; more prunes the model); level 3 holds, for each pair of
level 2, which followers of its second word follow the pair, as positions among that word's own
followers (context-relative ids). The starts of these runs are monotone and kept in Elias-Fano code
(low bits packed, high bits in unary with a directory of counts). Probabilities are absolutely
discounted and interpolated with the shorter context, so that each context sums to one; they and
the back-off weights are quantised to 256 values a shard. A look-up goes from the word before to its
run, finds the successor by binary search, and from that pair to the third word by its relative id.

Levels are cut into shards by context, built in parallel: tasks count distinct n-grams of their
texts, the counts of a shard meet in one task (the number of shards grows with the tokens), and its
arrays become files in the shared folder. Scoring tasks map these files into memory, so that all
workers of a machine share the pages they touch; on a store that cannot be mapped a worker maps an
unlinked local copy. A frequent word arrives as one entry per task and distinct follower, not per use.

Null and empty texts consist of the end sign. Without training texts every probability is one.
Repeated rows are learned from and scored each. Ties do not occur. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import io
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.llm.common import crc_remainder, stored
from riskmill.llm.textbytes import chunks, words
from riskmill.session import scratch_path

DISCOUNT, LEAST = 0.75, 2
WORDS_A_SHARD, TOKENS_A_SHARD, HELD, SLICE = 1 << 20, 3 << 20, 1 << 20, 1 << 20
END = np.uint64(0x656E64206F662074)
_FIELD = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NTH = np.array([[[b for b in range(8) if i >> b & 1][k] if k < bin(i).count("1") else 0 for k in range(8)] for i in range(256)], np.uint8)


class EliasFano:
    """A monotone array in about 2 + log2(largest / n) bits a value, with vectorised access."""

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        shift = max((top // max(n, 1)).bit_length() - 1, 0)
        low = (values & ((1 << shift) - 1)).astype(np.uint64)
        bits = ((low[:, None] >> np.arange(shift, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) // 64 * 64 + 64, np.uint8)
        high[ones] = 1
        high = np.packbits(high, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(_ONES[high].reshape(-1, 8).sum(axis=1, dtype=np.int64))])
        return {
            "low": np.packbits(bits.ravel(), bitorder="little") if shift else np.zeros(0, np.uint8),
            "high": high,
            "ranks": ranks[:-1].astype(np.uint32 if n < 1 << 32 else np.uint64),
            "shift": np.array([shift]),
        }

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ranks = arrays["low"], arrays["high"], arrays["ranks"]
        self.shift = int(arrays["shift"][0])

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ranks, i, "right") - 1
        rest, byte = i - self.ranks[word].astype(np.int64), word * 8
        for _ in range(7):
            ones = _ONES[self.high[byte]]
            skip = rest >= ones
            rest -= np.where(skip, ones, 0)
            byte += skip
        ones = byte * 8 + _NTH[self.high[byte], rest]
        value = (ones - i) << self.shift
        for b in range(self.shift):
            at = i * self.shift + b
            value |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return value


def quantised(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a byte and their values: the means of equally filled bins."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, levels + 1)[1:-1]))
    codes = np.searchsorted(edges, values, "left").astype(np.uint8)
    sums, n = np.bincount(codes, values, len(edges) + 1), np.bincount(codes, minlength=len(edges) + 1)
    return codes, (sums / np.maximum(n, 1)).astype(np.float32)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as files below ``uri``; a repeated task replaces equal content."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    for name, array in arrays.items():
        buffer = io.BytesIO()
        np.save(buffer, np.ascontiguousarray(array))
        part = f"{path}/{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(buffer.getbuffer())
        store.move(part, f"{path}/{name}.npy")


def mapped(uri: str, name: str) -> np.ndarray:
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    with tempfile.NamedTemporaryFile() as copy:  # gone from the folder at once, mapped as long as it is used
        with store.open_input_stream(f"{path}/{name}.npy") as source:
            while block := source.read(1 << 24):
                copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


class Model:
    """The levels of one model as a worker sees them; ``sizes``: what the driver knows about the shards."""

    def __init__(self, path: str, bits: int, offsets: list[int], total: int, texts: int, shards: int):
        self.path, self.bits, self.total, self.texts, self.shards = path, bits, total, texts, shards
        self.offsets = np.array(offsets, np.int64)
        self.size = int(self.offsets[-1])
        self.first = np.array([s * (self.size + 1) // shards for s in range(shards + 1)], np.int64)
        self._files: dict = {}

    def file(self, level: str, shard: int, name: str) -> np.ndarray:
        key = (level, shard, name)
        if key not in self._files:
            self._files[key] = mapped(f"{self.path}/{level}/{shard}", name)
        return self._files[key]

    def runs(self, level: str, shard: int) -> EliasFano:
        key = (level, shard)
        if key not in self._files:
            self._files[key] = EliasFano({n: self.file(level, shard, n) for n in ("low", "high", "ranks", "shift")})
        return self._files[key]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct word hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for shard, lo, hi in _slices((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            if self.offsets[shard] == self.offsets[shard + 1]:
                continue
            known = self.file("1", shard, "words")
            at = np.minimum(np.searchsorted(known, hashes[lo:hi]), len(known) - 1)
            found = known[at] == hashes[lo:hi]
            ids[lo:hi] = np.where(found, self.offsets[shard] + at, -1)
            counts[lo:hi] = np.where(found, self.file("1", shard, "counts")[at], 0)
        return ids, counts

    def shard_of(self, context: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, context, "right") - 1

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by id, in ascending order of ids; the start sign (id = size) counts the texts."""
        out = np.full(len(ids), self.texts, np.int64)
        for shard, lo, hi in _slices(np.searchsorted(self.offsets, ids, "right") - 1):
            if shard < len(self.offsets) - 1:
                out[lo:hi] = self.file("1", shard, "counts")[ids[lo:hi] - self.offsets[shard]]
        return out

    def pairs(self, context: np.ndarray, word: np.ndarray):
        """For each (context, word): shard, node in it (-1: none), relative id, log10 p (nan: none), log10 back-off."""
        n = len(context)
        shard_of = np.where(context < 0, 0, self.shard_of(context))
        node, relative = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        p, back = np.full(n, np.nan), np.zeros(n)
        order = np.argsort(np.where(context < 0, -1, shard_of), kind="stable")
        for shard, lo, hi in _slices(np.where(context < 0, -1, shard_of)[order]):
            if shard < 0:
                continue
            rows = order[lo:hi]
            local = context[rows] - self.first[shard]
            back[rows] = self.file("2", shard, "backs")[self.file("2", shard, "back")[local]]
            some = back[rows] < 0  # a context that leaves all to the shorter one has no followers here
            rows, local = rows[some], local[some]
            runs = self.runs("2", shard)
            distinct, inverse = np.unique(local, return_inverse=True)
            begin, end = runs.get(distinct)[inverse], runs.get(distinct + 1)[inverse]
            followers = self.file("2", shard, "followers")
            at = _successor(followers, begin, end, word[rows])
            found = at < end
            found[found] = followers[at[found]] == word[rows][found]
            rows, at = rows[found], at[found]
            node[rows], relative[rows] = at, at - begin[found]
            p[rows] = self.file("2", shard, "ps")[self.file("2", shard, "p")[at]]
        return shard_of, node, relative, p, back

    def triples(self, shard_of: np.ndarray, node: np.ndarray, relative: np.ndarray):
        """For each (pair node, relative id; -1: no such pair): log10 p (nan: none), log10 back-off of the pair."""
        p, back = np.full(len(node), np.nan), np.zeros(len(node))
        some = np.flatnonzero(node >= 0)
        some = some[np.argsort(shard_of[some], kind="stable")]
        for shard, lo, hi in _slices(shard_of[some]):
            rows = some[lo:hi]
            back[rows] = self.file("3", shard, "backs")[self.file("3", shard, "back")[node[rows]]]
            rows = rows[(back[rows] < 0) & (relative[rows] >= 0)]
            runs = self.runs("3", shard)
            begin, end = runs.get(node[rows]), runs.get(node[rows] + 1)
            followers = self.file("3", shard, "followers")
            at = _successor(followers, begin, end, relative[rows])
            found = at < end
            found[found] = followers[at[found]] == relative[rows][found]
            p[rows[found]] = self.file("3", shard, "ps")[self.file("3", shard, "p")[at[found]]]
        return p, back

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + 1.0) - np.log10(self.total + self.size + 1.0)


def _slices(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    starts = [0, *cuts.tolist()] if len(sorted_values) else []
    for lo, hi in zip(starts, [*cuts.tolist(), len(sorted_values)]):
        yield int(sorted_values[lo]), lo, hi


def _successor(values: np.ndarray, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first place in [begin, end) whose value is at least the wanted one (``end``: none)."""
    lo, hi = begin.copy(), end.copy()
    active = np.flatnonzero(lo < hi)
    while len(active):
        a, b = lo[active], hi[active]
        middle = (a + b) >> 1
        less = values[middle] < wanted[active]
        lo[active] = np.where(less, middle + 1, a)
        hi[active] = np.where(less, b, middle)
        active = active[lo[active] < hi[active]]
    return lo


@functools.lru_cache(maxsize=1)
def opened(path: str, bits: int, offsets: tuple, total: int, texts: int, shards: int) -> Model:
    return Model(path, bits, list(offsets), total, texts, shards)


def sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end sign after each text, and each text's number of tokens."""
    hashes, counts = words(texts)
    return np.insert(hashes, np.cumsum(counts), END), counts + 1


def _known(model: Model, texts: list[bytes]):
    """ids, counts of all tokens, each text's number of tokens, and the id before each token (start sign: size)."""
    hashes, sizes = sequence(texts)
    distinct, inverse = np.unique(hashes, return_inverse=True)
    ids, counts = model.words(distinct)
    ids, counts = ids[inverse], counts[inverse]
    before = np.concatenate([[model.size], ids[:-1]])
    before[np.cumsum(sizes)[:-1]] = model.size
    return ids, counts, sizes, before


class _Tally:
    """Distinct keys and their counts over a task, let go in sorted runs when many are held."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        return self.held > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _summed(self.keys, self.counts)
        self.__init__()
        return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _planes(values: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, which the shuffle's compression shrinks."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


RUNS = "shard int, keys binary, counts binary"


def _runs_of(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    rows = [(s, _planes(keys[lo:hi]), counts[lo:hi].astype("<u4").tobytes()) for s, lo, hi in _slices(shards)]
    columns = list(zip(*rows)) or [[], [], []]
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "keys", "counts"])


def _group(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _summed([_from_planes(k) for k in rows["keys"]], [np.frombuffer(c, "<u4").astype(np.int64) for c in rows["counts"]])


def build(train: DataFrame, path: str | None = None, least: int = LEAST) -> tuple:
    """Count, smooth and write all levels, with the n-grams seen ``least`` times or more; returns the arguments of ``opened``."""
    spark = train.sparkSession
    path = path or scratch_path(spark, "trie")
    path = path if "://" in path or path.startswith("/") else "/" + path.split(":", 1)[-1].lstrip("/")
    train = train.select("text")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for _, texts in chunks(batch, limit=SLICE):
                if tally.add(sequence(texts)[0]):
                    yield rows(*tally.take())
        yield rows(*tally.take())

    def rows(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])

    counted = train.mapInArrow(words_of, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "words")
    size, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = counted.where(F.col("word") == int(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max((size // WORDS_A_SHARD).bit_length(), 1)
    shards = max(total // TOKENS_A_SHARD, 4)

    def vocabulary(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["word"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        counts = rows["n"].to_numpy()[order]
        save(f"{path}/1/{rows['shard'].iloc[0]}", {"words": keys[order], "counts": counts.astype(np.uint32 if counts.max() < 2**32 else np.uint64)})
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "n": [len(rows)]})

    parts = counted.withColumn("shard", F.shiftrightunsigned("word", 64 - bits).cast("int"))
    made = dict(map(tuple, parts.groupBy("shard").applyInPandas(vocabulary, "shard int, n bigint").collect()))
    offsets = tuple(np.concatenate([[0], np.cumsum([made.get(s, 0) for s in range(1 << bits)])]).astype(int).tolist())
    model = (path, bits, offsets, int(total), int(texts), int(shards))

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tally = opened(*model), _Tally()

        def out():
            keys, counts = tally.take()
            return _runs_of(own.shard_of((keys >> _FIELD).astype(np.int64)), keys, counts)

        for batch in batches:
            for _, texts in chunks(batch, limit=SLICE):
                ids, counts, _, before = _known(own, texts)
                often = counts >= least
                often &= np.concatenate([[True], often[:-1]]) | (before == own.size)
                if tally.add(before[often].astype(np.uint64) << _FIELD | ids[often].astype(np.uint64)):
                    yield out()
        yield out()

    def level2(rows: pd.DataFrame) -> pd.DataFrame:
        own, shard = opened(*model), int(rows["shard"].iloc[0])
        keys, counts = _group(rows)
        keys, counts = keys[counts >= least], counts[counts >= least]
        context, word = (keys >> _FIELD).astype(np.int64), (keys & _LOW).astype(np.int64)
        local = context - own.first[shard]
        n = int(own.first[shard + 1] - own.first[shard]) + (shard == own.shards - 1)
        of_context = own.count_of(np.arange(own.first[shard], own.first[shard] + n))
        kept = (counts - DISCOUNT) / of_context[local]
        back = np.maximum(1 - np.bincount(local, kept, n), 1e-6)
        distinct, inverse = np.unique(word, return_inverse=True)
        unigram = 10 ** own.log_unigram(own.count_of(distinct))[inverse]
        _level(f"{path}/2/{shard}", local, n, word, kept + back[local] * unigram, back, {"pair_counts": counts.astype(np.uint32)})
        return pd.DataFrame({"shard": [shard], "n": [len(keys)]})

    def triples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tally = opened(*model), [_Tally() for _ in range(own_shards)]

        def out(shard: int):
            keys, counts = tally[shard].take()
            return _runs_of(np.full(len(keys), shard), keys, counts)

        for batch in batches:
            for _, texts in chunks(batch, limit=SLICE):
                ids, _, sizes, before = _known(own, texts)
                shard_of, node, relative, _, _ = own.pairs(np.where(ids < 0, -1, before), ids)
                node_before = np.concatenate([[-1], node[:-1]])
                node_before[np.cumsum(sizes)[:-1]] = -1
                rows = np.flatnonzero((node >= 0) & (node_before >= 0))
                of = shard_of[rows - 1]
                keys = node_before[rows].astype(np.uint64) << _FIELD | relative[rows].astype(np.uint64)
                order = np.argsort(of, kind="stable")
                for shard, lo, hi in _slices(of[order]):
                    tally[shard].add(keys[order[lo:hi]])
                if sum(t.held for t in tally) > HELD:
                    yield from (out(s) for s in range(own_shards) if tally[s].held)
        yield from (out(s) for s in range(own_shards) if tally[s].held)

    own_shards = int(shards)

    def level3(rows: pd.DataFrame) -> pd.DataFrame:
        own, shard = opened(*model), int(rows["shard"].iloc[0])
        keys, counts = _group(rows[rows["keys"].notna()])
        keys, counts = keys[counts >= least], counts[counts >= least]
        node, relative = (keys >> _FIELD).astype(np.int64), (keys & _LOW).astype(np.int64)
        of_pair = own.file("2", shard, "pair_counts")
        kept = (counts - DISCOUNT) / of_pair[node]
        back = np.maximum(1 - np.bincount(node, kept, len(of_pair)), 1e-6)
        second = own.file("2", shard, "followers")[node].astype(np.int64)
        lower = np.zeros(len(node))
        order = np.argsort(own.shard_of(second), kind="stable")
        for other, lo, hi in _slices(own.shard_of(second)[order]):
            part = order[lo:hi]
            at = own.runs("2", other).get(second[part] - own.first[other]) + relative[part]
            lower[part] = 10.0 ** own.file("2", other, "ps")[own.file("2", other, "p")[at]]
        _level(f"{path}/3/{shard}", node, len(of_pair), relative, kept + back[node] * lower, back, {})
        return pd.DataFrame({"shard": [shard], "n": [len(keys)]})

    # an empty run for each shard, so that every shard gets its files
    empty = spark.range(own_shards).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"))
    for scan, level in ((pairs_of, level2), (triples_of, level3)):
        found = train.mapInArrow(scan, RUNS).union(empty)
        found.groupBy("shard").applyInPandas(level, "shard int, n bigint").agg(F.sum("n")).collect()
    return model


def _level(uri: str, context: np.ndarray, n: int, follower: np.ndarray, p: np.ndarray, back: np.ndarray, more: dict) -> None:
    starts = np.searchsorted(context, np.arange(n + 1))
    p_codes, ps = quantised(np.log10(p))
    backs = np.zeros(256, np.float32)  # the last code is for contexts without followers here: all is left, exactly
    less = np.flatnonzero(back < 1)
    back_codes = np.full(len(back), 255, np.uint8)
    back_codes[less], values = quantised(np.log10(back[less]), 255)
    backs[: len(values)] = values
    small = np.uint16 if not len(follower) or follower.max() < 1 << 16 else np.uint32
    arrays = {"followers": follower.astype(small), "p": p_codes, "ps": ps, "back": back_codes, "backs": backs}
    save(uri, arrays | EliasFano.encode(starts) | more)


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (unigrams) and score (all levels) of every whole text, in log10."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(*model)
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in chunks(batch, limit=SLICE):
                ids, counts, sizes, before = _known(own, texts)
                base = own.log_unigram(counts)
                shard_of, node, relative, p, back = own.pairs(before, ids)
                p = np.where(node >= 0, p, back + base)
                starts = np.cumsum(sizes) - sizes
                pair = np.concatenate([[-1], node[:-1]])
                pair[starts] = -1
                p3, back3 = own.triples(np.concatenate([[0], shard_of[:-1]]), pair, np.where(node >= 0, relative, -1))
                p = np.where(np.isnan(p3), np.where(pair >= 0, back3, 0.0) + p, p3)
                columns = [
                    pa.array(sizes),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(p, starts)),
                ]
                yield pa.RecordBatch.from_arrays([names.slice(first, len(texts)), *columns], names=[f.split()[0] for f in SCORES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(scored, SCORES)


def op3_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = build(docs.where(crc_remainder("doc_id", 7) != 2), least=1)
    return score(docs, model).select(
        "doc_id",
        (crc_remainder("doc_id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model[3]).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
