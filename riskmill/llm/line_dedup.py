"""Operator 7: fuzzy line dedup by MinHash, in DataFrame functions only.

Method: a line is compared in lower case without outer white space. Its signature is made of the
minima, under ``BANDS * ROWS`` permutations, of the hashes of all its overlapping character shingles
(``SIZE`` characters from every place; a shorter line: itself), the same that the check uses. Bands
of ``ROWS`` minima propose pairs with high recall, and a pair is a link if the sets of
these shingles have a Jaccard similarity of
``least`` or more. Components of links are found by distributed union-find; of each, the first line
(by doc_id, line number, row) stays and the others are removed. A permutation is one of ``ROWS`` hashes
of a shingle, ints made of 64 bits, each bit of it turned or not by a fixed number. A line is cut into pieces that overlap, so a
piece's ``STEP`` shingles are plain columns of one row, and a minimum is taken of them before it is
taken over rows.

Equal lines, by 128 bits, are one node of the graph from the start, so a line that fills a third of the
table is one row before any pair is made. A node is known by 64 of these bits; of different lines
that share them, one is looked at and the others stay. Blank lines are never removed. Null and empty texts
have no lines. Rows are told apart by a number of their own: of rows that repeat a doc_id each keeps or loses its
own lines, and of identical rows one is first. Null doc_ids come first in order. Extra columns, of
any name, are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.llm.common import linked, may_be_similar, parity, sent, stored, unused

SIZE, BANDS, ROWS, LEAST, PARITY, STEP = 9, 12, 3, 0.75, 16, 8
_random = random.Random(17)
_TURNS = [_random.getrandbits(32) - (1 << 31) for _ in range(BANDS * ROWS)]


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, written once, with a number of each row, and the name of its column."""
    row = unused(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def lines_of(docs: DataFrame, row: Column) -> DataFrame:
    """row, doc_id, line_no (from 0), norm (what is compared) and its name (id, more), of every line that is not blank."""
    rows = docs.select(row.alias("row"), "doc_id", F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("line_no", "line"))
    rows = rows.select("row", "doc_id", "line_no", F.btrim("line", F.lit("\x20\x09\x0b\x0c\x0d")).alias("norm"))
    return rows.where("norm <> ''").select("*", F.xxhash64("norm").alias("id"), F.xxhash64(F.lit(1), "norm").alias("more"))


def buckets_of(lines: DataFrame) -> DataFrame:
    """bucket, id: the bands of every distinct line."""
    # a shingle that comes again changes no minimum; for ``explode`` the optimizer would cut each line twice
    pieces = lines.select("id", F.posexplode_outer(_pieces(F.col("norm"))).alias("k", "piece")).select(
        "id", "k", "piece", F.length("piece").alias("n")
    )
    pieces = pieces.where((F.col("k") == 0) | (F.col("n") >= SIZE))
    # one hash a shingle; where a piece has fewer shingles, its first stands for the others and changes no minimum
    hashes = pieces.select("id", "piece", "n", F.xxhash64(F.substring("piece", 1, SIZE)).alias("x0")).select(
        "id",
        "x0",
        *[F.when(F.col("n") >= i + SIZE, F.xxhash64(F.substring("piece", i + 1, SIZE))).otherwise(F.col("x0")).alias(f"x{i}") for i in range(1, STEP)],
    )
    hashes = hashes.select("id", *[h.alias(f"h{r}_{i}") for i in range(STEP) for r, h in enumerate(_three(f"x{i}"))])
    minima = []
    for at, turn in enumerate(_TURNS):
        turned = [F.col(f"h{at % ROWS}_{i}").bitwiseXOR(F.lit(turn)) for i in range(STEP)]
        minima.append(F.min(F.least(*turned)).alias(f"m{at}"))
    signed = hashes.groupBy("id").agg(*minima)
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return signed.select(F.explode(F.array(*bands)).alias("bucket"), "id")


def _three(x: str) -> tuple[Column, Column, Column]:
    """Three ints of a 64-bit hash: its halves and a hash of both."""
    return F.shiftright(x, 32).cast("int"), F.shiftright(F.shiftleft(x, 32), 32).cast("int"), F.hash(x)


def _pieces(norm: Column) -> Column:
    """Runs of up to STEP + SIZE - 1 characters, one from every STEP-th place."""
    return F.regexp_extract_all(norm, F.lit(rf"(?s)(?=(.{{1,{STEP + SIZE - 1}}})).{{1,{STEP}}}"), F.lit(1))


def _shingles(norm: str) -> Column:
    """64-bit hashes of a line's distinct shingles."""

    def hashes(pieces: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.length(norm) - SIZE, F.lit(0)))
        return F.transform(
            places,
            lambda i: F.xxhash64(F.get(pieces, F.floor(i / STEP).cast("int")).substr(F.pmod(i, F.lit(STEP)) + 1, F.lit(SIZE))),
        )

    # named by a lambda, the pieces are cut once
    return F.array_distinct(F.get(F.transform(F.array(_pieces(F.col(norm))), hashes), F.lit(0)))


def components_of(lines: DataFrame, least: float = LEAST) -> DataFrame:
    """id, component of every line that is linked with another."""

    def prepare(ids: DataFrame):
        texts = lines.select("id", "more", "norm").join(sent(ids), "id", "left_semi").groupBy("id")
        texts = stored(texts.agg(F.max_by("norm", "more").alias("norm")), "line-texts")

        def verify(pairs: DataFrame) -> DataFrame:
            left = texts.select(F.col("id").alias("a"), F.col("norm").alias("x"))
            right = texts.select(F.col("id").alias("b"), F.col("norm").alias("y"))
            # named by a lambda, both sets are made once; (1 + least) * common >= least * (sizes) is the Jaccard test
            similar = F.transform(
                F.array(F.struct(_shingles("x").alias("x"), _shingles("y").alias("y"))),
                lambda p: (1 + least) * F.size(F.array_intersect(p["x"], p["y"])) >= least * (F.size(p["x"]) + F.size(p["y"])),
            )
            return pairs.join(left, "a").join(right, "b").where(F.get(similar, F.lit(0))).select("a", "b")

        def features(some: DataFrame) -> DataFrame:
            rows = texts.join(some, "id", "left_semi").select("id", F.explode_outer(_shingles("norm")).alias("h"))
            return rows.groupBy("id").agg(F.count("*").alias("n"), *parity("h", 64 * PARITY))

        return verify, features, may_be_similar(PARITY, least)

    return linked(buckets_of(lines), prepare, "lines", orders=1)


def removed_lines(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per line that goes: doc_id, line_no, and the line that stays for it: kept_doc_id, kept_line_no."""
    lines = stored(lines_of(docs, F.monotonically_increasing_id()), "lines")
    return _removed(lines, least).drop("row")


def _removed(lines: DataFrame, least: float) -> DataFrame:
    parts = stored(components_of(lines, least), "line-parts")
    places = lines.select("row", "doc_id", "line_no", "id", "more")
    # the one of the lines of an id that was looked at is the one whose second name is greatest
    seen = places.join(sent(parts), "id").groupBy("id", "component").agg(F.max("more").alias("more"))
    places = places.join(sent(stored(seen, "line-seen")), ["id", "more"], "left")
    alone = F.when(F.col("component").isNull(), F.col("more"))
    places = places.select("row", "doc_id", "line_no", F.coalesce("component", "id").alias("part"), alone.alias("alone"))
    first = places.groupBy("part", "alone").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("kept"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").drop("n"), "line-first").withColumnsRenamed({"part": "p", "alone": "a"})
    rows = places.join(first, (places["part"] == first["p"]) & places["alone"].eqNullSafe(first["a"]))
    rows = rows.where((F.col("row") != F.col("kept.row")) | (F.col("line_no") != F.col("kept.line_no")))
    kept = [F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")]
    return rows.select("row", "doc_id", "line_no", *kept)


def without_lines(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents with the lines that go cut out of their texts; a text that loses all its words to this goes with them."""
    rows, row = numbered(docs)
    lines = stored(lines_of(rows.select("doc_id", "text", row), F.col(row)), "lines")
    gone, cut = unused(rows, "gone"), unused(rows, "cut")
    removed = _removed(lines, least).groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    joined = rows.join(removed, row, "left")  # at most a text's own lines
    left = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(gone, i))
    joined = joined.withColumn(cut, F.when(F.col(gone).isNotNull(), F.array_join(left, "\n")))
    joined = joined.where(F.col(gone).isNull() | F.col(cut).rlike(r"\S"))
    return joined.withColumn("text", F.coalesce(cut, "text")).select(*docs.columns)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return removed_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage_line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Second stage of the pipeline: repeated lines go; a document that loses all its words to this goes with them."""
    return without_lines(docs)
