"""Streams over several micro-batches give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from riskmill.operators import audit
from riskmill.streaming import streams
from tests_support import EVENTS, ROWS, fold


def batches(spark, df, path, order, n=3):
    """Write rows as n files in order, to be read one file per micro-batch."""
    rows = df.withColumn("_b", F.ntile(n).over(__import__("pyspark").sql.Window.orderBy(*order)))
    for i in range(1, n + 1):
        rows.filter(F.col("_b") == i).drop("_b").coalesce(1).write.mode("append").parquet(path)
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_chain_across_batches(spark, tmp_path):
    stream = batches(spark, spark.createDataFrame(ROWS, EVENTS), str(tmp_path / "in"), ["seq", "chain"])
    got = streams.run_to_table(streams.audit_chain_stream(stream), "t-chain")
    assert {(r.chain, r.seq): (r.prev_hash, r.hash) for r in got.collect()} == fold(ROWS)
    log = spark.createDataFrame(ROWS, EVENTS).join(got.drop("payload"), ["chain", "seq"])
    assert audit.verify_chain(log, ["chain"]).filter("NOT ok").isEmpty()


def test_change_feed_across_batches(spark, tmp_path):
    states = ["A", "A", "B", "B", "DONE", "C", "DONE"]
    df = spark.createDataFrame([(k, i, s) for k in (1, 2) for i, s in enumerate(states)], "id bigint, seq bigint, state string")
    stream = batches(spark, df, str(tmp_path / "in"), ["seq", "id"], n=4)
    got = streams.run_to_table(streams.change_feed_stream(stream, ("DONE",)), "t-feed").collect()
    assert {(r.id, r.seq, r.state, r.prev_state) for r in got} == {(k, *x) for k in (1, 2) for x in [(0, "A", None), (2, "B", "A"), (4, "DONE", "B")]}


def recurring(spark):
    """Events of a few keys over thirty days, many of them within a day of one another."""
    rng = random.Random(21)
    hours = sorted(rng.sample(range(30 * 24 * 4), 400))
    rows = [(f"e{rng.randrange(12)}", h * 900) for h in hours]
    rows += [rows[7], rows[100]]
    return sorted(rows, key=lambda r: r[1]), 86_400


@pytest.mark.parametrize("n", [1, 3, 30])
def test_dedup_does_not_depend_on_batches(spark, tmp_path, n):
    rows, day = recurring(spark)
    last, want = {}, []
    for key, second in rows:
        if key not in last or second - last[key] >= day:
            last[key] = second
            want.append((key, second))
    df = spark.createDataFrame(rows, "event_id string, s bigint").select("event_id", F.timestamp_seconds("s").alias("ts"))
    kept = streams.run_to_table(streams.dedup_stream(batches(spark, df, str(tmp_path / "in"), ["ts"], n), ["event_id"]), "t-dedup")
    assert sorted((r.event_id, r.s) for r in kept.select("event_id", F.unix_seconds("ts").alias("s")).collect()) == sorted(want)


@pytest.mark.parametrize("n", [1, 3, 30])
def test_repeats_do_not_depend_on_batches(spark, tmp_path, n):
    rows, day = recurring(spark)
    last, total, want = {}, {}, []
    for key, second in rows:
        total[key] = total[key] + 1 if key in last and second - last[key] < day else 1
        last[key] = second
        if total[key] >= 2:
            want.append((key, second, total[key]))
    df = spark.createDataFrame(rows, "event_id string, s bigint").select("event_id", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("effects"))
    found = streams.run_to_table(streams.duplicate_effect_stream(batches(spark, df, str(tmp_path / "in"), ["ts"], n)), "t-effects")
    got = found.select("event_id", F.unix_seconds("ts").alias("s"), "effects").collect()
    assert sorted((r.event_id, r.s, r.effects) for r in got) == sorted(want)


def test_keys_share_the_state_of_their_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "BUCKETS", 4)
    df = spark.range(600).select(
        F.when(F.col("id") % 7 > 0, F.lit(2**53 + 1) + F.col("id") % 300).alias("user_id"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 300).cast("int")).alias("k"),
        F.when(F.col("id") % 11 > 0, F.lit(2**60 + 1) + F.col("id")).alias("event_id"),
        F.timestamp_seconds(F.lit(86_400) + F.col("id")).alias("ts"),
    )
    seen, want = set(), []
    for r in df.orderBy("ts").collect():
        if (r.user_id, r.k) not in seen:
            seen.add((r.user_id, r.k))
            want.append(tuple(r))
    kept = streams.dedup_stream(batches(spark, df, str(tmp_path / "in"), ["ts"], 2), ["user_id", "k"])
    query = kept.writeStream.format("memory").queryName("shared_state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("shared_state").collect())) == sorted(map(str, spark.createDataFrame(want, df.schema).collect()))
    assert len(want) > 300 and max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 100


def test_corpus_stream(spark, tmp_path):
    from riskmill.sources.corpus import read_source_corpus

    for name, text in {"r1/a.js": "const r = require('razorpay');\nr.orders.create({});", "r2/b.js": "let x = 1;", "r1/dist/c.js": "require('razorpay').orders.create()"}.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    hits = streams.run_to_table(streams.scan_stream(read_source_corpus(spark, str(tmp_path / "src"), stream=True)), "t-hits")
    assert [(r.repo_id, r.rule_id) for r in hits.collect()] == [("r1", "DP-R1")]
