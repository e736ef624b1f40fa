"""Chains: append equals a fold, tampering is found, canonical JSON equals the library's."""

import hashlib
import json

from pyspark.sql import functions as F

from riskmill.functions.hashing import canonical_json, json_string
from riskmill.operators import audit
from riskmill.operators.sequences import lag_across_buckets, trailing_window

EVENTS = "chain string, seq bigint, actor string, event string, object_type string, object_id string, metadata_json string"
ROWS = [
    (c, s, actor, "SCAN_STARTED", "Scan" if s % 2 else None, f"id-{s}", json.dumps({"n": s}, separators=(",", ":")) if s % 3 else None)
    for c in ("x", "y") for s, actor in [(1, "SYSTEM"), (4, "HUMAN:Zoë 😀"), (5, 'LLM "q" \\ \n\t\x01\x7f'), (11, "SYSTEM"), (12, "VERIFIER")]
]


def fold(rows, start="0" * 64):
    out, last = {}, {}
    for c, s, actor, event, kind, oid, meta in sorted(rows):
        data = {"actor": actor, "event": event, "object_type": kind, "object_id": oid, "metadata": json.loads(meta) if meta else {}}
        text = json.dumps(data, sort_keys=True, separators=(",", ":"))
        prev = last.get(c, start)
        last[c] = hashlib.sha256((prev + text).encode()).hexdigest()
        out[c, s] = (prev, last[c])
    return out


def chained(spark):
    return audit.append_chain(spark.createDataFrame(ROWS, EVENTS).repartition(5), "chain")


def test_append_is_a_fold(spark):
    assert {(r.chain, r.seq): (r.prev_hash, r.hash) for r in chained(spark).collect()} == fold(ROWS)


def test_append_continues_from_the_tail(spark):
    first = [r for r in ROWS if r[1] < 5]
    rest = [r for r in ROWS if r[1] >= 5]
    head = audit.append_chain(spark.createDataFrame(first, EVENTS), "chain")
    tail = head.groupBy("chain").agg(F.max_by("hash", "seq").alias("last_hash"))
    more = audit.append_chain(spark.createDataFrame(rest, EVENTS), "chain", tail)
    want = fold(ROWS)
    assert {(r.chain, r.seq): r.hash for r in more.collect()} == {k: v[1] for k, v in want.items() if k[1] >= 5}


def test_verify(spark):
    log = chained(spark).filter("chain = 'x'")
    for width in (1, 4, 100):
        assert audit.verify_chain(log, width=width).first().ok
    assert audit.verify_chain(log.limit(0)).first().ok
    for column, reason in (("hash", "HASH"), ("prev_hash", "LINK"), ("actor", "HASH")):
        bad = log.withColumn(column, F.when(F.col("seq") == 5, F.lit("f" * 64)).otherwise(F.col(column)))
        for width in (1, 4, 100):
            report = audit.verify_chain(bad, width=width).first()
            assert (report.ok, report.bad_seq, report.reason, report.n_events) == (False, 5, reason, 5)
    cut = audit.verify_chain(log.filter("seq <> 4")).first()
    assert (cut.bad_seq, cut.reason) == (5, "LINK")
    # From the last verified row on.
    at_four = log.filter("seq = 4").first().hash
    assert audit.verify_chain(log.filter("seq > 4"), start_hash=at_four).first().ok
    page = audit.audit_page(log, 2, 1).collect()
    assert [r.seq for r in page] == [11, 5] and page[0].chain_ok and page[0].total == 5


def test_canonical_json(spark):
    texts = ["plain", 'q"\\', "é₹", "😀", "\n\r\t\b\f\x00\x1f\x7f", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.j for r in df.select(json_string(F.col("t")).alias("j")).collect()] == [json.dumps(t) for t in texts]
    metas = [{"b": [1, {"z": None, "a": "é"}], "a": 1.5}, {}]
    df = spark.createDataFrame([(json.dumps(m, indent=1),) for m in metas], "t string").select(canonical_json("t").alias("j"))
    assert [r.j for r in df.collect()] == [json.dumps(m, sort_keys=True, separators=(",", ":")) for m in metas]


def test_bucketed_windows_equal_plain_ones(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1009).alias("t"), "id")
    got = lag_across_buckets(df, ["k"], ["t", "id"], F.expr("t DIV 10"), ["id"])
    df.createOrReplaceTempView("rows")
    want = spark.sql("SELECT k, t, id, lag(id) OVER (PARTITION BY k ORDER BY t, id) AS prev_id FROM rows")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    got = trailing_window(df, ["k"], "t", 50, {"n": F.count(F.lit(1)), "s": F.sum("id")}, 60)
    want = spark.sql("SELECT k, t, id, count(*) OVER w AS n, sum(id) OVER w AS s FROM rows WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_rows_after_the_mark_are_verified_and_read(spark, tmp_path):
    events = spark.createDataFrame(
        [("c", i, "A", "E", "T", str(i), "{}") for i in range(1, 101)],
        "chain string, seq long, actor string, event string, object_type string, object_id string, metadata_json string",
    )
    log = audit.append_chain(events, "chain").drop("chain")
    log.where("seq <= 60").write.parquet(f"{tmp_path}/log")
    stored = spark.read.parquet(f"{tmp_path}/log")
    nothing = stored.select("seq", "hash").where("false")
    first = audit.verify_since(stored, nothing)
    row = first.first()
    assert (row.n_events, row.ok, row.seq) == (60, True, 60)
    mark = spark.createDataFrame([(row.seq, row.hash)], "seq long, hash string")

    broken = log.withColumn("hash", F.when(F.col("seq") == 80, F.reverse("hash")).otherwise(F.col("hash")))
    broken.where("seq > 60").write.mode("append").parquet(f"{tmp_path}/log")
    since = audit.verify_since(spark.read.parquet(f"{tmp_path}/log"), mark)
    assert "GreaterThan(seq,60)" in since._jdf.queryExecution().executedPlan().toString()
    found = since.first()
    assert (found.n_events, found.ok, found.bad_seq, found.reason, found.seq) == (40, False, 80, "HASH", 79)
    again = audit.verify_since(log.where("seq <= 90"), spark.createDataFrame([(found.seq, found.hash)], "seq long, hash string")).first()
    assert again.ok and again.seq == 90
    tampered_first = log.withColumn("prev_hash", F.when(F.col("seq") == 61, F.lit("x")).otherwise(F.col("prev_hash")))
    worst = audit.verify_since(tampered_first, mark).first()
    assert (worst.ok, worst.reason, worst.seq, worst.hash) == (False, "LINK", 60, row.hash)
