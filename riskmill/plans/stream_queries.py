"""Streaming queries: each tails a given table, runs over all of it and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmill.plans import derived as D
from riskmill.plans.ledger_queries import deliveries_of
from riskmill.plans.registry import query
from riskmill.operators.rules import SHOWN_RULES
from riskmill.plans.scan_queries import RULE_HITS_SQL, _KEY, _flat_hits
from riskmill.schemas import EVENTS
from riskmill.sources.corpus import keep_source_files
from riskmill.streaming import streams

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def event_stream(spark, sf):
    """Events with number, microseconds and an event-time column."""
    raw = streams.read_table_stream(spark, f"{sf}/events.parquet", EVENTS)
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return raw.select(
        "event_id", "user_id", "event_type", "value", F.timestamp_micros(us).alias("ts"), us.alias("ts_us"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"), F.replace("props", F.lit(" "), F.lit("")).alias("meta"),
    )


_HORIZON_US = 86_400_000_000


@query(
    "stream_event_dedup",
    f"""WITH RECURSIVE {D.KEYED_EVENTS},
      e AS (SELECT user_id, event_type, k, event_id, ts_us, row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY ts_us, event_id) AS n FROM keyed),
      walk AS (SELECT *, ts_us AS last_us FROM e WHERE n = 1
        UNION ALL SELECT e.*, CASE WHEN e.ts_us - w.last_us >= {_HORIZON_US} THEN e.ts_us ELSE w.last_us END
          FROM walk w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.k = w.k AND e.n = w.n + 1)
      SELECT user_id, event_type, k, event_id FROM walk WHERE last_us = ts_us AND n = (SELECT min(x.n) FROM e x WHERE x.user_id = walk.user_id
        AND x.event_type = walk.event_type AND x.k = walk.k AND x.ts_us = walk.ts_us)""",
)
def stream_event_dedup(spark, sf):
    """The events that get through: those at least a day after the last one of their key that did."""
    events = event_stream(spark, sf).select("ts", "event_id", "user_id", "event_type", "k")
    kept = streams.dedup_stream(events, ["user_id", "event_type", "k"])
    return streams.run_to_table(kept, "dedup").select("user_id", "event_type", "k", "event_id")


@query(
    "stream_signature_gate",
    f"WITH {D.KEYED_EVENTS} SELECT event_id, k >= 20 AS valid FROM keyed",
)
def stream_signature_gate(spark, sf):
    """Valid and forged deliveries go to two tables."""
    target = streams.scratch_path(spark, "gate")
    gated = streams.signature_gate(deliveries_of(event_stream(spark, sf)), _KEY)
    writer = streams.route_by_signature(gated, f"{target}/valid", f"{target}/forged", f"{target}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    columns = ["event_id"]
    return (
        spark.read.parquet(f"{target}/valid").select(*columns, F.lit(True).alias("valid"))
        .unionByName(spark.read.parquet(f"{target}/forged").select(*columns, F.lit(False).alias("valid")))
    )


@query(
    "stream_duplicate_effects",
    f"""WITH {D.KEYED_EVENTS}, e AS (SELECT user_id || '-' || event_type AS event_key, ts_us, event_id,
          coalesce(ts_us - lag(ts_us) OVER (PARTITION BY user_id, event_type ORDER BY ts_us, event_id) >= {_HORIZON_US}, true)::INT AS fresh FROM keyed),
        runs AS (SELECT *, sum(fresh) OVER (PARTITION BY event_key ORDER BY ts_us, event_id) AS run FROM e),
        counted AS (SELECT event_key, ts_us, row_number() OVER (PARTITION BY event_key, run ORDER BY ts_us, event_id) AS effects FROM runs)
        SELECT event_key, ts_us, effects FROM counted WHERE effects >= 2""",
)
def stream_duplicate_effects(spark, sf):
    """Each effect that follows another of its key within a day, and the how-manieth of its run it is."""
    effects = event_stream(spark, sf).select("ts", F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("event_key"), F.lit(1).alias("effects"))
    found = streams.run_to_table(streams.duplicate_effect_stream(effects, "event_key"), "effects")
    return found.select("event_key", F.unix_micros("ts").alias("ts_us"), "effects")


@query(
    "stream_state_changes",
    f"""WITH {D.KEYED_EVENTS} SELECT id, seq, state, prev_state FROM (SELECT user_id AS id, event_id AS seq, event_type AS state,
          lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_state FROM keyed) WHERE prev_state IS NULL OR prev_state <> state""",
)
def stream_state_changes(spark, sf):
    log = event_stream(spark, sf).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return streams.run_to_table(streams.change_feed_stream(log), "changes")


@query("stream_audit_append", f"WITH RECURSIVE {D.AUDIT_CHAIN} SELECT chain, seq, prev_hash, hash FROM log")
def stream_audit_append(spark, sf):
    events = D.audit_events_of(event_stream(spark, sf))
    return streams.run_to_table(streams.audit_chain_stream(events), "audit").select("chain", "seq", "prev_hash", "hash")


@query("stream_rule_hits", RULE_HITS_SQL + " SELECT * FROM hits")
def stream_rule_hits(spark, sf):
    docs = streams.read_table_stream(spark, f"{sf}/documents.parquet", DOCUMENTS)
    files = keep_source_files(D.code_files_of(docs))
    return _flat_hits(streams.run_to_table(streams.scan_stream(files, SHOWN_RULES), "hits"))
