"""Hash-chained audit log: append and verify.

Verification is parallel, because every row stores the hash it claims to follow. Appending is
sequential inside one chain by definition; separate chains run side by side, and a chain streams
through its task in batches, so its length is not limited by memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions.hashing import audit_payload
from riskmill.operators.sequences import lag_across_buckets

BUCKET_WIDTH = 100_000


def with_payload(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "payload",
        audit_payload(
            F.col("actor"), F.col("event"), F.col("object_type"), F.col("object_id"), F.col("metadata_json")
        ),
    )


def chain_step(prev_hash: str, payload: str) -> str:
    return hashlib.sha256((prev_hash + payload).encode()).hexdigest()


def append_chain(events: DataFrame, chain: str, tail: DataFrame | None = None) -> DataFrame:
    """Chain new events onto their chains.

    events(chain, seq, actor, event, object_type, object_id, metadata_json); tail(chain, last_hash)
    holds the current ends. Two writers must not append to one chain at the same time.
    """
    rows = with_payload(events)
    if tail is not None:
        rows = rows.join(tail.select(chain, F.col("last_hash").alias("_start")), chain, "left")
    else:
        rows = rows.withColumn("_start", F.lit(None).cast("string"))
    rows = rows.withColumn("_start", F.coalesce("_start", F.lit(C.GENESIS_HASH)))
    schema = ", ".join(f"`{name}` {kind}" for name, kind in events.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            before, after = [], []
            for key, start, payload in zip(batch[chain], batch["_start"], batch["payload"]):
                if current is None or key != current:
                    current, last = key, start
                before.append(last)
                last = chain_step(last, payload)
                after.append(last)
            yield batch.drop(columns=["payload", "_start"]).assign(prev_hash=before, hash=after)

    return (
        rows.repartition(chain)
        .sortWithinPartitions(chain, "seq")
        .select(*events.columns, "_start", "payload")
        .mapInPandas(fold, f"{schema}, prev_hash string, hash string")
    )


def check_links(
    audit: DataFrame, keys: Sequence[str] = (), start_hash: str | Column = C.GENESIS_HASH, width: int = BUCKET_WIDTH
) -> DataFrame:
    """Add ``failure`` per row: LINK, HASH or null.

    Rows are cut into buckets of ``width`` sequence numbers, so no task holds a whole chain. A run
    over new rows only starts from the hash of the last verified row (a column of the rows if chains differ).
    """
    rows = with_payload(audit).withColumn("own_hash", F.col("hash"))
    linked = lag_across_buckets(rows, keys, ["seq"], F.expr(f"seq DIV {width}"), ["own_hash"])
    expected_prev = F.coalesce(F.col("prev_own_hash"), start_hash if isinstance(start_hash, Column) else F.lit(start_hash))
    failure = F.when(~F.col("prev_hash").eqNullSafe(expected_prev), "LINK").when(
        ~F.col("hash").eqNullSafe(F.sha2(F.concat(expected_prev, "payload"), 256)), "HASH"
    )
    return linked.select(*audit.columns, failure.alias("failure"))


def verify_chain(
    audit: DataFrame, keys: Sequence[str] = (), start_hash: str = C.GENESIS_HASH, width: int = BUCKET_WIDTH
) -> DataFrame:
    """One row per chain (one in all without keys): valid, first bad sequence number and reason.

    Without keys an empty log yields one valid row.
    """
    bad_seq = F.when(F.col("failure").isNotNull(), F.col("seq"))
    return (
        check_links(audit, keys, start_hash, width)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.min(bad_seq).alias("bad_seq"),
            F.min_by("failure", bad_seq).alias("reason"),
        )
        .withColumn("ok", F.col("bad_seq").isNull())
    )


def verify_since(audit: DataFrame, mark: DataFrame, keys: Sequence[str] = (), width: int = BUCKET_WIDTH) -> DataFrame:
    """Verify only the rows after a stored mark: n_events, bad_seq, reason, ok and the next mark (seq, hash) per chain with new rows.

    ``mark`` has keys, seq and hash of the last verified row (a row per chain; chains without one start at
    the beginning). The least marked number of a log whose chains all have a mark is a filter that reaches the scan, so
    files of older rows are not read. The next mark is the row before the first bad one, and the old mark if the first
    new row is bad.
    """
    known = mark.select(*keys, F.col("seq").alias("_seq"), F.col("hash").alias("_hash"))
    if keys:
        rows = audit.join(known, list(keys), "left")
        rows = rows.filter(F.col("_seq").isNull() | (F.col("seq") > F.col("_seq")))
    else:
        last = mark.select("seq", "hash").first()
        since = audit if last is None else audit.filter(F.col("seq") > last["seq"])
        rows = since.withColumns({"_seq": F.lit(last and last["seq"]).cast("long"), "_hash": F.lit(last and last["hash"])})
    links = check_links(rows, keys, F.coalesce("_hash", F.lit(C.GENESIS_HASH)), width)
    # whatever follows the first bad row of a chain is not verified, though it may link
    bad = links.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(F.when(F.col("failure").isNotNull(), F.col("seq"))).alias("bad_seq"),
        F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("seq"))).alias("reason"),
        F.max_by(F.struct("seq", "hash"), "seq").alias("newest"),
        F.first("_seq").alias("_seq"),
        F.first("_hash").alias("_hash"),
    )
    if keys:
        before = links.join(bad.filter("bad_seq IS NOT NULL").select(*keys, F.col("bad_seq").alias("_bad")), list(keys))
    else:
        before = links.withColumn("_bad", bad.select("bad_seq").scalar()).filter("_bad IS NOT NULL")
    before = before.filter(F.col("seq") < F.col("_bad")).groupBy(*keys).agg(F.max_by(F.struct("seq", "hash"), "seq").alias("held"))
    joined = bad.join(before, list(keys), "left") if keys else bad.withColumn("held", before.select("held").scalar())
    old = F.when(F.col("_seq").isNotNull(), F.struct(F.col("_seq").alias("seq"), F.col("_hash").alias("hash")))
    reached = F.when(F.col("bad_seq").isNull(), F.col("newest")).otherwise(F.coalesce("held", old))
    return joined.select(
        *keys, "n_events", "bad_seq", "reason", F.col("bad_seq").isNull().alias("ok"), reached["seq"].alias("seq"), reached["hash"].alias("hash")
    )


def audit_page(audit: DataFrame, limit: int = 50, offset: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Newest events with the verdict on the whole chain, or with keys on the chain of each row."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    total = audit.agg(F.count(F.lit(1))).scalar()
    page = audit.orderBy(F.desc("seq")).offset(offset).limit(limit)
    if not keys:
        return page.withColumns({"total": total, "chain_ok": verify_chain(audit).select("ok").scalar()})
    shown = audit.join(page.select(*keys).distinct(), list(keys), "left_semi")
    verdicts = verify_chain(shown, keys).select(*keys, F.col("ok").alias("chain_ok"))
    return page.join(verdicts, list(keys)).withColumn("total", total)
