"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskmill import config as C
from riskmill.operators.audit import chain_step, with_payload
from riskmill.operators.ledger import verify_signatures
from riskmill.operators.rules import BUILT_IN_RULES, apply_rules
from riskmill.operators.units import extract_code_units
from riskmill.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, path: str, schema: str, max_files: int = 64, **options) -> DataFrame:
    """Tail a Parquet table, at most ``max_files`` files in a micro-batch, so that its size is bounded.
    ``path`` may be a file, as a glob pattern keeps the source from treating it as a partition base."""
    pattern = path[:-1] + f"[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).options(**options).parquet(pattern)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and return what it wrote."""
    spark = stream.sparkSession
    target = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{target}/out")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/out")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond heap size; needed by the stateful processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Horizon(StatefulProcessor):
    """Remembers the last event of every key of a bucket for as long as the redelivery horizon.

    ``distinct``: an event is passed on if it comes at least the horizon after the last one passed on.
    Otherwise an event is passed on, with the number of effects so far, if it comes less than the
    horizon after the one before. Both depend on event time only, not on how the stream is cut into
    micro-batches, for sources that deliver a key in event-time order.

    State is read and written once a bucket and micro-batch, not once a key, and holds the keys that the
    watermark has not passed by the horizon yet: from then on every event of a key is a first one.
    """

    def __init__(self, columns: list[str], order: list[str], key: str, ts: str, horizon: str, distinct: bool):
        self.columns, self.order, self.key, self.ts, self.distinct = columns, order, key, ts, distinct
        self.horizon = pd.Timedelta(horizon).value // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "key array<string>, us array<bigint>, effects array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.key, self.ts, *self.order])
        seen = self._seen()
        kept, totals = [], []
        times = batch[self.ts].astype("datetime64[us]").astype("int64").tolist()
        for name, us, effects in zip(batch[self.key].tolist(), times, self._effects(batch)):
            last, total = seen.get(name, (None, 0))
            fresh = last is None or us - last >= self.horizon
            total = effects if fresh else total + effects
            kept.append(fresh if self.distinct else total >= 2)
            totals.append(total)
            seen[name] = (us if fresh or not self.distinct else last, total)
        self._remember(seen, timers.getCurrentWatermarkInMs())
        if not self.distinct:
            batch["effects"] = totals
        yield batch[kept][self.columns]

    def _effects(self, batch: pd.DataFrame) -> list[int]:
        return [1] * len(batch) if self.distinct else batch["effects"].tolist()

    def _seen(self) -> dict:
        if not self.seen.exists():
            return {}
        keys, times, totals = self.seen.get()
        return dict(zip(keys, zip(times, totals)))

    def _remember(self, seen: dict, watermark_ms: int) -> None:
        """Keep what is within the horizon and come back when all of it has passed."""
        live = [(k, us, total) for k, (us, total) in seen.items() if us + self.horizon > watermark_ms * 1000]
        if live:
            keys, times, totals = map(list, zip(*live))
            self.seen.update((keys, times, totals))
            self.handle.registerTimer((max(times) + self.horizon) // 1000 + 1)
        elif self.seen.exists():
            self.seen.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.seen.exists() and max(self.seen.get()[1]) + self.horizon <= watermark:
            self.seen.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


#: Buckets of keys that share one state each.
BUCKETS = 1024


def _within_horizon(events: DataFrame, key: list[str], ts: str, horizon: str, distinct: bool) -> DataFrame:
    use_rocksdb(events.sparkSession)
    # a null whole number would make pandas read its column as floats: such columns are sent with a flag
    whole = [c for c, kind in events.dtypes if kind in ("tinyint", "smallint", "int", "bigint")]
    flags = {c: f"null_{c}_" for c in whole}
    sent = [F.coalesce(c, F.lit(0).cast(events.schema[c].dataType)).alias(c) if c in flags else F.col(c) for c in events.columns]
    named = [F.col(c).cast("string") for c in key]
    name = F.concat(*[F.coalesce(F.concat(F.length(n).cast("string"), F.lit(":"), n), F.lit("-")) for n in named])
    rows = events.withWatermark(ts, horizon).select(
        *sent,
        *[F.col(c).isNull().alias(flag) for c, flag in flags.items()],
        name.alias("key_"),
        F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("bucket_"),
    )
    passed = [*events.columns, *flags.values()]
    order = [c for column in events.columns if column not in (*key, ts) for c in (flags.get(column, column), column)]
    processor = _Horizon(passed, list(dict.fromkeys(order)), "key_", ts, horizon, distinct)
    out = rows.groupBy("bucket_").transformWithStateInPandas(processor, rows.select(*passed).schema, "Append", "EventTime")
    return out.select(*[F.when(~F.col(flags[c]), F.col(c)).alias(c) if c in flags else F.col(c) for c in events.columns])


def dedup_stream(events: DataFrame, key: list[str], ts: str = "ts", horizon: str = C.REDELIVERY_HORIZON) -> DataFrame:
    """Drop an event that comes less than the horizon after the last event of its key that was kept."""
    return _within_horizon(events, key, ts, horizon, True)


def signature_gate(deliveries: DataFrame, secret: str) -> DataFrame:
    """Deliveries with ``valid``; split them with ``route_by_signature``."""
    return verify_signatures(deliveries, secret)


def route_by_signature(gated: DataFrame, valid_path: str, forged_path: str, checkpoint: str):
    """Write valid and forged deliveries to two tables. A micro-batch is read and checked once; the batch
    id is part of the path, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.DISK_ONLY)  # lost parts are computed again from the batch
        for flag, path in ((True, valid_path), (False, forged_path)):
            kept.filter(F.col("valid") == flag).drop("valid").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        kept.unpersist()

    return gated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def duplicate_effect_stream(effects: DataFrame, key: str = "event_id", ts: str = "ts", horizon: str = C.REDELIVERY_HORIZON) -> DataFrame:
    """Every effect of an event that follows another within the horizon, with the number of effects so far.

    A run of effects goes on as long as no gap reaches the horizon, so no border of a window can split
    a pair, and each repeat is reported when it arrives. A null number of effects counts as none.
    """
    counted = F.coalesce(F.col("effects").cast("long"), F.lit(0).cast("long")).alias("effects")
    return _within_horizon(effects.select(key, ts, counted), [key], ts, horizon, False)


def scan_stream(files: DataFrame, rules=BUILT_IN_RULES) -> DataFrame:
    """Rule hits of newly arrived source files; stateless."""
    return apply_rules(extract_code_units(files), rules)


class _ChangeFeed(StatefulProcessor):
    """Remembers the last state of a key and emits a row when it changes; silent after a terminal
    state."""

    def __init__(self, terminal: tuple[str, ...]):
        self.terminal = terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, state in zip(batch["seq"], batch["state"]):
            if last in self.terminal:
                break
            if state != last:
                out.append((key[0], seq, state, last))
                last = state
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["id", "seq", "state", "prev_state"])

    def close(self) -> None:
        pass


def change_feed_stream(log: DataFrame, terminal: tuple[str, ...] = ()) -> DataFrame:
    """log(id, seq, state) → rows where the state of an id changes."""
    use_rocksdb(log.sparkSession)
    return log.select("id", "seq", "state").groupBy("id").transformWithStateInPandas(
        _ChangeFeed(tuple(terminal)),
        f"id {dict(log.dtypes)['id']}, seq {dict(log.dtypes)['seq']}, state string, prev_state string",
        "Append",
        "None",
    )


class _ChainAppender(StatefulProcessor):
    """Keeps the last hash of a chain and extends the chain by the rows of each micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else C.GENESIS_HASH
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before, after = [], []
        for payload in batch["payload"]:
            before.append(last)
            last = chain_step(last, payload)
            after.append(last)
        self.last.update((last,))
        yield pd.DataFrame({"chain": key[0], "seq": batch["seq"], "payload": batch["payload"], "prev_hash": before, "hash": after})

    def close(self) -> None:
        pass


def audit_chain_stream(events: DataFrame) -> DataFrame:
    """Streaming append: events(chain, seq, actor, ...) → (chain, seq, payload, prev_hash, hash).

    The end of each chain is keyed state, so the log is never read back, and chains run side by
    side. One query must be the only writer of its chains.
    """
    use_rocksdb(events.sparkSession)
    kinds = dict(events.dtypes)
    return (
        with_payload(events)
        .select("chain", "seq", "payload")
        .groupBy("chain")
        .transformWithStateInPandas(
            _ChainAppender(),
            f"chain {kinds['chain']}, seq {kinds['seq']}, payload string, prev_hash string, hash string",
            "Append",
            "None",
        )
    )
