"""Ledger rules and verdicts against a command-by-command replay."""

import hashlib
import hmac
import random

import pytest

from pyspark.sql import functions as F

from riskmill.functions.hashing import checkout_signature, hmac_sha256
from riskmill.operators import ledger, verdicts

COMMANDS = "order_id int, payment_id string, seq bigint, command string, outcome string, amount bigint"


def replay(amounts, commands):
    """The state machine, one command after the other."""
    paid, payments, out = set(), {}, {}
    for order, pay, seq, command, outcome, amount in sorted(commands, key=lambda c: (c[0], c[2])):
        reason = None
        if command == "checkout":
            if order not in amounts:
                reason = "UNKNOWN_ORDER"
            elif order in paid:
                reason = "ORDER_ALREADY_PAID"
            else:
                payments[pay] = "authorized" if outcome == "success" else "failed"
        elif pay not in payments:
            reason = "UNKNOWN_PAYMENT"
        elif payments[pay] == "captured":
            reason = "ALREADY_CAPTURED"
        elif payments[pay] == "failed":
            reason = "NOT_AUTHORIZED"
        elif amount is not None and amount != amounts[order]:
            reason = "AMOUNT_MISMATCH"
        else:
            payments[pay] = "captured"
            paid.add(order)
        out[order, seq] = reason
    return out, payments, paid


def random_commands(rng, n_orders):
    commands = []
    for order in range(n_orders + 1):  # the last order does not exist
        pays = [f"p{order}_{i}" for i in range(4)]
        steps = [(p, "checkout", rng.choice(["success", "success", "failure"]), None) for p in pays]
        steps += [(rng.choice(pays), "capture", None, rng.choice([None, 500, 501])) for _ in range(6)]
        rng.shuffle(steps)
        commands += [(order, p, seq, c, o, a) for seq, (p, c, o, a) in enumerate(steps)]
    return commands


def test_replay_is_the_state_machine(spark):
    commands = random_commands(random.Random(3), 150)
    amounts = {i: 500 for i in range(150)}
    want, payments, paid = replay(amounts, commands)
    orders = spark.createDataFrame(list(amounts.items()), "order_id int, amount bigint")
    df = spark.createDataFrame(commands, COMMANDS).repartition(5)
    replayed = ledger.replay_ledger(orders, df)
    assert {(r.order_id, r.seq): r.reject_reason for r in replayed.collect()} == want
    assert {r.payment_id: r.status for r in ledger.payment_states(replayed, df).collect()} == payments
    states = {r.order_id: r for r in ledger.order_states(orders, replayed).collect()}
    assert {o for o, r in states.items() if r.status == "paid"} == paid
    assert all(r.amount_due == (0 if r.status == "paid" else 500) for r in states.values())


def test_refunds_are_greedy(spark):
    rng = random.Random(5)
    payments = [(i, rng.choice([None, 100, 1000])) for i in range(60)]
    refunds = [(rng.choice([1] * 10 + list(range(62))), seq, rng.choice([-5, 0, 1, 30, 60, 90, 400, 2000])) for seq in range(1500)]
    want, total = {}, {}
    captured = dict(payments)
    for pay, seq, amount in refunds:
        if pay not in captured:
            want[seq] = "UNKNOWN_PAYMENT"
        elif captured[pay] is None:
            want[seq] = "NOT_CAPTURED"
        elif amount <= 0:
            want[seq] = "INVALID_AMOUNT"
        elif total.get(pay, 0) + amount > captured[pay]:
            want[seq] = "EXCEEDS_CAPTURED"
        else:
            want[seq] = None
            total[pay] = total.get(pay, 0) + amount
    r = spark.createDataFrame(refunds, "payment_id int, seq int, amount bigint").repartition(6)
    p = spark.createDataFrame(payments, "payment_id int, captured bigint")
    judged = ledger.apply_refund_limit(r, p)
    assert {x.seq: x.reject_reason for x in judged.collect()} == want
    got = {x.payment_id: (x.refunded, x.status) for x in ledger.refund_totals(judged, p).collect()}
    for pay, cap in payments:
        t = total.get(pay, 0)
        assert got[pay] == (t, None if cap is None else "refunded" if t >= cap else "captured")


def test_a_rejected_refund_does_not_count(spark):
    r = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40)], "payment_id int, seq int, amount bigint")
    p = spark.createDataFrame([(1, 100)], "payment_id int, captured bigint")
    assert {x.seq: x.accepted for x in ledger.apply_refund_limit(r, p).collect()} == {1: True, 2: False, 3: True}


def test_order_validation(spark):
    df = spark.createDataFrame([("100",), ("99",), ("1.5",), (None,), ("9" * 30,)], "amount string")
    reasons = [r.reject_reason for r in ledger.validate_orders(df).collect()]
    assert reasons == [None, "BELOW_MINIMUM", "NOT_AN_INTEGER", "NOT_AN_INTEGER", "OUT_OF_RANGE"]


def test_hmac_matches_the_library(spark):
    for key in ("k", "x" * 64, "long" * 40):
        bodies = ["", "{}", "é₹" * 50]
        df = spark.createDataFrame([(b,) for b in bodies], "b string").select(hmac_sha256(F.col("b"), key).alias("s"))
        assert [r.s for r in df.collect()] == [hmac.new(key.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]
    row = spark.createDataFrame([("o", "p")], "o string, p string").select(checkout_signature(F.col("o"), F.col("p"), "k").alias("s")).first()
    assert row.s == hmac.new(b"k", b"o|p", hashlib.sha256).hexdigest()


def test_verdicts(spark):
    cols = "count_before int, count_after int, probe_available boolean, target_http_status int, order_amount_paise bigint"
    rows = [(0, 2, True, 200, 150), (0, 1, True, 401, 150), (0, 0, True, 302, 150), (0, 1, True, 302, 150), (0, None, True, 200, 150), (0, 5, False, 200, 150)]
    df = spark.createDataFrame(rows, cols)

    def outcome(fn, **kw):
        return [(r.status, r.error_code, r.measured_impact_paise) for r in fn(df, **kw).collect()]

    inc = ("INCONCLUSIVE", "PROBE_UNAVAILABLE", None)
    assert outcome(verdicts.verdict_duplicate) == [
        ("VERIFIED", None, 150), ("NOT_REPRODUCED", None, None), ("INCONCLUSIVE", "NO_STATE_CHANGE", None), ("NOT_REPRODUCED", None, None), inc, inc]
    assert outcome(verdicts.verdict_forged) == [
        ("VERIFIED", None, 150), ("NOT_REPRODUCED", None, None), ("NOT_REPRODUCED", None, None), ("INCONCLUSIVE", "AMBIGUOUS_RESPONSE", None), inc, inc]
    assert [s for s, _, _ in outcome(verdicts.verdict_forged, client_errors_only=True)][:4] == ["VERIFIED", "NOT_REPRODUCED", "INCONCLUSIVE", "INCONCLUSIVE"]
    money = spark.createDataFrame([(150000, "1500"), (150000, "150000"), (150000, None), (150000, "x")], "order_amount_paise bigint, actual_amount string")
    assert [(r.status, r.measured_impact_paise) for r in verdicts.verdict_denomination(money).collect()] == [
        ("VERIFIED", 148500), ("NOT_REPRODUCED", None), ("INCONCLUSIVE", None), ("INCONCLUSIVE", None)]


def test_measured_money_needs_a_verified_verdict(spark):
    findings = spark.createDataFrame([(i, "ADVISORY", None) for i in range(5)], "finding_id int, state string, exposure_measured_paise bigint")
    outcomes = spark.createDataFrame(
        [(0, 1, "VERIFIED", 10), (1, 1, "ERROR", 10), (2, 1, "NOT_REPRODUCED", 10), (3, 1, "VERIFIED", 7), (3, 2, "NOT_REPRODUCED", 9)],
        "finding_id int, finished_seq int, status string, measured_impact_paise bigint",
    )
    got = {r.finding_id: (r.state, r.exposure_measured_paise) for r in verdicts.gate_measured(findings, outcomes).collect()}
    assert got == {0: ("VERIFIED", 10), 1: ("ADVISORY", None), 2: ("UNVERIFIED", None), 3: ("UNVERIFIED", 7), 4: ("ADVISORY", None)}
    assert verdicts.smuggled_amounts(outcomes).count() == 3
    assert verdicts.smuggled_amounts(verdicts.scrub_outcomes(outcomes)).count() == 0


def test_retries(spark):
    rows = [("a", 1, 503, False), ("a", 2, None, True), ("a", 3, 500, False), ("b", 1, 500, False), ("b", 2, 404, False), ("c", 1, 200, False), ("d", 4, 200, False), ("d", 1, 500, False), ("e", 4, 200, False)]
    df = spark.createDataFrame(rows, "call_id string, attempt int, http_status int, transport_error boolean")
    got = {r.call_id: (r.status, r.http_status, r.attempts, r.error_code) for r in verdicts.retry_outcomes(df).collect()}
    assert got == {
        "a": ("ERROR", None, 3, "GATEWAY_UNAVAILABLE"), "b": ("ANSWERED", 404, 2, None), "c": ("ANSWERED", 200, 1, None),
        "d": ("ERROR", None, 1, "GATEWAY_UNAVAILABLE"), "e": ("ERROR", None, 0, "GATEWAY_UNAVAILABLE"),
    }


@pytest.mark.parametrize("rows", [100, 5000])
def test_order_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch, rows):
    """A task that numbers and replays lines holds a bounded number of them, however long the table."""
    from riskmill import session
    from riskmill.plans import derived

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    key = F.col("id")
    spark.range(rows).select(
        (key % 1000).alias("l_orderkey"), (key % 7).alias("l_linenumber"), key.alias("l_partkey"), key.alias("l_suppkey"),
        F.lit(1.0).alias("l_extendedprice"), F.lit("2020-01-01").alias("l_shipdate"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    lines = derived.order_lines(spark, str(tmp_path))
    tasks = lines.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == rows
    assert max(r["count"] for r in tasks) <= 1000
    assert lines.groupBy("l_orderkey").agg((F.max("n") == F.count("*")).alias("ok")).filter("NOT ok").isEmpty()
