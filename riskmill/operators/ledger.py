"""Order, payment and refund rules over a log of commands.

The state machine is sequential, but its outcome has a closed form in first times, so the replay is
windows over the commands of an order, which meet once, instead of a fold:

* an order is paid at its first good capture, so a checkout is accepted when it comes before that;
* a capture is good when its payment was authorised before it, is not captured yet, and the amount
  is the payment's;
* refunds on one payment are greedy (a rejected one does not count), which is a running sum as long
  as nothing is rejected. All requests pass in the order of their payment; only those of payments whose
  requests exceed the captured amount are walked, with one running total.

Both inputs are read once and dealt by order or payment once; a key's rows are a sorted run that
spills, never one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions.hashing import hmac_sha256

_INTEGER = r"^-?\d+$"


def validate_orders(orders: DataFrame, amount: str = "amount") -> DataFrame:
    """Accept orders whose amount is a whole number of at least 100 paise.

    ``amount`` is the raw request value as text, so that "12.5" and "abc" can be told apart from
    numbers.
    """
    raw = F.col(amount).cast("string")
    whole = F.coalesce(raw.rlike(_INTEGER), F.lit(False))
    value = F.when(whole, raw.try_cast("long"))
    reason = (
        F.when(~whole, "NOT_AN_INTEGER")
        .when(value.isNull(), "OUT_OF_RANGE")
        .when(value < C.MIN_ORDER_PAISE, "BELOW_MINIMUM")
    )
    return orders.withColumns({"amount_paise": value, "reject_reason": reason, "accepted": reason.isNull()})


def replay_ledger(orders: DataFrame, commands: DataFrame) -> DataFrame:
    """Outcome of every checkout and capture command.

    orders(order_id, amount); commands(order_id, payment_id, seq, command, outcome, amount) with
    command ``checkout`` (outcome ``success`` or ``failure``) or ``capture`` (amount null means the
    payment's). ``seq`` is unique within an order. Each payment id has one checkout, and its
    captures name the same order.
    """
    known = orders.select("order_id", F.col("amount").alias("order_amount"))
    rows = commands.join(known, "order_id", "left")
    checkout = F.col("command") == "checkout"
    capture = F.col("command") == "capture"
    exact = F.coalesce(F.col("amount"), F.col("order_amount")) == F.col("order_amount")
    # a window by payment is satisfied by rows that are dealt by order: both cost one exchange
    of_payment, of_order = Window.partitionBy("order_id", "payment_id"), Window.partitionBy("order_id")
    tried = checkout & F.col("order_amount").isNotNull()
    rows = rows.withColumns(
        {
            "pay_seq": F.min(F.when(tried, F.col("seq"))).over(of_payment),
            "outcome_of": F.min(F.when(tried, F.col("outcome"))).over(of_payment),
        }
    )
    good = capture & (F.col("outcome_of") == "success") & (F.col("seq") > F.col("pay_seq")) & exact
    rows = rows.withColumn("good_seq", F.when(good, F.col("seq")))
    rows = rows.withColumn("captured_seq", F.min("good_seq").over(of_payment)).withColumn("paid_seq", F.min("good_seq").over(of_order))

    # Captures of a payment whose own checkout came after the order was paid do not exist at all.
    alive = F.col("pay_seq").isNotNull() & (F.col("seq") > F.col("pay_seq")) & (
        F.col("paid_seq").isNull() | (F.col("pay_seq") < F.col("paid_seq"))
    )
    capture_reason = (
        F.when(~alive, "UNKNOWN_PAYMENT")
        .when(F.col("seq") > F.col("captured_seq"), "ALREADY_CAPTURED")
        .when(F.col("outcome_of") != "success", "NOT_AUTHORIZED")
        .when(~exact, "AMOUNT_MISMATCH")
    )
    checkout_reason = F.when(F.col("order_amount").isNull(), "UNKNOWN_ORDER").when(
        F.col("seq") > F.col("paid_seq"), "ORDER_ALREADY_PAID"
    )
    out = rows.filter(checkout | capture).select(
        "order_id", "payment_id", "seq", "command", "order_amount",
        F.when(capture, capture_reason).otherwise(checkout_reason).alias("reject_reason"),
    )
    return out.withColumn("accepted", F.col("reject_reason").isNull())


def order_states(orders: DataFrame, replayed: DataFrame) -> DataFrame:
    """Final status and amounts of every order."""
    done = replayed.filter("accepted").groupBy("order_id").agg(
        F.count_if(F.col("command") == "capture").alias("captures"),
        F.count_if(F.col("command") == "checkout").alias("checkouts"),
    )
    zero = F.lit(0).cast("long")
    paid = F.coalesce(F.col("captures"), zero) > 0
    return orders.join(done, "order_id", "left").select(
        "order_id",
        "amount",
        F.when(paid, "paid").when(F.col("checkouts") > 0, "attempted").otherwise("created").alias("status"),
        F.when(paid, F.col("amount")).otherwise(zero).alias("amount_paid"),
        F.when(paid, zero).otherwise(F.col("amount")).alias("amount_due"),
    )


def payment_states(replayed: DataFrame, commands: DataFrame) -> DataFrame:
    """Payments that came to exist, with status before refunds."""
    made = replayed.filter("accepted AND command = 'checkout'").select("order_id", "payment_id", "order_amount", "seq")
    outcome = commands.filter("command = 'checkout'").select("order_id", "payment_id", "seq", "outcome")
    taken = replayed.filter("accepted AND command = 'capture'").select(
        "order_id", "payment_id", F.col("seq").alias("captured_seq")
    )
    return (
        made.join(outcome, ["order_id", "payment_id", "seq"])
        .join(taken, ["order_id", "payment_id"], "left")
        .select(
            "order_id",
            "payment_id",
            F.col("order_amount").alias("amount"),
            F.when(F.col("outcome") == "failure", "failed")
            .when(F.col("captured_seq").isNotNull(), "captured")
            .otherwise("authorized")
            .alias("status"),
            "captured_seq",
        )
    )


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reject what a running total does not hold. Rows arrive sorted by payment and sequence; only tight payments are walked."""
    current, total = None, 0
    for batch in batches:
        reason = batch.column(5)
        at = np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False))
        if len(at):
            walked = [batch.column(k).take(pa.array(at)).to_pylist() for k in (0, 2, 3)]
            refused = np.zeros(batch.num_rows, bool)
            for k, payment, amount, captured in zip(at, *walked):
                if payment != current:
                    current, total = payment, 0
                if total + amount <= captured:
                    total += amount
                else:
                    refused[k] = True
            reason = pc.if_else(pa.array(refused), pa.scalar("EXCEEDS_CAPTURED"), reason)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], reason], names=["payment_id", "seq", "amount", "reject_reason"])


def apply_refund_limit(refunds: DataFrame, payments: DataFrame) -> DataFrame:
    """Accept or reject every refund request.

    refunds(payment_id, seq, amount) with ``seq`` unique per payment; payments(payment_id, captured)
    where ``captured`` is the captured amount or null, and optionally ``captured_seq``.
    """
    types = dict(refunds.dtypes)
    if "captured_seq" not in payments.columns:
        payments = payments.withColumn("captured_seq", F.lit(None).cast(types["seq"]))
    rows = refunds.select("payment_id", "seq", "amount").join(
        payments.select("payment_id", "captured", "captured_seq", F.lit(True).alias("known")), "payment_id", "left"
    )
    early = F.col("captured").isNull() | F.coalesce(F.col("seq") < F.col("captured_seq"), F.lit(False))
    reason = (
        F.when(F.col("known").isNull(), "UNKNOWN_PAYMENT")
        .when(early, "NOT_CAPTURED")
        .when(F.col("amount").isNull() | (F.col("amount") <= 0), "INVALID_AMOUNT")
        .when(F.col("amount") > F.col("captured"), "EXCEEDS_CAPTURED")
    )
    judged = rows.withColumn("reject_reason", reason)
    open_ = F.col("reject_reason").isNull()
    # requests that fit as a whole need no walk
    asked = F.sum(F.when(open_, F.col("amount"))).over(Window.partitionBy("payment_id"))
    tight = open_ & F.coalesce(asked > F.col("captured"), F.lit(False))
    dealt = judged.select("payment_id", "seq", "amount", "captured", tight.alias("tight"), "reject_reason")
    walked = dealt.sortWithinPartitions("payment_id", "seq").mapInArrow(
        _greedy, f"payment_id {types['payment_id']}, seq {types['seq']}, amount {types['amount']}, reject_reason string"
    )
    return walked.withColumn("accepted", F.col("reject_reason").isNull())


def refund_totals(judged: DataFrame, payments: DataFrame) -> DataFrame:
    """Refunded amount per payment and whether it is fully refunded."""
    total = judged.filter("accepted").groupBy("payment_id").agg(F.sum("amount").alias("refunded"))
    refunded = F.coalesce(F.col("refunded"), F.lit(0).cast("long"))
    return payments.join(total, "payment_id", "left").select(
        "payment_id",
        "captured",
        refunded.alias("refunded"),
        F.when(F.col("captured").isNotNull() & (refunded >= F.col("captured")), "refunded")
        .when(F.col("captured").isNotNull(), "captured")
        .alias("status"),
    )


def payments_of_orders(payments: DataFrame) -> DataFrame:
    """Number and amount of payments per order."""
    return payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_payments"), F.sum("amount").cast("long").alias("amount")
    )


def verify_signatures(deliveries: DataFrame, secret: str, body: str = "body", signature: str = "signature") -> DataFrame:
    """Mark each delivery by its signature over the raw body."""
    return deliveries.withColumn("valid", F.coalesce(hmac_sha256(F.col(body), secret) == F.col(signature), F.lit(False)))


def reconciliation(replayed: DataFrame, judged_refunds: DataFrame) -> DataFrame:
    """Accepted and rejected commands by kind and reason."""
    commands = replayed.select("command", "reject_reason").unionByName(
        judged_refunds.select(F.lit("refund").alias("command"), "reject_reason")
    )
    return commands.groupBy("command", F.coalesce("reject_reason", F.lit("ACCEPTED")).alias("result")).agg(
        F.count(F.lit(1)).alias("n")
    )
