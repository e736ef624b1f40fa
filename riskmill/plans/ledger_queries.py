"""Queries on orders, payments, refunds, verdicts and the audit log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskmill.operators import audit, ledger, verdicts
from riskmill.plans import derived as D
from riskmill.plans.registry import query, table
from riskmill.plans.scan_queries import _KEY, hmac_sql

# --- orders and payments -------------------------------------------------------------------


@query(
    "order_validation",
    """SELECT order_id, CASE WHEN regexp_matches(raw, '^-?\\d+$') THEN CAST(raw AS BIGINT) END AS amount_paise,
         CASE WHEN NOT regexp_matches(raw, '^-?\\d+$') THEN 'NOT_AN_INTEGER' WHEN CAST(raw AS BIGINT) < 100 THEN 'BELOW_MINIMUM' END AS reject_reason,
         coalesce(regexp_matches(raw, '^-?\\d+$') AND TRY_CAST(raw AS BIGINT) >= 100, false) AS accepted
       FROM (SELECT o_orderkey AS order_id, CASE o_orderkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN (o_custkey % 200)::VARCHAR WHEN 2 THEN (o_custkey % 9) || '.5'
             ELSE (o_custkey * 100)::VARCHAR END AS raw FROM orders)""",
)
def order_validation(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    raw = (
        F.when(key % 5 == 0, F.lit("abc"))
        .when(key % 5 == 1, (cust % 200).cast("string"))
        .when(key % 5 == 2, F.concat((cust % 9).cast("string"), F.lit(".5")))
        .otherwise((cust * 100).cast("string"))
    )
    orders = table(spark, sf, "orders").select(key.alias("order_id"), raw.alias("amount"))
    return ledger.validate_orders(orders).drop("amount")


# The SQL replays each order command by command.
_REPLAY = f"""{D.PAYMENT_COMMANDS}, commands AS (
    SELECT order_id, payment_id, seq, 'checkout' AS command, outcome, NULL::BIGINT AS amount FROM checkouts
    UNION ALL SELECT order_id, payment_id, seq, 'capture', NULL, amount FROM captures),
  numbered AS (SELECT c.*, o.amount AS order_amount, row_number() OVER (PARTITION BY c.order_id ORDER BY seq) AS rn
               FROM commands c JOIN paise_orders o ON o.order_id = c.order_id),
  steps AS (
    SELECT order_id, 0::BIGINT AS rn, NULL::VARCHAR AS payment_id, NULL::BIGINT AS seq, NULL::VARCHAR AS command, NULL::VARCHAR AS reason,
           []::VARCHAR[] AS authorized, []::VARCHAR[] AS failed, []::VARCHAR[] AS captured FROM paise_orders
    UNION ALL
    SELECT s.order_id, n.rn, n.payment_id, n.seq, n.command, reason,
      CASE WHEN n.command = 'checkout' AND reason IS NULL AND n.outcome = 'success' THEN list_append(authorized, n.payment_id) ELSE authorized END,
      CASE WHEN n.command = 'checkout' AND reason IS NULL AND n.outcome = 'failure' THEN list_append(failed, n.payment_id) ELSE failed END,
      CASE WHEN n.command = 'capture' AND reason IS NULL THEN list_append(captured, n.payment_id) ELSE captured END
    FROM (SELECT s.order_id, s.authorized, s.failed, s.captured, s.rn,
            CASE WHEN n.command = 'checkout' THEN CASE WHEN len(s.captured) > 0 THEN 'ORDER_ALREADY_PAID' END
                 WHEN list_contains(s.captured, n.payment_id) THEN 'ALREADY_CAPTURED'
                 WHEN list_contains(s.failed, n.payment_id) THEN 'NOT_AUTHORIZED'
                 WHEN NOT list_contains(s.authorized, n.payment_id) THEN 'UNKNOWN_PAYMENT'
                 WHEN coalesce(n.amount, n.order_amount) <> n.order_amount THEN 'AMOUNT_MISMATCH' END AS reason
          FROM steps s JOIN numbered n ON n.order_id = s.order_id AND n.rn = s.rn + 1) s
      JOIN numbered n ON n.order_id = s.order_id AND n.rn = s.rn + 1),
  replayed AS (SELECT order_id, payment_id, seq, command, reason AS reject_reason, reason IS NULL AS accepted FROM steps WHERE rn > 0)"""


def _replayed(spark, sf):
    commands = D.payment_commands(spark, sf)
    return ledger.replay_ledger(D.paise_orders(spark, sf), commands), commands


@query("ledger_replay", f"WITH RECURSIVE {_REPLAY} SELECT * FROM replayed")
def ledger_replay(spark, sf):
    return _replayed(spark, sf)[0].drop("order_amount")


@query(
    "order_states",
    f"""WITH RECURSIVE {_REPLAY} SELECT o.order_id, o.amount, CASE WHEN coalesce(c, 0) > 0 THEN 'paid' WHEN coalesce(k, 0) > 0 THEN 'attempted' ELSE 'created' END AS status,
          CASE WHEN coalesce(c, 0) > 0 THEN o.amount ELSE 0 END AS amount_paid, CASE WHEN coalesce(c, 0) > 0 THEN 0 ELSE o.amount END AS amount_due
        FROM paise_orders o LEFT JOIN (SELECT order_id, count(*) FILTER (command = 'capture') AS c, count(*) FILTER (command = 'checkout') AS k
          FROM replayed WHERE accepted GROUP BY 1) r ON r.order_id = o.order_id""",
)
def order_states(spark, sf):
    return ledger.order_states(D.paise_orders(spark, sf), _replayed(spark, sf)[0])


@query(
    "payment_states",
    f"""WITH RECURSIVE {_REPLAY} SELECT k.order_id, k.payment_id, o.amount, CASE WHEN c.outcome = 'failure' THEN 'failed' WHEN p.seq IS NOT NULL THEN 'captured' ELSE 'authorized' END AS status
        FROM replayed k JOIN checkouts c ON c.payment_id = k.payment_id JOIN paise_orders o ON o.order_id = k.order_id
          LEFT JOIN (SELECT payment_id, seq FROM replayed WHERE accepted AND command = 'capture') p ON p.payment_id = k.payment_id
        WHERE k.accepted AND k.command = 'checkout'""",
)
def payment_states(spark, sf):
    replayed, commands = _replayed(spark, sf)
    return ledger.payment_states(replayed, commands).drop("captured_seq")


@query(
    "payments_of_orders",
    f"""WITH RECURSIVE {_REPLAY} SELECT k.order_id, count(*) AS n_payments, CAST(sum(o.amount) AS BIGINT) AS amount FROM replayed k JOIN paise_orders o ON o.order_id = k.order_id
        WHERE accepted AND command = 'checkout' GROUP BY 1""",
)
def payments_of_orders(spark, sf):
    return ledger.payments_of_orders(ledger.payment_states(*_replayed(spark, sf)))


_REFUNDS = f"""{D.REFUND_REQUESTS}, asked AS (
    SELECT r.*, captured, row_number() OVER (PARTITION BY r.payment_id ORDER BY seq) AS rn FROM refunds r JOIN payments p ON p.payment_id = r.payment_id),
  fold AS (
    SELECT payment_id, 0::BIGINT AS rn, 0::BIGINT AS seq, 0::BIGINT AS amount, NULL::VARCHAR AS reject_reason, 0::BIGINT AS total FROM payments
    UNION ALL
    SELECT a.payment_id, a.rn, a.seq, a.amount,
      CASE WHEN captured IS NULL THEN 'NOT_CAPTURED' WHEN a.amount <= 0 THEN 'INVALID_AMOUNT' WHEN f.total + a.amount > captured THEN 'EXCEEDS_CAPTURED' END,
      f.total + CASE WHEN captured IS NOT NULL AND a.amount > 0 AND f.total + a.amount <= captured THEN a.amount ELSE 0 END
    FROM fold f JOIN asked a ON a.payment_id = f.payment_id AND a.rn = f.rn + 1),
  judged AS (SELECT payment_id, seq, amount, reject_reason, reject_reason IS NULL AS accepted FROM fold WHERE rn > 0)"""


@query("refund_limit", f"WITH RECURSIVE {_REFUNDS} SELECT * FROM judged")
def refund_limit(spark, sf):
    return ledger.apply_refund_limit(*D.refund_requests(spark, sf))


@query(
    "refund_totals",
    f"""WITH RECURSIVE {_REFUNDS} SELECT p.payment_id, captured, coalesce(t, 0)::BIGINT AS refunded,
          CASE WHEN captured IS NULL THEN NULL WHEN coalesce(t, 0) >= captured THEN 'refunded' ELSE 'captured' END AS status
        FROM payments p LEFT JOIN (SELECT payment_id, sum(amount) AS t FROM judged WHERE accepted GROUP BY 1) j ON j.payment_id = p.payment_id""",
)
def refund_totals(spark, sf):
    refunds, payments = D.refund_requests(spark, sf)
    return ledger.refund_totals(ledger.apply_refund_limit(refunds, payments), payments)


@query(
    "ledger_reconciliation",
    f"""WITH RECURSIVE {_REPLAY}, refunds AS {_REFUNDS.split(", refunds AS ", 1)[1]}
        SELECT command, coalesce(reject_reason, 'ACCEPTED') AS result, count(*) AS n FROM (
          SELECT command, reject_reason FROM replayed UNION ALL SELECT 'refund', reject_reason FROM judged) GROUP BY ALL""",
)
def ledger_reconciliation(spark, sf):
    return ledger.reconciliation(_replayed(spark, sf)[0], ledger.apply_refund_limit(*D.refund_requests(spark, sf)))


def deliveries(spark, sf):
    return deliveries_of(D.keyed_events(spark, sf))


def deliveries_of(keyed):
    """Events as signed deliveries; those with k below 20 carry a wrong signature."""
    body = F.concat(F.lit('{"event":"'), "event_type", F.lit('","payload":'), "meta", F.lit(',"user":'), F.col("user_id").cast("string"), F.lit("}"))
    rows = keyed.withColumn("body", body)
    from riskmill.functions.hashing import hmac_sha256

    good = hmac_sha256(F.col("body"), _KEY)
    return rows.withColumn("signature", F.when(F.col("k") < 20, F.reverse(good)).otherwise(good))


@query(
    "signature_check",
    f"""WITH {D.KEYED_EVENTS}, d AS (SELECT *, {hmac_sql("body")} AS good FROM (SELECT *, '{{"event":"' || event_type || '","payload":' || meta || ',"user":' || user_id || '}}' AS body FROM keyed))
        SELECT event_id, CASE WHEN k < 20 THEN reverse(good) ELSE good END AS signature, CASE WHEN k < 20 THEN reverse(good) ELSE good END = good AS valid FROM d""",
)
def signature_check(spark, sf):
    return ledger.verify_signatures(deliveries(spark, sf), _KEY).select("event_id", "signature", "valid")


# --- verdicts ------------------------------------------------------------------------------

_EFFECT_KEY = "user_id || '-' || event_type || '-' || k"


def effects(spark, sf):
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type", F.col("k").cast("string"))
    return D.keyed_events(spark, sf).select(key.alias("event_key"), F.lit(1).alias("effects"), "value", "k")


@query(
    "duplicate_effects",
    f"WITH {D.KEYED_EVENTS} SELECT {_EFFECT_KEY} AS event_key, count(*) AS effects FROM keyed GROUP BY 1 HAVING count(*) >= 2",
)
def duplicate_effects(spark, sf):
    return verdicts.duplicate_effects(effects(spark, sf), "event_key")


@query(
    "duplicate_verdicts",
    f"""WITH {D.KEYED_EVENTS}, e AS (SELECT {_EFFECT_KEY} AS event_key, count(*) - 1 AS count_after, CAST(round(max(value) * 100) AS BIGINT) AS amount, min(k) AS k FROM keyed GROUP BY 1)
        SELECT event_key, CASE WHEN k % 10 = 0 THEN 'INCONCLUSIVE' WHEN count_after + 1 >= 2 THEN 'VERIFIED' WHEN k % 3 = 0 THEN 'INCONCLUSIVE' ELSE 'NOT_REPRODUCED' END AS status,
          CASE WHEN k % 10 = 0 THEN 'PROBE_UNAVAILABLE' WHEN count_after = 0 AND k % 3 = 0 THEN 'NO_STATE_CHANGE' END AS error_code,
          CASE WHEN k % 10 <> 0 AND count_after + 1 >= 2 THEN amount END AS measured_impact_paise FROM e""",
)
def duplicate_verdicts(spark, sf):
    """Evidence per event key: the number of effects is the probe's difference, some seen as none."""
    found = effects(spark, sf).groupBy("event_key").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("value") * 100, 0).cast("long").alias("order_amount_paise"), F.min("k").alias("k")
    )
    single_unseen = (F.col("n") == 1) & (F.col("k") % 3 == 0)
    evidence = found.select(
        "event_key", "order_amount_paise", (F.col("k") % 10 != 0).alias("probe_available"), F.lit(5).alias("count_before"),
        (F.lit(5) + F.when(single_unseen, 0).otherwise(F.col("n"))).alias("count_after"),
    )
    return verdicts.verdict_duplicate(evidence).select("event_key", "status", "error_code", "measured_impact_paise")


_FORGED = f"""{D.KEYED_EVENTS}, e AS (SELECT event_id, k, CASE WHEN k % 4 = 0 THEN 200 WHEN k % 4 = 1 THEN 401 WHEN k % 4 = 2 THEN 302 ELSE 500 END AS http,
    k % 3 AS delta, k % 10 <> 9 AS probe, CAST(round(value * 100) AS BIGINT) AS amount FROM keyed)"""


def _forged_evidence(spark, sf):
    k = F.col("k")
    return D.keyed_events(spark, sf).select(
        "event_id",
        F.when(k % 4 == 0, 200).when(k % 4 == 1, 401).when(k % 4 == 2, 302).otherwise(500).alias("target_http_status"),
        F.lit(0).alias("count_before"), (k % 3).alias("count_after"), (k % 10 != 9).alias("probe_available"),
        F.round(F.col("value") * 100, 0).cast("long").alias("order_amount_paise"),
    )


@query(
    "forged_verdicts",
    f"""WITH {_FORGED}, v AS (SELECT *, CASE WHEN NOT probe THEN 'INCONCLUSIVE' WHEN http BETWEEN 200 AND 299 AND delta >= 1 THEN 'VERIFIED' WHEN http >= 400 OR delta = 0 THEN 'NOT_REPRODUCED' ELSE 'INCONCLUSIVE' END AS status FROM e)
        SELECT event_id, status, CASE WHEN NOT probe THEN 'PROBE_UNAVAILABLE' WHEN status = 'INCONCLUSIVE' THEN 'AMBIGUOUS_RESPONSE' END AS error_code,
          CASE WHEN status = 'VERIFIED' THEN amount END AS measured_impact_paise FROM v""",
)
def forged_verdicts(spark, sf):
    return verdicts.verdict_forged(_forged_evidence(spark, sf)).select("event_id", "status", "error_code", "measured_impact_paise")


@query(
    "forged_verdicts_older_form",
    f"""WITH {_FORGED} SELECT event_id, CASE WHEN http BETWEEN 200 AND 299 AND delta >= 1 THEN 'VERIFIED' WHEN http BETWEEN 400 AND 499 THEN 'NOT_REPRODUCED' ELSE 'INCONCLUSIVE' END AS status FROM e""",
)
def forged_verdicts_older_form(spark, sf):
    return verdicts.verdict_forged(_forged_evidence(spark, sf), client_errors_only=True).select("event_id", "status")


@query(
    "denomination_check",
    f"""WITH {D.PAISE_ORDERS}, e AS (SELECT order_id, amount, amount // 100 * 100 AS expected, CASE order_id % 5 WHEN 0 THEN (amount // 100)::VARCHAR WHEN 1 THEN 'none' ELSE (amount // 100 * 100)::VARCHAR END AS raw FROM paise_orders)
        SELECT order_id, CASE WHEN raw = 'none' THEN 'INCONCLUSIVE' WHEN TRY_CAST(raw AS BIGINT) <> expected THEN 'VERIFIED' ELSE 'NOT_REPRODUCED' END AS status,
          CASE WHEN raw = 'none' THEN 'NO_AMOUNT' END AS error_code, CASE WHEN TRY_CAST(raw AS BIGINT) <> expected THEN abs(expected - TRY_CAST(raw AS BIGINT)) END AS measured_impact_paise FROM e""",
)
def denomination_check(spark, sf):
    rupees = F.expr("amount DIV 100")
    key = F.col("order_id")
    evidence = D.paise_orders(spark, sf).select(
        "order_id", F.col("amount").alias("order_amount_paise"),
        F.when(key % 5 == 0, rupees.cast("string")).when(key % 5 == 1, F.lit("none")).otherwise((rupees * 100).cast("string")).alias("actual_amount"),
    )
    return verdicts.verdict_denomination(evidence).select("order_id", "status", "error_code", "measured_impact_paise")


@query(
    "retry_outcomes",
    """WITH l AS (SELECT l_orderkey AS call_id, l_linenumber AS line, min(CASE WHEN l_returnflag = 'R' THEN 503 WHEN l_returnflag = 'A' THEN 404 ELSE 200 END) AS http, bool_or(l_linestatus = 'F' AND l_returnflag = 'N') AS broken FROM lineitem GROUP BY ALL),
       a AS (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY line) AS attempt, http, broken FROM l),
       ok AS (SELECT call_id, min(attempt) AS hit_at, arg_min(http, attempt) AS http FROM a WHERE attempt <= 3 AND NOT broken AND http < 500 GROUP BY 1),
       tried AS (SELECT call_id, least(max(attempt), 3) AS n FROM a GROUP BY 1)
       SELECT t.call_id, ok.http AS http_status, coalesce(hit_at, n)::BIGINT AS attempts, CASE WHEN hit_at IS NULL THEN 'ERROR' ELSE 'ANSWERED' END AS status,
         CASE WHEN hit_at IS NULL THEN 'GATEWAY_UNAVAILABLE' END AS error_code FROM tried t LEFT JOIN ok ON ok.call_id = t.call_id""",
)
def retry_outcomes(spark, sf):
    flag = F.col("l_returnflag")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call_id"), "l_linenumber").agg(
        F.min(F.when(flag == "R", 503).when(flag == "A", 404).otherwise(200)).alias("http_status"),
        F.bool_or((F.col("l_linestatus") == "F") & (flag == "N")).alias("transport_error"),
    )
    order = Window.partitionBy("call_id").orderBy("l_linenumber")
    return verdicts.retry_outcomes(lines.withColumn("attempt", F.row_number().over(order)))


_OUTCOMES = f"""{D.SCAN_TABLES}, outcomes AS (SELECT finding_id, part AS finished_seq, CASE part % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'NOT_REPRODUCED' WHEN 2 THEN 'ERROR' ELSE 'INCONCLUSIVE' END AS status,
    paise AS measured_impact_paise FROM findings)"""


def outcomes(findings):
    """One outcome per finding; every one carries an amount, also those that must not."""
    part = F.col("part")
    status = F.when(part % 4 == 0, "VERIFIED").when(part % 4 == 1, "NOT_REPRODUCED").when(part % 4 == 2, "ERROR").otherwise("INCONCLUSIVE")
    return findings.select("finding_id", part.alias("finished_seq"), status.alias("status"), F.col("paise").alias("measured_impact_paise"))


@query(
    "measured_gate",
    f"""WITH {_OUTCOMES} SELECT f.finding_id, CASE o.status WHEN 'VERIFIED' THEN 'VERIFIED' WHEN 'NOT_REPRODUCED' THEN 'UNVERIFIED' ELSE f.state END AS state,
          CASE WHEN o.status = 'VERIFIED' THEN o.measured_impact_paise END AS exposure_measured_paise FROM findings f JOIN outcomes o ON o.finding_id = f.finding_id""",
)
def measured_gate(spark, sf):
    findings = D.scan_tables(spark, sf)["findings"].withColumn("exposure_measured_paise", F.lit(None).cast("long"))
    return verdicts.gate_measured(findings, outcomes(findings)).select("finding_id", "state", "exposure_measured_paise")


@query(
    "smuggled_amounts",
    f"WITH {_OUTCOMES} SELECT finding_id, status FROM outcomes WHERE status <> 'VERIFIED'",
)
def smuggled_amounts(spark, sf):
    """The raw outcomes all smuggle; after scrubbing none is left, which a test asserts."""
    findings = D.scan_tables(spark, sf)["findings"]
    return verdicts.smuggled_amounts(outcomes(findings)).select("finding_id", "status")


# --- audit ---------------------------------------------------------------------------------


@query("audit_append", f"WITH RECURSIVE {D.AUDIT_CHAIN} SELECT chain, seq, prev_hash, hash FROM log")
def audit_append(spark, sf):
    return audit.append_chain(D.audit_events(spark, sf), "chain").select("chain", "seq", "prev_hash", "hash")


def tampered_log(spark, sf):
    """The log with hashes changed where the event number ends in 77 and links where it ends in 55."""
    log = audit.append_chain(D.audit_events(spark, sf), "chain")
    ending = F.col("seq") % 100
    return log.withColumns(
        {
            "hash": F.when(ending == 77, F.reverse("hash")).otherwise(F.col("hash")),
            "prev_hash": F.when(ending == 55, F.reverse("prev_hash")).otherwise(F.col("prev_hash")),
        }
    )


_TAMPERED = f"""{D.AUDIT_CHAIN}, stored AS (SELECT chain, seq, payload, CASE WHEN seq % 100 = 77 THEN reverse(hash) ELSE hash END AS hash, CASE WHEN seq % 100 = 55 THEN reverse(prev_hash) ELSE prev_hash END AS prev_hash FROM log),
  linked AS (SELECT *, lag(hash, 1, repeat('0', 64)) OVER (PARTITION BY chain ORDER BY seq) AS expected FROM stored),
  checked AS (SELECT *, CASE WHEN prev_hash <> expected THEN 'LINK' WHEN hash <> sha256(expected || payload) THEN 'HASH' END AS failure FROM linked)"""


@query(
    "audit_verify",
    f"""WITH RECURSIVE {_TAMPERED} SELECT chain, count(*) AS n_events, min(seq) FILTER (failure IS NOT NULL) AS bad_seq,
          arg_min(failure, seq) FILTER (failure IS NOT NULL) AS reason, count(failure) = 0 AS ok FROM checked GROUP BY chain""",
)
def audit_verify(spark, sf):
    return audit.verify_chain(tampered_log(spark, sf), ["chain"], width=1000)


@query(
    "audit_failures",
    f"WITH RECURSIVE {_TAMPERED} SELECT chain, seq, failure FROM checked WHERE failure IS NOT NULL",
)
def audit_failures(spark, sf):
    return audit.check_links(tampered_log(spark, sf), ["chain"], width=1000).filter("failure IS NOT NULL").select("chain", "seq", "failure")


@query(
    "audit_page",
    f"""WITH RECURSIVE {D.AUDIT_CHAIN} SELECT chain, seq, hash, (SELECT count(*) FROM log) AS total, false AS chain_ok FROM log ORDER BY seq DESC LIMIT 50 OFFSET 10""",
)
def audit_page(spark, sf):
    """Newest events. The chains of all users read as one chain do not link, so chain_ok is false."""
    log = audit.append_chain(D.audit_events(spark, sf), "chain")
    return audit.audit_page(log, 50, 10).select("chain", "seq", "hash", "total", "chain_ok")


@query(
    "audit_page_by_chain",
    f"""WITH RECURSIVE {_TAMPERED}, verdicts AS (SELECT chain, count(failure) = 0 AS chain_ok FROM checked GROUP BY chain)
        SELECT chain, seq, hash, (SELECT count(*) FROM stored) AS total, chain_ok FROM (SELECT * FROM stored ORDER BY seq DESC LIMIT 200) JOIN verdicts USING (chain)""",
)
def audit_page_by_chain(spark, sf):
    """Newest events of all chains, each with the verdict on its own: some are whole, some are broken."""
    return audit.audit_page(tampered_log(spark, sf), 200, 0, ["chain"]).select("chain", "seq", "hash", "total", "chain_ok")


@query(
    "audit_verify_new",
    f"""WITH RECURSIVE {_TAMPERED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq) AS n,
            min(seq) FILTER (failure IS NOT NULL) OVER (PARTITION BY chain) AS bad FROM checked),
          marks AS (SELECT chain, max(seq) AS mark FROM ranked WHERE n <= 20 AND (bad IS NULL OR seq < bad) GROUP BY chain),
          fresh AS (SELECT r.*, mark FROM ranked r LEFT JOIN marks USING (chain) WHERE mark IS NULL OR seq > mark)
        SELECT chain, count(*) AS n_events, any_value(bad) AS bad_seq, arg_min(failure, seq) FILTER (failure IS NOT NULL) AS reason, any_value(bad) IS NULL AS ok,
          coalesce(max(seq) FILTER (bad IS NULL OR seq < bad), any_value(mark)) AS seq FROM fresh GROUP BY chain""",
)
def audit_verify_new(spark, sf):
    """The first twenty events of every chain are verified and marked, then only what follows the marks."""
    log = tampered_log(spark, sf)
    place = Window.partitionBy("chain").orderBy("seq")
    early = log.withColumn("n", F.row_number().over(place)).filter("n <= 20").drop("n")
    nothing = log.select("chain", "seq", "hash").filter("false")
    mark = audit.verify_since(early, nothing, ["chain"], width=1000).filter("seq IS NOT NULL").select("chain", "seq", "hash")
    return audit.verify_since(log, mark, ["chain"], width=1000).drop("hash")
