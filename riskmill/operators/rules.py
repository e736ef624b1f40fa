"""Detection rules: a table of patterns compiled into one array column per code unit.

A rule is a row, so users add rules without writing functions. All rules of a table become one array of
conditions and one array of hits, followed by one explode: one pass over the corpus, no Python worker, no
shuffle. A pattern runs only on texts and lines that hold the literals it cannot match without
(``functions.literals``), so plain byte searches decide most texts, and lines are cut only for texts with
a hit. The arrays are SQL text, read by the JVM at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions import literals as L
from riskmill.functions import textops as T


@dataclass(frozen=True)
class Rule:
    """``all_of`` patterns must match, ``none_of`` patterns must not.

    ``on_code`` tests the text without comments. ``evidence`` patterns select lines of the raw
    text; with ``evidence_also`` a line must match both and a hit needs at least one such line.
    ``allowed_values`` turns the first ``all_of`` pattern into a capture: the hit needs a captured
    value outside that list, and ``{values}`` in the explanation becomes all such values. ``cap`` limits the
    evidence lines of a hit (None: all). Patterns ignore case unless listed in ``cased``.
    """

    rule_id: str
    defect_class: str
    severity: str
    confidence: float
    explanation: str
    all_of: Sequence[str] = ()
    none_of: Sequence[str] = ()
    on_code: bool = False
    kind: str | None = None
    scenarios: Sequence[str] = ()
    evidence: Sequence[str] = ()
    evidence_also: str | None = None
    cap: int | None = None
    allowed_values: Sequence[str] | None = None
    cased: frozenset[str] = field(default_factory=frozenset)


# --- fixed values: the patterns of the built-in rules --------------------------------------

ORDER_CREATE = r"\b(orders?\.(create|place)|/v1/orders)\b"
ORDER_LOOKUP = (
    r"\b(find|get|fetch|lookup|exists|check|query|select|filter)\b.*"
    r"(order|receipt|idempoten|cart|transaction)"
)
UNIQUE_WORD = r"\b(unique|UNIQUE|UniqueConstraint|unique_together)\b"
LOOP_WORD = r"\b(for|while|retry|backoff|attempts?)\b"
LOOP_TARGET = r"\b(orders?\.(create|place)|payments?\.(capture)|refund)\b"
IDEMPOTENCY_WORD = r"\b(idempoten|unique_key|X-Payout-Idempotency)\b"
FULFILLMENT = (
    r"\b(fulfill\w*|credit\w*|ship\w*|dispatch|"
    r"grant_access|activate_subscription|deliver\w*|"
    r"send_order|confirm_order|process_order|complete_order)\b"
)
EVENT_DEDUP = (
    r"\b(already.*processed|already.*handled|already.*seen|"
    r"mark.*processed|set.*processed|event_log|processed_events|"
    r"ProcessedEvent|EventLog|idempoten|"
    r"processed[_-]?events?|seen[_-]?events?|"
    r"(has|includes|add)\s*\(\s*event[_-]?id|"
    r"(find|get|fetch|lookup|exists|filter|query)\s*\(.*event_id|"
    r"(find|get|fetch|lookup|exists|filter|query)\s*\(.*payment_id)\b"
)
REFUND_CALL = r"\b(refund|rfnd)\b.*\b(create|post|issue|process)\b"
REFUND_CHECK = (
    r"\b(already.*refund|refund.*exist|find.*refund|get.*refund|check.*refund|"
    r"refund.*processed|rfnd_)\b"
)
SIGNATURE_CHECK = (
    r"\b(verify_webhook_signature|validateWebhookSignature|"
    r"hmac.*sha256|createHmac|compute.*signature|verify.*signature)\b"
)
PARSED_BODY = (
    r"\b(body|payload|data)\s*=\s*(JSON\.parse|json\.loads|request\.json\(\)|"
    r"await req\.json\(\))"
)
HMAC_OF_PARSED = r"(hmac|signature|createHmac)\s*[\(,]\s*(body|payload|data|parsed)\b"
EVENT_STORE = (
    r"\b(event_id|X-Razorpay-Event-Id|payment_id|pay_|"
    r"processed_events|event_log|idempoten)\b"
)
PAYLOAD_AMOUNT = r"payload.*amount|event.*amount|data.*amount|body.*amount"
ORDER_FETCH = r"\b(orders?\.fetch|payments?\.fetch|/v1/orders?/|/v1/payments?/)\b"
ORDER_CREATE_LOOSE = r"\borders?\.create\b|/v1/orders\b"
DOUBLE_HUNDRED = r"\*\s*100\s*\*\s*100|\*100\s*\*100"
RUPEE_NAME = r"\b(amount_inr|rupees?|inr_amount|price_inr|cost_inr|value_inr)\b"
PAISE_CONVERSION = r"\*\s*100\b|\bpaise\b|\bto_paise\b|\bint\s*\(\s*.*\*\s*100"
FLOAT_ARITHMETIC = r"(\d+\.\d+\s*[+\-*/]|\s*[+\-*/]\s*\d+\.\d+)"
MONEY_WORD = r"\b(amount|price|total|cost|value|fee|tax|gst)\b"
DECIMAL_WORD = r"\b(Decimal|decimal\.Decimal|toFixed\(|Math\.round)\b"
CLIENT_AMOUNT = (
    r"(req\.body\.(amount|price|total)|"
    r"request\.json\(\)\[.amount.\]|"
    r"request\.json\[.amount.\]|"
    r"request\.form\.get\(.amount.\)|"
    r"params\[.amount.\]|query\[.amount.\]|"
    r"body\[.amount.\]|"
    r"req\.body\[.amount.\]|"
    r"req\.query\.(amount|price|total))"
)
SERVER_AMOUNT = (
    r"\b(compute_total|calculate_amount|get_order_amount|db\.(get|find)|"
    r"Product\.(get|find)|Cart\.(get|find)|ORDER_AMOUNT)\b"
)
CURRENCY_LITERAL = r"""['"]currency['"]\s*:\s*['"](\w+)['"]"""
INJECTED_PHRASE = (
    r"(ignore\s+(previous|prior|above|all)\s+instructions?|"
    r"disregard\s+(your|the)\s+instructions?|"
    r"you\s+are\s+now\s+a|"
    r"send\s+(the|all|this)\s+(data|info|credentials?|keys?|secrets?)\s+to\b)"
)

BUILT_IN_RULES = [  # fixed values
    Rule(
        "DP-R1", C.DUPLICATE_PAYMENT, "HIGH", 0.55,
        "An order is created and nothing looks for an existing one; a client retry charges twice.",
        all_of=[ORDER_CREATE], none_of=[ORDER_LOOKUP, UNIQUE_WORD], on_code=True,
        scenarios=["DP-1"], evidence=[ORDER_CREATE],
    ),
    Rule(
        "DP-R2", C.DUPLICATE_PAYMENT, "HIGH", 0.60,
        "A create, capture or refund call sits in a retry loop without an idempotency key.",
        all_of=[LOOP_WORD, LOOP_TARGET], none_of=[IDEMPOTENCY_WORD], on_code=True,
        scenarios=["DP-1", "DP-3"], evidence=[LOOP_TARGET],
    ),
    Rule(
        "DP-R3", C.DUPLICATE_PAYMENT, "CRITICAL", 0.70,
        "A webhook handler fulfills without asking whether the event was handled before.",
        all_of=[FULFILLMENT], none_of=[EVENT_DEDUP], on_code=True, kind="WEBHOOK",
        scenarios=["DP-2"], evidence=[FULFILLMENT],
    ),
    Rule(
        "DP-R4", C.DUPLICATE_PAYMENT, "HIGH", 0.55,
        "A refund is issued without a look at refunds already made for the payment.",
        all_of=[REFUND_CALL], none_of=[REFUND_CHECK], scenarios=["DP-3"], evidence=[REFUND_CALL],
    ),
    Rule(
        "WI-R1", C.WEBHOOK_INTEGRITY, "CRITICAL", 0.80,
        "The webhook handler never checks the signature, so anyone can post an event.",
        none_of=[SIGNATURE_CHECK], kind="WEBHOOK", scenarios=["WI-1"],
    ),
    Rule(
        "WI-R2", C.WEBHOOK_INTEGRITY, "HIGH", 0.65,
        "The keyed digest is taken over a parsed body instead of the bytes received.",
        all_of=[PARSED_BODY, HMAC_OF_PARSED], kind="WEBHOOK", scenarios=["WI-2"],
        evidence=[PARSED_BODY, HMAC_OF_PARSED],
    ),
    Rule(
        "WI-R3", C.WEBHOOK_INTEGRITY, "HIGH", 0.65,
        "The webhook handler keeps no record of event or payment ids before its side effect.",
        all_of=[FULFILLMENT], none_of=[EVENT_STORE], kind="WEBHOOK", scenarios=["WI-3"],
    ),
    Rule(
        "WI-R4", C.WEBHOOK_INTEGRITY, "MEDIUM", 0.50,
        "The amount in the webhook body is trusted and never compared with the order.",
        all_of=[PAYLOAD_AMOUNT], none_of=[ORDER_FETCH], kind="WEBHOOK", scenarios=["WI-4"],
        evidence=[PAYLOAD_AMOUNT],
    ),
    Rule(
        "AC-R1", C.AMOUNT_CURRENCY, "CRITICAL", 0.85,
        "The amount is multiplied by 100 twice, which charges a hundred times too much.",
        all_of=[ORDER_CREATE_LOOSE, DOUBLE_HUNDRED], on_code=True, scenarios=["AC-1"],
        evidence=[DOUBLE_HUNDRED], cased=frozenset([DOUBLE_HUNDRED]),
    ),
    Rule(
        "AC-R1", C.AMOUNT_CURRENCY, "CRITICAL", 0.75,
        "A value named for rupees reaches order creation without conversion to paise.",
        all_of=[ORDER_CREATE_LOOSE, RUPEE_NAME], none_of=[DOUBLE_HUNDRED, PAISE_CONVERSION],
        on_code=True, scenarios=["AC-1"], evidence=[RUPEE_NAME],
        cased=frozenset([DOUBLE_HUNDRED, PAISE_CONVERSION]),
    ),
    Rule(
        "AC-R2", C.AMOUNT_CURRENCY, "HIGH", 0.60,
        "Money is computed with floating point numbers.",
        all_of=[FLOAT_ARITHMETIC, MONEY_WORD], none_of=[DECIMAL_WORD], scenarios=["AC-2"],
        evidence=[FLOAT_ARITHMETIC], evidence_also=MONEY_WORD,
        cased=frozenset([DECIMAL_WORD]),
    ),
    Rule(
        "AC-R3", C.AMOUNT_CURRENCY, "CRITICAL", 0.75,
        "The amount comes from the client request and is not computed on the server.",
        all_of=[CLIENT_AMOUNT], none_of=[SERVER_AMOUNT], on_code=True, scenarios=["AC-3"],
        evidence=[CLIENT_AMOUNT],
    ),
    Rule(
        "AC-R4", C.AMOUNT_CURRENCY, "LOW", 0.40,
        "Currency codes outside the supported list are written in the code: {values}.",
        all_of=[CURRENCY_LITERAL], allowed_values=C.SUPPORTED_CURRENCIES,
    ),
    Rule(
        "SC-R1", C.SUSPICIOUS_CONTENT, "MEDIUM", 0.90,
        "The code holds text that reads like instructions to a language model; for review only.",
        all_of=[INJECTED_PHRASE], evidence=[INJECTED_PHRASE],
    ),
]
# How many evidence lines a hit shows where results must have the length of the original ones.
SHOWN_EVIDENCE = {"WI-R4": 3, "AC-R1": 3, "AC-R2": 3, "AC-R3": 3, "AC-R4": 3, "SC-R1": 3}
SHOWN_RULES = [replace(r, cap=SHOWN_EVIDENCE.get(r.rule_id, 5)) for r in BUILT_IN_RULES]

HIT_SCHEMA = (
    "struct<rule_pos:int,rule_id:string,defect_class:string,severity:string,confidence:double,"
    "evidence_lines:array<string>,explanation:string,scenario_ids:array<string>>"
)
_CODE, _LOW, _LOW_CODE, _FLAGS, _LINES = "_code", "_low", "_low_code", "_flags", "_lines"


def _condition(rule: Rule) -> str:
    """Whether a rule can hit, as SQL: from cheap to dear, kind, literals, patterns."""
    text, low = (_CODE, _LOW_CODE) if rule.on_code else ("source", _LOW)
    tests = [] if rule.kind is None else [f"kind = {L.sql_text(rule.kind)}"]
    tests += [t for t in (L.holds(L.needed(p), low) for p in rule.all_of) if t is not None]
    # one line with both patterns, without which there is no hit, shows that the text has them
    shown = {*rule.evidence, rule.evidence_also} if rule.evidence_also and len(rule.evidence) == 1 and not rule.on_code else set()
    tests += [T.match_sql(text, p, p not in rule.cased) for p in rule.all_of if p not in shown]
    tests += [f"NOT {T.tried_sql(text, low, p, p not in rule.cased)}" for p in rule.none_of]
    return " AND ".join(tests) or "true"


def _strange_values(rule: Rule) -> str:
    allowed = ", ".join(L.sql_text(v.upper()) for v in rule.allowed_values)
    values = f"regexp_extract_all(source, {L.sql_text(T.java_pattern(rule.all_of[0], 'i'))}, 1)"
    return f"filter({values}, v -> NOT upper(v) IN ({allowed}))"


def _evidence(rule: Rule) -> str:
    """The evidence of a hit, as SQL."""
    if rule.allowed_values is not None:
        found = f"transform({_strange_values(rule)}, v -> concat('currency: \\'', v, '\\''))"
    elif rule.evidence:
        parts = []
        for pattern in rule.evidence:
            fits = T.tried_sql("l.raw", "l.low", pattern, pattern not in rule.cased)
            if rule.evidence_also:
                fits = f"{T.tried_sql('l.raw', 'l.low', rule.evidence_also)} AND {fits}"
            parts.append(f"transform(filter({_LINES}, l -> {fits}), l -> {T.strip_edges_sql('l.raw')})")
        found = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    else:
        return "cast(array() AS array<string>)"
    return found if rule.cap is None else f"slice({found}, 1, {rule.cap})"


def _hit(rule: Rule, pos: int, flag: int) -> str:
    """One rule as a nullable struct, as SQL."""
    explanation = L.sql_text(rule.explanation)
    if "{values}" in rule.explanation:
        explanation = f"replace({explanation}, '{{values}}', array_join({_strange_values(rule)}, ', '))"
    scenarios = ", ".join(L.sql_text(s) for s in rule.scenarios)
    fields = [
        f"'rule_pos', {pos}",
        f"'rule_id', {L.sql_text(rule.rule_id)}",
        f"'defect_class', {L.sql_text(rule.defect_class)}",
        f"'severity', {L.sql_text(rule.severity)}",
        f"'confidence', {rule.confidence}D",
        f"'evidence_lines', {_evidence(rule)}",
        f"'explanation', {explanation}",
        f"'scenario_ids', cast(array({scenarios}) AS array<string>)",
    ]
    return f"CASE WHEN {_FLAGS}[{flag}] THEN cast(named_struct({', '.join(fields)}) AS {HIT_SCHEMA}) END"


def uncapped(rules: Sequence[Rule]) -> list[Rule]:
    """The same rules with all their evidence lines."""
    return [replace(r, cap=None) for r in rules]


def apply_rules(units: DataFrame, rules: Sequence[Rule] = BUILT_IN_RULES) -> DataFrame:
    """One row per (unit, rule) hit.

    ``units`` needs ``source`` and ``kind``; its other columns except ``source`` are kept. The text
    without comments and the folded texts are made once per unit, the lines once per unit with a hit.
    """
    order = {rule_id: i for i, rule_id in enumerate(dict.fromkeys(r.rule_id for r in rules))}
    kept = [c for c in units.columns if c != "source"]
    on_code = any(r.on_code for r in rules)
    nothing = F.lit(None).cast("string")
    # each step is a projection of its own, as the next one uses its columns many times
    staged = units.withColumn(_CODE, T.strip_comments(F.col("source")) if on_code else nothing)
    staged = staged.withColumns({_LOW: F.expr(L.fold_sql("source")), _LOW_CODE: F.expr(L.fold_sql(_CODE))})
    staged = staged.withColumn(_FLAGS, F.expr(f"array({', '.join(_condition(r) for r in rules)})"))
    both = f"zip_with({T.lines_sql('source')}, {T.lines_sql(_LOW)}, (a, b) -> named_struct('raw', a, 'low', b))"
    staged = staged.withColumn(_LINES, F.expr(f"CASE WHEN array_contains({_FLAGS}, true) THEN {both} END"))
    hits = F.expr(f"array({', '.join(_hit(r, order[r.rule_id], i) for i, r in enumerate(rules))})")
    # explode() would make the optimizer add a filter on the array's size, which evaluates every rule
    # a second time; the outer form does not.
    rows = staged.select(*kept, F.explode_outer(hits).alias("_hit")).filter(F.col("_hit").isNotNull())
    bare = {order[r.rule_id] for r in rules if r.evidence_also or r.allowed_values is not None}
    if bare:  # rules that need a line or a value to show
        rows = rows.filter(~F.col("_hit.rule_pos").isin(*sorted(bare)) | (F.size("_hit.evidence_lines") > 0))
    return rows.select(*kept, "_hit.*")
