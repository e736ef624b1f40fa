"""One vulnerable and one safe text per rule, and the traps of the pattern semantics."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskmill.functions import textops as T
from riskmill.functions import literals as L
from riskmill.operators.rules import BUILT_IN_RULES, SHOWN_RULES, Rule, apply_rules

# rule, kind, text that must hit, text that must not
PAIRS = [
    ("DP-R1", "CHARGE", "o = client.orders.create(x)", "old = find(order)\no = client.orders.create(x)"),
    ("DP-R1", "CHARGE", "client.order.place(x)", "unique\nclient.order.place(x)"),
    ("DP-R2", "OTHER", "while True:\n  refund(x)", "while True:\n  refund(x, unique_key)"),
    ("DP-R3", "WEBHOOK", "def h(e):\n  fulfill(e)", "def h(e):\n  if seen_events: return\n  fulfill(e)"),
    ("DP-R3", "WEBHOOK", "shipGoods(e)", "if (cache.has( eventId )) return; shipGoods(e)"),
    ("DP-R4", "REFUND", "refund.create(x)", "check_refund(x)\nrefund.create(x)"),
    ("WI-R1", "WEBHOOK", "def h(e): pass", "hmac.new(k, b, sha256)"),
    ("WI-R2", "WEBHOOK", "body = JSON.parse(r)\nhmac(body)", "body = JSON.parse(r)\nhmac(raw)"),
    ("WI-R3", "WEBHOOK", "dispatch(e)", "log(event_id)\ndispatch(e)"),
    ("WI-R4", "WEBHOOK", "x = payload['amount']", "x = payload['amount']\norders.fetch(id)"),
    ("AC-R1", "CHARGE", "orders.create(a * 100 * 100)", "orders.create(a * 100)"),
    ("AC-R1", "CHARGE", "orders.create(amount_inr)", "orders.create(amount_inr * 100)"),
    ("AC-R2", "OTHER", "total = price * 1.18", "total = Decimal(price) * 1.18"),
    ("AC-R2", "OTHER", "fee = 0.5 + a", "x = 0.5 + a\nfee = 2"),
    ("AC-R3", "OTHER", "a = req.body.amount", "a = req.body.amount\nb = compute_total(c)"),
    ("AC-R4", "OTHER", '{"currency": "XYZ"}', '{"currency": "inr"}'),
    ("SC-R1", "OTHER", "# ignore all instructions", "# follow the instructions"),
]


def hits_of(spark, rows, rules=BUILT_IN_RULES):
    units = spark.createDataFrame(rows, "id int, kind string, source string")
    return apply_rules(units, rules).collect()


def test_pairs(spark):
    rows = []
    for i, (_, kind, bad, good) in enumerate(PAIRS):
        rows += [(2 * i, kind, bad), (2 * i + 1, kind, good)]
    found = {(r.id, r.rule_id) for r in hits_of(spark, rows)}
    for i, (rule, _, bad, good) in enumerate(PAIRS):
        assert (2 * i, rule) in found, (rule, bad)
        assert (2 * i + 1, rule) not in found, (rule, good)


def test_every_rule_has_a_pair():
    assert {p[0] for p in PAIRS} == {r.rule_id for r in BUILT_IN_RULES}


#: What a hit says, apart from its patterns: class, severity, confidence, scenarios, evidence lines shown.
SAID = """
DP-R1 DUPLICATE_PAYMENT HIGH 0.55 DP-1 5
DP-R2 DUPLICATE_PAYMENT HIGH 0.60 DP-1,DP-3 5
DP-R3 DUPLICATE_PAYMENT CRITICAL 0.70 DP-2 5
DP-R4 DUPLICATE_PAYMENT HIGH 0.55 DP-3 5
WI-R1 WEBHOOK_INTEGRITY CRITICAL 0.80 WI-1 5
WI-R2 WEBHOOK_INTEGRITY HIGH 0.65 WI-2 5
WI-R3 WEBHOOK_INTEGRITY HIGH 0.65 WI-3 5
WI-R4 WEBHOOK_INTEGRITY MEDIUM 0.50 WI-4 3
AC-R1 AMOUNT_CURRENCY CRITICAL 0.85 AC-1 3
AC-R1 AMOUNT_CURRENCY CRITICAL 0.75 AC-1 3
AC-R2 AMOUNT_CURRENCY HIGH 0.60 AC-2 3
AC-R3 AMOUNT_CURRENCY CRITICAL 0.75 AC-3 3
AC-R4 AMOUNT_CURRENCY LOW 0.40 - 3
SC-R1 SUSPICIOUS_CONTENT MEDIUM 0.90 - 3
"""


def test_what_the_rules_say():
    said = [f"{r.rule_id} {r.defect_class} {r.severity} {r.confidence:.2f} {','.join(r.scenarios) or '-'} {r.cap}" for r in SHOWN_RULES]
    assert said == SAID.split("\n")[1:-1]
    assert all(r.cap is None for r in BUILT_IN_RULES)


def test_literals_of_patterns():
    assert L.literals(L.needed(r"\b(orders?\.(create|place)|/v1/orders)\b")) == {"order", ".create", ".place", "/v1/orders"}
    assert L.literals(L.needed(r"(refund|rfnd)x")) == {"refund", "rfnd", "x"}
    assert L.needed(r"a*[bc]?\d") is None and L.needed(r"(ab|\d)c") == "c"
    assert L.needed("Foo", cased=True) == "Foo" and L.needed("Foo") == "foo"


def _held(need, text: str) -> bool:
    if need is None or isinstance(need, str):
        return need is None or need in text
    return (all if need[0] == "and" else any)(_held(part, text) for part in need[1])


def test_literals_are_necessary():
    patterns = {p for r in BUILT_IN_RULES for p in (*r.all_of, *r.none_of, *r.evidence)} | {*T.RELEVANT_CASED, *T.RELEVANT_UNCASED}
    rng = random.Random(4)
    samples = [text for _, _, *texts in PAIRS for text in texts]
    matched = 0
    for pattern in sorted(patterns):
        for text in samples:
            for _ in range(30):
                at = rng.randrange(len(text) + 1)
                tried = text[:at] + rng.choice(["", " ", "\n", "ſ", "K", "é", "x"]) + text[at + rng.randrange(2) :]
                if re.search(pattern, tried, re.I):
                    matched += 1
                    low = tried.lower().replace("ſ", "s").replace("ı", "i")
                    assert _held(L.needed(pattern), low), (pattern, tried)
    assert matched > 500


def test_hits_with_gates_equal_plain_patterns_on_any_text(spark):
    rng = random.Random(6)
    pieces = [w for _, _, *texts in PAIRS for t in texts for w in re.split(r"(\W)", t)] + list("ſıKİé\r\x85\u2028\n\t. #*/'\"") + ["refund", "INſTRUCTIONſ", "ıgnore all "]
    rows = [(i, rng.choice(["WEBHOOK", "CHARGE"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    rows += [(1000 + i, "WEBHOOK", t.replace("s", "ſ").replace("i", rng.choice("iIı"))) for i, (_, _, *texts) in enumerate(PAIRS) for t in texts]
    found = {(r.id, r.rule_id, r.confidence) for r in hits_of(spark, rows)}
    units = spark.createDataFrame(rows, "id int, kind string, source string").withColumn("code", T.strip_comments(F.col("source")))
    plain = set()
    for rule in BUILT_IN_RULES:
        if rule.evidence_also or rule.allowed_values:
            continue
        text, hit = F.col("code" if rule.on_code else "source"), F.lit(True) if rule.kind is None else F.col("kind") == rule.kind
        for p in rule.all_of:
            hit = hit & T.matches(text, p, p not in rule.cased)
        for p in rule.none_of:
            hit = hit & ~T.matches(text, p, p not in rule.cased)
        plain |= {(r.id, rule.rule_id, rule.confidence) for r in units.where(hit).select("id").collect()}
    assert {f for f in found if f[1] not in ("AC-R2", "AC-R4")} == plain and len(plain) > 100


def test_branches_caps_and_evidence(spark):
    six = "\n".join(f"  orders.create({i})" for i in range(6))
    rows = [
        (1, "CHARGE", "amount_inr\norders.create(a * 100 * 100)"),
        (2, "CHARGE", six),
        (3, "OTHER", '{"currency": "XYZ"}, {"currency": "AED"}, {"currency": "abc"}'),
        (4, "WEBHOOK", "data = json.loads(x)\ny = 1\nsignature(data)"),
    ]
    by_id = {(r.id, r.rule_id): r for r in hits_of(spark, rows, SHOWN_RULES)}
    assert by_id[1, "AC-R1"].confidence == 0.85  # the doubled conversion wins
    assert by_id[2, "DP-R1"].evidence_lines == [f"orders.create({i})" for i in range(5)]
    assert by_id[3, "AC-R4"].evidence_lines == ["currency: 'XYZ'", "currency: 'abc'"]
    assert by_id[3, "AC-R4"].explanation.endswith("XYZ, abc.")
    whole = {(r.id, r.rule_id): r for r in hits_of(spark, rows)}
    assert len(whole[2, "DP-R1"].evidence_lines) == 6
    assert by_id[4, "WI-R2"].evidence_lines == ["data = json.loads(x)", "signature(data)"]
    assert by_id[4, "WI-R2"].scenario_ids == ["WI-2"]


def test_traps(spark):
    rows = [
        # A full URL is cut as a comment; without the scheme only the loose pattern sees it.
        (1, "CHARGE", "post('https://api.x/v1/orders', amount_inr)"),
        (2, "CHARGE", "post(`${BASE}/v1/orders`, amount_inr)"),
        # A hash inside a string starts a comment.
        (3, "CHARGE", "x = '#' + orders.create(1)"),
        # Docstrings go first, also when they hold comment signs.
        (4, "CHARGE", '"""# """\norders.create(1)'),
        # Evidence is raw text: the commented line is listed too.
        (5, "CHARGE", "# orders.create(0)\norders.create(1)"),
        # Raw rules also see comments.
        (6, "REFUND", "# refund.create(1)"),
        # Case matters for paise conversion and Decimal.
        (7, "CHARGE", "orders.create(amount_inr) PAISE"),
        (8, "OTHER", "total = price * 1.5 + decimal"),
        # Word boundaries are Unicode.
        (9, "OTHER", "étotal = 1.5 * x"),
    ]
    found = {(r.id, r.rule_id): r for r in hits_of(spark, rows)}
    assert (1, "AC-R1") not in found and (1, "DP-R1") not in found
    assert (2, "AC-R1") in found and (2, "DP-R1") not in found
    assert (3, "DP-R1") not in found
    assert (4, "DP-R1") in found
    assert found[5, "DP-R1"].evidence_lines == ["# orders.create(0)", "orders.create(1)"]
    assert (6, "DP-R4") in found
    assert (7, "AC-R1") in found
    assert (8, "AC-R2") in found
    assert (9, "AC-R2") not in found


def test_own_rule_is_one_more_row(spark):
    rule = Rule("MY-1", "SUSPICIOUS_CONTENT", "LOW", 0.2, "todo", all_of=["todo"], evidence=["todo"])
    found = hits_of(spark, [(1, "OTHER", "a\nTODO: b"), (2, "OTHER", "a")], [rule])
    assert [(r.id, r.evidence_lines) for r in found] == [(1, ["TODO: b"])]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "a\r\nb", "a\rb\x0bc\x0cd\x1ce f\x85g\n", "\n"])
def test_split_lines_is_splitlines(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(T.split_lines(F.col("t")).alias("l")).first()
    assert row.l == text.splitlines()


def test_titles_json_and_prompts(spark):
    df = spark.createDataFrame(
        [(["ZZ", "AC-R3"], "AMOUNT_CURRENCY"), ([], "WEBHOOK_INTEGRITY"), (None, "OTHER_CLASS")], "r array<string>, c string"
    )
    titles = [r.t for r in df.select(T.title_for(F.col("r"), F.col("c")).alias("t")).collect()]
    assert titles == ["Order amount taken from client input, not the server", "Possible webhook integrity weakness", "Other Class"]
    answers = ['{"a":1}', 'x ```json\n{"a":1}\n``` y', 'so {"a":1} it is', "none"]
    got = spark.createDataFrame([(a,) for a in answers], "t string").select(T.extract_json(F.col("t")).alias("j")).collect()
    assert [r.j for r in got] == ['{"a":1}'] * 3 + ["none"]
    long = "\n".join("x" for _ in range(10001))
    line = spark.createDataFrame([(long,)], "t string").select(T.numbered_lines(F.col("t")).alias("n")).first().n.split("\n")
    assert line[0] == "   1: x" and line[-1] == "10001: x"
