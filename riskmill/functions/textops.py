"""Text expressions. All stay on the JVM; none needs a Python worker.

Java regular expressions are ASCII by default while the semantics we follow are Unicode, so every
pattern gets the flags ``U`` (Unicode classes), ``u`` (Unicode case folding) and ``d`` (only ``\\n``
ends a line). What is made of many parts is one SQL expression, which the JVM reads at once, and a pattern
runs only on texts that hold the literals it cannot match without (``literals``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions import literals as L

# What makes a piece of source code payment related.
RELEVANT_CASED = [
    r"\brazorpay\b",
    r"""require\(['"]razorpay['"]\)|from ['"]razorpay['"]""",
    r"/v1/(orders|payments|refunds|captures)",
    r"\brazorpay_\w+\b",
]
RELEVANT_UNCASED = [
    r"X-Razorpay-Signature|razorpay_signature|webhook.*razorpay|razorpay.*webhook",
]

# Words that decide the kind of a unit, first match wins.
KIND_WORDS = [
    ("WEBHOOK", ["webhook", "signature", "x-razorpay-signature", "event"]),
    ("REFUND", ["refund", "rfnd"]),
    ("CAPTURE", ["capture"]),
    ("CHARGE", ["order", "charge", "checkout", "payment", "pay"]),
]

# Comment shapes, removed in this order.
COMMENT_SHAPES = [
    ("s", r'""".*?"""' + r"|'''.*?'''"),
    ("m", r"#.*$"),
    ("m", r"//.*$"),
    ("s", r"/\*.*?\*/"),
]

_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_RARE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_EDGE_SPACE = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def java_pattern(pattern: str, flags: str = "") -> str:
    """Prefix a pattern with the flags that give it Unicode semantics."""
    return f"(?Uud{flags}){pattern}"


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java_pattern(pattern, "i" if ignore_case else ""))


def named(value: Column, use: str) -> Column:
    """The SQL expression ``use`` of a value that it calls ``t``, computed once however often it is named."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"t -> {use}")), F.lit(0))


def match_sql(text: str, pattern: str, ignore_case: bool = True) -> str:
    return f"rlike({text}, {L.sql_text(java_pattern(pattern, 'i' if ignore_case else ''))})"


def tried_sql(text: str, literal_text: str, pattern: str, ignore_case: bool = True) -> str:
    """Whether a pattern matches a text whose literals stand in ``literal_text`` (folded if case is ignored)."""
    need = L.holds(L.needed(pattern, cased=literal_text == text), literal_text)
    match = match_sql(text, pattern, ignore_case)
    return match if need is None else f"({need} AND {match})"


def strip_edges_sql(text: str) -> str:
    return f"regexp_replace({text}, {L.sql_text(java_pattern(_EDGE_SPACE))}, '')"


def is_payment_relevant(source: Column) -> Column:
    cased = [tried_sql("t", "t", p, False) for p in RELEVANT_CASED]
    uncased = " OR ".join(tried_sql("t", "low", p) for p in RELEVANT_UNCASED)
    return named(source, f"{' OR '.join(cased)} OR get(transform(array({L.fold_sql('t')}), low -> {uncased}), 0)")


def infer_kind(source: Column, symbol: Column) -> Column:
    cases = [
        f"WHEN {' OR '.join(f'contains(t, {L.sql_text(w)})' for w in words)} THEN '{kind}'" for kind, words in KIND_WORDS
    ]
    return named(F.lower(F.concat(source, F.lit(" "), symbol)), f"CASE {' '.join(cases)} ELSE 'OTHER' END")


def strip_comments(source: Column) -> Column:
    out = source
    for flags, shape in COMMENT_SHAPES:
        cut = f"regexp_replace(t, {L.sql_text(java_pattern(shape, flags))}, '')"
        out = named(out, f"CASE WHEN {L.holds(L.needed(shape, cased=True), 't')} THEN {cut} ELSE t END")
    return out


def lines_sql(text: str) -> str:
    """Lines of a text, without the empty piece after a final line end. Most texts have plain line ends only."""
    rare = " OR ".join(f"contains({text}, {L.sql_text(end)})" for end in _RARE_ENDS)
    parts = f"CASE WHEN {rare} THEN split({text}, {L.sql_text(_LINE_ENDS)}, -1) ELSE split({text}, '\\n', -1) END"
    return f"get(transform(array({parts}), p -> CASE WHEN element_at(p, -1) = '' THEN slice(p, 1, size(p) - 1) ELSE p END), 0)"


def split_lines(text: Column) -> Column:
    return named(text, lines_sql("t"))


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, java_pattern(_EDGE_SPACE), "")


def collapse_space(text: Column) -> Column:
    return strip_edges(F.regexp_replace(text, java_pattern(r"[\s\x1c-\x1f]+"), " "))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, in lower case (which is taken once no other sign is left)."""
    words = F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9_]+", " ")))
    return named(words, "CASE WHEN t = '' THEN cast(array() AS array<string>) ELSE split(t, ' ', -1) END")


def code_context(content: Column, start_line: Column, end_line: Column, margin: int = 15) -> Column:
    """Lines around a finding and where the finding lies in them, counted from 1."""
    lines = split_lines(content)
    first = F.greatest(F.lit(0), start_line - 1 - margin)
    last = F.least(F.size(lines), end_line + margin)
    return F.struct(
        F.slice(lines, first + 1, F.greatest(F.lit(0), last - first)).alias("lines"),
        (start_line - first).alias("highlight_start"),
        (end_line - first).alias("highlight_end"),
    )


def lookup(values: dict, key: Column, default=None) -> Column:
    """A fixed table as a map literal: no join, no shuffle."""
    pairs: list[Column] = []
    for name, value in values.items():
        pairs += [F.lit(name), F.lit(value)]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def title_for(rule_ids: Column, defect_class: Column) -> Column:
    """Title of the first rule that has one, else of the class, else the class name in words."""
    known = F.filter(rule_ids, lambda rule: rule.isin(*C.RULE_TITLES))
    return F.coalesce(
        lookup(C.RULE_TITLES, F.try_element_at(known, F.lit(1))),
        lookup(C.CLASS_TITLES, defect_class),
        F.initcap(F.replace(defect_class, F.lit("_"), F.lit(" "))),
    )


def infer_safe_classes(sample_id: Column) -> Column:
    """Classes a safe sample speaks for, read from its id; all three when the id says nothing."""
    name = F.lower(sample_id)
    found = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.array(
                    *[
                        F.when(name.rlike(rf"[-_]{t}\d|[-_]{t}[-_]|^{t}[-_]"), F.lit(cls))
                        for t, cls in C.SAFE_CLASS_TOKENS.items()
                    ]
                )
            )
        )
    )
    every = F.array(*[F.lit(cls) for cls in C.EVAL_CLASSES])
    return F.when(F.size(found) > 0, found).otherwise(every)


def extract_json(text: Column) -> Column:
    """The JSON object in a model answer: bare, fenced, or somewhere in prose."""
    body = strip_edges(text)
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    loose = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return (
        F.when(body.startswith("{"), body)
        .when(fenced != "", fenced)
        .when(loose != "", loose)
        .otherwise(body)
    )


def numbered_lines(source: Column) -> Column:
    return F.array_join(
        F.transform(
            split_lines(source),
            lambda line, i: F.concat(F.lpad((i + 1).cast("string"), F.greatest(F.lit(4), F.length((i + 1).cast("string"))), F.lit(" ")), F.lit(": "), line),
        ),
        "\n",
    )


# The wording of the prompt, since keys of cached answers are made from it.
def analysis_prompt(file: Column, symbol: Column, kind: Column, source: Column) -> Column:
    return F.concat(
        F.lit("Analyze this payment code unit for defects.\n\nFile: "),
        file,
        F.lit("\nFunction: "),
        symbol,
        F.lit(" (kind="),
        kind,
        F.lit(")\n\n```python\n"),
        numbered_lines(source),
        F.lit("\n```\n\nReturn JSON only."),
    )
