"""Corpus reading and code units."""

from riskmill.operators.units import extract_code_units, with_whole_file_fallback
from riskmill.plans.scan import scan_corpus
from riskmill.sources.corpus import read_rule_chunks, read_samples, read_source_corpus

PY = '''import os

def before(x):
    return x

import razorpay
from a.b import c

def outer(x):
    def inner(y):
        return client.orders.create(y)
    return inner(x)[0](1)

async def late():
    import stripe
    pass
'''


def test_python_units(spark):
    files = spark.createDataFrame(
        [("r", "/r/a.py", PY), ("r", "/r/bad.py", "import razorpay\ndef f(:"), ("r", "/r/plain.py", "def f(): pass"), ("r", "/r/e.py", "# razorpay\n")],
        "repo_id string, path string, content string",
    )
    units = {u.symbol: u for u in extract_code_units(files).collect()}
    assert set(units) == {"outer", "inner", "late"}
    # The import after a function does not count for it.
    assert units["outer"].imports == ["os", "razorpay", "a.b"]
    assert (units["outer"].start_line, units["outer"].end_line) == (9, 12)
    assert set(units["outer"].callees) == {"create", "inner"}
    assert units["inner"].source == "    def inner(y):\n        return client.orders.create(y)"
    assert units["late"].imports == ["os", "razorpay", "a.b"]
    assert units["outer"].file_end_line == units["late"].end_line
    fallback = with_whole_file_fallback(files, extract_code_units(files))
    assert {r.symbol for r in fallback.collect()} == {"outer", "inner", "late", "bad", "e"}


def test_script_units_and_scan(spark):
    js = "const r = require('razorpay');\nclient.orders.create({amount: amount_inr});\n"
    files = spark.createDataFrame([("r", "/r/pay.ts", js), ("r", "/r/x.js", "let a")], "repo_id string, path string, content string")
    unit = extract_code_units(files).collect()
    assert [(u.symbol, u.kind, u.end_line) for u in unit] == [("pay", "CHARGE", 2)]
    found = {f.defect_class: f for f in scan_corpus(files)["findings"].collect()}
    assert set(found) == {"DUPLICATE_PAYMENT", "AMOUNT_CURRENCY"}
    assert found["AMOUNT_CURRENCY"].score == 0.7 and found["AMOUNT_CURRENCY"].end_line == 2
    assert found["DUPLICATE_PAYMENT"].exposure_kind == "ESTIMATED"


def test_read_source_corpus(spark, tmp_path):
    for name, content in {
        "one/a.py": b"import razorpay\n", "one/node_modules/b.js": b"x", "one/c.txt": b"x", "two/src/d.mjs": b"caf\xff", "two/venvx/e.cjs": b"y",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    rows = read_source_corpus(spark, f"file://{tmp_path}").collect()
    got = {(r.repo_id, r.path.rsplit("/", 1)[1]): r.content for r in rows}
    assert set(got) == {("one", "a.py"), ("two", "d.mjs"), ("two", "e.cjs")}
    assert got["two", "d.mjs"] == "caf�"


def test_read_samples_and_rules(spark, tmp_path):
    good = tmp_path / "a" / "sample.json"
    good.parent.mkdir()
    good.write_text('{"sample_id":"s1","repo_id":"r","language":"python","framework":"flask","labels":[{"defect_class":"AMOUNT_CURRENCY"}]}')
    bad = tmp_path / "b" / "sample.json"
    bad.parent.mkdir()
    bad.write_text('{"sample_id": ')
    unknown = tmp_path / "c" / "sample.json"
    unknown.parent.mkdir()
    unknown.write_text('{"sample_id":"s2","repo_id":"r","language":"p","framework":"f","source":"NOPE"}')
    rows = read_samples(spark, str(tmp_path)).collect()
    assert [r.sample_id for r in rows] == ["s1"]
    row = rows[0]
    assert row.labels[0].lines == [[1, 999]] and row.difficulty == 2 and row.license == "MIT" and row.static_detectable
    assert row.file_path.endswith("/a/app.py")

    book = tmp_path / "facts.md"
    book.write_text("intro\n### RULE A-1 — First one\nclass: AMOUNT_CURRENCY\n line a\n\nline b\n### RULE B-2 — No class\ntext\n### RULE C-3 — Third\nx\nclass: WEBHOOK_INTEGRITY\n")
    chunks = {r.id: r for r in read_rule_chunks(spark, str(book)).collect()}
    assert set(chunks) == {"rule:A-1", "rule:C-3"}
    assert chunks["rule:A-1"].text == "First one\nline a line b" and chunks["rule:A-1"].source == "facts.md"
    assert chunks["rule:C-3"].text == "Third\nx" and chunks["rule:C-3"].defect_class == "WEBHOOK_INTEGRITY"
