"""Model answers, cache and costs; lists and counts of the serving layer."""

import hashlib

from pyspark.sql import functions as F

from riskmill.operators import model_calls, serving
from riskmill.schemas import domain_violations


def test_answers(spark):
    good = '{"defect_class":"AMOUNT_CURRENCY","confidence":0.5,"explanation":"e"}'
    answers = [
        ('{"findings":[' + good + "]}", True, 1), ("{}", True, 0), ("not json", False, 0), ('```json\n{"findings":[]}\n```', True, 0),
        ('{"findings":[' + good + ',{"defect_class":"X","confidence":0.5,"explanation":"e"}]}', False, 0),
        ('{"findings":[{"defect_class":"AMOUNT_CURRENCY","confidence":1.1,"explanation":"e"}]}', False, 0),
        ('{"findings":[{"defect_class":"AMOUNT_CURRENCY","confidence":0.1}]}', False, 0),
        ('{"findings":[{"defect_class":"AMOUNT_CURRENCY","confidence":"high","explanation":"e"}]}', False, 0),
        ("", False, 0),
    ]
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(answers)], "id int, response string")
    rows = {r.id: r for r in model_calls.parse_analyses(df).collect()}
    assert [(rows[i].valid, len(rows[i].findings)) for i in range(len(answers))] == [a[1:] for a in answers]
    assert rows[2].analysis_notes == "PARSE_ERROR" and rows[0].analysis_notes == ""
    found = model_calls.explode_findings(model_calls.parse_analyses(df), "id").collect()
    assert [(f.id, f.evidence_lines, f.scenario_ids) for f in found] == [(0, [], [])]


def test_cache_and_costs(spark):
    names = ("provider", "base_url", "model", "temperature", "prompt_version", "user_prompt")
    rows = [(i, "p", "u", "m", "0.0", "v1", text) for i, text in enumerate(["a", "b", "b", "c"])]
    keyed = model_calls.with_request_key(spark.createDataFrame(rows, "request_id int, " + ", ".join(f"{n} string" for n in names)))
    assert keyed.filter("request_id = 0").first().cache_key == hashlib.sha256(b"p|u|m|0.0|v1|a").hexdigest()
    cache = keyed.filter("request_id = 0").select("cache_key")
    assert [r.hit for r in model_calls.split_cached(keyed, cache).orderBy("request_id").collect()] == [True, False, False, False]
    assert sorted((r.request_id, r.n_requests) for r in model_calls.calls_to_make(keyed, cache).collect()) == [(1, 2), (3, 1)]
    df = spark.createDataFrame([("claude-sonnet-4-6", 1_000_000, 100_000), ("unknown", 5, 5)], "m string, i bigint, o bigint")
    assert [r.c for r in df.select(model_calls.call_cost(F.col("m"), F.col("i"), F.col("o")).alias("c")).collect()] == [4.5, 0.0]


def test_serving(spark):
    calls = spark.createDataFrame([(1, True, 0), (2, True, 0), (2, False, 3), (3, False, 0)], "scan_id int, failed boolean, n_findings int")
    assert {r.scan_id: r.llm_status for r in serving.model_status(calls, F.lit(True)).collect()} == {1: "FAILED", 2: "DEGRADED", 3: "OK"}
    assert {r.llm_status for r in serving.model_status(calls, F.lit(False)).collect()} == {"OFF"}
    files = spark.createDataFrame([("r", "a.py", "Razorpay"), ("r", "b.py", "x"), ("r", "c.json", "razorpay"), ("s", "a.js", "razorpay")], "repo_id string, path string, content string")
    assert {tuple(r) for r in serving.preflight(files).collect()} == {("r", True, 2, 2), ("s", False, 0, 0)}
    strict = {r.repo_id: r.manifest_present for r in serving.preflight(files, ignore_case=False).collect()}
    assert strict == {"r": False, "s": False}
    assert {r.repo_id: r.manifest_present for r in serving.preflight(files, False, True).collect()} == {"r": True, "s": False}
    for bad in ({"limit": 0}, {"limit": 201}, {"limit": 5, "offset": -1}):
        try:
            serving.page(files, [F.col("path")], **bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert domain_violations(spark.createDataFrame([("HIGH",), ("high",), (None,)], "severity string")).count() == 2
