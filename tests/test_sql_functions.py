"""Functions and views under SQL names."""

import hashlib

from riskmill.functions.sql import register_functions, register_views


def test_registered_names(spark):
    register_functions(spark)
    row = spark.sql("""SELECT canonical_json('{"b": 1, "a": 2}') AS j, content_hash('x', 'id') AS h, content_hash(NULL, 'id') AS i, rupees_in(150050) AS r, code_tokens('A b_1-c') AS t""").first()
    assert row.j == '{"a":2,"b":1}' and row.r == 1500.5 and row.t == ["a", "b_1", "c"]
    assert row.h == hashlib.sha256(b"x").hexdigest()[:16] and row.i == hashlib.sha256(b"id").hexdigest()[:16]
    register_views(some_rows=spark.range(3))
    assert spark.sql("SELECT count(*) AS n FROM some_rows").first().n == 3


def test_keyed_digest_and_scan_views(spark):
    import hmac

    from riskmill.functions.sql import register_scan

    register_functions(spark, hmac_key="k" * 80)
    assert spark.sql("SELECT hmac_sha256('añb') AS h").first().h == hmac.new(b"k" * 80, "añb".encode(), "sha256").hexdigest()
    assert spark.sql("SELECT canonical_json('{bad') AS j").first().j is None
    code = "const r = require('razorpay');\nr.orders.create({});"
    register_scan(spark, spark.createDataFrame([("r1", "/c/r1/src/a.js", code)], "repo_id string, path string, content string"))
    assert [r.rule_id for r in spark.sql("SELECT rule_id FROM rule_hits").collect()] == ["DP-R1"]
    assert spark.sql("SELECT count(*) AS n FROM code_units").first().n == 1 == spark.sql("SELECT count(*) AS n FROM findings").first().n
