"""Run registered queries in Spark and their SQL in DuckDB and compare: python tests/check_sql.py [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cols = df.columns
    if sql is None:
        return len(got), "rows only"
    rel = con.sql(sql)
    want_cols = list(rel.columns)
    want = rel.fetchall()
    if sorted(cols) != sorted(want_cols):
        return len(got), f"COLUMNS {sorted(cols)} vs {sorted(want_cols)}"
    order = sorted(cols)
    a = sorted(tuple(str(_norm(r[cols.index(c)])) for c in order) for r in got)
    b = sorted(tuple(str(_norm(r[want_cols.index(c)])) for c in order) for r in want)
    kinds = {c: t for c, t in df.dtypes}
    duck = {c: str(t) for c, t in zip(want_cols, rel.types)}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = [f"{c}:{kinds[c]}/{duck[c]}" for c in order if pairs.get(kinds[c]) != duck[c]]
    if a == b:
        return len(got), "ok" + (f" (types {types})" if types else "")
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:3]
    only_b = [r for r in b if r not in in_a][:3]
    return len(got), f"MISMATCH rows {len(a)}/{len(b)}\n   cols  {order}\n   spark {only_a}\n   duck  {only_b}"


def main() -> None:
    from riskmill.plans import QUERIES, SQL
    from riskmill.session import local_session

    sf = "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("sf=")] or list(QUERIES)
    for a in sys.argv[1:]:
        if a.startswith("sf="):
            sf = "/root/testdata/sf" + a[3:]
    spark = local_session(8)
    con = connect(sf)
    for name in names:
        start = time.time()
        try:
            n, verdict = compare(spark, con, name, QUERIES[name], SQL.get(name), sf)
        except Exception as error:  # report and go on
            n, verdict = -1, f"ERROR {type(error).__name__} {str(error)[:1500]}"
        print(f"{name:32s} {n:8d} rows {time.time() - start:6.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
