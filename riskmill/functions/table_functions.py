"""SQL table functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from riskmill import config as C
from riskmill.functions import textops as T
from riskmill.operators.units import python_functions

_RELEVANT = [re.compile(p) for p in T.RELEVANT_CASED] + [re.compile(p, re.I) for p in T.RELEVANT_UNCASED]
_COLUMNS = (
    "repo_id string, file string, unit_pos int, symbol string, start_line int, end_line int, kind string, "
    "imports array<string>, callees array<string>, source string"
)


def _relevant(text: str) -> bool:
    return any(p.search(text) for p in _RELEVANT)


def _kind(source: str, symbol: str) -> str:
    text = f"{source} {symbol}".lower()
    return next((kind for kind, words in T.KIND_WORDS if any(w in text for w in words)), "OTHER")


class CodeUnits:
    """The payment related units of files: a TABLE argument with repo_id, path and content.

    One file at a time, so memory is one file. Rows without path or content give nothing.
    """

    def eval(self, row: Row) -> Iterator[tuple]:
        repo, path, content = row["repo_id"], row["path"], row["content"]
        if path is None or content is None or not _relevant(content):
            return
        name, _, suffix = path.rsplit("/", 1)[-1].rpartition(".")
        if suffix in C.JS_SUFFIXES:
            last = len(content.splitlines())
            yield repo, path, 0, name, 1, last, _kind(content, name), [], [], content
        elif suffix in C.PY_SUFFIXES:
            for pos, (symbol, start, end, imports, callees, source) in enumerate(python_functions(content)):
                if _relevant(source) or _relevant(" ".join(imports)):
                    yield repo, path, pos, symbol, start, end, _kind(source, symbol), imports, callees, source


def register_table_functions(spark: SparkSession) -> None:
    """``SELECT * FROM code_units_of(TABLE(files))``; the query spreads files as the table is partitioned."""
    spark.udtf.register("code_units_of", udtf(CodeUnits, returnType=_COLUMNS))
