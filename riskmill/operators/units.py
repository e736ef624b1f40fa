"""Cut source files into code units.

JavaScript files are one unit each and stay on the JVM. Python files need a parser, so exactly the
Python files that pass the relevance filter go through one Arrow call; relevance and kind of the
functions found are again native expressions.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from riskmill import config as C
from riskmill.functions import textops as T

UNIT_COLUMNS = [
    "repo_id",
    "file",
    "unit_pos",
    "symbol",
    "start_line",
    "end_line",
    "kind",
    "imports",
    "callees",
    "source",
    "file_start_line",
    "file_end_line",
]

_FUNCTIONS = ArrayType(
    StructType(
        [
            StructField("symbol", StringType()),
            StructField("start_line", IntegerType()),
            StructField("end_line", IntegerType()),
            StructField("imports", ArrayType(StringType())),
            StructField("callees", ArrayType(StringType())),
            StructField("source", StringType()),
        ]
    )
)


def _call_names(node: ast.AST) -> list[str]:
    names = []
    for inner in ast.walk(node):
        if isinstance(inner, ast.Call):
            target = inner.func
            name = getattr(target, "id", None) or getattr(target, "attr", None)
            if name:
                names.append(name)
    return names


def python_functions(source: str) -> list[tuple]:
    """Every function with the imports met before it, in document order; [] on a syntax error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = source.splitlines()
    imports: list[str] = []
    found: list[tuple] = []
    pending = [tree]
    while pending:
        node = pending.pop()
        if isinstance(node, ast.Import):
            imports.extend(alias.name for alias in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.append(node.module)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            last = node.end_lineno or node.lineno
            text = "\n".join(lines[node.lineno - 1 : last])
            found.append((node.name, node.lineno, last, list(imports), _call_names(node), text))
        pending.extend(reversed(list(ast.iter_child_nodes(node))))
    return found


@pandas_udf(_FUNCTIONS)
def parse_functions(content: pd.Series) -> pd.Series:
    """Functions of each Python source; rows without content cost nothing."""
    names = _FUNCTIONS.elementType.names
    return content.map(
        lambda text: None if text is None else [dict(zip(names, found)) for found in python_functions(text)]
    )


def _suffix(path):
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def _stem(path):
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def _whole_file(files: DataFrame, symbol) -> DataFrame:
    last = F.size(T.split_lines(F.col("content")))
    return files.select(
        "repo_id",
        F.col("path").alias("file"),
        F.lit(0).alias("unit_pos"),
        symbol.alias("symbol"),
        F.lit(1).alias("start_line"),
        last.alias("end_line"),
        T.infer_kind(F.col("content"), symbol).alias("kind"),
        F.array().cast("array<string>").alias("imports"),
        F.array().cast("array<string>").alias("callees"),
        F.col("content").alias("source"),
        F.lit(1).alias("file_start_line"),
        last.alias("file_end_line"),
    )


def extract_code_units(files: DataFrame) -> DataFrame:
    """files(repo_id, path, content) → units, in one pass over the files.

    Only Python sources that pass the relevance filter are handed to the parser; the content of
    other files is null there and never leaves the JVM. A function counts when its own text or the
    imports met before it are payment related; a JavaScript or TypeScript file is one unit.
    """
    suffix = _suffix(F.col("path"))
    is_python = suffix.isin(*C.PY_SUFFIXES)
    relevant = files.filter(suffix.isin(*C.PY_SUFFIXES, *C.JS_SUFFIXES)).filter(
        T.is_payment_relevant(F.col("content"))
    )
    empty = F.array().cast("array<string>")
    whole = F.struct(
        _stem(F.col("path")).alias("symbol"),
        F.lit(1).alias("start_line"),
        F.size(T.split_lines(F.col("content"))).alias("end_line"),
        empty.alias("imports"),
        empty.alias("callees"),
        F.col("content").alias("source"),
        F.lit(0).alias("unit_pos"),
    )
    parsed = relevant.select(
        "repo_id",
        F.col("path").alias("file"),
        "content",
        "path",
        is_python.alias("is_python"),
        parse_functions(F.when(is_python, F.col("content"))).alias("functions"),
    )
    relevant_function = F.filter(
        F.transform("functions", lambda f, i: f.withField("unit_pos", i)),
        lambda f: T.is_payment_relevant(f.source) | T.is_payment_relevant(F.array_join(f.imports, " ")),
    )
    found = F.when(F.col("is_python"), relevant_function).otherwise(F.array(whole))
    cut = parsed.select("repo_id", "file", found.alias("units"))
    last = F.try_element_at("units", F.lit(-1))
    # The outer form keeps the optimizer from evaluating the array once more as a filter.
    rows = cut.select(
        "repo_id",
        "file",
        F.explode_outer("units").alias("u"),
        last.start_line.alias("file_start_line"),
        last.end_line.alias("file_end_line"),
    ).filter(F.col("u").isNotNull())
    return (
        rows.select("repo_id", "file", "u.*", "file_start_line", "file_end_line")
        .withColumn("kind", T.infer_kind(F.col("source"), F.col("symbol")))
        .select(*UNIT_COLUMNS)
    )


def with_whole_file_fallback(files: DataFrame, units: DataFrame) -> DataFrame:
    """Evaluation also scores relevant files that yield no unit, as one whole-file unit."""
    bare = files.filter(T.is_payment_relevant(F.col("content"))).join(
        units.select("repo_id", F.col("file").alias("path")).distinct(),
        ["repo_id", "path"],
        "left_anti",
    )
    return units.unionByName(_whole_file(bare, _stem(F.col("path"))))
