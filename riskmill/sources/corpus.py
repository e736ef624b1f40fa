"""Source corpora, labelled samples and rule books as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill import config as C
from riskmill.functions import textops as T
from riskmill.schemas import SAMPLES_JSON

_GLOB = "*.{" + ",".join(C.PY_SUFFIXES + C.JS_SUFFIXES) + "}"


def keep_source_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Source suffixes only, and no file under a skipped directory."""
    suffix = F.regexp_extract(path, r"\.([^./]+)$", 1)
    parts = F.split(path, "/")
    skipped = F.array(*[F.lit(d) for d in C.SKIPPED_DIRS])
    return files.filter(
        suffix.isin(*C.PY_SUFFIXES, *C.JS_SUFFIXES) & ~F.arrays_overlap(parts, skipped)
    )




def decode_text(content: Column) -> Column:
    """UTF-8 text; invalid bytes become replacement characters, so no file can fail the job."""
    return F.make_valid_utf8(content.cast("string"))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def repository_of(path: Column, root: str) -> Column:
    """First path component below the root; scheme and authority do not matter."""
    base = re.sub(_SCHEME, "", root).rstrip("/") + "/"
    below = F.substring(F.regexp_replace(path, _SCHEME, ""), F.lit(len(base) + 1), F.length(path))
    return F.substring_index(below, "/", 1)


def read_source_corpus(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """files(repo_id, path, content) of every source file below ``path``.

    The suffix filter runs at listing time, so other files are never opened.
    """
    reader = spark.readStream if stream else spark.read
    raw = (
        reader.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _GLOB)
        .load(path)
    )
    return keep_source_files(raw).select(
        repository_of(F.col("path"), path).alias("repo_id"),
        "path",
        decode_text(F.col("content")).alias("content"),
    )


def sample_defaults(samples: DataFrame) -> DataFrame:
    """Fill the defaults of optional sample fields and drop samples without required ones."""
    labels = F.transform(
        F.coalesce("labels", F.array().cast(dict(samples.dtypes)["labels"])),
        lambda x: F.struct(
            x.defect_class.alias("defect_class"),
            F.coalesce(x.lines, F.array(F.array(F.lit(1), F.lit(999)))).alias("lines"),
            F.coalesce(x.scenario_ids, F.array().cast("array<string>")).alias("scenario_ids"),
        ),
    )
    required = ["sample_id", "repo_id", "language", "framework"]
    return samples.dropna(subset=required).withColumns(
        {
            "labels": labels,
            "source": F.coalesce("source", F.lit("MANUAL")),
            "hard_negative": F.coalesce("hard_negative", F.lit(False)),
            "difficulty": F.coalesce("difficulty", F.lit(2)),
            "runnable": F.coalesce("runnable", F.lit(False)),
            "notes": F.coalesce("notes", F.lit("")),
            "license": F.coalesce("license", F.lit("MIT")),
            "static_detectable": F.coalesce("static_detectable", F.lit(True)),
            "file": F.coalesce("file", F.lit("app.py")),
        }
    )


def read_samples(spark: SparkSession, path: str, curated: DataFrame | None = None) -> DataFrame:
    """Every ``sample.json`` below ``path`` with defaults filled; unreadable files are dropped."""
    raw = (
        spark.read.schema(SAMPLES_JSON)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "sample.json")
        .json(path)
        .withColumn("dir", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1))
    )
    known = F.col("source").isNull() | F.col("source").isin("MANUAL", "SEEDED_VARIANT", "LLM_GENERATED", "PUBLIC")
    good = sample_defaults(raw.filter(F.col("_bad").isNull() & known).drop("_bad"))
    good = good.withColumn("file_path", F.concat_ws("/", "dir", "file")).drop("dir")
    return good if curated is None else curated.unionByName(good, allowMissingColumns=True)


def rule_chunks(books: DataFrame) -> DataFrame:
    """Cut rule books (path, text) into one chunk per ``### RULE`` block that names a class."""
    header = r"^###\s+RULE\s+([A-Z0-9-]+)\s+—\s+([^\n]*)"
    class_line = r"(?m)^\s*class:\s*([A-Z_]+)\s*$"
    blocks = books.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("source"),
        F.explode(F.split("text", r"(?m)(?=^###\s+RULE\s+[A-Z0-9-]+\s+—\s)")).alias("block"),
    ).filter(F.col("block").rlike(header))
    lines = F.transform(
        F.filter(
            F.slice(T.split_lines(F.col("block")), F.lit(2), F.size(T.split_lines(F.col("block")))),
            lambda line: (T.strip_edges(line) != "") & ~line.rlike(r"^\s*class:\s*[A-Z_]+\s*$"),
        ),
        T.strip_edges,
    )
    classes = F.regexp_extract_all("block", F.lit(class_line), F.lit(1))
    title = T.strip_edges(F.regexp_extract("block", header, 2))
    return blocks.filter(F.size(classes) > 0).select(
        F.concat(F.lit("rule:"), F.regexp_extract("block", header, 1)).alias("id"),
        F.concat(title, F.lit("\n"), F.array_join(lines, " ")).alias("text"),
        F.element_at(classes, -1).alias("defect_class"),
        F.lit("RULE").alias("kind"),
        F.lit("RULE").alias("tier"),
        "source",
        F.lit(None).cast("string").alias("sample_id"),
        F.lit(False).alias("hard_negative"),
        title.alias("title"),
    )


def read_rule_chunks(spark: SparkSession, path: str) -> DataFrame:
    books = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    return rule_chunks(books)
