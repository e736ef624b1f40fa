"""The training-data pipeline: documents through language ID, line dedup, near-dedup, decontamination and packing.

Every stage takes the session, its predecessor's documents and the folder of the tables, and returns
a frame that is written as Parquet and read again. All but the last return the columns of documents.
SQL cannot express the language model of the first stage, so there is no ORACLE_SQL; the tests hold
every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskmill.llm.common import stored
from riskmill.llm.decontaminate import stage_decontamination
from riskmill.llm.language_id import stage_language_id
from riskmill.llm.line_dedup import stage_line_dedup
from riskmill.llm.near_dup import stage_near_dedup
from riskmill.llm.packing import stage_best_fit_packing

STAGES = [
    ("language_id", stage_language_id),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontamination", stage_decontamination),
    ("best_fit_packing", stage_best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
