"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcweave.llm.common import shared_path, table
from arcweave.llm.decontam import decontamination_stage
from arcweave.llm.langid import language_stage
from arcweave.llm.near_dedup import near_duplicate_stage
from arcweave.llm.packing import packing_stage
from arcweave.llm.quality import quality_stage

STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Language identification and tokenization can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
