"""Degrees of a growing arc file set, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcweave.operators.degree import degrees
from arcweave.sources.text import ARC, parse


def arc_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Arcs of text files as they appear in a folder."""
    return parse(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder), ARC)


def degree_stream(arcs: DataFrame, side: str) -> DataFrame:
    """Running (id, degree); write it in update or complete mode."""
    return degrees(arcs, side)
