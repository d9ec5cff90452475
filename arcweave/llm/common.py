"""Helpers shared by the corpus operators.

All operators take and return DataFrames and read their columns by name, so
extra columns of the input are ignored (or carried along where the docstring
says so) and never clash with the operators' own, in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.plans.state import delete, shared_path, stored

__all__ = ["delete", "shared_path", "stored"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space, and words of ASCII alphanumerics plus every non-ASCII character.
SPACED_WORD, ALNUM_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: An Arrow batch holds at most so many rows and (where Spark supports it) bytes: a Python worker's memory is bounded by these.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
#: Rows of a counted table of keys that may be broadcast (about 100 bytes each).
BROADCAST_ROWS = 200_000
#: A key is hot if it has more than one in so many rows; there are no more hot keys than that.
HOT = 10_000


def ascii_lower(text: str | None) -> str:
    """A-Z lower-cased and nothing else; null as empty. (Bytes lower-case just these, and UTF-8 has none of them inside other characters; far faster than str.translate.)"""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get. Spark reads these settings when a plan runs, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def lower_ascii(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column | str, separators: str) -> Column:
    """Words of a string column as an array: what stands between runs of ``separators`` (a Java character class); null and empty give an empty array.

    ``filter`` drops the empty parts at the ends. It also ends the generated code of the scan, so that an explode of the words is compiled by itself: as one method with the split it is too large to be compiled, and several times slower."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{separators}]+"), lambda w: w != "")


def columns_without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those named like one of ``names`` in any case (Spark's names know no case, so both could not stand side by side)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def broadcast_if_small(rows: DataFrame, keys: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys``, of which there are ``n``: broadcast up to BROADCAST_ROWS, shuffled by key beyond."""
    return rows.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys.hint("merge"), on, how)


def whole_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text): all columns of ``docs`` as one, and the text beside it, so that no name of theirs meets an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))


def joined_by_key(rows: DataFrame, facts: DataFrame, key: list[str], copies: str, total: int) -> DataFrame:
    """``rows`` left-joined by ``key`` with ``facts``, which has a row a key and in ``copies`` how many rows share it (of ``total`` in all).

    Keys of more than one in HOT rows are HOT at most whatever the corpus, so their facts are broadcast and their rows never meet in one task; all others are joined by key."""
    hot = facts.where(F.col(copies) * HOT > total).drop(copies)
    cold = facts.where(F.col(copies) * HOT <= total).drop(copies)
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, "left")
    return often.unionByName(seldom)


def doc_fold(c: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; rows without an id belong to fold 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")
