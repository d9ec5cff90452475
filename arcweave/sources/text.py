"""Plain-text arcs, indexes, values and incidences.

A line holds fields separated by one blank, tab or comma; ``%`` starts a comment
line. The strict tab-only variants know no comments. Further fields are ignored.
A malformed line fails the job, unless ``on_error="drop"``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arcweave.plans.state import delete, shared_path

SEPARATORS, TAB, COMMENT = "[ \t,]", "\t", "%"
Fields = list[tuple[str, int, str]]


def parse(lines: DataFrame, fields: Fields, sep: str = SEPARATORS, comment: str | None = COMMENT, on_error: str = "fail") -> DataFrame:
    """Typed columns (name, position, type) from the column ``value`` of text lines."""
    if on_error not in ("fail", "drop"):
        raise ValueError("on_error must be 'fail' or 'drop'")
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    parts = F.split("value", sep)

    def field(position: int, kind: str) -> Column:
        if on_error == "drop":
            return F.get(parts, F.lit(position)).try_cast(kind)
        return F.element_at(parts, position + 1).cast(kind)  # fails on a missing or malformed field

    out = lines.select(*(field(p, t).alias(n) for n, p, t in fields))
    return out.dropna() if on_error == "drop" else out


ARC: Fields = [("src", 0, "bigint"), ("dst", 1, "bigint")]
NODE: Fields = [("name", 0, "string"), ("id", 1, "bigint")]
NODE_ID: Fields = [("id", 1, "bigint")]
VALUE: Fields = [("id", 0, "bigint"), ("value", 1, "double")]
INCIDENCE: Fields = [("arc_id", 0, "bigint"), ("node", 1, "bigint")]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_arcs(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return parse(read_lines(spark, path), ARC, **options)


def read_nodes(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return parse(read_lines(spark, path), NODE, **options)


def read_node_ids(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return parse(read_lines(spark, path), NODE_ID, **options)


def read_pages(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Page ids of a tab-only index without comments."""
    return parse(read_lines(spark, path), NODE_ID, TAB, None, on_error)


def read_links(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Arcs of a tab-only file without comments."""
    return parse(read_lines(spark, path), ARC, TAB, None, on_error)


def read_values(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(id, value) rows, such as another job's CSV output."""
    return parse(read_lines(spark, path), VALUE, **options)


def read_incidence(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(arc_id, node) rows; a weight after them is ignored."""
    return parse(read_lines(spark, path), INCIDENCE, **options)


def write_rows(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text without a header, replacing what is there."""
    df.write.mode("overwrite").option("sep", sep).option("header", False).csv(path)


def convert_delimiter(lines: DataFrame, old: str, new: str) -> DataFrame:
    """Lines with one character replaced by another."""
    return lines.select(F.translate("value", old, new).alias("value"))


def show_rows(df: DataFrame) -> None:
    """Print every row, a line each, without holding more than one partition."""
    for row in df.toLocalIterator():
        print("(" + ",".join(str(x) for x in row) + ")")


def convert_file(spark: SparkSession, path: str, out: str, old: str = "\t", new: str = ",", reverse: bool = True) -> int:
    """Rewrite text as one file with another delimiter, last line first by default and no line end after the last line; the number of lines.

    Lines are sorted by their place in parallel into ordered parts, whose bytes are then appended to one another."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    lines = read_lines(spark, path).select(F.translate("value", old, new).alias("value"), *(c.alias(f"place{k}") for k, c in enumerate(place)))
    order = [F.desc(f"place{k}") if reverse else F.asc(f"place{k}") for k in range(len(place))]
    counted, parts = Observation(), shared_path(spark, "converted-parts")
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
    ordered.observe(counted, F.count("*").alias("lines")).write.text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(out)
    source, sink = folder.getFileSystem(conf), target.getFileSystem(conf)
    found = sorted((f for f in source.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
    stream = sink.create(target, True)
    for k, f in enumerate(found):
        opened = source.open(f.getPath())
        jvm.org.apache.commons.io.IOUtils.copyLarge(opened, stream, 0, f.getLen() - (k == len(found) - 1))
        opened.close()
    stream.close()
    delete(spark, parts)
    return counted.get["lines"]
