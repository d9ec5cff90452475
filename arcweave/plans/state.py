"""Stored tables of driver loops and long plans.

They lie in the folder that driver and executors share, so plans stay short and a
lost executor costs a re-read. A loop's old versions are deleted as it goes on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arcs of one vertex that one task gets at most.
HUB = 1_000_000


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names. Without that setting, a session on one machine gets a temporary folder; on a cluster that would be another disk on every executor, so it is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/arcweave-shared"
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class State:
    """The stored versions of a loop's table; an old one is deleted once two newer ones exist."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.what, self.paths = spark, what, []

    def store(self, df: DataFrame) -> DataFrame:
        self.paths.append(path := shared_path(self.spark, self.what))
        df.write.parquet(path)
        if len(self.paths) > 2:
            delete(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self) -> None:
        """Delete all versions but the newest."""
        for path in self.paths[:-1]:
            delete(self.spark, path)
        self.paths = self.paths[-1:]

    def clear(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write and read again: cuts the lineage."""
    return State(df.sparkSession, what).store(df)


class Buckets:
    """A table stored in buckets by its key, so that joins on the key exchange the other side only.

    A key of more than HUB rows is dealt over several parts by a hash of ``other``; a row of the other side is sent once to each part of its key, so a hub is never one task's. ``parts`` has a row a split key. ``sizes`` (key, size) saves counting the rows of each key."""

    def __init__(self, df: DataFrame, what: str, key: str, other: str, hub: int | None = None, sizes: DataFrame | None = None) -> None:
        spark = self.spark = df.sparkSession
        hub = hub or HUB
        self.key, self.name, self.path = key, f"{what.replace('-', '_')}_{uuid.uuid4().hex}", shared_path(spark, what)
        sizes = df.groupBy(key).agg(F.count("*").alias("size")) if sizes is None else sizes
        self.parts = stored(sizes.where(F.col("size") > hub).select(key, F.ceil(F.col("size") / hub).cast("int").alias("parts")), f"{what}-hubs")
        self.split = not self.parts.isEmpty()
        self.keys = [key, "part"] if self.split else [key]
        if self.split:
            part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
            df = df.join(self.parts, key, "left").withColumn("part", part).drop("parts")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, *self.keys).write.format("parquet").bucketBy(n, *self.keys).sortBy(*self.keys).option("path", self.path).saveAsTable(self.name)
        self.table = spark.table(self.name)

    def joined(self, values: DataFrame) -> DataFrame:
        """The table's rows with the columns of ``values``, which has the key and a row a key at most."""
        if self.split:
            parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
            values = values.join(self.parts, self.key, "left").withColumn("part", F.explode(parts)).drop("parts")
        return self.table.join(values, self.keys).drop("part")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)
