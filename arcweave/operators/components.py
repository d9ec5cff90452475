"""Weakly connected components: each vertex gets the smallest id it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.degree import undirected
from arcweave.plans.state import State


def stars(links: DataFrame, what: str = "stars") -> DataFrame:
    """(u, root): the smallest id that each id at a link (a, b) can reach; roots themselves have no row.

    Alternating stars: first every vertex hangs its larger neighbours on its smallest one, then its smaller ones, until nothing changes. Trees get shallower by a factor a step, so steps grow with the logarithm of the longest path. Each step is stored; old ones are deleted. Minima combine before their shuffle, and adaptive execution splits the join at a vertex of very many links."""
    state = State(links.sparkSession, what)
    edges = state.store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    checksum = None
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        after = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(after, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = state.store(small.unionByName(after.withColumnRenamed("m", "v")).distinct())
        # Equal sets have equal sums of hashes; a step that changes nothing is the last.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("g")).first()
        if now == checksum:
            state.keep_last()
            return edges.withColumnRenamed("v", "root")
        checksum = now


def labels(ids: DataFrame, arcs: DataFrame, max_iterations: int | None = None) -> DataFrame:
    """(id, component) for every id. Arcs with an end outside the ids are left out; ids without arcs are components of their own.

    With ``max_iterations``, labels travel one arc a step and may be unfinished when the steps run out. Without, components are found in full, in a logarithmic number of steps (``stars``)."""
    spark = ids.sparkSession
    known = ids.select("id").distinct()
    inside = arcs.where("src <> dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if max_iterations is None:
        found = stars(inside.select(F.col("src").alias("a"), F.col("dst").alias("b")), "wcc-stars").withColumnRenamed("u", "id")
        return known.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
    edge_state, state = State(spark, "wcc-edges"), State(spark, "wcc-labels")
    edges = edge_state.store(undirected(inside))
    current = state.store(known.select("id", F.col("id").alias("component"), F.lit(True).alias("changed")))
    for _ in range(max_iterations):
        active = current.where("changed").select(F.col("id").alias("src"), F.col("component").alias("candidate"))
        offered = edges.join(active, "src").groupBy(F.col("dst").alias("id")).agg(F.min("candidate").alias("candidate"))
        better = F.coalesce(F.col("candidate") < F.col("component"), F.lit(False))
        current = state.store(current.drop("changed").join(offered, "id", "left").select("id", F.when(better, F.col("candidate")).otherwise(F.col("component")).alias("component"), better.alias("changed")))
        if current.where("changed").isEmpty():
            break
    state.keep_last()
    return current.select("id", "component")


def component_count(found: DataFrame) -> DataFrame:
    return found.agg(F.countDistinct("component").alias("components"))


def size_distribution(found: DataFrame) -> DataFrame:
    """(component_size, num_components)."""
    sizes = found.groupBy("component").agg(F.count("*").alias("component_size"))
    return sizes.groupBy("component_size").agg(F.count("*").alias("num_components"))
