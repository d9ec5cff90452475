"""Approximate closeness centrality from counting sketches of growing neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.sketch import estimate, merge_agg, merged, singleton
from arcweave.operators.degree import above, top_k, undirected
from arcweave.plans.state import Buckets, State

FLOOR = 0.3


def closeness(nodes: DataFrame, arcs: DataFrame, max_iterations: int = 10) -> DataFrame:
    """(id, value): (n - 1) over the sum, for each step, of step x newly reached vertices; higher is more central, 0 for vertices that reach none.

    n counts the vertices at an arc. A vertex whose estimate doesn't change in a step keeps its old sketch. Stops early when no estimate changes: every later step would be the same."""
    spark = nodes.sparkSession
    both_ways = State(spark, "closeness-both-ways")
    pairs = both_ways.store(undirected(arcs))
    n = pairs.select("src").distinct().count()
    # Bucketed by the end that is heard once: a step exchanges sketches, never edges.
    edges = Buckets(pairs, "closeness-edges", "dst", "src")
    both_ways.clear()
    state = State(spark, "closeness-state")
    current = state.store(nodes.select("id").distinct().withColumn("sketch", singleton(F.col("id"))).select("id", "sketch", estimate(F.col("sketch")).alias("seen"), F.lit(0.0).alias("total"), F.lit(True).alias("changed")))
    for step in range(1, max_iterations + 1):
        heard = edges.joined(current.select(F.col("id").alias("dst"), "sketch")).groupBy(F.col("src").alias("id")).agg(merge_agg("sketch").alias("heard"))
        both = current.join(heard, "id", "left").withColumn("union", F.when(F.col("heard").isNull(), F.col("sketch")).otherwise(merged(F.col("sketch"), F.col("heard"))))
        both = both.withColumn("now", estimate(F.col("union")))
        grown = F.col("now") != F.col("seen")
        current = state.store(
            both.select(
                "id",
                F.when(grown, F.col("union")).otherwise(F.col("sketch")).alias("sketch"),
                F.when(grown, F.col("now")).otherwise(F.col("seen")).alias("seen"),
                (F.col("total") + step * (F.col("now") - F.col("seen"))).alias("total"),
                grown.alias("changed"),
            )
        )
        if current.where("changed").isEmpty():
            break
    state.keep_last()
    edges.drop()
    return current.select("id", F.when(F.col("total") > 0, F.lit(float(n - 1)) / F.when(F.col("total") > 0, F.col("total"))).otherwise(0.0).alias("value"))


def top_k_closeness(nodes: DataFrame, arcs: DataFrame, k: int, max_iterations: int = 10, floor: float = FLOOR) -> DataFrame:
    return top_k(above(closeness(nodes, arcs, max_iterations), "value", floor), "value", k)
