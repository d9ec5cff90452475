"""LineRank betweenness: a random walk on the line graph, without building it.

Everything lives in one arc table (arc_id, src, dst); its incidence matrices are
projections of it. An arc's score depends on its target only, so the walk's state
has a row a vertex: a step joins it to the stored arcs and sums by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.operators.degree import degrees
from arcweave.plans.state import Buckets, State, stored

DAMPING, EPSILON = 0.85, 0.001


def numbered(arcs: DataFrame) -> DataFrame:
    """Arcs with arc_id from 1, in the order of (src, dst). Ranges are sorted in parallel; an id is the rows of earlier ranges plus the place in its own."""
    ordered = arcs.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    row = F.monotonically_increasing_id()
    placed = stored(ordered.select("src", "dst", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "arc-places")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    before = counts.select("part", F.sum("n").over(so_far).alias("before"))
    return placed.join(F.broadcast(before), "part", "left").select((F.coalesce("before", F.lit(0)) + F.col("nth") + 1).alias("arc_id"), "src", "dst")


def incidence(arcs: DataFrame, side: str) -> DataFrame:
    """(arc_id, node, weight 1.0) by ``src`` or ``dst``, from numbered arcs."""
    return arcs.select("arc_id", F.col(side).alias("node"), F.lit(1.0).alias("weight"))


def normalisation(arcs: DataFrame) -> DataFrame:
    """(arc_id, d): one over the arcs that start at the arc's target; arcs into a dead end have none."""
    out = degrees(arcs, "src").select(F.col("id").alias("dst"), "degree")
    return arcs.join(out, "dst").select("arc_id", (1.0 / F.col("degree")).alias("d"))


def linerank(arcs: DataFrame, max_iterations: int = 10, epsilon: float = EPSILON, damping: float = DAMPING, init: str = "zero", fixed: bool = False) -> DataFrame:
    """(id, value) from numbered arcs (arc_id, src, dst): what the scored arcs that start and that end at a vertex add up to; vertices that lack either have no row.

    init: every arc's first score, "zero" or "uniform" (one over the distinct arcs). Stops when the scores move by less than epsilon in sum, unless ``fixed``. A step keeps the arcs whose target is the source of a scored arc."""
    if init not in ("zero", "uniform"):
        raise ValueError("init must be 'zero' or 'uniform'")
    pairs = stored(arcs.groupBy("src", "dst").agg(F.count("*").alias("times")), "linerank-pairs")
    m = pairs.count()
    edges = Buckets(pairs, "linerank-arcs", "dst", "src")
    ends = lambda side, name: pairs.groupBy(F.col(side).alias("id")).agg(F.sum("times").alias(name))
    # A vertex's v is the score of each arc that ends there. It has one as long as scored arcs start there.
    first = 0.0 if init == "zero" or not m else 1.0 / m
    state = State(arcs.sparkSession, "linerank")
    current = state.store(ends("src", "out").join(ends("dst", "into"), "id").select("id", (1.0 / F.col("out")).alias("d"), "into", F.lit(first).alias("v"), F.lit(0.0).alias("move")))

    def by_source(value: Column, name: str) -> DataFrame:
        scored = edges.joined(current.select(F.col("id").alias("dst"), value.alias("value")))
        return scored.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("times") * F.col("value")).alias(name))

    for _ in range(max_iterations):
        score = F.lit(damping) * F.col("x") + F.lit((1 - damping) / max(m, 1))
        moved = current.join(by_source(F.col("d") * F.col("v"), "x"), "id").withColumn("score", score)
        current = state.store(moved.select("id", "d", "into", F.col("score").alias("v"), (F.col("into") * F.abs(F.col("score") - F.col("v"))).alias("move")))
        if not fixed and (current.agg(F.sum("move").alias("s")).first()["s"] or 0.0) < epsilon:
            break
    starting = by_source(F.col("v"), "a")
    found = stored(current.join(starting, "id").select("id", (F.col("a") + F.col("into") * F.col("v")).alias("value")), "linerank-values")
    edges.drop()
    state.clear()
    return found
