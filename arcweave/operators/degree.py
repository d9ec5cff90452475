"""Vertices, degrees, their distributions and top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A top-k list up to this length is broadcast when it is joined with names.
BROADCAST_K = 100_000


def vertices(arcs: DataFrame) -> DataFrame:
    """Distinct ids that an arc starts or ends at. One scan: both ends are exploded from each arc."""
    return arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def undirected(arcs: DataFrame) -> DataFrame:
    """Each arc in both directions, without repeats."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return arcs.select(F.inline(ends)).distinct()


def degrees(arcs: DataFrame, side: str) -> DataFrame:
    """(id, degree) by ``src`` (out) or ``dst`` (in); parallel arcs and self loops count."""
    return arcs.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))


def distribution(arcs: DataFrame, side: str) -> DataFrame:
    """(degree, fraction): share of the vertices at an arc that have the degree; vertices of degree 0 have no row."""
    total = vertices(arcs).agg(F.count("*").alias("total"))  # one row
    counted = degrees(arcs, side).groupBy("degree").agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("degree", (F.col("n") / F.col("total")).alias("fraction"))


def above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows whose value is strictly above the threshold."""
    return df.where(F.col(column) > threshold)


def top_k(df: DataFrame, column: str, k: int, tie: str = "id") -> DataFrame:
    """The k rows of the largest values; equal ones by id. Each task keeps k rows, so nothing is sorted as a whole."""
    return df.orderBy(F.desc(column), tie).limit(k)


def with_names(top: DataFrame, nodes: DataFrame, column: str, k: int) -> DataFrame:
    """(name, value) of at most k rows; ids without a name drop out. The k rows are broadcast (up to BROADCAST_K), never the index."""
    side = F.broadcast(top) if k <= BROADCAST_K else top
    return nodes.join(side, "id").select("name", column)


def top_k_degree(arcs: DataFrame, nodes: DataFrame, side: str, k: int, threshold: int = 0) -> DataFrame:
    """(name, degree) of the k largest degrees above the threshold."""
    return with_names(top_k(above(degrees(arcs, side), "degree", threshold), "degree", k), nodes, "degree", k)


def top_k_values(values: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(name, value) of the k largest values of (id, value)."""
    return with_names(top_k(values, "value", k), nodes, "value", k)


def adjacency(arcs: DataFrame) -> DataFrame:
    """(src, targets): all targets of a source, repeats kept, sorted. For display and export only: the algorithms keep arcs flat, so a hub is never one row."""
    return arcs.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("targets"))


def power_law(dist: DataFrame) -> DataFrame:
    """Log-log regression of a distribution: slope, intercept, r2."""
    x, y = F.log("degree"), F.log("fraction")
    return dist.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
