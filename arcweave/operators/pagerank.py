"""PageRank by power iteration.

A page without out-links spreads its rank over all pages, itself included.
Instead of |sinks| x n links, each step adds the sinks' total rank over n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.degree import above, degrees, top_k
from arcweave.plans.state import Buckets, State

BETA, EPSILON = 0.85, 0.001


def sinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that no link starts at."""
    return pages.join(links.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def sink_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links of every sink to every page. |sinks| x n rows: for small graphs and tests; ``pagerank`` never builds them."""
    return sinks(pages, links).select(F.col("id").alias("src")).crossJoin(pages.select(F.col("id").alias("dst")))


def sink_link_counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(src, links): how many links each sink would get in ``sink_links``, without building them."""
    n = pages.agg(F.count("*").alias("links"))  # one row
    return sinks(pages, links).select(F.col("id").alias("src")).crossJoin(F.broadcast(n))


def sink_link_sums(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(src, links, sum_dst, min_dst, max_dst): sums over each sink's links in ``sink_links``, without building them, as all sinks link to the same pages. A sink that is in ``pages`` k times has k links to each."""
    all_pages = pages.agg(F.count("*").alias("links"), F.sum("id").alias("sum_dst"), F.min("id").alias("min_dst"), F.max("id").alias("max_dst"))  # one row
    copies = sinks(pages, links).groupBy(F.col("id").alias("src")).agg(F.count("*").alias("copies"))
    return copies.crossJoin(F.broadcast(all_pages)).select("src", *((F.col("copies") * F.col(c)).alias(c) for c in ("links", "sum_dst")), "min_dst", "max_dst")


def pagerank(pages: DataFrame, links: DataFrame, beta: float = BETA, epsilon: float = EPSILON, max_iterations: int = 10, fixed: bool = False, keep_unlinked: bool = True, strict: bool = False) -> DataFrame:
    """(id, value). Stops when no rank moves by more than epsilon, or after ``max_iterations`` steps (always all of them if ``fixed``).

    keep_unlinked: pages without in-links keep a row (without it, they vanish from the second step on). strict: link ends that are no page take part too; otherwise such links are left out."""
    spark = pages.sparkSession
    n = pages.count()
    if not n:
        return pages.select("id", F.lit(0.0).alias("value"))
    if not strict:
        known = pages.select("id")
        links = links.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    kept, counted = State(spark, "pagerank-arcs"), State(spark, "pagerank-out")
    links = kept.store(links.select("src", "dst"))
    out = counted.store(degrees(links, "src").select(F.col("id").alias("src"), F.col("degree").alias("out")))
    # Bucketed by source once: a step exchanges ranks and sums, never links.
    linked = Buckets(links.join(out, "src").select("src", "dst", "out"), "pagerank-links", "src", "dst", sizes=out.withColumnRenamed("out", "size"))
    ranks = State(spark, "pagerank-ranks")
    first = pages.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("sink"), F.lit(1.0 / n).alias("value"), F.lit(True).alias("moved"))
    current = ranks.store(first)
    kept.clear()
    counted.clear()
    for _ in range(max_iterations):
        lost = current.where("sink").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("lost"))  # one row
        sent = linked.joined(current.select(F.col("id").alias("src"), "value")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("value") / F.col("out")).alias("sent"))
        both = current.select("id", "sink", F.col("value").alias("old")).join(sent, "id", "full" if strict else "left").crossJoin(F.broadcast(lost))
        if not keep_unlinked:
            both = both.where("sent IS NOT NULL OR lost > 0")
        value = F.lit(beta) * (F.coalesce("sent", F.lit(0.0)) + F.col("lost") / n) + F.lit((1 - beta) / n)
        both = both.withColumn("value", value).withColumn("moved", F.coalesce(F.abs(F.col("value") - F.col("old")) > epsilon, F.lit(False)))
        current = ranks.store(both.select("id", F.coalesce("sink", F.lit(False)).alias("sink"), "value", "moved"))
        if not fixed and current.where("moved").isEmpty():
            break
    ranks.keep_last()
    linked.drop()
    return current.select("id", "value")


def top_k_pagerank(pages: DataFrame, links: DataFrame, k: int, max_iterations: int = 10, beta: float = BETA, epsilon: float = EPSILON, floor: float = EPSILON, **options: bool) -> DataFrame:
    """The k largest ranks above the floor."""
    return top_k(above(pagerank(pages, links, beta, epsilon, max_iterations, **options), "value", floor), "value", k)
