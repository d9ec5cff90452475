"""Command line: one sub-command a job, with positional arguments in a fixed order.

    python -m arcweave.plans.cli pagerank index arcs out 0.85 0.001 20

Any other number of arguments prints the usage and runs nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from arcweave.operators import closeness, components, degree, linerank, pagerank
from arcweave.sources import text


def in_degree(spark: SparkSession, arcs: str, out: str) -> None:
    text.write_rows(degree.distribution(text.read_arcs(spark, arcs), "dst"), out)


def out_degree(spark: SparkSession, arcs: str, out: str) -> None:
    text.write_rows(degree.distribution(text.read_arcs(spark, arcs), "src"), out)


def top_in_degree(spark: SparkSession, index: str, arcs: str, out: str, k: str, threshold: str) -> None:
    text.write_rows(degree.top_k_degree(text.read_arcs(spark, arcs), text.read_nodes(spark, index), "dst", int(k), int(threshold)), out)


def top_out_degree(spark: SparkSession, index: str, arcs: str, out: str, k: str, threshold: str) -> None:
    text.write_rows(degree.top_k_degree(text.read_arcs(spark, arcs), text.read_nodes(spark, index), "src", int(k), int(threshold)), out)


def page_rank(spark: SparkSession, index: str, arcs: str, out: str, beta: str, epsilon: str, steps: str) -> None:
    text.write_rows(pagerank.pagerank(text.read_pages(spark, index), text.read_links(spark, arcs), float(beta), float(epsilon), int(steps)), out)


def top_page_rank(spark: SparkSession, index: str, arcs: str, out: str, steps: str, k: str) -> None:
    text.write_rows(pagerank.top_k_pagerank(text.read_pages(spark, index), text.read_links(spark, arcs), int(k), int(steps)), out)


def wcc(spark: SparkSession, index: str, arcs: str, out: str, steps: str) -> None:
    """``steps`` 0 runs until nothing changes; ``out`` - prints the sizes."""
    found = components.size_distribution(components.labels(text.read_node_ids(spark, index), text.read_arcs(spark, arcs), int(steps) or None))
    if out == "-":
        text.show_rows(found)
    else:
        text.write_rows(found, out, " ")


def top_closeness(spark: SparkSession, index: str, arcs: str, out: str, steps: str, k: str) -> None:
    text.write_rows(closeness.top_k_closeness(text.read_nodes(spark, index), text.read_arcs(spark, arcs), int(k), int(steps)), out)


def _incidence(spark: SparkSession, arcs: str, out: str, side: str) -> None:
    counted = Observation()
    numbered = linerank.numbered(text.read_arcs(spark, arcs)).observe(counted, F.count("*").alias("lines"))
    text.write_rows(linerank.incidence(numbered, side), out, "\t")
    print(f"{counted.get['lines']} arcs")


def source_incidence(spark: SparkSession, arcs: str, out: str) -> None:
    _incidence(spark, arcs, out, "src")


def target_incidence(spark: SparkSession, arcs: str, out: str) -> None:
    _incidence(spark, arcs, out, "dst")


def line_rank(spark: SparkSession, source: str, target: str, out: str, steps: str, epsilon: str, damping: str) -> None:
    """From the two incidence files: an arc is the pair of rows with its id."""
    s, t = (text.read_incidence(spark, p).withColumnRenamed("node", n) for p, n in ((source, "src"), (target, "dst")))
    text.write_rows(linerank.linerank(s.join(t, "arc_id"), int(steps), float(epsilon), float(damping)), out)


def top_names(spark: SparkSession, index: str, values: str, out: str, k: str) -> None:
    text.write_rows(degree.top_k_values(text.read_values(spark, values), text.read_nodes(spark, index), int(k)), out)


def convert(spark: SparkSession, path: str, out: str, to: str) -> None:
    """``to`` is csv or tab; lines come out last first."""
    old, new = ("\t", ",") if to == "csv" else (",", "\t")
    print(f"{text.convert_file(spark, path, out, old, new)} lines")


COMMANDS: dict[str, Callable[..., None]] = {f.__name__.replace("_", "-"): f for f in (in_degree, out_degree, top_in_degree, top_out_degree, page_rank, top_page_rank, wcc, top_closeness, source_incidence, target_incidence, line_rank, top_names, convert)}


def usage() -> str:
    return "\n".join(f"{name} {' '.join(c.__code__.co_varnames[1 : c.__code__.co_argcount])}" for name, c in COMMANDS.items())


def main(args: list[str], spark: SparkSession | None = None) -> int:
    command = COMMANDS.get(args[0]) if args else None
    if command is None or len(args) != command.__code__.co_argcount:
        print(usage(), file=sys.stderr)
        return 0
    command(spark or SparkSession.builder.getOrCreate(), *args[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
