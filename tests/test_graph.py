"""Operators on the small hermetic graph, its edge cases, and the files."""

import random

import pytest
from pyspark.sql import functions as F

from arcweave.functions import sketch
from arcweave.operators import closeness, components, degree, linerank, pagerank
from arcweave.plans import cli, queries, state
from arcweave.plans.state import Buckets, State
from arcweave.sources import text

ARCS = [(1, 2), (2, 3), (2, 4), (3, 4), (4, 1)]


@pytest.fixture(scope="module")
def arcs(spark):
    return spark.createDataFrame(ARCS, "src bigint, dst bigint")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(f"n{k}", k) for k in range(1, 6)], "name string, id bigint")


def rows(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_reader_separators_comments_and_extra_fields(spark):
    assert rows(text.parse(lines(spark, "% a comment", "1\t2", "3 4 x", "5,6,7,8"), text.ARC)) == [(1, 2), (3, 4), (5, 6)]


def test_malformed_lines_fail_or_drop(spark):
    bad = lines(spark, "1\t2", "x\t2", "3", "")
    with pytest.raises(Exception):
        text.parse(bad, text.ARC).collect()
    assert rows(text.parse(bad, text.ARC, on_error="drop")) == [(1, 2)]
    with pytest.raises(ValueError):
        text.parse(bad, text.ARC, on_error="ignore")


def test_tab_readers_know_no_comments(spark):
    assert rows(text.parse(lines(spark, "%a b\t7"), text.NODE_ID, text.TAB, None)) == [(7,)]
    assert rows(text.parse(lines(spark, "a\t9223372036854775807", "b\t-3"), text.NODE)) == [("a", 9223372036854775807), ("b", -3)]


def test_degree_distributions(arcs):
    assert rows(degree.distribution(arcs, "src")) == [(1, 0.75), (2, 0.25)]
    assert rows(degree.distribution(arcs, "dst")) == [(1, 0.75), (2, 0.25)]


def test_parallel_arcs_and_loops_count(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "src bigint, dst bigint")
    assert rows(degree.degrees(a, "src")) == [(1, 3)]
    assert rows(degree.undirected(a)) == [(1, 1), (1, 2), (2, 1)]
    assert rows(degree.adjacency(a)) == [(1, [1, 2, 2])]


def test_top_k(arcs, nodes):
    assert rows(degree.top_k_degree(arcs, nodes, "dst", 2)) == [("n1", 1), ("n4", 2)]
    assert rows(degree.top_k_degree(arcs, nodes, "dst", 99, 1)) == [("n4", 2)]
    assert rows(degree.top_k_degree(arcs, nodes.where("id <> 4"), "dst", 1)) == []


def test_pagerank(arcs, nodes):
    expected = [(1, 0.276491348), (2, 0.253510754), (3, 0.146915041), (4, 0.286915013), (5, 0.036167843)]
    assert rows(pagerank.pagerank(nodes.select("id"), arcs, max_iterations=5, fixed=True)) == expected
    assert round(sum(v for _, v in expected), 6) == 1.0
    assert dict(rows(pagerank.pagerank(nodes.select("id"), arcs, epsilon=1e-10, max_iterations=100)))[4] == pytest.approx(0.276528160, abs=1e-8)


def test_sink_links(arcs, nodes):
    assert rows(pagerank.sinks(nodes.select("id"), arcs)) == [(5,)]
    assert rows(pagerank.sink_links(nodes.select("id"), arcs)) == [(5, k) for k in range(1, 6)]
    assert rows(pagerank.sink_link_counts(nodes.select("id"), arcs)) == [(5, 5)]


def test_sink_link_sums_build_no_links(spark, arcs, nodes):
    pages = nodes.select("id").union(spark.createDataFrame([(5,), (9,), (None,)], "id long"))
    made = pagerank.sink_links(pages, arcs).groupBy("src").agg(F.count("*"), F.sum("dst"), F.min("dst"), F.max("dst"))
    sums = pagerank.sink_link_sums(pages, arcs)
    assert rows(sums.na.fill(-1)) == rows(made.na.fill(-1)) and sums.where("src = 5").first() == (5, 16, 58, 1, 9)
    assert rows(pagerank.sink_link_sums(pages.limit(0), arcs)) == []


def test_sums_over_more_sink_links_than_can_be_built(spark, tmp_path):
    n = 300_000  # 9e10 links
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    items = spark.createDataFrame([(1, k, k, 50.0) for k in range(5)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    sums = queries.QUERIES["sinks_cross_sums_sparse"](spark, str(tmp_path))
    assert sums.agg(F.count("*"), F.min("links"), F.max("links"), F.min("sum_dst"), F.max("max_dst")).first() == (n - 4, n, n, n * (n - 1) // 2, n - 1)


def test_pagerank_without_sinks_and_with_unknown_ends(spark, nodes):
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src bigint, dst bigint")
    three = nodes.where("id < 4").select("id")
    assert len(rows(pagerank.pagerank(three, ring, max_iterations=3, fixed=True))) == 3
    assert [i for i, _ in rows(pagerank.pagerank(three, ring, max_iterations=3, fixed=True, keep_unlinked=False))] == [1, 2]
    unknown = spark.createDataFrame([(1, 2), (2, 77)], "src bigint, dst bigint")
    assert 77 not in dict(rows(pagerank.pagerank(three, unknown)))
    assert 77 in dict(rows(pagerank.pagerank(three, unknown, strict=True)))
    assert rows(pagerank.pagerank(three.limit(0), ring)) == []


def test_components(spark, arcs, nodes):
    found = components.labels(nodes.select("id"), arcs)
    assert rows(found) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]
    assert rows(components.size_distribution(found)) == [(1, 1), (4, 1)]
    assert rows(components.component_count(found)) == [(2,)]
    path = spark.createDataFrame([(k, k + 1) for k in range(1, 40)], "src bigint, dst bigint")
    ids = spark.range(1, 41)
    assert {c for _, c in rows(components.labels(ids, path))} == {1}
    assert dict(rows(components.labels(ids, path, max_iterations=3)))[40] == 37


def test_components_take_few_steps(spark, monkeypatch):
    order = list(range(1000))
    random.Random(5).shuffle(order)
    taken = []
    monkeypatch.setattr(State, "store", lambda self, df, f=State.store: taken.append(self.what) or f(self, df))
    path = spark.createDataFrame(list(zip(order, order[1:])), "src bigint, dst bigint")
    assert {c for _, c in rows(components.labels(spark.range(1000), path))} == {0}
    assert taken.count("wcc-stars") <= 16
    hub = spark.range(1, 500).selectExpr("id AS src", "0 AS dst")
    assert rows(components.labels(spark.range(500), hub)) == [(k, 0) for k in range(500)]


@pytest.mark.parametrize("hub", [1000, 2])
def test_buckets_join_without_moving_arcs(spark, hub):
    arcs = [(k % 3, k) for k in range(40)] + [(7, 1), (7, 1), (8, 2)]
    stored_arcs = Buckets(spark.createDataFrame(arcs, "src bigint, dst bigint"), "test-arcs", "src", "dst", hub)
    values = spark.createDataFrame([(k, k * 10) for k in (0, 1, 2, 7, 9)], "src bigint, v bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = stored_arcs.joined(values)
        assert sorted(tuple(r) for r in found.select("src", "dst", "v").collect()) == sorted((a, b, a * 10) for a, b in arcs if a != 8)
        plan = stored_arcs.joined(values)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    arcs_side = plan[: plan.index("Bucketed: true")].rsplit("SortMergeJoin", 1)[1]
    assert "Exchange" not in arcs_side
    stored_arcs.drop()


def test_iterations_leave_no_tables(spark, arcs, nodes):
    pagerank.pagerank(nodes.select("id"), arcs).count()
    closeness.closeness(nodes, arcs).count()
    linerank.linerank(linerank.numbered(arcs)).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("pagerank", "closeness", "linerank"))]


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        state.shared_path(Session, "x")
    Context.master = "local[4]"
    assert state.shared_path(Session, "x").startswith("file:///")


def test_sketch_hashes(spark):
    df = spark.createDataFrame([(0,), (1,), (102,), (1 << 32,)], "id bigint")
    found = {r["id"]: r["h"] for r in df.select("id", sketch.level_hashes(df["id"]).alias("h")).collect()}
    assert (found[0][0], found[1][0], found[1][1], found[102][31]) == (1800329511, 1266253385, 1614001898, 1728947388)
    assert found[1 << 32] == found[0]  # low 32 bits only


def test_closeness(arcs, nodes):
    assert rows(closeness.closeness(nodes, arcs)) == [(1, 0.75), (2, 1.0), (3, 0.75), (4, 1.0), (5, 0.0)]
    assert rows(closeness.top_k_closeness(nodes, arcs, 2)) == [(2, 1.0), (4, 1.0)]


def test_linerank(arcs):
    numbered = linerank.numbered(arcs)
    assert rows(numbered) == [(k + 1, *a) for k, a in enumerate(sorted(ARCS))]
    assert rows(linerank.linerank(numbered, 5, fixed=True)) == [(1, 0.270069797), (2, 0.377944406), (3, 0.202468500), (4, 0.295436766)]
    uniform = dict(rows(linerank.linerank(numbered, 50, init="uniform")))
    assert uniform[2] == pytest.approx(0.684046895, abs=1e-8)
    with pytest.raises(ValueError):
        linerank.linerank(numbered, init="random")


def test_empty_arcs(spark, nodes):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert rows(degree.distribution(none, "src")) == []
    assert rows(components.labels(nodes.select("id"), none)) == [(k, k) for k in range(1, 6)]
    assert rows(closeness.closeness(nodes, none)) == [(k, 0.0) for k in range(1, 6)]
    assert rows(linerank.linerank(linerank.numbered(none))) == []


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "arcs").write_text("% toy\n" + "".join(f"{a}\t{b}\n" for a, b in ARCS))
    (tmp_path / "index").write_text("".join(f"n{k}\t{k}\n" for k in range(1, 6)))
    at = lambda name: str(tmp_path / name)
    read = lambda name: sorted(r["value"] for r in spark.read.text(at(name)).collect())
    assert cli.main(["in-degree", at("arcs")], spark) == 0
    assert "top-in-degree index arcs out k threshold" in capsys.readouterr().err
    cli.main(["wcc", at("index"), at("arcs"), at("sizes"), "0"], spark)
    assert read("sizes") == ["1 1", "4 1"]
    cli.main(["source-incidence", at("arcs"), at("s")], spark)
    cli.main(["target-incidence", at("arcs"), at("t")], spark)
    assert read("s")[0] == "1\t1\t1.0"
    cli.main(["line-rank", at("s"), at("t"), at("lr"), "5", "0.0", "0.85"], spark)
    cli.main(["top-names", at("index"), at("lr"), at("top"), "1"], spark)
    assert read("top")[0].startswith("n2,0.3779444")
    cli.main(["convert", at("arcs"), at("csv"), "csv"], spark)
    assert (tmp_path / "csv").read_text() == "\n".join([f"{a},{b}" for a, b in reversed(ARCS)] + ["% toy"])
    capsys.readouterr()
    cli.main(["wcc", at("index"), at("arcs"), "-", "0"], spark)
    assert sorted(capsys.readouterr().out.split()) == ["(1,1)", "(4,1)"]
    cli.main(["source-incidence", at("arcs"), at("s2")], spark)
    assert capsys.readouterr().out == "5 arcs\n"


def test_convert_file_keeps_the_order_of_many_parts(spark, tmp_path):
    rows_of = [f"{k}\tx" for k in range(20_000)]
    (tmp_path / "in").write_text("\n".join(rows_of) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert text.convert_file(spark, str(tmp_path / "in"), str(tmp_path / "out"), reverse=False) == len(rows_of)
        assert text.convert_file(spark, str(tmp_path / "in"), str(tmp_path / "back")) == len(rows_of)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (tmp_path / "out").read_text() == "\n".join(x.replace("\t", ",") for x in rows_of)
    assert (tmp_path / "back").read_text() == "\n".join(x.replace("\t", ",") for x in reversed(rows_of))


def test_degree_stream(spark, tmp_path):
    from arcweave.streaming.degrees import arc_stream, degree_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\t2\n1\t3\n")
    query = degree_stream(arc_stream(spark, str(tmp_path / "in")), "src").writeStream.outputMode("complete").format("memory").queryName("running_degrees").start()
    try:
        query.processAllAvailable()
        (tmp_path / "in" / "b.txt").write_text("1\t4\n2\t4\n")
        query.processAllAvailable()
        assert rows(spark.table("running_degrees")) == [(1, 3), (2, 1)]
    finally:
        query.stop()
