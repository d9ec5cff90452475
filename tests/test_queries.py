"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from arcweave.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_whole_graph_reaches_every_line_item(spark, duck):
    items = duck.sql("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY ALL").fetchall()
    arcs = sorted((a[2], b[2]) for a, b in zip(items, items[1:]) if a[0] == b[0])
    read = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, DATA).collect())
    assert read("arc_reader") == read("link_reader_tab") == read("incidence_reader") == read("arc_scan") == arcs
    assert [r.value for r in QUERIES["csv_tab_convert"](spark, DATA).orderBy("value").collect()] == sorted(f"{a},{b}" for a, b in arcs)
    component = {r[0]: r[0] for r in duck.sql("SELECT p_partkey FROM part").fetchall()}
    while moved := [(c, component[b]) for a, b in [*arcs, *((b, a) for a, b in arcs)] if (c := component[a]) > component[b]]:
        lower = dict(sorted(moved, reverse=True))
        component = {k: lower.get(c, c) for k, c in component.items()}
    assert read("wcc_labels") == sorted(component.items())
    assert all(name.endswith("_sparse") == ("l_quantity" in sql) for name, sql in ORACLE_SQL.items())
