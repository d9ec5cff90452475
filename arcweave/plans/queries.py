"""Queries over the driver's tables, each with DuckDB SQL for the same rows.

The graph: vertices are parts; an arc leads from each line item's part to that
of the next line item of its order. Queries run over the whole graph. Those whose
result depends on its shape also run, as ``NAME_sparse``, over the graph of line
items of at least 45 pieces, which has sinks, isolated vertices and many components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.functions import sketch as fm
from arcweave.operators import closeness as cl
from arcweave.operators import components as wcc
from arcweave.operators import degree as dg
from arcweave.operators import linerank as lr
from arcweave.operators import pagerank as pr
from arcweave.plans.state import shared_path
from arcweave.sources import text

STEPS, CLOSENESS_STEPS = 5, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def arcs(spark: SparkSession, d: str, least: float | None = None) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    if least is not None:
        items = items.where(F.col("l_quantity") >= least)
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return items.select(F.col("l_partkey").alias("src"), following.alias("dst")).where("dst IS NOT NULL")


def sparse(spark: SparkSession, d: str) -> DataFrame:
    return arcs(spark, d, 45)


Graph = Callable[[SparkSession, str], DataFrame]


def arc_lines(a: DataFrame) -> DataFrame:
    """Arcs as text with all three separators, a trailing field and comment lines."""
    sep = F.when(F.col("src") % 3 == 0, "\t").when(F.col("src") % 3 == 1, " ").otherwise(",")
    return a.select(F.concat("src", sep, "dst", sep, F.lit("x")).alias("value")).union(a.select(F.concat(F.lit("% "), "src").alias("value")))


def node_lines(spark: SparkSession, d: str, comments: bool = True) -> DataFrame:
    n = nodes(spark, d)
    lines = n.select(F.concat(F.lit("n"), "id", F.lit("\t"), "id").alias("value"))
    return lines.union(n.select(F.concat(F.lit("%"), "id").alias("value"))) if comments else lines


def rounded(df: DataFrame, column: str = "value", digits: int = 9) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


def joined(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(column, ","))


def tab_pages(s: SparkSession, d: str) -> DataFrame:
    return text.parse(node_lines(s, d, False), text.NODE_ID, text.TAB, None)


def tab_links(a: DataFrame) -> DataFrame:
    return text.parse(a.select(F.concat("src", F.lit("\t"), "dst").alias("value")), text.ARC, text.TAB, None)


def value_lines(s: SparkSession, d: str) -> DataFrame:
    return text.parse(table(s, d, "part").select(F.concat("p_partkey", F.lit(","), "p_retailprice").alias("value")), text.VALUE)


def part_values(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))


def hash_rows(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).select("id", F.posexplode(fm.level_hashes(F.col("id"))).alias("level", "hash"))


def sketch_rows(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).select("id", F.array_join(fm.singleton(F.col("id")), ",").alias("sketch"))


def brand_estimates(s: SparkSession, d: str) -> DataFrame:
    """Distinct parts of each brand, by merged sketches."""
    part = table(s, d, "part").select("p_brand", fm.singleton(F.col("p_partkey")).alias("sketch"))
    return part.groupBy("p_brand").agg(fm.merge_agg("sketch").alias("sketch")).select("p_brand", fm.estimate(F.col("sketch")).alias("parts"))


def read_back(s: SparkSession, df: DataFrame, sep: str) -> DataFrame:
    """The lines of the text files that a delimited sink writes."""
    path = shared_path(s, "sink")
    text.write_rows(df, path, sep)
    return text.read_lines(s, path)


def scanned(s: SparkSession, lines: DataFrame) -> str:
    """A folder of text files with these lines."""
    path = shared_path(s, "lines")
    lines.write.text(path)
    return path


def converted(s: SparkSession, a: DataFrame) -> DataFrame:
    """Lines of the converter's one output file, and how many it says it wrote."""
    out = shared_path(s, "converted")
    n = text.convert_file(s, scanned(s, a.select(F.concat("src", F.lit("\t"), "dst").alias("value"))), out)
    return text.read_lines(s, out).withColumn("lines", F.lit(n))


def queries_over(graph: Graph) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that run over the whole and over the sparse graph."""
    return {
        "sinks_cross_sums": lambda s, d: pr.sink_link_sums(nodes(s, d).select("id"), graph(s, d)),
        "linerank_converged": lambda s, d: rounded(lr.linerank(lr.numbered(graph(s, d)))),
        "arc_reader": lambda s, d: text.parse(arc_lines(graph(s, d)), text.ARC),
        "link_reader_tab": lambda s, d: tab_links(graph(s, d)),
        "incidence_reader": lambda s, d: text.parse(graph(s, d).select(F.concat("src", F.lit(" "), "dst", F.lit(" 1.0")).alias("value")), text.INCIDENCE),
        "csv_tab_convert": lambda s, d: text.convert_delimiter(graph(s, d).select(F.concat("src", F.lit("\t"), "dst").alias("value")), "\t", ","),
        "sinks_anti_join": lambda s, d: pr.sinks(nodes(s, d).select("id"), graph(s, d)),
        "sinks_cross_all": lambda s, d: pr.sink_link_counts(nodes(s, d).select("id"), graph(s, d)),
        "pagerank_5": lambda s, d: rounded(pr.pagerank(nodes(s, d).select("id"), graph(s, d), max_iterations=STEPS, fixed=True)),
        "topk_pagerank_5": lambda s, d: rounded(pr.top_k_pagerank(nodes(s, d).select("id"), graph(s, d), 10, STEPS, floor=0.0001, fixed=True)),
        "pagerank_converged": lambda s, d: rounded(pr.pagerank(nodes(s, d).select("id"), graph(s, d))),
        "wcc_labels": lambda s, d: wcc.labels(nodes(s, d).select("id"), graph(s, d)),
        "wcc_count": lambda s, d: wcc.component_count(wcc.labels(nodes(s, d).select("id"), graph(s, d))),
        "wcc_size_dist": lambda s, d: wcc.size_distribution(wcc.labels(nodes(s, d).select("id"), graph(s, d))),
        "closeness_4": lambda s, d: rounded(cl.closeness(nodes(s, d), graph(s, d), CLOSENESS_STEPS)),
        "topk_closeness_4": lambda s, d: rounded(cl.top_k_closeness(nodes(s, d), graph(s, d), 700, CLOSENESS_STEPS)),
        "source_incidence": lambda s, d: lr.incidence(lr.numbered(graph(s, d)), "src"),
        "target_incidence": lambda s, d: lr.incidence(lr.numbered(graph(s, d)), "dst"),
        "linerank_norm": lambda s, d: rounded(lr.normalisation(lr.numbered(graph(s, d))), "d"),
        "linerank_5": lambda s, d: rounded(lr.linerank(lr.numbered(graph(s, d)), STEPS, fixed=True)),
        "linerank_uniform_5": lambda s, d: rounded(lr.linerank(lr.numbered(graph(s, d)), STEPS, init="uniform", fixed=True)),
    }


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "node_reader": lambda s, d: text.parse(node_lines(s, d), text.NODE),
    "node_id_reader": lambda s, d: text.parse(node_lines(s, d), text.NODE_ID),
    "page_reader_tab": tab_pages,
    "value_reader": value_lines,
    "vertices_distinct": lambda s, d: dg.vertices(arcs(s, d)),
    "undirect_edges": lambda s, d: dg.undirected(arcs(s, d)),
    "out_degree": lambda s, d: dg.degrees(arcs(s, d), "src"),
    "in_degree": lambda s, d: dg.degrees(arcs(s, d), "dst"),
    "out_degree_dist": lambda s, d: rounded(dg.distribution(arcs(s, d), "src"), "fraction"),
    "in_degree_dist": lambda s, d: rounded(dg.distribution(arcs(s, d), "dst"), "fraction"),
    "topk_in_degree_names": lambda s, d: dg.top_k_degree(arcs(s, d), nodes(s, d), "dst", 10, 2),
    "topk_out_degree_names": lambda s, d: dg.top_k_degree(arcs(s, d), nodes(s, d), "src", 10, 2),
    "topk_value_names": lambda s, d: dg.top_k_values(part_values(s, d), nodes(s, d), 20),
    "power_law_fit": lambda s, d: rounded(rounded(rounded(dg.power_law(dg.distribution(arcs(s, d), "dst")), "slope", 6), "intercept", 6), "r2", 6),
    "adjacency_list": lambda s, d: joined(dg.adjacency(arcs(s, d)), "targets"),
    "fm_hash": hash_rows,
    "fm_sketch_init": sketch_rows,
    "fm_estimate": brand_estimates,
    "arc_scan": lambda s, d: text.read_arcs(s, scanned(s, arc_lines(arcs(s, d)))),
    "node_scan": lambda s, d: text.read_nodes(s, scanned(s, node_lines(s, d))),
    "sink_comma": lambda s, d: read_back(s, dg.degrees(arcs(s, d), "src"), ","),
    "sink_blank": lambda s, d: read_back(s, wcc.size_distribution(wcc.labels(nodes(s, d).select("id"), arcs(s, d))), " "),
    "sink_tab": lambda s, d: read_back(s, lr.incidence(lr.numbered(arcs(s, d)), "src"), "\t"),
    "csv_file_convert": lambda s, d: converted(s, arcs(s, d)),
    **queries_over(arcs),
    **{f"{name}_sparse": query for name, query in queries_over(sparse).items()},
}


def _arcs_sql(least: str = "") -> str:
    return f"""nodes AS (SELECT p_partkey AS id, p_name AS name FROM part),
arcs AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem {least}) WHERE dst IS NOT NULL)"""


ALL, SPARSE = f"WITH {_arcs_sql()}", f"WITH {_arcs_sql('WHERE l_quantity >= 45')}"
_EDGES = "edges AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs)"
_ENDS = "ends AS (SELECT src AS id FROM arcs UNION SELECT dst FROM arcs)"


def _degree_sql(side: str) -> str:
    return f"SELECT {side} AS id, count(*) AS degree FROM arcs GROUP BY {side}"


def _dist_sql(side: str) -> str:
    return f"{ALL}, {_ENDS}, deg AS ({_degree_sql(side)}) SELECT degree, round(count(*) / (SELECT count(*) FROM ends), 9) AS fraction FROM deg GROUP BY degree"


def _topk_sql(side: str) -> str:
    return f"{ALL}, top AS (SELECT * FROM ({_degree_sql(side)}) WHERE degree > 2 ORDER BY degree DESC, id LIMIT 10) SELECT name, degree FROM top JOIN nodes USING (id)"


def _pagerank_ctes(steps: int) -> str:
    out = "n AS (SELECT count(*) AS n FROM nodes), deg AS (SELECT src, count(*) AS out FROM arcs GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / n AS value FROM nodes, n)"
    for k in range(1, steps + 1):
        out += f""",
s{k} AS (SELECT dst AS id, sum(value / out) AS sent FROM arcs JOIN deg USING (src) JOIN r{k - 1} ON r{k - 1}.id = src GROUP BY dst),
l{k} AS (SELECT coalesce(sum(value), 0) AS lost FROM r{k - 1} WHERE id NOT IN (SELECT src FROM deg)),
r{k} AS (SELECT nodes.id, 0.85 * (coalesce(sent, 0) + lost / n) + 0.15 / n AS value FROM nodes CROSS JOIN n CROSS JOIN l{k} LEFT JOIN s{k} ON s{k}.id = nodes.id)"""
    return out


def _converged_sql(most: int = 10) -> str:
    moved = ", ".join(f"m{k} AS (SELECT {k} AS k, max(abs(a.value - b.value)) > 0.001 AS moving FROM r{k} a JOIN r{k - 1} b USING (id))" for k in range(1, most + 1))
    steps = " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k}" for k in range(1, most + 1))
    tests = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, most + 1))
    return f"{SPARSE}, {_pagerank_ctes(most)}, {moved} SELECT id, round(value, 9) AS value FROM ({steps}) WHERE k = (SELECT coalesce(min(k) FILTER (NOT moving), {most}) FROM ({tests}))"


_WCC = f"""{SPARSE.replace("WITH", "WITH RECURSIVE", 1)}, {_EDGES},
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, edges.dst FROM reach JOIN edges ON reach.b = edges.src),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""


def _hash_ctes(ids: str) -> str:
    m = "4294967295"
    return f"""lv AS (SELECT unnest(range(32)) AS lvl),
h0 AS (SELECT id, lvl, ((((id & {m}) << ((lvl * 11) & 31)::INT) & {m}) | ((id & {m}) >> ((32 - ((lvl * 11) & 31)) & 31)::INT)) AS x FROM ({ids}), lv),
h1 AS (SELECT id, lvl, (x + 2127912214 + ((x << 12) & {m})) & {m} AS x FROM h0),
h2 AS (SELECT id, lvl, xor(xor(x, 3345072700), (x >> 19)) AS x FROM h1),
h3 AS (SELECT id, lvl, (x + 374761393 + ((x << 5) & {m})) & {m} AS x FROM h2),
h4 AS (SELECT id, lvl, xor(((x + 3550635116) & {m}), ((x << 9) & {m})) AS x FROM h3),
h5 AS (SELECT id, lvl, (x + 4251993797 + ((x << 3) & {m})) & {m} AS x FROM h4),
h6 AS (SELECT id, lvl, xor(xor(x, 3042594569), (x >> 16)) AS x FROM h5),
h AS (SELECT id, lvl, CASE WHEN x >= 2147483648 THEN {m} - x ELSE x END AS x FROM h6),
sk AS (SELECT id, lvl, CASE WHEN x = 0 THEN 1 ELSE x & -x END AS b FROM h)"""


def _estimate(group: str, source: str) -> str:
    return f"SELECT {group}, trunc(pow(2.0, list_sum(list_sort(list(bit_count(xor(b, b + 1)) - 1))[9:24]) / 16.0) / 0.77351)::BIGINT AS est FROM {source} GROUP BY {group}"


def _closeness_ctes(steps: int) -> str:
    out = f"{_EDGES}, {_ENDS}, {_hash_ctes('SELECT id FROM nodes')}, s0 AS (SELECT * FROM sk), e0 AS (SELECT id, est, 0.0::DOUBLE AS total FROM ({_estimate('id', 's0')}))"
    for k in range(1, steps + 1):
        out += f""",
g{k} AS (SELECT src AS id, lvl, bit_or(b) AS b FROM edges JOIN s{k - 1} ON s{k - 1}.id = dst GROUP BY src, lvl),
u{k} AS (SELECT id, lvl, s.b AS old, (s.b | coalesce(g.b, 0)) AS b FROM s{k - 1} s LEFT JOIN g{k} g USING (id, lvl)),
n{k} AS ({_estimate('id', f'u{k}')}),
e{k} AS (SELECT id, n.est, total + {k} * (n.est - e.est) AS total, n.est <> e.est AS grown FROM e{k - 1} e JOIN n{k} n USING (id)),
s{k} AS (SELECT id, lvl, CASE WHEN grown THEN b ELSE old END AS b FROM u{k} JOIN e{k} USING (id))"""
    return out + f", c AS (SELECT id, CASE WHEN total > 0 THEN ((SELECT count(*) FROM ends) - 1) / total ELSE 0.0 END AS value FROM e{steps})"


def _numbered(extra: str = "") -> str:
    return f"{SPARSE}, num AS (SELECT row_number() OVER (ORDER BY src, dst) AS arc_id, src, dst FROM arcs){extra}"


_NORM = ", deg AS (SELECT src AS dst, count(*) AS out FROM arcs GROUP BY src), d AS (SELECT arc_id, num.src, dst, 1.0::DOUBLE / out AS d FROM num JOIN deg USING (dst)), m AS (SELECT count(*) AS m FROM (SELECT DISTINCT src, dst FROM arcs))"


def _linerank_converged_sql(most: int = 10) -> str:
    """Unrolled steps; a step's move is what its arcs' scores changed by, in sum, and the first below 0.001 is the last."""
    out = f"{_numbered(_NORM)}, v0 AS (SELECT arc_id, src, dst, d, 0.0::DOUBLE AS v FROM d, m)"
    for k in range(1, most + 1):
        out += f", x{k} AS (SELECT src AS dst, sum(d * v) AS x FROM v{k - 1} GROUP BY src), v{k} AS (SELECT arc_id, src, dst, d, 0.85 * x + 0.15 / m AS v, abs(0.85 * x + 0.15 / m - v) AS move FROM v{k - 1} JOIN x{k} USING (dst), m)"
    moves = " UNION ALL ".join(f"SELECT {k} AS k, coalesce(sum(move), 0) AS move FROM v{k}" for k in range(1, most + 1))
    steps = " UNION ALL ".join(f"SELECT {k} AS k, src, dst, v FROM v{k}" for k in range(1, most + 1))
    out += f", stop AS (SELECT coalesce(min(k) FILTER (move < 0.001), {most}) AS k FROM ({moves})), f AS (SELECT src, dst, v FROM ({steps}) JOIN stop USING (k))"
    return out + ", a AS (SELECT src AS id, sum(v) AS a FROM f GROUP BY src), b AS (SELECT dst AS id, sum(v) AS b FROM f GROUP BY dst) SELECT id, round(a + b, 9) AS value FROM a JOIN b USING (id)"


def _linerank_sql(steps: int, first: str) -> str:
    out = f"{_numbered(_NORM)}, v0 AS (SELECT arc_id, src, dst, d, {first} AS v FROM d, m)"
    for k in range(1, steps + 1):
        out += f", x{k} AS (SELECT src AS dst, sum(d * v) AS x FROM v{k - 1} GROUP BY src), v{k} AS (SELECT arc_id, src, dst, d, 0.85 * x + 0.15 / m AS v FROM v{k - 1} JOIN x{k} USING (dst), m)"
    return out + f", a AS (SELECT src AS id, sum(v) AS a FROM v{steps} GROUP BY src), b AS (SELECT dst AS id, sum(v) AS b FROM v{steps} GROUP BY dst) SELECT id, round(a + b, 9) AS value FROM a JOIN b USING (id)"


ORACLE_SQL: dict[str, str] = {
    "arc_reader": f"{SPARSE} SELECT src, dst FROM arcs",
    "node_reader": "SELECT 'n' || p_partkey AS name, p_partkey AS id FROM part",
    "node_id_reader": "SELECT p_partkey AS id FROM part",
    "page_reader_tab": "SELECT p_partkey AS id FROM part",
    "link_reader_tab": f"{SPARSE} SELECT src, dst FROM arcs",
    "value_reader": "SELECT p_partkey AS id, p_retailprice AS value FROM part",
    "incidence_reader": f"{SPARSE} SELECT src AS arc_id, dst AS node FROM arcs",
    "csv_tab_convert": f"{SPARSE} SELECT src || ',' || dst AS value FROM arcs",
    "vertices_distinct": f"{ALL} SELECT src AS id FROM arcs UNION SELECT dst FROM arcs",
    "undirect_edges": f"{ALL} SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs",
    "out_degree": f"{ALL} {_degree_sql('src')}",
    "in_degree": f"{ALL} {_degree_sql('dst')}",
    "out_degree_dist": _dist_sql("src"),
    "in_degree_dist": _dist_sql("dst"),
    "topk_in_degree_names": _topk_sql("dst"),
    "topk_out_degree_names": _topk_sql("src"),
    "topk_value_names": "SELECT p_name AS name, p_retailprice AS value FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
    "power_law_fit": f"{ALL}, {_ENDS}, dist AS (SELECT degree, count(*) / (SELECT count(*) FROM ends) AS fraction FROM ({_degree_sql('dst')}) GROUP BY degree) SELECT round(regr_slope(ln(fraction), ln(degree)), 6) AS slope, round(regr_intercept(ln(fraction), ln(degree)), 6) AS intercept, round(regr_r2(ln(fraction), ln(degree)), 6) AS r2 FROM dist",
    "sinks_anti_join": f"{SPARSE} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM arcs)",
    "sinks_cross_all": f"{SPARSE} SELECT a.id AS src, count(*) AS links FROM nodes a, nodes b WHERE a.id NOT IN (SELECT src FROM arcs) GROUP BY a.id",
    "adjacency_list": f"{ALL} SELECT src, string_agg(dst, ',' ORDER BY dst) AS targets FROM arcs GROUP BY src",
    "pagerank_5": f"{SPARSE}, {_pagerank_ctes(STEPS)} SELECT id, round(value, 9) AS value FROM r{STEPS}",
    "topk_pagerank_5": f"{SPARSE}, {_pagerank_ctes(STEPS)} SELECT id, round(value, 9) AS value FROM r{STEPS} WHERE value > 0.0001 ORDER BY r{STEPS}.value DESC, id LIMIT 10",
    "pagerank_converged": _converged_sql(),
    "wcc_labels": f"{_WCC} SELECT id, component FROM comp",
    "wcc_count": f"{_WCC} SELECT count(DISTINCT component) AS components FROM comp",
    "wcc_size_dist": f"{_WCC} SELECT component_size, count(*) AS num_components FROM (SELECT component, count(*) AS component_size FROM comp GROUP BY component) GROUP BY component_size",
    "fm_hash": f"WITH {_hash_ctes('SELECT p_partkey AS id FROM part')} SELECT id, lvl::INT AS level, x AS hash FROM h",
    "fm_sketch_init": f"WITH {_hash_ctes('SELECT p_partkey AS id FROM part')} SELECT id, string_agg(b, ',' ORDER BY lvl) AS sketch FROM sk GROUP BY id",
    "fm_estimate": f"WITH {_hash_ctes('SELECT p_partkey AS id FROM part')}, br AS (SELECT p_brand, lvl, bit_or(b) AS b FROM sk JOIN part ON p_partkey = id GROUP BY p_brand, lvl) SELECT p_brand, est AS parts FROM ({_estimate('p_brand', 'br')})",
    "closeness_4": f"{SPARSE}, {_closeness_ctes(CLOSENESS_STEPS)} SELECT id, round(value, 9) AS value FROM c",
    "topk_closeness_4": f"{SPARSE}, {_closeness_ctes(CLOSENESS_STEPS)} SELECT id, round(value, 9) AS value FROM c WHERE value > 0.3 ORDER BY c.value DESC, id LIMIT 700",
    "source_incidence": f"{_numbered()} SELECT arc_id, src AS node, 1.0::DOUBLE AS weight FROM num",
    "target_incidence": f"{_numbered()} SELECT arc_id, dst AS node, 1.0::DOUBLE AS weight FROM num",
    "linerank_norm": f"{_numbered(_NORM)} SELECT arc_id, round(d, 9) AS d FROM d",
    "sinks_cross_sums": f"{SPARSE} SELECT a.id AS src, count(*) AS links, sum(b.id)::DECIMAL(38,0)::BIGINT AS sum_dst, min(b.id) AS min_dst, max(b.id) AS max_dst FROM nodes a, nodes b WHERE a.id NOT IN (SELECT src FROM arcs) GROUP BY a.id",
    "linerank_converged": _linerank_converged_sql(),
    "linerank_5": _linerank_sql(STEPS, "0.0::DOUBLE"),
    "linerank_uniform_5": _linerank_sql(STEPS, "1.0::DOUBLE / m"),
}
#: The same SQL with and without the sparse graph's filter.
for _name in queries_over(arcs):
    ORACLE_SQL[f"{_name}_sparse"] = ORACLE_SQL[_name]
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace(_arcs_sql("WHERE l_quantity >= 45"), _arcs_sql())
ORACLE_SQL |= {
    "arc_scan": f"{ALL} SELECT src, dst FROM arcs",
    "node_scan": ORACLE_SQL["node_reader"],
    "sink_comma": f"{ALL} SELECT id || ',' || degree AS value FROM ({_degree_sql('src')})",
    "sink_blank": f"{ORACLE_SQL['wcc_size_dist'].replace('SELECT component_size, count(*) AS num_components', "SELECT component_size || ' ' || count(*) AS value")}",
    "sink_tab": f"{ALL} SELECT row_number() OVER (ORDER BY src, dst) || chr(9) || src || chr(9) || '1.0' AS value FROM arcs",
    "csv_file_convert": f"{ALL} SELECT src || ',' || dst AS value, (SELECT count(*) FROM arcs) AS lines FROM arcs",
}
