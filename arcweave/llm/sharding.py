"""Sharding along a Hilbert curve.

Several metadata dimensions (language, source, text length) are quantised to a
few bits each; a row's place on the Hilbert curve through that grid orders it,
and equal runs of the order are the shards. Rows close in all dimensions then
share files, so a filter on any of them prunes most shards.

Ranks need no single task: rows are dealt over ranges of the order (curve, text,
id), which splits a cell or a text that holds a third of all rows; a row's rank is
its place in its range after the rows of the ranges before. Only repeated rows,
equal in text and id, share a range whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.common import stored, table

SHARDS, BITS = 16, 4


def hilbert_index(dimensions: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of points whose coordinates are integer columns of ``bits`` bits (Skilling's transform, all in column expressions)."""
    n = len(dimensions)
    state = F.array(*(d.cast("int") for d in dimensions))
    xor = lambda a, b: a.bitwiseXOR(b)

    def step(q: int, i: int):  # noqa: ANN202  invert the low bits of x[0], or exchange them with x[i]'s
        p = q - 1

        def run(x: Column) -> Column:
            first, own = F.element_at(x, 1), F.element_at(x, i + 1)
            t = xor(first, own).bitwiseAND(F.lit(p))
            high = own.bitwiseAND(F.lit(q)) != 0
            new_first = F.when(high, xor(first, F.lit(p))).otherwise(xor(first, t))
            new_own = F.when(high, own).otherwise(xor(own, t))
            parts = [new_first if k == 0 else (new_own if k == i else F.element_at(x, k + 1)) for k in range(n)]
            return F.array(*parts)

        return run

    # A chain of transforms over one-element arrays binds each state once, so the expression grows linearly.
    chain = F.array(state)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            chain = F.transform(chain, step(q, i))
        q >>= 1

    def gray(x: Column) -> Column:
        parts = [F.element_at(x, 1)]
        for k in range(1, n):
            parts.append(xor(F.element_at(x, k + 1), parts[-1]))
        last, t, q = parts[-1], F.lit(0), 1 << (bits - 1)
        while q > 1:
            t = xor(t, F.when(last.bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(0))
            q >>= 1
        return F.array(*(xor(p, t) for p in parts))

    x = F.element_at(F.transform(chain, gray), 1)

    def interleave(v: Column) -> Column:
        total = F.lit(0).cast("long")
        for b in reversed(range(bits)):
            for k in range(n):
                total = total * 2 + F.shiftright(F.element_at(v, k + 1), b).bitwiseAND(F.lit(1))
        return total

    return F.element_at(F.transform(F.array(x), interleave), 1)


def quantised_text(c: str, bits: int = BITS) -> Column:
    """A string column's cell by its hash: equal strings share one; null has the first."""
    number = F.conv(F.substring(F.md5(F.col(f"`{c}`").cast("string").cast("binary")), 1, 4), 16, 10).cast("int")
    return F.coalesce(F.pmod(number, F.lit((1 << bits) - 1)) + 1, F.lit(0)).cast("int")


def quantised_size(c: Column, bits: int = BITS) -> Column:
    """A count's cell on a logarithmic scale: its binary digits."""
    return F.least(F.length(F.bin(c.cast("long"))), F.lit((1 << bits) - 1)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Every row of ``docs`` as doc_id, size, text_crc32, shard, slot, curve: shards hold equal numbers of rows, to within one, as runs of the curve's order.

    Within a cell equal texts stand together (by md5), then rows are ordered by id, null ids first; rows that are equal in all of that have equal results but for the slot, of which each gets one. Null texts have no bytes and the crc32 of none (0); null metadata have cells of their own; very long texts are only hashed; no rows give no shards. Other columns are ignored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    curve = hilbert_index([quantised_text("lang", bits), quantised_text("source", bits), quantised_size(F.octet_length(text), bits)], bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), curve.alias("curve"), F.substring(F.md5(text), 1, 16).alias("text_key"))
    order = ["curve", "text_key", "doc_id"]
    # Stored first, so that finding the ranges' bounds doesn't read the texts again.
    ordered = stored(rows, "curve").repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    placed = stored(ordered.select("doc_id", "size", "text_crc32", "curve", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "curve-order")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row a range.
    before = counts.select("part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"), F.sum("n").over(every).alias("total"))
    ranked = placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("nth"))
    # Rank r is in shard floor(r * shards / total), which starts at ceil(shard * total / shards); exact in integers.
    at = F.expr(f"(rank * {shards}) div total")
    start = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return ranked.withColumn("shard", at.cast("int")).withColumn("slot", F.col("rank") - start).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "curve")


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _curve_sql(n: int, source: str, bits: int = BITS) -> tuple[str, str]:
    """CTEs that carry x0 .. x(n-1) of ``source`` through the curve's steps, and the last one's name; its column ``curve`` is the place."""
    ctes, name, step = [], source, 0
    for b in reversed(range(1, bits)):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            low = f"xor(x0, x{i}) & {p}"
            first = f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE {'x0' if i == 0 else f'xor(x0, {low})'} END AS x0"
            own = [] if i == 0 else [f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {low}) END AS x{i}"]
            ctes.append(f"c{step} AS (SELECT * REPLACE ({', '.join([first, *own])}) FROM {name})")
            name, step = f"c{step}", step + 1
    for i in range(1, n):
        ctes.append(f"c{step} AS (SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM {name})")
        name, step = f"c{step}", step + 1
    flip = "0"
    for b in reversed(range(1, bits)):
        flip = f"xor({flip}, CASE WHEN x{n - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    ctes.append(f"c{step} AS (SELECT * REPLACE ({', '.join(f'xor(x{i}, {flip}) AS x{i}' for i in range(n))}) FROM {name})")
    place = " + ".join(f"((x{k} >> {b}) & 1) * {1 << (b * n + n - 1 - k)}" for b in reversed(range(bits)) for k in range(n))
    ctes.append(f"placed AS (SELECT *, ({place})::BIGINT AS curve FROM c{step})")
    return ",\n".join(ctes), "placed"


def _sql() -> str:
    cell = lambda c: f"coalesce(('0x' || substr(md5({c}), 1, 4))::INT % {(1 << BITS) - 1} + 1, 0)"
    curve, placed = _curve_sql(3, "m")
    table = ",\n".join(f"k{k + 1} AS (SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN {0xEDB88320} ELSE 0 END) AS c FROM k{k})" for k in range(8))
    return f"""
WITH k0 AS (SELECT range AS b, range::BIGINT AS c FROM range(256)),
{table},
crc AS (SELECT list(c ORDER BY b) AS t FROM k8),
d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS x FROM documents),
bytes AS (SELECT r, octet_length(encode(x)) AS n, hex(encode(x)) AS hx FROM d),
sums AS (SELECT r, xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, list_transform(range(n), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), {0xFFFFFFFF}) AS text_crc32 FROM bytes, crc),
m AS (SELECT r, doc_id, n, substr(md5(x), 1, 16) AS text_key, {cell('lang')} AS x0, {cell('source')} AS x1, least(length(CASE WHEN n = 0 THEN '0' ELSE ltrim(bin(n), '0') END), {(1 << BITS) - 1})::INT AS x2 FROM d JOIN bytes USING (r)),
{curve},
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, text_key, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER () AS total FROM {placed}),
dealt AS (SELECT *, rank * {SHARDS} // total AS shard FROM ranked)
SELECT doc_id, (n + 1)::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (rank - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, curve
FROM dealt JOIN sums USING (r)
"""


QUERIES = {"op5_hilbert_sharding": op5_hilbert_sharding}
ORACLE_SQL = {"op5_hilbert_sharding": _sql()}
