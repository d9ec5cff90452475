"""URL filters by the ratio of two character language models.

Host and path rules decide the URLs that they fit. Those are also the examples
of accepted and rejected URLs from which two smoothed variable-order Markov
models are counted; every other URL is judged by the mean log-likelihood ratio
of its characters, against a threshold calibrated on rule-decided URLs that the
counts leave out.

Counts cover all rule-decided URLs. A sequence is kept as a state of the models
if it was seen ``LEAST`` times, whatever the input's size, so the models grow
with the input: their tables are stored and joined without hints. URLs are
scored by their distinct sequences, each looked up once. Only DataFrame
operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.common import columns_without, joined_by_key, lower_ascii, stored, table

#: (verdict, host and path); a rule fits its host and all subdomains, if the path starts with the rule's. The longest that fits decides.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Occurrences that make a state of the models, longest context, weight of the shorter context, symbols assumed, first digits of the md5 of labelled URLs that calibrate, bins of a unit of score.
LEAST, ORDER, WEIGHT, ALPHABET, HELD_OUT, BINS = 2, 4, 2.0, 256, "0123", 1000


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        own, _, tail = r.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def sequences(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each place i of ``u`` with g0..gORDER: the character there, led by 0 to ORDER others (null where the URL starts later)."""
    places = urls.select("u", *keep, F.explode(F.sequence(F.lit(1), F.length("u"))).alias("i"))
    return places.select(*keep, *(F.when(F.col("i") > k, F.expr(f"substring(u, i - {k}, {k + 1})")).alias(f"g{k}") for k in range(ORDER + 1)))


def train(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """Stored (g, llr): log ratio of a sequence's last character given the others, accepted over rejected, from (u, allow) rows."""
    grams = sequences(labelled, "allow").select("allow", F.explode(F.array(*(F.col(f"g{k}") for k in range(order + 1)))).alias("g")).where("g IS NOT NULL")
    counts = grams.groupBy("g").agg(F.sum("allow").alias("a"), F.sum(1 - F.col("allow")).alias("b"))
    total = labelled.agg(F.sum(F.length("u") * F.col("allow")).alias("ta"), F.sum(F.length("u") * (1 - F.col("allow"))).alias("tb")).select(F.coalesce("ta", F.lit(0)).alias("ta"), F.coalesce("tb", F.lit(0)).alias("tb"))
    kept = stored(counts.where(F.col("a") + F.col("b") >= LEAST), "url-states")
    first = kept.where(F.length("g") == 1).crossJoin(F.broadcast(total))  # one row
    level = stored(first.select("g", *(((F.col(n) + WEIGHT / ALPHABET) / (F.col(f"t{n}") + WEIGHT)).alias(f"p{n}") for n in "ab")), "url-level-0")
    every = level
    for k in range(1, order + 1):
        context = kept.where(F.length("g") == k).select(F.col("g").alias("context"), F.col("a").alias("ca"), F.col("b").alias("cb"))
        shorter = level.select(F.col("g").alias("shorter"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        own = kept.where(F.length("g") == k + 1).select("g", "a", "b", F.substring("g", 1, k).alias("context"), F.substring("g", 2, k).alias("shorter"))
        own = own.join(context, "context").join(shorter, "shorter")  # a row of either meets as many others as there are characters
        level = stored(own.select("g", *(((F.col(n) + WEIGHT * F.col(f"q{n}")) / (F.col(f"c{n}") + WEIGHT)).alias(f"p{n}") for n in "ab")), f"url-level-{k}")
        every = every.unionByName(level)
    return stored(every.select("g", (F.log("pa") - F.log("pb")).alias("llr")), "url-model")


def scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(u, score): mean log ratio over the characters of each distinct URL, each by its longest kept sequence.

    Characters carry a number for their URL and what stands before them; their distinct sequences are looked up in the model, then joined back."""
    numbered = stored(urls.select("u").distinct().withColumn("number", F.monotonically_increasing_id()), "url-numbers")
    places = sequences(numbered, "number").select("number", F.coalesce(*(F.col(f"g{k}") for k in reversed(range(ORDER + 1)))).alias("g"))
    found, ratio = places.groupBy("g").agg(F.count("*").alias("n")), F.lit(0.0)
    for k in range(ORDER + 1):
        states = model.where(F.length("g") == k + 1).select(F.col("g").alias(f"g{k}"), F.col("llr").alias(f"r{k}"))
        ending = F.when(F.length("g") > k, F.expr(f"right(g, {k + 1})"))
        found = found.withColumn(f"g{k}", ending).join(states, f"g{k}", "left")
        ratio = F.coalesce(f"r{k}", ratio)
    found = stored(found.select("g", "n", ratio.alias("ratio")), "url-sequences")
    total = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    means = joined_by_key(places, found, ["g"], "n", total).groupBy("number").agg(F.round(F.avg("ratio"), 9).alias("score"))
    return numbered.join(means, "number").select("u", "score")


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best mean of the shares of accepted URLs at or above and rejected URLs below it, from (score, allow) rows; of equal ones the nearest to 0. 0 if either kind is missing.

    Scores are mean log ratios, so bins are few whatever the number of rows."""
    rows = scored.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.sum("allow").alias("a"), F.sum(1 - F.col("allow")).alias("b")).where("bin IS NOT NULL").collect()
    total_a, total_b = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not total_a or not total_b:
        return 0.0
    best, below_a, below_b, last = [], 0, 0, None
    for r in sorted(rows, key=lambda r: r["bin"]):
        cut = r["bin"] if last is None else (last + 1 + r["bin"]) / 2  # halfway between neighbouring scores
        best.append((below_a * total_b - below_b * total_a, abs(cut), cut))
        below_a, below_b, last = below_a + r["a"], below_b + r["b"], r["bin"]
    return min(best)[2] / BINS


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """``pages`` (all columns) with host, path, rule, verdict and score appended; every row stays.

    A null or empty URL fits no rule and has nothing to judge: it is blocked, with a null score. Without rule-decided URLs of both kinds, what no rule fits is allowed at score 0. Rows of one URL get one verdict; a score at the threshold is allowed. A very long URL is as many sequences as it has characters, dealt over tasks. Columns that are named like the new ones, in any case, are replaced."""
    host, path = host_and_path()
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules or RULES)
    own = [F.col(f"`{c}`") for c in columns_without(pages, "host", "path", "rule", "verdict", "score")]
    u = lower_ascii(F.col("url").cast("string"))
    ruled = pages.select(F.struct(*own).alias("page"), u.alias("u"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("decided", verdict)
    urls = ruled.select("u", "decided").where(F.length("u") > 0)
    labelled = urls.where("decided IS NOT NULL").select("u", (F.col("decided") == "allow").cast("long").alias("allow"))
    held_out = F.substring(F.md5(F.col("u").cast("binary")), 1, 1).isin(*HELD_OUT)
    model = train(labelled.where(~held_out))
    checked = labelled.where(held_out).groupBy("u").agg(F.max("allow").alias("allow"))
    scored = stored(scores(urls.where(F.col("decided").isNull() | held_out).select("u"), model), "url-scores")
    threshold = calibrate(scored.join(checked, "u"))
    asked = F.col("decided").isNull() & (F.coalesce(F.length("u"), F.lit(0)) > 0)
    joined = ruled.where(asked).join(scored, "u", "left").unionByName(ruled.where(~asked).withColumn("score", F.lit(None).cast("double")))
    judged = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return joined.select("page.*", "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url", "score")


def _sql() -> str:
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    fits = lambda own, tail: f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{tail}')"
    longest = sorted(RULES, key=lambda x: -len(x[1]))
    rule = " ".join(f"WHEN {fits(*r.split('/', 1))} THEN '{r}'" for _, r in longest)
    allowed = ", ".join(f"'{r}'" for v, r in RULES if v == "allow")
    digits = ", ".join(f"'{c}'" for c in HELD_OUT)
    levels = f"p0 AS (SELECT g, (a + {WEIGHT} / {ALPHABET}) / (ta + {WEIGHT}) AS pa, (b + {WEIGHT} / {ALPHABET}) / (tb + {WEIGHT}) AS pb FROM kept WHERE length(g) = 1)"
    for k in range(1, ORDER + 1):
        levels += f""",
p{k} AS (SELECT x.g, (x.a + {WEIGHT} * s.pa) / (c.a + {WEIGHT}) AS pa, (x.b + {WEIGHT} * s.pb) / (c.b + {WEIGHT}) AS pb
  FROM kept x JOIN kept c ON c.g = substr(x.g, 1, {k}) JOIN p{k - 1} s ON s.g = substr(x.g, 2) WHERE length(x.g) = {k + 1})"""
    model = " UNION ALL ".join(f"SELECT g, ln(pa) - ln(pb) AS llr FROM p{k}" for k in range(ORDER + 1))
    joins = " ".join(f"LEFT JOIN m m{k} ON i > {k} AND m{k}.g = substr(u, i - {k}, {k + 1})" for k in range(ORDER + 1))
    best = ", ".join(f"m{k}.llr" for k in reversed(range(ORDER + 1)))
    return f"""
WITH p AS (SELECT page_id, translate(url, {lower}) AS u, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*', 0), {lower}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
d AS (SELECT *, CASE {rule} END AS rule FROM h),
l AS (SELECT u, (rule IN ({allowed}))::BIGINT AS allow, substr(md5(u), 1, 1) IN ({digits}) AS held FROM d WHERE rule IS NOT NULL AND length(u) > 0),
t AS (SELECT u, allow FROM l WHERE NOT held),
ti AS (SELECT u, allow, unnest(range(1, length(u) + 1)) AS i FROM t),
grams AS (SELECT allow, substr(u, i - k, k + 1) AS g FROM ti, (SELECT unnest(range({ORDER + 1})) AS k) WHERE i > k),
tot AS (SELECT coalesce(sum(length(u) * allow), 0) AS ta, coalesce(sum(length(u) * (1 - allow)), 0) AS tb FROM t),
kept AS (SELECT g, a, b, ta, tb FROM (SELECT g, sum(allow) AS a, sum(1 - allow) AS b FROM grams GROUP BY g), tot WHERE a + b >= {LEAST}),
{levels},
m AS ({model}),
us AS (SELECT DISTINCT u FROM d WHERE rule IS NULL AND length(u) > 0 UNION SELECT u FROM l WHERE held),
ui AS (SELECT u, unnest(range(1, length(u) + 1)) AS i FROM us),
sc AS (SELECT u, round(avg(coalesce({best}, 0.0)), 9) AS score FROM ui {joins} GROUP BY u),
bins AS (SELECT floor(score * {BINS}) AS bin, sum(allow) AS a, sum(1 - allow) AS b FROM (SELECT u, max(allow) AS allow FROM l WHERE held GROUP BY u) JOIN sc USING (u) GROUP BY ALL),
cuts AS (SELECT coalesce((lag(bin) OVER o + 1 + bin) / 2, bin) AS cut, coalesce(sum(a) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_a,
  coalesce(sum(b) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_b, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b FROM bins WINDOW o AS (ORDER BY bin)),
cut AS (SELECT coalesce((SELECT cut / {BINS} FROM cuts WHERE all_a > 0 AND all_b > 0 ORDER BY below_a * all_b - below_b * all_a, abs(cut), cut LIMIT 1), 0.0) AS t)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({allowed}) THEN 'allow' WHEN rule IS NULL AND score >= t THEN 'allow' ELSE 'block' END AS verdict FROM d LEFT JOIN sc ON d.u = sc.u AND rule IS NULL, cut
"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE_SQL = {"op1_url_filter": _sql()}
