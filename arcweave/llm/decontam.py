"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows (10 words, or the whole item if it is shorter).
Corpus frequencies of the test terms are counted over all texts, which gives
every window its two rarest places. The index stores postings (text, term,
position) of the terms at those places only; those of a rarest term also hold
the words around them. A query shifts each posting by its place in the item and
intersects the lists of the rarest and the second rarest terms on (text, item,
shift): within a few words for proximity matches, of which those at the same
shift are checked word by word for phrase matches.

Texts are split into words twice: for the frequencies, and for the index, which
also holds a row a document. Only DataFrame operations are used. Texts are told
apart by two hashes, so copies share one entry of the result; nothing is
collected but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.common import ALNUM_WORD, BROADCAST_ROWS, broadcast_if_small, joined_by_key, lower_ascii, stored, table, whole_rows, words

#: Words of a window, and how many words off the second rarest term of a proximity match may stand.
LENGTH, SLACK = 10, 3
SEPARATORS = r"\x00-/:-`{-\x7f"
TEXT_KEY = ["k1", "k2"]


def terms_of(c: str = "text") -> Column:
    return words(lower_ascii(c), SEPARATORS)


def keyed(docs: DataFrame) -> DataFrame:
    """Two hashes that stand for the text, its words, and doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), terms_of("text").alias("ws"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table whose row count was checked; a plain table beyond it (its joins then shuffle, and adaptive execution splits hot keys)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Query:
    """The benchmark's side: items, the places of their terms, and how often each term stands in the corpus."""

    def __init__(self, benchmark: DataFrame, corpus: DataFrame, length: int = LENGTH) -> None:
        self.length = length
        items = benchmark.select("item_id", terms_of("text").alias("ws")).where(F.size("ws") > 0).distinct()
        self.items = items.withColumn("item", F.xxhash64("item_id", "ws"))
        places = self.items.select("item", F.posexplode("ws").alias("place", "term"))
        self.n_places = places.count()
        vocabulary = stored(places.select("term").distinct(), "vocabulary")
        self.n_terms = vocabulary.count()
        self.counts = stored(corpus.select(F.explode("ws").alias("term")).join(small(vocabulary, self.n_terms), "term").groupBy("term").agg(F.count("*").alias("n")), "term-counts")
        size = F.size("ws")
        windows = self.items.select("item", F.explode(F.sequence(F.lit(0), F.greatest(size - length, F.lit(0)))).alias("o"), F.least(size, F.lit(length)).alias("len"))
        parts = windows.select("item", "o", F.explode(F.expr("sequence(o, o + len - 1)")).alias("place")).join(places, ["item", "place"]).join(self.counts, "term")
        rarest = Window.partitionBy("item", "o").orderBy("n", "place")
        ranked = parts.withColumn("r", F.row_number().over(rarest)).withColumn("found", F.count("*").over(Window.partitionBy("item", "o")))
        size = self.items.select("item", F.least(F.size("ws"), F.lit(length)).alias("len"))
        # A window with a term that the corpus lacks can't occur. A window of one word is its own second rarest.
        ranked = ranked.join(size, "item").where((F.col("found") == F.col("len")) & (F.col("r") <= 2))
        self.places = stored(
            ranked.groupBy("item", "place", "term").agg(F.max(F.col("r") == 1).alias("first"), F.max((F.col("r") == 2) | (F.col("len") == 1)).alias("second")),
            "rare-places",
        )

    def terms(self) -> DataFrame:
        return self.places.groupBy("term").agg(F.max("first").alias("first"))


def build_index(corpus: DataFrame, query: Query) -> DataFrame:
    """Stored postings (k1, k2, term, pos) of the query's rare terms; the rarest ones' hold the words around (around, from word ``left`` on). A row a document, with the empty term, holds doc_id and n_words.

    Beyond the bound of a broadcast, postings are shuffled with the words around them, never with their texts."""
    reach = query.length - 1
    terms = query.terms().unionByName(corpus.sparkSession.createDataFrame([("", None)], "term string, first boolean"))
    left = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.when(F.col("pos") >= 0, F.slice("ws", left + 1, F.col("pos") - left + 1 + reach))
    words_of = corpus.select("doc_id", *TEXT_KEY, "ws", F.size("ws").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "ws")).alias("pos", "term")).withColumn("pos", F.col("pos") - 1)
    if query.n_terms > BROADCAST_ROWS:
        found = words_of.withColumn("around", around).drop("ws").join(terms, "term").withColumn("around", F.when("first", F.col("around")))
    else:
        found = words_of.join(F.broadcast(terms), "term").withColumn("around", F.when(F.col("first"), around))
    own = F.col("term") == ""
    return stored(found.select(F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n_words")).alias("n_words"), *TEXT_KEY, "term", "pos", left.alias("left"), "around"), "postings")


def near_postings(index: DataFrame, query: Query, slack: int = SLACK) -> DataFrame:
    """Postings of rarest terms (k1, k2, item, place, shift, pos, left, around) whose item has a second rarest term in the same text at the same shift, or at most ``slack`` words off."""
    at = lambda df, flag: df.join(small(query.places.where(flag).select("item", "place", "term"), query.n_places), "term").withColumn("shift", F.col("pos") - F.col("place"))
    first = at(index.where(F.col("around").isNotNull()).select(*TEXT_KEY, "term", "pos", "left", "around"), "first")
    second = at(index.where("term <> ''").select(*TEXT_KEY, "term", "pos"), "second").select(*TEXT_KEY, "item", "shift")
    if not slack:
        return first.join(second, [*TEXT_KEY, "item", "shift"], "left_semi")
    # Shifts at most ``slack`` apart are in the same or in neighbouring bins of slack + 1.
    binned = F.floor(F.col("shift") / (slack + 1))
    reach = second.select(*TEXT_KEY, "item", F.col("shift").alias("other"), F.explode(F.sequence(binned - 1, binned + 1)).alias("bin"))
    a, b = first.withColumn("bin", binned).alias("a"), reach.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*TEXT_KEY, "item", "bin")]
    near = a.join(b, [*same, F.abs(F.col("a.shift") - F.col("b.other")) <= slack], "left_semi").drop("bin")
    return near


def at_same_shift(near: DataFrame, index: DataFrame, query: Query) -> DataFrame:
    """Of near postings, those whose second rarest term stands just where it does in the item."""
    second = index.where("term <> ''").select(*TEXT_KEY, "term", "pos").join(small(query.places.where("second").select("item", "place", "term"), query.n_places), "term")
    return near.join(second.select(*TEXT_KEY, "item", (F.col("pos") - F.col("place")).alias("shift")), [*TEXT_KEY, "item", "shift"], "left_semi")


def phrase_matches(candidates: DataFrame, query: Query) -> DataFrame:
    """(k1, k2, item, start, len): a window of the item that stands in the text, word for word, from ``start`` on."""
    size, length = F.size("ws"), query.length
    checked = (
        candidates.join(small(query.items.select("item", "ws"), query.n_places), "item")
        .withColumn("len", F.least(size, F.lit(length)))
        .withColumn("o", F.explode(F.sequence(F.greatest(F.col("place") - F.col("len") + 1, F.lit(0)), F.least(F.col("place"), size - F.col("len")))))
        .withColumn("start", F.col("shift") + F.col("o"))
        .where(F.col("start") >= F.col("left"))
        .where(F.slice("around", (F.col("start") - F.col("left") + 1).cast("int"), F.col("len")) == F.slice("ws", F.col("o") + 1, F.col("len")))
    )
    return checked.select(*TEXT_KEY, "item", "start", "len").distinct()


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int = SLACK, length: int = LENGTH) -> DataFrame:
    """(doc_id, item_id, start): where the two rarest terms of a window stand near each other as in the item, at most ``slack`` words off, whatever stands around them. Null texts and items match nothing."""
    corpus = keyed(docs)
    query = Query(benchmark, corpus, length)
    index = build_index(corpus, query)
    near = near_postings(index, query, slack).select(*TEXT_KEY, "item", F.greatest("shift", F.lit(0)).alias("start")).distinct()
    return index.where("term = ''").select("doc_id", *TEXT_KEY).join(near, TEXT_KEY).join(query.items.select("item", "item_id"), "item").select("doc_id", "item_id", "start")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row of ``docs`` as doc_id, k1, k2, n_words, n_hit, n_items (long), items_sha256, contaminated, n_near (long: items with a proximity match).

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; equal items count once an id; items without an id count as one and are left out of the digest. Copies of a document get equal results; repeated rows stay. Of equally rare terms of a window the earlier is taken as the rarer. A very long text is as many rows as it has words of the index. Other columns of ``docs`` are ignored."""
    corpus = keyed(docs)
    query = Query(benchmark, corpus, length)
    index = build_index(corpus, query)
    near = stored(near_postings(index, query), "near-postings")
    hits = stored(phrase_matches(at_same_shift(near, index, query), query), "phrase-matches")
    n_hit = hits.select(*TEXT_KEY, F.explode(F.expr("sequence(start, start + len - 1)")).alias("pos")).distinct().groupBy(*TEXT_KEY).agg(F.count("*").alias("n_hit"))
    names = small(query.items.select("item", "item_id"), query.n_places)
    named = hits.select(*TEXT_KEY, "item").distinct().join(names, "item")
    items = named.groupBy(*TEXT_KEY).agg(F.size(F.collect_set(F.struct("item_id"))).cast("long").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_set(F.col("item_id").cast("string")))).alias("ids"))
    close = near.select(*TEXT_KEY, "item").distinct().join(names, "item").groupBy(*TEXT_KEY).agg(F.size(F.collect_set(F.struct("item_id"))).cast("long").alias("n_near"))
    rows = index.where("term = ''").select("doc_id", *TEXT_KEY, "n_words")
    copies = rows.groupBy(*TEXT_KEY).agg(F.count("*").alias("copies"))
    facts = stored(copies.join(close.join(n_hit.join(items, TEXT_KEY), TEXT_KEY, "left"), TEXT_KEY, "left"), "text-facts")
    return joined_by_key(rows, facts, TEXT_KEY, "copies", rows.count()).select(
        "doc_id",
        *TEXT_KEY,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window occurs in, with their own columns. Null and empty texts hold none and stay, as do all rows of a clean text; no rows give none."""
    corpus = keyed(docs)
    query = Query(table(spark, sf_dir, "benchmark"), corpus)
    hit = phrase_matches(near_postings(build_index(corpus, query), query, 0), query).select(*TEXT_KEY).distinct()
    hit = stored(hit, "contaminated-texts")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = whole_rows(docs).select("row", F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))
    # Contaminated texts are few: their keys are joined, and up to a counted bound no text is shuffled.
    return broadcast_if_small(rows, hit, TEXT_KEY, hit.count(), "left_anti").select("row.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop(*TEXT_KEY)


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS o FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[o:o + n - 1], ' ') AS g FROM bw),
dw AS (SELECT r, generate_subscripts(ws, 1) AS k, unnest(ws) AS word FROM d),
runs AS (SELECT r, k, n, string_agg(word, ' ') OVER (PARTITION BY r, n ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten, word, count(*) OVER (PARTITION BY r, n ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM dw, (SELECT DISTINCT n FROM win)),
cut AS (SELECT r, k, n, CASE WHEN n = 10 THEN ten ELSE array_to_string(string_split(ten, ' ')[1:n], ' ') END AS g FROM runs WHERE rest >= n),
hit AS (SELECT r, k, cut.n, item_id FROM cut JOIN win ON cut.n = win.n AND cut.g = win.g),
pos AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM hit, (SELECT unnest(range(10)) AS o) WHERE o < n GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r),
it AS (SELECT row_number() OVER () AS item, item_id, ws, least(len(ws), 10) AS len FROM (SELECT DISTINCT item_id, ws FROM b WHERE len(ws) > 0)),
wo AS (SELECT item, item_id, ws, len, unnest(range(0, greatest(len(ws) - 10, 0) + 1)) AS o FROM it),
wp AS (SELECT item, item_id, len, o, p, ws[p + 1] AS word FROM (SELECT *, unnest(range(o, o + len)) AS p FROM wo)),
tc AS (SELECT word, count(*) AS n FROM dw WHERE word IN (SELECT word FROM wp) GROUP BY word),
rk AS (SELECT wp.*, row_number() OVER (PARTITION BY item, o ORDER BY n, p) AS rare, count(*) OVER (PARTITION BY item, o) AS found FROM wp JOIN tc USING (word)),
pl AS (SELECT item, item_id, p, word, bool_or(rare = 1) AS is_first, bool_or(rare = 2 OR len = 1) AS is_second FROM rk WHERE found = len AND rare <= 2 GROUP BY ALL),
po AS (SELECT r, item, item_id, k - p AS shift, is_first, is_second FROM dw JOIN pl USING (word)),
nr AS (SELECT r, count(*) AS n_near FROM (SELECT DISTINCT x.r, x.item_id FROM po x JOIN po y ON x.r = y.r AND x.item = y.item AND abs(x.shift - y.shift) <= 3 WHERE x.is_first AND y.is_second) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r) LEFT JOIN nr USING (r)
"""
QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE_SQL = {"op10_decontamination": OP10_SQL}
