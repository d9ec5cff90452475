"""Quality rules as a bitmask ledger.

Every rule is evaluated once a text; the ledger keeps one bit a failed rule and
the measurements behind them. A policy is a versioned mask of rules: applying
one, or asking what would change without a rule, reads the ledger only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.common import SPACED_WORD, columns_without, small_batches, stored, table, whole_rows

SYMBOLS = "#*$%&|<>"
#: Rules by bit, over the measurements; a measurement is a count, so each rule is exact integer arithmetic.
RULES = {
    "few_words": lambda m: m("n_words") < 10,
    "repeated_windows": lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"),
    "symbols": lambda m: 100 * m("n_symbols") > 5 * m("word_chars"),
    "shouting": lambda m: 100 * m("n_upper") > 50 * m("n_letters"),
    "exclamations": lambda m: 100 * m("n_exclaims") > 30 * m("n_words"),
    "duplicate_lines": lambda m: (m("n_dup_lines") >= 3) & (2 * m("n_dup_lines") > m("n_lines")),
    "stutter": lambda m: 100 * m("n_stutters") > 30 * m("n_words"),
    "few_letters": lambda m: 100 * m("n_letters") < 30 * m("word_chars"),
    "word_length": lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 25 * m("n_words")),
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Versioned policies. A version never changes once used; a new one is added instead.
POLICIES = {"base-1": BASE, "strict-1": sum(BITS.values())}
POLICY = "strict-1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_exclaims", "n_stutters")

_word = re.compile(SPACED_WORD)
_no_letters = re.compile(r"[^A-Za-z]+")


def repeat_words(words: list[str], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found at least twice."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = end = 0
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered += k + width - max(k, end)
            end = k + width
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text; null counts as empty."""
    text = text or ""
    words = _word.findall(text)
    lines, n_lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if _word.search(line):
            n_lines += 1
            dup += line in lines
            lines.add(line)
    letters = _no_letters.sub("", text) if text.isascii() else "".join(filter(str.isalpha, text))  # category L
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if letters.isascii() else sum(map(str.isupper, letters))
    stutters = sum(map(str.__eq__, words, words[1:]))
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), n_lines, len(letters), upper, text.count("!"), stutters)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus MEASURES (long) and fail_bits (long). Every row stays, repeated ones with equal measures; null and empty texts measure 0 and fail few_words. A text is held as a whole, with its words and windows, one text at a time. Columns that are named like the new ones, in any case, are replaced."""
    import pyarrow as pa

    kept = columns_without(docs, text, "fail_bits", *MEASURES)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*map(measure, batch.column(batch.num_columns - 1).to_pylist()), strict=True) if batch.num_rows else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(c, pa.int64()) for c in columns], names=[*kept, *MEASURES])

    left = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = left.withColumns({m: F.lit(0).cast("long") for m in MEASURES}).schema
    measured = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)
    bits = reduce(Column.__add__, [F.when(rule(F.col), F.lit(BITS[name])).otherwise(0) for name, rule in RULES.items()])
    return measured.withColumn("fail_bits", bits.cast("long"))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    """Whether a ledger row fails none of the policy's rules."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def only_rule(policy: str, bits: str = "fail_bits") -> Column:
    """The name of the rule without which the policy would keep a rejected row; null if none or more than one rejects it."""
    failed = F.col(bits).bitwiseAND(F.lit(POLICIES[policy]))
    return F.coalesce(*(F.when(failed == bit, name) for name, bit in BITS.items()))


def ablations(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """A row a rule of the policy: rule, failed (rows that fail it), only (rows that no other rule of the policy rejects), kept_without (rows kept if it were dropped).

    Rows are first counted by bitmask, of which there are 2**rules at most."""
    mask = POLICIES[policy]
    by_mask = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    one = [F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BITS.items() if bit & mask]
    each = by_mask.select("bits", "n", F.explode(F.array(*one)).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(total(hit)("failed"), total(F.col("bits") == F.col("bit"))("only"), total((F.col("bits") == F.col("bit")) | (F.col("bits") == 0))("kept_without"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps, with their own columns. Null and empty texts fail few_words; repeated rows share their fate; no rows give none."""
    return ledger(whole_rows(docs)).where(passes(POLICY)).select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "quality-ledger")
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes(POLICY).alias("kept"), "fail_bits", only_rule(POLICY).alias("only_rule"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, generate_subscripts(ws, 1) AS k, unnest(ws) AS word FROM w),
five AS (SELECT r, k, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY k)),
win AS (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS seen FROM five WHERE g IS NOT NULL),
rep AS (SELECT r, count(DISTINCT k + o) AS n_repeat_words FROM win, (SELECT unnest(range(5)) AS o) WHERE seen > 1 GROUP BY r),
st AS (SELECT r, count(*) FILTER (word = prev) AS n_stutters FROM (SELECT r, word, lag(word) OVER (PARTITION BY r ORDER BY k) AS prev FROM p) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims, coalesce(n_stutters, 0) AS n_stutters
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN st USING (r) LEFT JOIN ln USING (r)),
b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 5 * word_chars)::BIGINT
    + 8 * (100 * n_upper > 50 * n_letters)::BIGINT + 16 * (100 * n_exclaims > 30 * n_words)::BIGINT + 32 * (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)::BIGINT
    + 64 * (100 * n_stutters > 30 * n_words)::BIGINT + 128 * (100 * n_letters < 30 * word_chars)::BIGINT
    + 256 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits,
  CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'shouting' WHEN 16 THEN 'exclamations' WHEN 32 THEN 'duplicate_lines'
    WHEN 64 THEN 'stutter' WHEN 128 THEN 'few_letters' WHEN 256 THEN 'word_length' END AS only_rule FROM b
"""
QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": OP7_SQL}
