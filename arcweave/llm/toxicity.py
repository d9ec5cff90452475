"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, word pairs, pairs that skip one word,
and (as a back-off for rare words) word beginnings, all hashed to ``2**BITS``
coordinates. Training reads a bounded sample of labelled rows in a fixed order;
per-coordinate learning rates and the L1 term leave few weights, which are sent
to the workers as two short arrays. Scoring runs over every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.common import columns_without, doc_fold, small_batches, stored, table

BITS = 20
#: Labelled rows to train on at most, and passes over them.
SAMPLE, EPOCHS = 12_000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 1.0
HELD_OUT, THRESHOLD = 2, 0.3
#: Words that a worker remembers.
MEMO = 400_000
STEMS = (4, 5, 6)

_word = re.compile(r"\w+")
_mask = np.uint64((1 << BITS) - 1)
_mult = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _hash(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings (the word itself where it is shorter)."""
    data = word.encode("utf-8", "surrogatepass")
    return (crc32(data) | crc32(data, 0x5BD1E995) << 32, *(crc32(word[:k].encode("utf-8", "surrogatepass"), k) << 8 | k for k in STEMS))


class Features:
    """Hashes each new word once; a word is then a row of ``table``."""

    def __init__(self, memo: int = MEMO) -> None:
        self.memo, self.known, self.table = memo, {}, np.zeros((1024, 1 + len(STEMS)), dtype=np.uint64)

    def learn(self, words: set[str]) -> None:
        new = {w for w in words if w not in self.known}
        if not new:
            return
        if len(self.known) + len(new) > self.memo:
            self.known.clear()
            new = words
        at = len(self.known)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(new)] = _mixed(np.array([_hash(w) for w in new], dtype=np.uint64))
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def of(self, text: str | None) -> np.ndarray:
        """Coordinates of the features of a text, some more than once; empty for a text without words."""
        words = _word.findall((text or "").lower())
        if not words:
            return np.zeros(0, dtype=np.int64)
        self.learn(set(words))
        rows = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        w = self.table[rows, 0]
        single = self.table[np.unique(rows)].ravel()
        pair = _mixed(w[:-1] * _mult[0] + w[1:] * _mult[1])
        skip = _mixed(w[:-2] * _mult[2] + w[2:] * _mult[0] + np.uint64(7))
        return (np.concatenate([single, pair, skip]) >> np.uint64(40) & _mask).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ x >> np.uint64(29)) * _mult[1]


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (distinct coordinates, label) rows: coordinates and values of the weights that L1 left, and the bias."""
    size = 1 << BITS
    z, n, bias_z, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0
    order = np.random.default_rng(7)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    def bias() -> float:
        return -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, y = rows[k]
            w = weights(i)
            b = bias()
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += g * g
    w = weights(np.arange(size))
    at = np.flatnonzero(w)
    return at, w[at].astype(np.float32), float(bias())


def sampled(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(rank, doc_id, toxic) of ``most`` labels (doc_id, toxic 0/1) at most, the first by a hash of the id. Labels below a bound on the hash are sorted, about twice as many as are kept."""
    n = max(1, labels.count())
    rank, range_ = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), 1 << 31
    near = labels.select(rank.alias("rank"), "doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("rank") < int(min(1.0, (2 * most + 64) / n) * range_))
    return near.orderBy("rank", "doc_id", "toxic").limit(most)


def sample_features(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(rank, doc_id, coordinates, label) of the rows of ``docs`` (doc_id, text) with a sampled label; long texts in whole. ``most`` narrow rows are broadcast, so no text is shuffled."""
    import pyarrow as pa

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(sampled(labels, most)), "doc_id").select("rank", "doc_id", "text", "toxic")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            rows = [np.unique(features.of(t)).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), b.column("toxic")], names=["rank", "doc_id", "at", "toxic"])

    return picked.mapInArrow(run, "rank long, doc_id long, at array<int>, toxic int")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from texts (doc_id, text) and labels (doc_id, toxic 0/1). Null ids and labels are left out; an id of several labels has the largest; rows of one id are all learned. Without any row, every score is 0.5.

    Training is sequential, so one task does it, which holds the distinct coordinates of the sampled rows; only the sparse weights come to the driver."""
    import pyarrow as pa

    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = sample_features(docs, known, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            got += zip(b.column("rank").to_pylist(), b.column("doc_id").to_pylist(), (np.asarray(x.values) for x in b.column("at")), b.column("toxic").to_pylist(), strict=True)
        got.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0, len(r[2]), r[3]))
        at, w, b = train([(r[2].astype(np.int64), r[3]) for r in got])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w, b).astype(float), pa.float64())], names=["at", "w"])

    model = stored(rows, "toxic-sample").coalesce(1).mapInArrow(run, "at long, w double").toPandas()  # 2**BITS weights at most
    real = model["at"] >= 0
    bias = model.loc[~real, "w"]
    return model.loc[real, "at"].to_numpy(), model.loc[real, "w"].to_numpy(dtype=np.float32), float(bias.iloc[0]) if len(bias) else 0.0


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` without the text, plus score (double, 0 to 1). Every row stays, repeated ones with equal scores; a null text scores like an empty one, which has the bias alone. A text's distinct coordinates bound the memory of a very long one. A column named score, in any case, is replaced."""
    import pyarrow as pa

    at, values, bias = model
    kept = columns_without(docs, text, "score")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[at] = values
        features = Features()
        for b in batches:
            scores = []
            for t in b.column(b.num_columns - 1).to_pylist():
                i = features.of(t)
                i = np.unique(i[w[i] != 0])
                scores.append(1 / (1 + np.exp(-np.clip(float(w[i].sum(dtype=np.float64)) + bias, -35, 35))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, "score"])

    left = docs.select(*(F.col(f"`{c}`") for c in kept))
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string")).mapInArrow(run, left.withColumn("score", F.lit(0.0)).schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(doc_fold() != HELD_OUT)
    scored = score_texts(docs, fit(docs, labels))
    return scored.select("doc_id", (doc_fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
