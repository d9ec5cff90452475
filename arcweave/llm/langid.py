"""Language identification by a byte convolutional network.

A text's lower-cased UTF-8 bytes are cut into fixed-length windows that overlap
by the widest filter, so every byte sequence a filter can see is seen. Filters
of several widths slide over each window, their largest responses (max pooling)
feed a softmax, and a text's prediction is the mean of its windows' outputs,
weighted by their bytes. The network is trained in numpy on all windows of a
bounded sample of labelled rows, shared out evenly among the languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.common import columns_without, doc_fold, small_batches, table, whole_rows

#: Bytes of a window, filter widths, filters of each width, and the symbol that pads.
WINDOW, WIDTHS, FILTERS, PAD = 256, (2, 3, 4, 5), 16, 256
#: Labelled rows to train on at most, passes, windows a step, step size at the start (it falls to nothing along a line).
SAMPLE, EPOCHS, STEP, RATE = 4_000, 6, 64, 0.02
HELD_OUT, UNKNOWN = 2, "und"
#: The pipeline keeps a document if its language is known with at least this probability.
KEEP_SCORE = 0.5


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def windows_of(data: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of symbols) of all texts, which text each belongs to, and its bytes. Every text has one at least."""
    step = length - max(WIDTHS) + 1
    sizes = np.array([len(x) for x in data], dtype=np.int64)
    pieces = np.maximum(1, -(-(sizes - (length - step)) // step))
    room = (pieces - 1) * step + length
    at = np.concatenate([[0], np.cumsum(room)[:-1]])
    flat = np.full(int(room.sum()), PAD, dtype=np.int16)
    for x, k in zip(data, at, strict=True):
        flat[k : k + len(x)] = np.frombuffer(x, dtype=np.uint8)
    owner = np.repeat(np.arange(len(data)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = at[owner] + nth * step
    return flat[starts[:, None] + np.arange(length)], owner, np.minimum(length, sizes[owner] - nth * step).clip(0)


def window_blocks(data: list[bytes], most: int = 128, length: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of all texts as ``windows_of`` gives them, ``most`` at a time: a very long text is cut at the starts of windows, short ones share a block."""
    step, group, first, held = length - max(WIDTHS) + 1, [], 0, 0
    for k, x in enumerate(data):
        pieces = max(1, -(-(len(x) - (length - step)) // step))
        if group and held + pieces > most:
            w, owner, size = windows_of(group, length)
            yield w, owner + first, size
            group, held = [], 0
        if pieces > most:
            for i in range(0, pieces, most):
                w, owner, size = windows_of([x[i * step : (i + most - 1) * step + length]], length)
                yield w, owner + k, size
            continue
        if not group:
            first = k
        group.append(x)
        held += pieces
    if group:
        w, owner, size = windows_of(group, length)
        yield w, owner + first, size


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # width x 257 x FILTERS: response of each place to each byte
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled responses of every window, and where each maximum is."""
        pooled, places = [], []
        for f in self.filters:
            n = x.shape[1] - len(f) + 1
            total = f[0][x[:, :n]]
            for j in range(1, len(f)):
                total += f[j][x[:, j : j + n]]
            where = total.argmax(axis=1)
            places.append(where)
            pooled.append(np.take_along_axis(total, where[:, None], axis=1)[:, 0])
        return np.concatenate(pooled, axis=1), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax outputs of each window of a block."""
        pooled = []
        for f in self.filters:
            n = x.shape[1] - len(f) + 1
            total = f[0][x[:, :n]]
            for j in range(1, len(f)):
                total += f[j][x[:, j : j + n]]
            pooled.append(total.max(axis=1))
        return softmax(np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.out_bias)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text; UNKNOWN and 0 for null and for texts without a letter."""
        known = [k for k, t in enumerate(texts) if t and self.languages and has_letter(t)]
        found = [(UNKNOWN, 0.0)] * len(texts)
        part = 64
        for b in range(0, len(known), part):
            ks = known[b : b + part]
            total = np.zeros((len(ks), len(self.languages)))
            for x, owner, size in window_blocks([texts[k].lower().encode("utf-8", "replace") for k in ks]):
                np.add.at(total, owner, self.probabilities(x) * np.maximum(size, 1)[:, None])
            total /= total.sum(axis=1, keepdims=True)
            for k, row in zip(ks, total, strict=True):
                found[k] = (self.languages[int(row.argmax())], min(1.0, float(row.max())))
        return found


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Network:
    """A network from all windows of (text, language) rows. Each row also gives a short window from some place, so that short texts are known too."""
    languages, random = sorted({y for _, y in rows}), np.random.default_rng(11)
    net = Network(
        languages,
        [random.normal(0, 0.1, (w, PAD + 1, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), dtype=np.float32),
        random.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(languages)))).astype(np.float32),
        np.zeros(max(1, len(languages)), dtype=np.float32),
    )
    data, labels = [], []
    for text, y in rows:
        b = text.lower().encode("utf-8", "replace")
        short = int(random.integers(4, 64))
        at = int(random.integers(0, max(1, len(b) - short + 1)))
        for x in (b, b[at : at + short]):
            data.append(x)
            labels.append(languages.index(y))
    if not data:
        return net
    x_all, owner, _ = windows_of(data)
    y_all = np.array(labels)[owner]
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (*net.filters, net.bias, net.out, net.out_bias)]
    t, steps = 0, epochs * -(-len(y_all) // STEP)
    for _ in range(epochs):
        order = random.permutation(len(y_all))
        for k in range(0, len(order), STEP):
            at = order[k : k + STEP]
            x, y = x_all[at], y_all[at]
            pooled, places = net.responses(x)
            hidden = np.maximum(pooled + net.bias, 0)
            d = softmax(hidden @ net.out + net.out_bias)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            back = (d @ net.out.T) * (hidden > 0)
            grads = []
            for n, (f, where) in enumerate(zip(net.filters, places, strict=True)):
                g, own = np.zeros_like(f), back[:, n * FILTERS : (n + 1) * FILTERS]
                for j in range(len(f)):
                    np.add.at(g[j], (np.take_along_axis(x, where + j, axis=1), np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]
            rate = RATE * (1 - t / steps)
            t += 1
            for a, g, (m, v) in zip((*net.filters, net.bias, net.out, net.out_bias), grads, state, strict=True):  # Adam
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each language: as even as their counts allow, ``most`` in all, but one each at least."""
    out, left = {}, most
    for k, (y, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[y] = min(n, max(1, left // (len(counts) - k)))
        left -= out[y]
    return out


def sampled(labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(h, doc_id, text, lang) of ``most`` distinct rows at most, whole texts, of each language those first by a hash of id and text.

    A hash below a language's bound leaves about twice its rows, so that few are sorted and no language is sorted as a whole."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bounds = [(y, n, min(1.0, (2 * n + 64) / counts[y])) for y, n in shares(counts, most).items()]
    quota = labelled.sparkSession.createDataFrame(bounds, "lang string, most int, bound double")  # a row a language
    rows = labelled.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text", "lang").join(F.broadcast(quota), "lang")
    near = rows.where(F.pmod("h", F.lit(1 << 31)) < F.col("bound") * (1 << 31)).dropDuplicates(["h", "lang"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 31)), "h"))
    return near.withColumn("nth", nth).where(F.col("nth") <= F.col("most")).select("h", "doc_id", "text", "lang")


def fit(labelled: DataFrame, most: int = SAMPLE) -> Network:
    """A network from (doc_id, text, lang) rows without nulls: the whole texts of ``most`` rows at most."""
    rows = sampled(labelled, most).orderBy("h", "lang").select("text", "lang")
    return train([(r["text"], r["lang"]) for r in rows.collect()])  # bounded by ``most``


def predict(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred (string) and score (double, 0 to 1) appended. Every row stays, repeated ones with equal results; UNKNOWN and 0 for null texts, texts without a letter, and without any training row; of equally likely languages the first by name. Very long texts pass a block of windows at a time. Columns that are named like the new ones, in any case, are replaced."""
    import pyarrow as pa

    kept = columns_without(docs, "lang_pred", "score")
    at = kept.index(text)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = net.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    left = docs.select(*(F.col(f"`{c}`") for c in kept))
    return left.mapInArrow(run, left.withColumn("lang_pred", F.lit(None).cast("string")).withColumn("score", F.lit(0.0)).schema)


def labelled_rows(docs: DataFrame) -> DataFrame:
    return docs.where((doc_fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with their own columns; those without a letter (null and empty texts too) or with no language of at least KEEP_SCORE go. Repeated rows share their fate. Without any labelled row no language is known, so all go."""
    known = predict(whole_rows(docs), fit(labelled_rows(docs))).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= KEEP_SCORE))
    return known.select("row.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(labelled_rows(docs)))
    return found.select("doc_id", (doc_fold() == HELD_OUT).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL: dict[str, str] = {}
