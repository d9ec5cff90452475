"""Packing token sequences into windows by non-negative least squares.

1. Every text is encoded (see ``Ids``) and the end id appended. Full windows are cut off; what remains has a length below
   the window. Only lengths, ranks and checksums are stored, never the ids.
2. The histogram of the remaining lengths has fewer bins than the window has
   tokens, whatever the corpus' size. On it the driver enumerates shallow
   combinations of lengths that fill a window exactly and solves the non-negative
   least-squares problem  A x ~ counts  for their repeats, rounds them, and solves
   again for what is left, with fresh combinations.
3. Residuals are packed greedily, the longest first, with lengths that fill its
   window exactly, all documents of such a fill at once. Documents that nothing fills a window with are few; only they
   are cut, into powers of two, which laid out in falling order leave no gap.
4. The plan maps (length, rank within the length) to (sequence, offset) by
   arithmetic; it is bounded by the window, so it is broadcast. Ranks come from
   per-partition counters plus offsets, so a length that holds a third of all
   documents is no one task's job.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.common import small_batches, stored, table

TOKENIZER, WINDOW, END_ID = "byte_bpe_50k.json", 2048, 1
#: Lengths of a combination at most, combinations that start with each length in a round, rounds, and documents below which combinations aren't solved for.
DEEPEST, EACH, ROUNDS, FEW = 6, 4, 12, 64
#: Texts that the tokenizers library encodes in one call; what it returns takes far more memory than the ids.
CALL = 32
#: Characters outside of this range, or a special string's beginning, send a text to the tokenizers library itself.
_other = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\u024f\u2010-\u2026]|<\|")


def ranks_of(path: str) -> tuple[dict[bytes, int], str] | None:
    """The merge ranks of a byte-level tokenizer file, by token bytes, and its pattern; None if ids don't follow the order of the merges (then they are no ranks)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"] for t in spec["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
    # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    in_order = len(vocab.keys() - special) == 256 + len(pairs) and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
    if not plain or not in_order:
        return None
    return {bytes(map(byte_of.__getitem__, token)): n for token, n in vocab.items() if token not in special}, PATTERN


#: The pattern of the byte-level pre-tokenizer. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Ids of texts as little-endian unsigned 32-bit integers, as the tokenizers library gives them for the file.

    Texts of Latin letters and common punctuation are merged by tiktoken with the ranks and pattern of the same file, which gives the same ids several times faster (tests hold that against the library); all others, and all texts if the file's ids are no ranks, are encoded by the library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        found = ranks_of(path)
        self.fast = found and tiktoken.Encoding("ranks", pat_str=found[1], mergeable_ranks=found[0], special_tokens={})

    def of(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        for k, t in enumerate(texts):
            if self.fast and not _other.search(t):
                out[k] = np.asarray(self.fast.encode_ordinary(t), dtype="<u4").tobytes()
        rest = [k for k, x in enumerate(out) if x is None]
        for at in range(0, len(rest), CALL):
            part = rest[at : at + CALL]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = np.asarray(e.ids, dtype="<u4").tobytes()
        return out


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One encoder a worker process."""
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, falling."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def encoded_lengths(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a document: doc_id, doc_tokens, rest (doc_tokens modulo window), part and nth (its place among the documents of that rest in its partition), full_crcs, rest_crc, bit_crcs (checksums of the rest's power-of-two pieces)."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    schema = "doc_id long, doc_tokens long, rest int, part int, nth long, full_crcs array<long>, rest_crc long, bit_crcs array<long>"
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, ids = TaskContext.get().partitionId(), np.zeros(window, dtype=np.int64), ids_of(path)
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), ids.of([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                data += end
                n = len(data) // 4
                rest, whole = n % window, n - n % window
                full = [zlib.crc32(data[4 * k : 4 * (k + window)]) for k in range(0, whole, window)]
                bits, at = [], whole
                for p in powers(rest):
                    bits.append(zlib.crc32(data[4 * at : 4 * (at + p)]))
                    at += p
                rows.append((doc, n, rest, part, int(seen[rest]), full, zlib.crc32(data[4 * whole :]), bits))
                seen[rest] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "doc_tokens", "rest", "part", "nth", "full_crcs", "rest_crc", "bit_crcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def combinations(counts: np.ndarray, window: int, random: np.random.Generator, each: int = EACH) -> list[tuple[int, ...]]:
    """Fills of a window by lengths that occur: for every length all pairs, and ``each`` fills that start with it, go on with lengths drawn by their counts and end with one length or pair that leaves no gap. DEEPEST lengths at most."""
    have = np.flatnonzero(counts)
    have = have[have > 0]
    if not len(have):
        return []
    found = {(int(window - a), int(a)) for a in have if 2 * a <= window and counts[window - a] and (2 * a < window or counts[a] > 1)}
    # The pair that fills a gap best: the one of the larger least count.
    pair = np.zeros(window + 1, dtype=np.int64)
    for gap in range(2, window + 1):
        a = have[: np.searchsorted(have, gap // 2, side="right")]
        if len(a):
            least = np.where(2 * a == gap, counts[a] // 2, np.minimum(counts[a], counts[gap - a]))
            best = int(least.argmax())
            pair[gap] = a[best] if least[best] else 0
    drawn = random.choice(have, size=(len(have) * each, DEEPEST - 3), p=counts[have] / counts[have].sum())
    for n, draws in zip(np.repeat(have, each).tolist(), drawn.tolist(), strict=True):
        fill, gap = [n], window - n
        for x in draws:
            if gap and counts[gap]:
                fill.append(gap)
                gap = 0
            elif gap and pair[gap]:
                fill += [int(pair[gap]), int(gap - pair[gap])]
                gap = 0
            if not gap:
                break
            if x < gap:
                fill.append(x)
                gap -= x
        if not gap:
            found.add(tuple(sorted(fill, reverse=True)))
    return sorted(found)


def solve_nnls(columns: list[tuple[int, ...]], counts: np.ndarray, steps: int = 60) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|^2 by accelerated projected gradients; column j of A counts the lengths in columns[j] (sparse, so A is kept as index lists)."""
    if not columns:
        return np.zeros(0)
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    row = np.fromiter((x for c in columns for x in c), dtype=np.int64)
    n, m = len(counts), len(columns)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=x[col], minlength=n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, weights=r[row], minlength=m)

    v = np.ones(m)
    for _ in range(20):  # the largest singular value bounds the step
        w = back(forward(v))
        norm = np.linalg.norm(w) / np.linalg.norm(v)
        v = w / np.linalg.norm(w)
    target, x, y, t = counts.astype(float), np.zeros(m), np.zeros(m), 1.0
    for _ in range(steps):
        z = np.maximum(0, y - back(forward(y) - target) / (1.05 * norm))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / t2 * (z - x), z, t2
    return x


def exact_fill(lengths: list[int], gap: int) -> list[int] | None:
    """Places of lengths that add up to the gap (the earlier ones where there is a choice), or None. Reachable sums are the bits of one number a length."""
    mask, reach = (1 << gap + 1) - 1, [1]
    for n in reversed(lengths):
        reach.append(reach[-1] | reach[-1] << n & mask)
        if reach[-1] >> gap & 1:
            break
    else:
        return None if gap else []
    out, k = [], len(reach) - 1
    while gap:
        if not reach[k - 1] >> gap & 1:
            out.append(len(lengths) - k)
            gap -= lengths[len(lengths) - k]
        k -= 1
    return out


def plan(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(lengths, repeats) of every pattern, and how many documents of each length are left to be cut. counts[n]: documents with a rest of n, counts[0] unused.

    Repeats are solved for, rounded and taken as far as the histogram goes; then the problem is solved again for what is left, with fresh combinations, until a round takes little. Where all repeats round to nothing, the largest are taken once."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    found: dict[tuple[int, ...], int] = {}
    random = np.random.default_rng(17)

    def take(pattern: tuple[int, ...], times: int) -> int:
        for n in set(pattern):
            times = min(times, int(left[n]) // pattern.count(n))
        if times > 0:
            for n in pattern:
                left[n] -= times
            found[pattern] = found.get(pattern, 0) + times
        return times * len(pattern)

    for _ in range(ROUNDS):
        total = int(left.sum())
        if total < FEW:
            break
        columns = combinations(left, window, random)
        x = solve_nnls(columns, left)
        placed = 0
        for j in np.argsort(-x, kind="stable").tolist():
            if x[j] < 0.5 and placed > total // 4:
                break
            placed += take(columns[j], max(1, round(x[j])))
        if placed < total // 20:
            break
    # Residuals: the longest first, with others that fill its window exactly. A fill holds no length more often than it fits
    # and is taken as often as its lengths last, which uses one up: the work depends on the window, not on how many are left.
    hopeful, most = left.copy(), window // np.maximum(np.arange(window), 1)
    while hopeful.any():
        first = int(np.flatnonzero(hopeful)[-1])
        others = hopeful.copy()
        others[first] -= 1
        lengths = np.repeat(np.arange(window), np.minimum(others, most))[::-1].tolist()
        places = exact_fill(lengths, window - first)
        if places is None:  # nor do the others of this length, with fewer to choose from
            hopeful[first] = 0
            continue
        pattern = (first, *(lengths[k] for k in places))
        times = min(int(hopeful[n]) // pattern.count(n) for n in set(pattern))
        take(pattern, times)
        for n in pattern:
            hopeful[n] -= times
    for p in range(window.bit_length() - 1):  # a length that is a power of two needs no window of the full size
        take((1 << p,), int(left[1 << p]))
    return sorted(found.items()), left


def layout(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple], list[tuple], int]:
    """Slots for whole rests (length, first rank, last rank, first sequence, copies, offset of the first copy) and for cut ones (length, first rank, bit, first place), and the number of sequences before the cut ones. Ranks of a length are used up in order."""
    patterns, cut = plan(counts, window)
    used, whole, sequence = np.zeros(window, dtype=np.int64), [], 0
    for pattern, times in patterns:
        at = 0
        for n in sorted(set(pattern), reverse=True):
            copies = pattern.count(n)
            whole.append((int(n), int(used[n]), int(used[n] + copies * times - 1), sequence, copies, at))
            used[n] += copies * times
            at += copies * n
        sequence += times
    pieces, place = [], 0
    for k in reversed(range(window.bit_length() - 1)):
        for n in np.flatnonzero(cut):
            if n >> k & 1:
                pieces.append((int(n), int(used[n]), k, place))
                place += int(cut[n]) << k
    return whole, pieces, sequence


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents (columns doc_id, text), each id in exactly one: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows with equal or null ids are packed like any others. No row at all: no piece. The window must be a power of two."""
    spark = docs.sparkSession
    lengths = stored(encoded_lengths(docs, path, window, end_id), "lengths")
    by_part = lengths.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.size("full_crcs")).alias("full"))
    counts = np.zeros(window, dtype=np.int64)
    for row in lengths.groupBy("rest").agg(F.count("*").alias("n")).collect():  # at most `window` rows
        counts[row["rest"]] = row["n"]
    whole, pieces, first_cut = layout(counts, window)
    total_cut = sum(int(counts[n]) - first << k for n, first, k, _ in pieces)

    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = lengths.join(offsets, ["part", "rest"]).withColumn("rank", F.col("nth") + F.col("before"))

    # The plan's tables have less than `window` times a small constant of rows, whatever the corpus.
    slots = spark.createDataFrame(whole or [(-1, 0, -1, 0, 1, 0)], "rest int, lo long, hi long, seq long, copies int, at int")
    slots = slots.groupBy("rest").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "seq", "copies", "at"))).alias("slots"))
    cuts = spark.createDataFrame(pieces or [(-1, 0, 0, 0)], "rest int, lo long, bit int, place long")
    cuts = cuts.groupBy("rest").agg(F.first("lo").alias("cut_from"), F.sort_array(F.collect_list(F.struct("bit", "place")), asc=False).alias("cuts"))
    ranked = ranked.join(F.broadcast(slots), "rest", "left").join(F.broadcast(cuts), "rest", "left")

    # Full windows: a sequence each, numbered after the others by partition and place in it.
    base = first_cut + total_cut // window + window  # the last, partial window of cut pieces is at most `window` sequences
    common = ["doc_id", "doc_tokens"]
    slot = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") <= s["hi"])), 1)
    is_cut = F.coalesce(F.col("rank") >= F.col("cut_from"), F.lit(False))
    start = F.col("doc_tokens") - F.col("rest")
    uncut = (
        ranked.where(~is_cut & (F.col("rest") > 0))
        .withColumn("slot", slot)
        .withColumn("i", F.col("rank") - F.col("slot.lo"))
        .select(
            *common,
            start.alias("start"),
            F.col("rest").cast("long").alias("length"),
            F.col("rest_crc").alias("ids_crc32"),
            (F.col("slot.seq") + F.floor(F.col("i") / F.col("slot.copies"))).alias("sequence_id"),
            (F.col("slot.at") + F.col("i") % F.col("slot.copies") * F.col("rest")).cast("long").alias("offset"),
        )
    )
    last = total_cut // window * window
    # The partial window at the end is cut at the powers of two that its length is the sum of; pieces fall in size, so none straddles a cut.
    tail_seq, tail_at, at = F.lit(0), F.lit(0), 0
    for k, p in enumerate(powers(total_cut - last)):
        inside = F.col("place") - last >= at
        tail_seq, tail_at, at = F.when(inside, k).otherwise(tail_seq), F.when(inside, at).otherwise(tail_at), at + p
    place = F.col("cut.place") + (F.col("rank") - F.col("cut_from")) * F.col("size")
    cut = (
        ranked.where(is_cut)
        .select(*common, "rest", "rank", "cut_from", "bit_crcs", F.posexplode("cuts").alias("nth_bit", "cut"))
        .withColumn("size", F.expr("shiftleft(1L, cut.bit)"))
        .withColumn("place", place)
        .select(
            *common,
            (start + F.expr("rest & ~((size << 1) - 1)")).alias("start"),
            F.col("size").alias("length"),
            F.element_at("bit_crcs", F.col("nth_bit") + 1).alias("ids_crc32"),
            F.when(F.col("place") < last, F.floor(F.col("place") / window)).otherwise(tail_seq + last // window).alias("nth_seq"),
            F.when(F.col("place") < last, F.col("place") % window).otherwise(F.col("place") - last - tail_at).cast("long").alias("offset"),
        )
        .select(*common, "start", "length", "ids_crc32", (F.col("nth_seq") + first_cut).alias("sequence_id"), "offset")
    )
    # (partition, place) numbers the full windows: 2**40 windows a partition.
    in_part = Window.partitionBy("part", "rest").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.withColumn("part_rest", F.sum("full").over(Window.partitionBy("part").orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)))
    full = (
        lengths.where(F.size("full_crcs") > 0)
        .select(*common, "part", "rest", "nth", "full_crcs", F.coalesce(F.sum(F.size("full_crcs")).over(in_part), F.lit(0)).alias("in_rest"))
        .join(starts.select("part", "rest", F.coalesce("part_rest", F.lit(0)).alias("part_rest")), ["part", "rest"])
        .select(*common, "part", "in_rest", "part_rest", F.posexplode("full_crcs").alias("k", "ids_crc32"))
        .select(
            *common,
            (F.col("k") * F.lit(window)).cast("long").alias("start"),
            F.lit(window).cast("long").alias("length"),
            "ids_crc32",
            (F.lit(base) + F.expr("shiftleft(cast(part as bigint), 40)") + F.col("part_rest") + F.col("in_rest") + F.col("k")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return uncut.select(order).unionByName(cut.select(order)).unionByName(full.select(order))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_stage(spark, table(spark, sf_dir, "documents"), sf_dir)


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
