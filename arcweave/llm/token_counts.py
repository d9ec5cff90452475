"""Token counts by overlap resynchronisation.

A text of more than CHUNK characters is cut into overlapping chunks at arbitrary
places. The library encodes each chunk; tokens carry offsets and the number of the
pre-token (a match of the tokenizer's pattern) that they are part of. Neighbouring
chunks are spliced at the last stable boundary that both encodings hold, and only
if all tokens from there to the end of what the earlier chunk can vouch for agree
in place and id. If there is none, the overlap is doubled, and once it is the chunk
itself, the chunk grows.

Shorter texts are one chunk. ASCII white space is a stable boundary, too: no
alternative of the pattern crosses it, nothing composes with it and special strings
hold none. So the words between are encoded independently, and a bounded memo asks
the library for each new word once.

Stable boundary: the start of a pre-token in both encodings, at an ASCII character
after an ASCII one, GUARD characters or more before the earlier chunk's end. The
earlier chunk begins at a true boundary, so its pre-tokens are those of the whole
text as far as its end can't reach: the pattern is matched from left to right, a
match that ends before the chunk does is not changed by what follows, special
strings are shorter than GUARD, and no character composes (NFC) with an ASCII one
before it unless it is a non-ASCII mark. From such a start on, the later chunk is
matched like the whole text, whatever its own beginning cut through.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.common import columns_without, small_batches, table

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: Characters of a chunk, of the overlap before it is widened, and before a chunk's end that it can't vouch for.
CHUNK, OVERLAP, GUARD = 16_384, 256, 32
#: Words that a worker remembers; about 150 bytes each.
MEMO = 1_000_000


class Chunk:
    """The encoding of text[begin:end]: ids, starts (places in the text) and whether a stable boundary is there."""

    def __init__(self, tokenizer, text: str, begin: int, end: int) -> None:  # noqa: ANN001
        found = tokenizer.encode(text[begin:end], add_special_tokens=False)
        self.begin, self.end = begin, end
        self.ids = np.asarray(found.ids, dtype=np.int64)
        self.starts = np.asarray([s for s, _ in found.offsets], dtype=np.int64) + begin
        word = np.asarray([-1 if w is None else w for w in found.word_ids], dtype=np.int64)
        self.stable = np.ones(len(word), dtype=bool)
        self.stable[1:] = (word[1:] != word[:-1]) & (self.starts[1:] > self.starts[:-1])

    def boundaries(self, text: str, begin: int, end: int) -> list[int]:
        """Stable boundaries c with begin < c <= end, falling."""
        at = self.starts[self.stable & (self.starts > begin) & (self.starts <= end)]
        return [int(c) for c in at[::-1] if text[c].isascii() and text[c - 1].isascii()]

    def before(self, c: int) -> int:
        """Tokens that start before c."""
        return int(np.searchsorted(self.starts, c))

    def after(self, c: int, end: int) -> tuple[bytes, bytes]:
        """Places and ids of the tokens from c to before ``end``."""
        part = slice(self.before(c), self.before(end))
        return self.starts[part].tobytes(), self.ids[part].tobytes()


def splice(text: str, a: Chunk, b: Chunk, begin: int) -> int | None:
    """The last stable boundary after ``begin`` that both chunks hold, if all that ``a`` vouches for from there on agrees; else None."""
    sure = a.end - GUARD
    theirs = set(b.boundaries(text, max(begin, b.begin), sure))
    common = [c for c in a.boundaries(text, begin, sure) if c in theirs]
    # What stands between the last common boundary and ``sure`` belongs to a pre-token that may go on, so it is compared from the first common one to the last.
    if not common or a.after(common[-1], common[0]) != b.after(common[-1], common[0]):
        return None
    return common[0]


def count_chunked(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:  # noqa: ANN001
    """Tokens of a text of any length; memory stays in proportion to a chunk (or to the longest stretch without a boundary)."""
    chunk = max(chunk, 2)
    total, begin = 0, 0  # tokens before ``begin``, a true boundary
    a = Chunk(tokenizer, text, 0, min(chunk, len(text)))
    while a.end < len(text):
        wide = max(1, min(overlap, chunk - 1))
        while True:
            start = max(begin, a.end - wide)
            b = Chunk(tokenizer, text, start, min(len(text), max(start + chunk, a.end + wide)))
            cut = splice(text, a, b, begin) if start > begin else None
            if cut is not None or start == begin:
                break
            wide *= 2
        if cut is None:  # no boundary in all of the chunk: a longer one takes its place
            a = b
            chunk = max(chunk, b.end - b.begin)
            chunk *= 2
            continue
        total += a.before(cut) - a.before(begin)
        a, begin = b, cut
    return total + len(a.ids) - a.before(begin)


class Words:
    """Token counts of words, each encoded by the library once while the memo holds it."""

    def __init__(self, tokenizer, memo: int = MEMO) -> None:  # noqa: ANN001
        self.tokenizer, self.memo, self.known = tokenizer, memo, {}

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        split = [x.split() for x in texts]
        seen = set().union(*split)
        new = list(seen.difference(self.known))
        if len(self.known) + len(new) > self.memo:
            self.known.clear()
            new = list(seen)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False)
            self.known.update(zip(part, [len(e.ids) for e in found], strict=True))
        return [sum(map(self.known.__getitem__, x)) for x in split]


_tokenizers: dict = {}


def tokenizer_of(path: str) -> tuple:
    """One tokenizer and its memo a worker process, which uses the task's own core only."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _tokenizers[path] = tokenizer, Words(tokenizer)
    return _tokenizers[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without the text, with n_bytes and n_tokens (long) appended; every row stays, in any number of copies, so ties and repeated rows need no rule.

    A null or empty text, or one of white space only, has no tokens (null: no bytes either). Very long texts are encoded chunk by chunk. No rows give no rows. Columns that are named like the new ones, in any case, are replaced."""
    import pyarrow as pa

    kept = columns_without(docs, text, "n_bytes", "n_tokens")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, words = tokenizer_of(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            data = [x.encode("utf-8", "surrogatepass") for x in texts]
            sizes = list(map(len, data))
            short = iter(words.count([d for d, x in zip(data, texts, strict=True) if len(x) <= chunk]))
            counts = [next(short) if len(x) <= chunk else count_chunked(tokenizer, x, chunk, overlap) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*kept, "n_bytes", "n_tokens"])

    left = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = left.withColumn("n_bytes", F.lit(0).cast("long")).withColumn("n_tokens", F.lit(0).cast("long")).schema
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE_SQL: dict[str, str] = {}
