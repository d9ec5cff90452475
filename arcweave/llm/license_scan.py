"""Licence scanning with a positional index of licence words weighed by IDF.

The index holds the licence templates' words with their positions. Document
frequencies of those words are counted over the whole corpus. Templates that a
file's words can't give enough IDF are dropped; for the others every word is
looked up, so that no licence of a file takes room from another. Each occurrence
and each posting give a relative position (file minus template), and postings
that agree on it (within a slack for small edits) are intersected. A template is
reported if what agrees holds enough of its IDF and its mandatory key phrase
stands there too.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.common import ALNUM_WORD, ascii_lower, columns_without, small_batches, table

#: Phrases whose every place is counted, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label, template (sentences of the public licence texts), phrase that must stand in the matched span.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "permission is hereby granted"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "substantial portions of the software"),
    ("mit", "released under the MIT license", "mit license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache license"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "unless required by applicable law"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "general public license"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "redistributions in binary form"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at", "copy of the mpl"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "attribution sharealike"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "attribution noncommercial"),
    ("cc-by-sa", "licensed under CC BY SA 4.0", "cc by sa"),
    ("cc-by-nc", "licensed under CC BY NC 4.0", "cc by nc"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights", "dedicated the work to the public domain"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited", "all rights reserved"),
]
#: Places that a posting may be off, share of a template's IDF that must agree, relative positions that are looked at together.
SLACK, SHARE, BLOCK = 3, 0.6, 8192

_word = re.compile(ALNUM_WORD)


def words_of(text: str | None) -> list[str]:
    return _word.findall(ascii_lower(text))


class Index:
    """Postings of the templates' words: word -> (template, position)."""

    def __init__(self, templates: list[tuple[str, str, str]]) -> None:
        self.labels = [label for label, *_ in templates]
        self.words = [words_of(text) for _, text, _ in templates]
        self.keys = [words_of(key) for *_, key in templates]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            for k, w in enumerate(ws):
                self.postings[w].append((t, k))
        self.vocabulary = frozenset(self.postings)

    def weigh(self, frequency: dict[str, int], n_docs: int) -> None:
        """IDF of each licence word from document counts, and of each template as a whole."""
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1e-6 for w in self.vocabulary}
        self.sums = [{w: self.idf[w] for w in ws} for ws in self.words]
        self.mass = [sum(x.values()) for x in self.sums]

    def scan(self, words: list[str], block: int = BLOCK) -> tuple[set[str], float]:
        """Labels of the templates that stand in the words, and the largest share of a template's IDF found in place.

        Relative positions are taken ``block`` at a time, each time with all the words that can agree on them, so postings of a very long text are never held at once."""
        longest = max(map(len, self.words), default=0)
        labels, best = set(), 0.0
        if self.within(self.vocabulary.intersection(words)):
            for begin in range(-longest, len(words), block):
                found, share = self.scan_block(words, begin, begin + block, longest)
                labels |= found
                best = max(best, share)
        return labels, min(1.0, best)

    def within(self, present: frozenset[str]) -> set[int]:
        """Templates that these words can give enough IDF."""
        shared = ((t, own.keys() & present) for t, own in enumerate(self.sums))
        return {t for t, ws in shared if ws and sum(self.sums[t][w] for w in ws) >= SHARE * self.mass[t]}

    def scan_block(self, words: list[str], begin: int, end: int, longest: int) -> tuple[set[str], float]:
        """``scan`` for templates that begin at a relative position from ``begin`` to before ``end``."""
        first, last = max(0, begin), max(0, min(len(words), end + longest + SLACK))
        present = self.vocabulary.intersection(words[first:last])
        within = self.within(present)
        if not within:
            return set(), 0.0
        postings = {w: here for w in present if (here := [(t, p) for t, p in self.postings[w] if t in within])}
        at: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for k in range(first, last):
            if (w := words[k]) in postings:
                for t, p in postings[w]:
                    at[t][k - p].add(w)
        labels, best = set(), 0.0
        for t, shifts in at.items():
            share = 0.0
            for s in [s for s in shifts if begin <= s < end]:
                near = set().union(*(shifts.get(s + e, ()) for e in range(SLACK + 1)))
                got = sum(self.idf[w] for w in near) / self.mass[t]
                if got > share and got >= SHARE and self.verified(t, words, s):
                    share = got
            if share:
                labels.add(self.labels[t])
                best = max(best, share)
        return labels, best

    def verified(self, t: int, words: list[str], shift: int) -> bool:
        key, lo = self.keys[t], max(0, shift - SLACK)
        span = words[lo : max(lo, shift + len(self.words[t]) + 2 * SLACK)]
        return any(span[k : k + len(key)] == key for k in range(len(span) - len(key) + 1))


PHRASE_WORDS = [(words_of(p), label) for p, label in PHRASES.items()]


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase."""
    found, have = [], set(words)
    for phrase, label in PHRASE_WORDS:
        if have.issuperset(phrase):
            rare = max(range(len(phrase)), key=lambda k: len(phrase[k]))
            at = -1
            while True:
                try:
                    at = words.index(phrase[rare], at + 1)
                except ValueError:
                    break
                s = at - rare
                if s >= 0 and words[s : s + len(phrase)] == phrase:
                    found.append((s, label))
    return found


def document_frequencies(docs: DataFrame, vocabulary: frozenset[str], text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each word of the vocabulary stands, and how many there are. Counted over all rows; each batch sends a row a word at most."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    pattern = re.compile(ALNUM_WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                for w in vocabulary.intersection(pattern.findall(ascii_lower(t))):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.string()), pa.array([n, *counts.values()], pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = {r["word"]: r["n"] for r in counted.collect()}  # at most a row a word of the templates
    return rows, rows.pop(None, 0)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double).

    Every row stays, repeated ones with equal results; null and empty texts have no words, no labels ('') and score 0. A base phrase gives score 1. Of places of equal share any does, as only the share counts. A very long text is held as its list of words, one text at a time. Columns that are named like the new ones, in any case, are replaced."""
    import pyarrow as pa

    index = Index(templates or TEMPLATES)
    index.weigh(*document_frequencies(docs, index.vocabulary, text))
    new = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    kept = columns_without(docs, text, *new)

    def row(index: Index, words: list[str]) -> tuple:
        places = base_places(words)
        labels, score = index.scan(words)
        base = {label for _, label in places}
        starts = [s for s, _ in places]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            columns = list(zip(*(row(index, words_of(t)) for t in batch.column(batch.num_columns - 1).to_pylist()), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*kept, *new])

    left = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = left.withColumns({c: F.lit(None).cast(t) for c, t in new.items()}).schema
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE_SQL: dict[str, str] = {}
