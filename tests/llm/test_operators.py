"""Corpus operators on small tables: brute force, round trips and edge cases."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions

pytest.importorskip("arcweave.llm")

from arcweave.llm import decontam, langid, license_scan, near_dedup, packing, quality, sharding, token_counts, toxicity, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, score double, labels string"
WORDS = [f"w{k}x" for k in range(300)]


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def documents(spark, texts, **more):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(k, t, "en", "src0", len(t or ""), 7, 0.5, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(more.get("parts", 2))


EDGES = [None, "", " \n\t ", "one", "Ünï çødé 漢字 😀", "a" * 5000, prose(1, 3000), prose(1, 3000), "tab\tand\u00a0other\u2003space", "<|endoftext|> x<|startoftext|>y", "don't  stop,, now. . ."]


@pytest.fixture(scope="module")
def edges(spark):
    df = documents(spark, EDGES)
    return df.union(df.where("doc_id = 3")).union(spark.createDataFrame([(None, "null id here", None, None, None, None, None, None)], SCHEMA)).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# token counts


def tokenizer(name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts_equal_the_library(spark, edges):
    path, t = tokenizer(token_counts.TOKENIZER)
    got = token_counts.count_tokens(edges, path, chunk=200, overlap=8).select("doc_id", "n_bytes", "n_tokens", "labels").collect()
    assert len(got) == edges.count()
    for r in got:
        text = "null id here" if r.doc_id is None else EDGES[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(t.encode(text, add_special_tokens=False).ids))
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_word_memo_equals_the_library():
    _, t = tokenizer(token_counts.TOKENIZER)
    words = token_counts.Words(t, memo=50)
    texts = [e or "" for e in EDGES] + [prose(k, 80) for k in range(20)] + ["e \u0301x \u2003y\x1cz\x85 it's 'S ǅ ﬁ\u00a0İ <|endoftext|>a"]
    assert words.count([x.encode() for x in texts]) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_chunks_resynchronise(spark):
    path, t = tokenizer(token_counts.TOKENIZER)
    for text in (prose(3, 500), "x" * 3000 + " " + prose(4, 50), prose(5, 20) + "\n" * 300 + "y" * 700, "z" * 999):
        for chunk, overlap in ((64, 4), (100, 1), (333, 50)):
            assert token_counts.count_chunked(t, text, chunk, overlap) == len(t.encode(text, add_special_tokens=False).ids)


def test_huge_texts_are_encoded_in_chunks(spark, monkeypatch):
    path, t = tokenizer(token_counts.TOKENIZER)
    encoded = []
    monkeypatch.setattr(token_counts, "Chunk", lambda tok, text, b, e, f=token_counts.Chunk: encoded.append(e - b) or f(tok, text, b, e))
    text = "\n".join(prose(k, 3000) for k in range(30)) + " it's <|endoftext|> e\u0301 " * 2000
    assert token_counts.count_chunked(t, text) == len(t.encode(text, add_special_tokens=False).ids)
    assert len(encoded) > len(text) // token_counts.CHUNK and max(encoded) <= 2 * token_counts.CHUNK
    r = random.Random(3)
    parts = ["a", "'", "'s", "'ll", " ", "  ", "\n", "e\u0301", "\u0301", "漢", "1", ".", "<|endoftext|>", "<|", "|>", "Σ", "😀", "x" * 50, "\u1e9b\u0323", "\x1c", "İ"]
    for k in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 300)))
        assert token_counts.count_chunked(t, text, 60, 7) == len(t.encode(text, add_special_tokens=False).ids), text


# packing


def test_ids_equal_the_library():
    path, t = tokenizer(packing.TOKENIZER)
    ids = packing.Ids(path)
    r = random.Random(2)
    latin = [*range(32, 127), *range(0xA0, 0x250), 9, 10, 13, 0x2019, 0x2026]
    texts = [e or "" for e in EDGES] + ["".join(chr(r.choice(latin)) for _ in range(60)) for _ in range(500)] + ["".join(r.choice(["漢", "a", "\x85", "\x1c", " ", "<|endoftext|>", "é"]) for _ in range(30)) for _ in range(200)]
    assert ids.fast and [np.frombuffer(x, dtype="<u4").tolist() for x in ids.of(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert packing.ranks_of(tokenizer(token_counts.TOKENIZER)[0]) is None  # another kind of file is left to the library


def test_most_documents_are_packed_whole():
    for n in (300, 3000):
        counts = np.bincount(np.random.default_rng(n).gamma(2, 250, n).astype(int) % 2048, minlength=2048)
        patterns, left = packing.plan(counts)
        assert left[1:].sum() < 0.08 * n and sum(times for p, times in patterns if len(p) == 1) < 0.02 * n
    assert sum([5, 4, 3, 3][k] for k in packing.exact_fill([5, 4, 3, 3], 10)) == 10
    assert packing.exact_fill([5, 4], 3) is None and packing.exact_fill([], 0) == []


def test_plan_does_not_search_once_for_every_document(monkeypatch):
    counts, searches, search = np.zeros(256, dtype=np.int64), [], packing.exact_fill
    counts[100:250], counts[1:30] = 400, 30  # far more long ones than fit with others
    monkeypatch.setattr(packing, "exact_fill", lambda lengths, gap: (searches.append(gap), search(lengths, gap))[1] if len(searches) < 2 * 256 else pytest.fail("too many searches"))
    patterns, left = packing.plan(counts, 256)
    used = Counter()
    for p, times in patterns:
        assert sum(p) == 256 or len(p) == 1
        for n in p:
            used[n] += times
    assert all(used[n] + left[n] == counts[n] for n in range(1, 256))


def check_pieces(pieces, ids, window):
    by_doc, by_seq, pad = {}, {}, 0
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            x = ids[doc]
            assert p.start == at and p.doc_tokens == len(x)
            assert zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids[doc])
    assert set(by_doc) == set(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad


@pytest.mark.parametrize("window", [16, 64])
def test_packing_round_trip(spark, window):
    path, t = tokenizer(packing.TOKENIZER)
    texts = [e for e in EDGES] + [prose(k, k % 40) for k in range(150)]
    ids = {k: np.asarray(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4") for k, x in enumerate(texts)}
    pieces = packing.pack(documents(spark, texts, parts=3), path, window).collect()
    assert check_pieces(pieces, ids, window) == 0
    assert packing.pack(empty(spark), path, window).count() == 0


def test_nnls_plan_uses_every_length_once():
    counts = np.random.default_rng(5).integers(0, 50, 256)
    patterns, left = packing.plan(counts, 256)
    used = Counter(n for p, times in patterns for n in p for _ in range(times))
    assert all(used[n] + left[n] == counts[n] for n in range(1, 256))
    assert all(sum(p) == 256 or len(p) == 1 for p, _ in patterns)
    a = [(3, 5), (4, 4)]
    x = packing.solve_nnls(a, np.array([0, 0, 0, 7, 10, 7, 0, 0]))
    assert x == pytest.approx([7, 5], abs=1e-3)


# quality


def test_quality_measures(spark, edges):
    rows = {r.doc_id: r for r in quality.ledger(edges).collect()}
    assert rows[0].n_words == rows[1].n_words == rows[2].n_words == 0
    assert rows[0].fail_bits & quality.BITS["few_words"]
    assert rows[3].n_words == 1 and rows[4].word_chars == len("Ünïçødé漢字😀")
    assert quality.repeat_words("a b c d e x a b c d e".split()) == 10
    assert quality.repeat_words("a a a a a a".split()) == 6
    assert quality.repeat_words("a b c d e f".split()) == 0
    assert quality.measure("x y\nx y\n\nx y#")[2:4] == (1, 1)
    assert dict(zip(quality.MEASURES, quality.measure("½² ²² Äß 漢")))["n_letters"] == 3 and dict(zip(quality.MEASURES, quality.measure("ÄÖ ǅ Ⅷ")))["n_upper"] == 2
    assert quality.ledger(empty(spark)).count() == 0


def test_policies_and_ablations(spark):
    good = prose(9, 60)
    loud, symbols = good.upper().replace(" ", "!! "), good.replace(" ", "# ")
    entries = quality.ledger(documents(spark, [good, loud, symbols, "few words", good + "\n" + good])).cache()
    kept = {r.doc_id for r in entries.where(quality.passes(quality.POLICY)).collect()}
    assert kept == {0}
    assert {r.doc_id for r in entries.where(quality.passes("base-1")).collect()} == {0, 1, 2}
    ablated = {r.rule: r for r in quality.ablations(entries).collect()}
    assert ablated["symbols"].failed == 1 and ablated["symbols"].only == 1 and ablated["symbols"].kept_without == 2
    assert quality.quality_stage(spark, documents(spark, [good]), "").columns == documents(spark, [good]).columns


# language id


def test_language_id(spark):
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "äöüßé"}
    texts, langs = [], []
    for k in range(240):
        lang = list(alphabets)[k % 3]
        r = random.Random(k)
        texts.append(" ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randint(2, 9))) for _ in range(r.randint(2, 200))))
        langs.append(lang)
    rows = [(k, t, x, "s", 1, 1, 0.0, "") for k, (t, x) in enumerate(zip(texts, langs))]
    docs = spark.createDataFrame([*rows, (900, None, "aa", "s", 0, 0, 0.0, ""), (901, "123 ...", None, "s", 0, 0, 0.0, ""), (902, "", "bb", "s", 0, 0, 0.0, "")], SCHEMA)
    net = langid.fit(langid.labelled_rows(docs))
    found = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert sum(found[k].lang_pred == x for k, x in enumerate(langs)) >= 235
    assert all((found[k].lang_pred, found[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert langid.predict(empty(spark), langid.fit(langid.labelled_rows(empty(spark)))).count() == 0
    kept = langid.language_stage(spark, docs, "")
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())


def test_windows_cover_every_byte():
    data = [b"", b"x", bytes(range(255)) * 5, b"y" * langid.WINDOW]
    x, owner, size = langid.windows_of(data)
    step = langid.WINDOW - max(langid.WIDTHS) + 1
    for k, d in enumerate(data):
        seen = bytearray()
        for n, w in enumerate(x[owner == k]):
            part = bytes(int(b) for b in w if b != langid.PAD)
            seen[n * step :] = part
        assert bytes(seen) == d


def test_blocks_of_windows_are_the_windows():
    r = random.Random(8)
    data = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 255, 256, 257, 9000, 3, 508, 20_000, 0)]
    x, owner, size = langid.windows_of(data)
    for most in (1, 3, 128):
        parts = list(langid.window_blocks(data, most))
        assert all(len(p[0]) <= most for p in parts)
        assert all(np.array_equal(np.concatenate(c), w) for c, w in zip(zip(*parts), (x, owner, size)))


def test_predictions_equal_a_plain_network():
    net = langid.train([("abab baba " * 40, "aa"), ("cdcd dcdc " * 40, "bb"), ("çéçé éçéç " * 30, "cc")], epochs=2)
    for text in ("abba", "dcdc abab " * 80, "çé x", "a"):
        data = text.lower().encode()
        step = langid.WINDOW - max(langid.WIDTHS) + 1
        total, k = np.zeros(3), 0
        while True:
            part = data[k : k + langid.WINDOW]
            symbols = list(part) + [langid.PAD] * (langid.WINDOW - len(part))
            hidden = []
            for f in net.filters:
                places = [sum(f[j][symbols[i + j]].astype(float) for j in range(len(f))) for i in range(langid.WINDOW - len(f) + 1)]
                hidden += np.max(places, axis=0).tolist()
            z = np.maximum(np.array(hidden) + net.bias, 0) @ net.out + net.out_bias
            e = np.exp(z - z.max())
            total += e / e.sum() * max(1, len(part))
            if k + langid.WINDOW >= len(data):
                break
            k += step
        total /= total.sum()
        (lang, score), = net.predict([text])
        assert lang == net.languages[int(total.argmax())] and score == pytest.approx(total.max(), abs=1e-4)


def test_training_covers_whole_texts_and_rare_languages(spark, monkeypatch):
    texts = [("a" * 500 + "xyz" * 400, "aa")] * 2 + [(prose(k, 40), "bb") for k in range(300)] + [(f"ccc {k}", "cc") for k in range(3)]
    docs = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(texts)], "doc_id bigint, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.extend(rows))
    langid.fit(docs.union(docs.where("doc_id = 0")), 30)
    assert Counter(y for _, y in seen) == {"aa": 2, "bb": 24, "cc": 3}  # the copy of a row takes its share too, but is learned once
    assert all(r in texts for r in seen)
    monkeypatch.undo()
    shown = []
    monkeypatch.setattr(langid, "windows_of", lambda data, f=langid.windows_of: shown.append(data) or f(data))
    langid.train(texts[:1], epochs=1)
    assert shown[0][0] == texts[0][0].encode()


# toxicity


def test_toxicity_learns_words_and_pairs(spark):
    r = random.Random(1)
    texts = [prose(k, 60) for k in range(600)]
    toxic = [k % 3 == 0 for k in range(600)]
    for k in range(0, 600, 3):
        w = texts[k].split()
        for _ in range(4):
            w.insert(r.randrange(len(w)), r.choice(["vile", "nasty", "rotten"]))
        texts[k] = " ".join(w)
    rows = [(k, t, int(y)) for k, (t, y) in enumerate(zip(texts, toxic))] + [(None, None, 1), (700, "", None)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(labelled, labelled)
    assert 0 < len(model[0]) < 5000
    fresh = [prose(k, 50) + (" vile x nasty y rotten" if k % 2 else "") for k in range(1000, 1040)]
    got = {r.doc_id: r.score for r in toxicity.score_texts(documents(spark, fresh + [None, ""]), model).collect()}
    assert all((got[k] >= 0.3) == bool(k % 2) for k in range(40))
    assert got[40] == got[41] and 0 <= got[40] <= 1
    assert toxicity.score_texts(empty(spark), model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, text string, toxic int")
    assert toxicity.fit(none, none)[2] == 0.0


def test_toxicity_training_equals_a_plain_version():
    rows = [(np.unique(toxicity.Features().of(t)), y) for t, y in [("you vile thing", 1), ("a fine day", 0), ("vile vile words", 1), ("", 0), ("fine words here", 0)] * 3]
    at, w, bias = toxicity.train(rows, 2)
    z, n, zb, nb = {}, {}, 0.0, 0.0
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((b + n[i] ** 0.5) / a + l2)
    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            i, y = rows[k]
            wb = -zb / ((b + nb**0.5) / a)
            g = 1 / (1 + np.exp(-(sum(map(weight, i.tolist())) + wb))) - y
            for c in i.tolist():
                wc = weight(c)
                z[c] = z.get(c, 0) + g - ((n.get(c, 0) + g * g) ** 0.5 - n.get(c, 0) ** 0.5) / a * wc
                n[c] = n.get(c, 0) + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / a * wb
            nb += g * g
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx({i: weight(i) for i in z if weight(i)}, rel=1e-4)
    assert bias == pytest.approx(-zb / ((b + nb**0.5) / a))


def test_toxicity_features_equal_a_plain_version():
    mask, mult = (1 << 64) - 1, [int(x) for x in toxicity._mult]
    mixed = lambda x: (x ^ x >> 29) * mult[1] & mask
    text = "One two, two THREE four-five one"
    words = re.findall(r"\w+", text.lower())
    h = {w: [mixed(x) for x in toxicity._hash(w)] for w in words}
    plain = {x >> 40 & (1 << toxicity.BITS) - 1 for w in words for x in h[w]}
    plain |= {mixed((h[a][0] * mult[0] + h[b][0] * mult[1]) & mask) >> 40 & (1 << toxicity.BITS) - 1 for a, b in zip(words, words[1:])}
    plain |= {mixed((h[a][0] * mult[2] + h[b][0] * mult[0] + 7) & mask) >> 40 & (1 << toxicity.BITS) - 1 for a, b in zip(words, words[2:])}
    assert set(toxicity.Features().of(text).tolist()) == plain


def test_toxicity_sample_is_bounded_and_texts_are_not_shuffled(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    found = toxicity.sample_features(docs, labels, 500)
    assert found.count() == 500 and found.select("doc_id").distinct().count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# sharding


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_are_neighbours(spark, n, bits):
    side = 1 << bits
    df = spark.range(side**n).selectExpr("id", *(f"cast(id div {side**k} % {side} as int) AS x{k}" for k in range(n)))
    rows = df.withColumn("h", sharding.hilbert_index([df[f"x{k}"] for k in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**n))
    assert all(sum(abs(a[f"x{k}"] - b[f"x{k}"]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark, edges):
    hot = documents(spark, ["the same text"] * 70 + [prose(k, k) for k in range(40)]).union(edges)
    rows = sharding.shard(hot).collect()
    n = hot.count()
    assert len(rows) == n
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(16))
    for s, c in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(c))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)
    assert all(r.size == len((EDGES[r.doc_id] or "").encode()) + 1 for r in sharding.shard(documents(spark, EDGES)).collect())
    assert sharding.shard(empty(spark)).count() == 0


def test_shards_prune_by_metadata(spark):
    rows = [(k, prose(k, 1 + k % 90), f"l{k % 4}", f"s{k % 7}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    placed = sharding.shard(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    for column, most in (("lang", 10), ("source", 9)):
        shards = {}
        for r in placed:
            shards.setdefault(r[column], set()).add(r.shard)
        assert np.mean([len(x) for x in shards.values()]) <= most  # of 16: a filter skips the others


# near duplicates


def brute_components(rows):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and root(a) != root(b):
                lo, hi = sorted((root(a), root(b)))
                comp[hi] = lo
    return {k: (len(sets[k]), root(k)) for k in ids}


def family(seed, n, edits):
    r = random.Random(seed)
    base = prose(seed, 120).split()
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        yield " ".join(w)


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = [*family(1, 60, 5), *family(2, 12, 3), *(prose(k, 80) for k in range(50, 90)), *EDGES, "Same Words here", "same words HERE", "a b c d", "a b c d"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(spark, texts, parts=4)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_near_duplicates_in_crowds_and_across_borders(spark):
    passage = prose(777, 45)
    crowd = [passage + " " + prose(1000 + k, 60) for k in range(700)]
    r = random.Random(9)
    pairs = []
    for k in range(0, 700, 7):
        w = crowd[k].split()
        w[r.randrange(len(w))] = "changed"
        pairs.append(" ".join(w))
    texts = crowd + pairs
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 31)
    try:
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(documents(spark, texts, parts=4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_components(list(enumerate(texts)))


def test_shared_values_are_prefixes():
    keys = np.array([[0] + [1] * 32, [0] + [1] * 32, [0] + [1] * 8 + [2] * 24, [0] + [1] * 7 + [3] * 25, [1] + [1] * 7 + [3] * 25], dtype=np.uint8)
    assert near_dedup.shared_values(keys).tolist() == [8, 2, 1, -1]
    trees = near_dedup.tree_values(near_dedup.TREES, 0) + near_dedup.tree_values(near_dedup.CROWDED, 1)
    assert all(len(set(t)) == near_dedup.VALUES for t in trees) and len({frozenset(t[:2]) for t in trees}) == len(trees)


def test_neighbours_in_dense_regions_share_longer_prefixes():
    r = np.random.default_rng(3)
    n, width = 400, 4 * near_dedup.VALUES
    keys = np.ones((n, 1 + width), dtype=np.uint8)
    keys[:, 1 + 4 * 3 :] = np.sort(r.integers(0, 200, (n, 1)), axis=0)  # all share three values
    keys[50:300] = keys[50]  # and these all eight
    sketches = r.integers(0, 256, (n, near_dedup.SKETCH)).astype(np.uint8)
    near_dedup_pairs = [(60, 260, True), (0, 40, True), (0, 390, False), (310, 395, False), (5, 20, True)]
    for a, b, _ in near_dedup_pairs:
        sketches[b] = sketches[a]
    for seen in (0, 250):
        a, b, crowded = near_dedup.neighbour_links(keys, np.arange(n), sketches, seen)
        pairs = set(zip(a.tolist(), b.tolist()))
        assert all(((x, y) in pairs) == (yes and y >= seen) for x, y, yes in near_dedup_pairs)
        assert len(crowded) == n
    empty_links = near_dedup.neighbour_links(keys[:1], np.arange(1), sketches[:1])
    assert [len(x) for x in empty_links] == [0, 0, 0]


def test_near_duplicate_stage_keeps_null_ids_apart(spark):
    text = prose(5, 50)
    rows = [(None, prose(6, 50)), (-1, text), (-2, text), (0, prose(7, 50)), (None, ""), (4, None), (4, None), (5, prose(7, 50))]
    kept = near_dedup.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert Counter(r.doc_id for r in kept) == Counter([None, None, -2, 0, 4])


def test_near_duplicates_edges(spark, edges):
    rows = near_dedup.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    nameless = [r for r in rows if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in nameless] == [(None, False)]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    stage = near_dedup.near_duplicate_stage(spark, edges, "")
    assert stage.columns == edges.columns
    assert Counter(r.doc_id for r in stage.collect()) == Counter([None, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10])


# licences


def test_license_scan(spark, edges):
    texts = [
        prose(1, 30) + "\nReleased under the MIT License. " + prose(2, 10),
        "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "Licensed under CC BY-SA 4.0; GNU General Public License, and gnu GENERAL public license",
        "the public of a general license work is permitted and this in any to",
        None,
    ]
    rows = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, texts + [prose(k, 50) for k in range(40)])).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels, rows[0].score) == (1, 33, 33, "mit", 1.0)
    assert rows[1].n_base == 0 and rows[1].first_word is None and rows[1].labels == "mit" and 0.6 <= rows[1].score <= 1
    assert (rows[2].n_base, rows[2].first_word, rows[2].last_word) == (3, 2, 12)
    assert rows[2].base_labels == "cc-by,gpl" and "cc-by-sa" in rows[2].labels
    assert rows[3].labels == rows[4].labels == "" and rows[4].n_words == 0 and rows[4].score == 0
    assert license_scan.scan_licenses(edges).count() == edges.count()
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_licenses_of_one_file_share_no_budget(spark):
    templates = license_scan.TEMPLATES
    pairs = [(a, b) for i, a in enumerate(templates) for b in templates[:i]]
    triples = [(templates[i], templates[i - 5], templates[i - 9]) for i in range(len(templates))]
    texts = [f" {prose(k, 12)} ".join(x[1] for x in some) for k, some in enumerate(pairs + triples)]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan_licenses(documents(spark, texts + [prose(k, 50) for k in range(900, 960)])).collect()}
    assert [(k, x[0]) for k, some in enumerate(pairs + triples) for x in some if x[0] not in got[k]] == []
    assert all(got[k] == [""] for k in range(len(texts), len(got)))


def test_license_base_columns_and_scores_equal_brute_force(spark):
    r = random.Random(4)
    common = "gnu general public license apache cc by mit free software permission work terms".split()
    texts = [" ".join(r.choice(common) for _ in range(r.randint(0, 60))) for _ in range(150)] + [prose(1, 5) + " " + t + " " + prose(2, 5) for _, t, _ in license_scan.TEMPLATES] + ["  ".join(t for _, t, _ in license_scan.TEMPLATES)]
    rows = {x.doc_id: x for x in license_scan.scan_licenses(documents(spark, texts)).collect()}
    templates = [(label, license_scan.words_of(t), license_scan.words_of(k)) for label, t, k in license_scan.TEMPLATES]
    all_words = [license_scan.words_of(t) for t in texts]
    idf = {w: np.log((len(texts) + 1) / (sum(w in set(x) for x in all_words) + 1)) + 1e-6 for _, ws, _ in templates for w in ws}
    for k, words in enumerate(all_words):
        places = [(s, label) for p, label in license_scan.PHRASES.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
        starts, labels, best = [s for s, _ in places], {label for _, label in places}, 1.0 if places else 0.0
        base = ",".join(sorted(labels))
        for label, ws, key in templates:
            for shift in range(-len(ws), len(words)):
                # Template words that stand at most SLACK places after where the shift puts them.
                got = {w for i, w in enumerate(ws) if w in words[max(0, shift + i) : max(0, shift + i + license_scan.SLACK + 1)]}
                share = sum(idf[w] for w in got) / sum(idf[w] for w in set(ws))
                lo = max(0, shift - license_scan.SLACK)
                span = words[lo : max(lo, shift + len(ws) + 2 * license_scan.SLACK)]
                if share >= license_scan.SHARE and any(span[j : j + len(key)] == key for j in range(len(span))):
                    labels.add(label)
                    best = max(best, min(1.0, share))
        got = rows[k]
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), base)
        assert got.labels == ",".join(sorted(labels)) and got.score == pytest.approx(best), k
    assert set(rows[len(texts) - 1].labels.split(",")) == {label for label, *_ in license_scan.TEMPLATES}


def test_license_scan_in_blocks_is_the_scan():
    r, templates = random.Random(8), license_scan.TEMPLATES
    index = license_scan.Index(templates)
    index.weigh({w: 3 * k for k, w in enumerate(sorted(index.vocabulary))}, 1000)
    for k in range(60):
        some = [license_scan.words_of(t[1]) for t in r.sample(templates, 3)]
        for ws in some:
            for _ in range(r.randint(0, 6)):
                ws[r.randrange(len(ws))] = r.choice(["the", "x", "software"])
        words = [w for ws in some for w in license_scan.words_of(prose(k, r.randint(0, 20))) + ws]
        for n in (1, 7, 50):
            assert index.scan(words, n) == index.scan(words), (k, n)
    assert index.scan([], 5) == (set(), 0.0)


# decontamination


def test_decontamination_equals_brute_force(spark):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    small = [f"v{k}" for k in range(12)]
    items = [(1, prose(1, 30)), (2, prose(2, 12)), (3, "only three words"), (4, None), (5, "..."), (10, prose(1, 30)), (6, prose(7, 14, small)), (None, "nameless item here")]
    texts = [prose(1, 30), "x " + prose(1, 30)[: len(prose(1, 30)) // 2] + " y", "Only, THREE! words. only three words", prose(3, 50), None, prose(7, 400, small), prose(2, 12) + " " + prose(2, 12), "a nameless item here", *(prose(k, 200, small) for k in range(20))]
    windows = []
    for i, t in items:
        w = words.findall((t or "").lower())
        windows += [(i, w[o : o + 10]) for o in range(max(1, len(w) - 9))] if w else []
    got = {r.doc_id: r for r in decontam.contamination(documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    import hashlib

    for k, t in enumerate(texts):
        w, hit, found = words.findall((t or "").lower()), set(), set()
        for i, x in windows:
            for s in range(len(w) - len(x) + 1):
                if w[s : s + len(x)] == x:
                    hit |= set(range(s, s + len(x)))
                    found.add(i)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256, got[k].contaminated) == (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)), k


def test_decontamination_edges(spark, edges, monkeypatch):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontam.contamination(edges, none).collect())
    assert decontam.contamination(empty(spark), none).count() == 0
    items = spark.createDataFrame([(1, prose(1, 30))], "item_id bigint, text string")
    moved = prose(1, 30).split()
    moved.insert(15, "inserted")
    stage = decontam.decontamination_stage
    monkeypatch.setattr(decontam, "table", lambda s, d, n: items)
    dirty = edges.union(documents(spark, [prose(1, 30) + " tail"]).withColumn("doc_id", functions.lit(77).cast("long")))
    kept = stage(spark, dirty, "")
    assert kept.columns == dirty.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in edges.collect() if r.doc_id not in (6, 7))  # prose(1, 3000) begins with the item
    assert stage(spark, empty(spark), "").count() == 0
    near = decontam.proximity_matches(documents(spark, [" ".join(moved), prose(5, 40)]), items)
    assert {(r.doc_id, r.item_id) for r in near.collect()} == {(0, 1)}


# URLs


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/en/12?x", "http://example.org/es/", "http://x.com/fr/a", "http://x.com/de/", "http://x.com/de", "http://org/", "http://forg/", "x://h?q#/p", "http://a.org", "a://b://c.org/d"]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    assert [rows[k].rule for k in range(13)] == [None, None, None, "example.org/en/1", "example.org/es/", "com/fr/", "com/de/", None, "org/", None, None, None, None]
    assert [rows[k].verdict for k in (0, 1, 3, 4, 5, 6, 8)] == ["block", "block", "block", "block", "allow", "block", "allow"]
    assert (rows[3].host, rows[3].path) == ("a.example.org", "/en/12") and (rows[10].host, rows[10].path) == ("h", "") and (rows[2].host, rows[2].path) == ("", "")
    assert (rows[12].host, rows[12].path) == ("b:", "//c.org/d")
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string, verdict string")).count() == 0


def brute_scores(urls):
    """The models in plain Python."""
    import hashlib
    import math

    def decided(u):
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u).groups()
        return 1 if host.endswith(".org") and path.startswith("/") else 0 if host.endswith(".com") and path.startswith("/de/") else None

    labelled = [(u, decided(u)) for u in urls if decided(u) is not None]
    train = [(u, y) for u, y in labelled if hashlib.md5(u.encode()).hexdigest()[0] not in url_filter.HELD_OUT]
    counts, total = Counter(), [0, 0]
    for u, y in train:
        total[y] += len(u)
        for i in range(len(u)):
            for k in range(min(i, url_filter.ORDER) + 1):
                counts[y, u[i - k : i + 1]] += 1
    least = url_filter.LEAST
    kept = {g for _, g in counts if counts[0, g] + counts[1, g] >= least}
    w = url_filter.WEIGHT

    def p(y, g):
        if len(g) == 1:
            return (counts[y, g] + w / url_filter.ALPHABET) / (total[y] + w)
        return (counts[y, g] + w * p(y, g[1:])) / (counts[y, g[:-1]] + w)

    def score(u):
        out = []
        for i in range(len(u)):
            g = next((u[i - k : i + 1] for k in range(min(i, url_filter.ORDER), -1, -1) if u[i - k : i + 1] in kept), None)
            out.append(math.log(p(1, g) / p(0, g)) if g else 0.0)
        return sum(out) / len(out)

    return {u: score(u) for u in urls if decided(u) is None}


def test_url_scores_equal_brute_force(spark):
    r = random.Random(4)
    hosts = {"org": ["good", "nice", "fine"], "com": ["bad", "spam", "junk"]}
    urls = [f"http://{r.choice(hosts[t])}{r.randint(0, 9)}.{t}/{'a' if t == 'org' else 'de'}/{r.randint(0, 999)}" for t in ("org", "com") for _ in range(80)]
    urls += [f"http://{r.choice(hosts[t])}{r.randint(0, 9)}.net/{r.randint(0, 999)}" for t in ("org", "com") for _ in range(30)]
    rules = [("allow", "org/"), ("block", "com/de/")]
    rows = {r.url: r for r in url_filter.judge(spark.createDataFrame([(1, u) for u in urls], "page_id bigint, url string"), rules).collect()}
    for u, s in brute_scores(urls).items():
        assert rows[u].score == pytest.approx(s, abs=1e-6)
        assert rows[u].verdict == ("allow" if any(h in u for h in hosts["org"]) else "block")


def test_url_states_grow_with_the_input(spark):
    r = random.Random(6)
    urls = ["http://" + "".join(r.choice("abcdefgh") for _ in range(60)) for _ in range(600)] + ["http://zq1xv"] * 2  # 40,226 characters
    counts = Counter(u[i - k : i + 1] for u in urls for i in range(len(u)) for k in range(min(i, url_filter.ORDER) + 1))
    model = url_filter.train(spark.createDataFrame([(u, k % 2) for k, u in enumerate(urls)], "u string, allow bigint"))
    kept = {x.g for x in model.collect()}
    assert {"zq1xv", "q1xv"} <= kept and kept == {g for g, n in counts.items() if n >= 2}
    assert [x.score != 0 for x in url_filter.scores(spark.createDataFrame([("abc",), ("abc",), ("~~",)], "u string"), model).orderBy("u").collect()] == [True, False]


# columns of any name


def odd_documents(spark, texts):
    """Columns named like the operators' own in other letters, and like their inner names."""
    names = ["Host", "VERDICT", "Score", "N_Words", "Labels", "Lang_Pred", "N_TOKENS", "Fail_Bits", "row", "page", "u", "k1", "tk", "none", "id", "__text", "term", "part", "rank"]
    rows = [(k, t, "en", "src0", *names) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)).coalesce(2)


def test_column_names_never_clash(spark, monkeypatch):
    path, _ = tokenizer(token_counts.TOKENIZER)
    texts = [prose(k, 30) for k in range(6)] + [None, ""]
    docs = odd_documents(spark, texts)
    net = langid.fit(langid.labelled_rows(docs))
    items = spark.createDataFrame([(1, prose(2, 30))], "item_id bigint, text string")
    pages = docs.withColumn("url", functions.lit("http://a.org/x")).withColumn("page_id", functions.col("doc_id"))
    outs = [
        url_filter.judge(pages),
        toxicity.score_texts(docs, (np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)),
        token_counts.count_tokens(docs, path),
        langid.predict(docs, net),
        sharding.shard(docs),
        near_dedup.near_duplicates(docs),
        quality.ledger(docs),
        packing.pack(docs, tokenizer(packing.TOKENIZER)[0], 64),
        license_scan.scan_licenses(docs),
        decontam.contamination(docs, items),
    ]
    for k, out in enumerate(outs):
        lower = [c.lower() for c in out.columns]
        assert len(set(lower)) == len(lower), k
        assert out.select("page_id" if k == 0 else "doc_id").distinct().count() == len(texts), k
    monkeypatch.setattr(decontam, "table", lambda s, d, n: items)
    for stage in (quality.quality_stage, langid.language_stage, near_dedup.near_duplicate_stage, decontam.decontamination_stage):
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns
        assert all(r.Score == "Score" and r.N_Words == "N_Words" and r["row"] == "row" for r in kept.collect())


# queries and pipeline

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")


@needs_tables
@pytest.mark.parametrize("name", ["op1_url_filter", "op5_hilbert_sharding", "op6_near_duplicates", "op7_quality_rules", "op10_decontamination"])
def test_query_matches_sql(spark, name):
    import duckdb

    from arcweave import llm

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    text = lambda x: "null" if x is None or str(x) in ("nan", "<NA>", "None") else str(x)
    rows = lambda f: sorted(tuple(map(text, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert rows(llm.queries()[name](spark, DATA).toPandas()) == rows(con.sql(llm.oracle_sql()[name]).df())


@needs_tables
def test_pipeline_equals_plain_steps(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    _, t = tokenizer(packing.TOKENIZER)
    pieces = corpus_pipeline.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    bits = lambda m: sum(quality.BITS[k] for k, rule in quality.RULES.items() if rule(lambda n: dict(zip(quality.MEASURES, m))[n]))
    kept = [d for d in docs if not bits(quality.measure(d.text)) & quality.POLICIES[quality.POLICY]]
    assert 0.6 * len(docs) < len(kept) < len(docs)
    by_id = {d.doc_id: d for d in kept}
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    net = langid.fit(langid.labelled_rows(spark.createDataFrame([tuple(d) for d in kept], schema)))
    known = dict(zip(by_id, net.predict([d.text for d in by_id.values()])))
    kept = [d for d in kept if known[d.doc_id][0] != langid.UNKNOWN and known[d.doc_id][1] >= langid.KEEP_SCORE]
    comp = brute_components([(d.doc_id, d.text) for d in kept])
    kept = [d for d in kept if comp[d.doc_id][1] == d.doc_id]
    words = license_scan.words_of
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {" ".join(w[o : o + 10]) for w in items for o in range(max(1, len(w) - 9))}
    sizes = {len(g.split()) for g in grams}
    clean = {d.doc_id: d.text for d in kept if not any(" ".join(w[s : s + n]) in grams for w in [words(d.text)] for n in sizes for s in range(len(w) - n + 1))}
    ids = {k: np.asarray(t.encode(x, add_special_tokens=False).ids + [1], dtype="<u4") for k, x in clean.items()}
    assert check_pieces(pieces, ids, packing.WINDOW) == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    tokenizer(packing.TOKENIZER)
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
