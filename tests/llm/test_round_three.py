"""Phrases, exact top-k search and spelling variants against brute force, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trackfields.llm import collocations, spelling, topk

from .test_operators import words

DOCS = "doc_id long, text string, lang string, phrase string, word string, n int, rank int, code long, id string, codes int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def plain_phrases(docs, least=30, first=2000):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    found = defaultdict(list)
    candidates = {x for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = defaultdict(int)
    for lang, p in candidates:
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], f[lang, p])
    for lang, p in candidates:
        a = f[lang, p]
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if 100 * inside[lang, p] < 80 * a or not inside[lang, p]:
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first]))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = words(12, 5).split() + ["New", "YORK", "été", "ÉTÉ", "straße", " x", "日本"]
    texts = [None, "", " \n\t", ".", "a b\tc  d", "x" * 40_000, "one two. one two\rone two;one\ttwo"]
    texts += ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  ", ", "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["set phrase of four words here"] * 40 + ["phrase of four"] * 3 + ["a a a a a a"] * 20
    texts += [" ".join(rng.choice(vocabulary) for _ in range(9000))]
    docs = [(i, t, rng.choice(["en", "de", None, "und"]), "x", "y", 1, 2, 3, "z", 4) for i, t in enumerate(texts)]
    return [*docs, docs[9], docs[9], (None, texts[9], None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize("chunk", [50, 2_000_000])
def test_phrases(spark, corpus, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    got = collocations.collocations(spark.createDataFrame(corpus, DOCS).repartition(5)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = plain_phrases(corpus)
    assert len(want) > 100 and sorted(map(tuple, got)) == want


def test_phrases_with_few_bits_and_few_ranks(spark, corpus, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 32)
    monkeypatch.setattr(collocations, "MOST_BITS", 32)  # the semi-join lets nearly everything pass
    monkeypatch.setattr(collocations, "FIRST", 7)
    got = collocations.collocations(spark.createDataFrame(corpus, DOCS).repartition(5)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain_phrases(corpus, first=7)


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert collocations.collocations(none).count() == 0 and spelling.variants(none).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    d = spark.createDataFrame([(5 * 10**12, 6 * 10**12, 7 * 10**12)], "a long, l long, r long")
    assert d.select(collocations._score(d.a, d.l, d.r).alias("s")).head()[0] == 2_000_000 * 5 // 13


def plain_top(rows, k, each):
    vectors = defaultdict(set)
    for i, v, *_ in rows:
        if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v):
            vectors[i].add(tuple(int(np.floor(64 * float(x))) for x in v))
    out = []
    for q in (i for i in vectors if i % each == 0):
        best = {j: max(sum(a * b for a, b in zip(x, y)) for x in vectors[q] for y in vectors[j]) for j in vectors if j != q}
        out += [(q, n + 1, j, s) for n, (s, j) in enumerate(sorted(((s, j) for j, s in best.items()), key=lambda t: (-t[0], t[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows", [0, 5, 60, 700])
def test_top_k(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "BLOCK", 10)
    rng = np.random.default_rng(rows)
    x = np.concatenate([rng.normal(size=(rows // 2, 6)) * 0.3 + 2, np.tile([[0.5, -0.5, 0.1, 0, 0, 1]], (rows // 4, 1)), rng.integers(-1, 2, size=(rows - rows // 2 - rows // 4, 6)) / 8])
    d = [(i, v.tolist(), "a", 1, "b") for i, v in enumerate(x)]
    d += [(2000, None, "a", 1, "b"), (2005, [float("nan")] * 6, "a", 1, "b"), (2010, [None] * 6, "a", 1, "b"), (2015, [float("inf")] + [0.0] * 5, "a", 1, "b"), (None, [1.0] * 6, "a", 1, "b"), (2100, [], "a", 1, "b")]
    if rows:
        d += [d[1], (2020, [0.0] * 6, "a", 1, "b"), (1, [1.0] * 6, "a", 1, "b"), (0, [0.25] * 6, "a", 1, "b"), (2200, [1.0], "a", 1, "b")]
        d += [(7, (rng.normal(size=6) * 3).tolist(), "a", 1, "b") for _ in range(40)]  # an id of many vectors
    table = spark.createDataFrame(d, "vec_id long, embedding array<double>, id string, v int, shard string")
    got = sorted(map(tuple, topk.search(table, table.where("vec_id % 5 = 0"), k=9).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == plain_top(d, 9, 5)


def test_top_k_of_large_components(spark):
    d = [(0, [1e7, 1.0, 3.0]), (1, [1e7, 1 / 64, 0.0]), (2, [1e7, 2 / 64, 0.0]), (3, [1e30, 0.0, 0.0]), (5, [-1e7, 2.5, 1.0])]
    table = spark.createDataFrame(d, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.search(table, table.where("vec_id % 5 = 0")).collect()}
    assert got[0, 2] - got[0, 1] == 64 and got[0, 1] == (64 * 10**7) ** 2 + 64 and got[0, 3] == 2**63 - 1 and got[5, 3] == -(2**63)


def test_top_k_opens_few_leaves_of_clusters():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(-99, 100, size=(32, 8)), 128, 0) + rng.integers(-2, 3, size=(4096, 8))
    tree = topk.build(np.arange(4096), x.astype(float))
    assert all((tree.points[b:e] >= low).all() and (tree.points[b:e] <= high).all() for low, high, b, e in zip(tree.low, tree.high, tree.begin, tree.end))
    opened = 0

    class Counting(topk.Found):
        def add(self, ids, scores):
            nonlocal opened
            opened += 1
            super().add(ids, scores)

    for q in x[::100]:
        found = Counting(20, None)
        topk.visit(tree, q.astype(float), -1, np.maximum(q, 0) @ tree.high.T + np.minimum(q, 0) @ tree.low.T, found)
        s = x @ q
        assert found.ids.tolist() == np.lexsort((np.arange(4096), -s))[:20].tolist()
    assert opened / 41 < 6


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    n = Counter()
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    out, form = [], {}
    for w in n:
        near = [(-n[x], x) for x in n if edits(w, x)]
        form[w] = min(near)[1] if near and -min(near)[0] >= 10 * n[w] else None
        out.append((w, len(near)))
    rows = []
    for w, k in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n[w], k, form[w], n[form[w]] if form[w] else None, root))
    return sorted(rows)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(6)
    base = ["".join(rng.choice("aeirstonéÿ") for _ in range(rng.randint(7, 10))) for _ in range(25)] + ["aaaaaaaa", "x" * 3000, "Übergröße", "abcdefg"]
    texts = [None, "", "...", "abcdefg abcdefgh", "éééééééé ÉÉÉÉÉÉÉÉ"]
    for k in range(400):
        some = []
        for w in rng.choices(base, weights=[1 / (i + 1) for i in range(len(base))], k=30):
            if rng.random() < 0.1:
                i, c = rng.randrange(len(w)), rng.choice("aeßz")
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            some.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", ", ", "-", "1"]).join(some))
    # A chain of forms: one occurs 3 times, the next 40, the next 500.
    texts.append(" ".join(["chainend"] * 500 + ["chainen"] * 40 + ["chaine"] * 9 + ["chainena"] * 3 + ["chainex"] * 4))
    docs = [(i, t, "en", "x", "y", 1, 2, 3, "z", 4) for i, t in enumerate(texts)]
    return [*docs, docs[20], (None, texts[21], None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize("tile", [7, 50_000])
def test_spelling_variants(spark, misspelt, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    got = spelling.variants(spark.createDataFrame(misspelt, DOCS).repartition(4)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants(misspelt)
    assert len(want) > 200 and sorted(map(tuple, got)) == want
    assert any(r[3] and r[3] != r[5] for r in want)


@pytest.mark.parametrize("bucket", [1, 4])
def test_trie_reaches_all_words_one_edit_away(monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rng = random.Random(3)
    some = sorted({"".join(rng.choice("abeß") for _ in range(rng.randint(2, 8))) for _ in range(900)} | {"a" * k for k in range(1, 45)} | {"e" * 40 + "b", "e" * 40 + "ß"})
    a = spelling.Words(some)
    i, j = spelling.verified(a, *(lambda x: (x[0], a, x[1]))(spelling.Trie(a).leaves(a.counts)))
    found = {(some[x], some[y]) for x, y in zip(i, j)}
    assert {p for p in found} | {(y, x) for x, y in found} == {(x, y) for x in some for y in some if edits(x, y)}
    once = [(x, y) for x, y in zip(i, j) if a.key[y] >= a.key[x]]
    assert len(set(once)) == len(once)
