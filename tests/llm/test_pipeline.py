"""Every stage of the corpus pipeline against a plain version, over nulls, empty and repeated rows, clashing names and no rows."""

import base64
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from trackfields.llm import mixing

from .test_operators import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, kept_lines int, position double, toxicity string"
VILE = "vilesome gruntish snarlow"


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def similar(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = words(80, 70)
    texts = [words(rng.randint(20, 60), 300 + i) + (f" {VILE}" * 3 if i % 5 == 0 else "") for i in range(150)]
    near = base.split()
    near[40] = "changed"
    texts += [base, base, " ".join(near), None, "", " \n\t", "one line here\n" + words(12, 71), words(12, 72) + "\none line here", words(3000, 73)]
    return [(i, t, "en", None if i % 7 == 6 else f"s{i % 3}", len(t or ""), "x", 1, 0.5, "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def staged(spark, corpus, tmp_path_factory):
    """The rows before and after each stage."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([*corpus, corpus[151], (None, words(30, 74), None, None, None, None, None, None, None)], SCHEMA)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(VILE in (t or ""))) for i, t, *_ in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    out, d = [], spark.read.parquet(f"{at}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, d, at)
        after.write.parquet(f"{at}/{k}")
        after = spark.read.parquet(f"{at}/{k}")
        out.append((d.collect(), after.collect(), d.columns, after.columns))
        d = after
    return out


def test_toxicity_keeps_clean_rows(staged):
    before, after, columns, kept = staged[0]
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in after)
    assert columns == kept and {r.toxicity for r in after} <= {"y", None} and left == sorted((r.doc_id is None, r.doc_id or 0) for r in before if VILE not in (r.text or ""))


def test_line_dedup(staged):
    before, after, columns, kept = staged[1]
    assert columns == kept and len(before) == len(after)
    lines = sorted((r.doc_id, k, set(w.lower() for w in plain_words(s))) for r in before if r.doc_id is not None for k, s in enumerate((r.text or "").split("\n")))
    stays = {(d, k) for i, (d, k, s) in enumerate(lines) if not s or not any(similar(s, o, 80) for e, j, o in lines[:i] if (e, j) != (d, k))}
    for r in after:
        text = next(b.text for b in before if b.doc_id == r.doc_id)
        want = text if r.doc_id is None or text is None else "\n".join(s for k, s in enumerate(text.split("\n")) if (r.doc_id, k) in stays)
        assert r.text == want and (r.n_chars == len(want or ""))


def test_near_copies(staged):
    before, after, columns, kept = staged[2]
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := plain_words((r.text or "").lower())) else set() for r in before if r.doc_id is not None}
    first = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if first[b] < first[a] and similar(sets[a], sets[b], 80):
                    first[a] = first[b]
        if all(first[first[d]] == first[d] for d in first):
            break
    assert columns == kept
    assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if r.doc_id is None or first[r.doc_id] == r.doc_id)


def test_mixing(staged):
    before, after, columns, kept = staged[3]
    assert kept == [c for c in columns if c != "position"] + ["copy", "position"]
    sizes, taken = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(plain_words(r.text))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(plain_words(r.text))
        assert r.copy < 2 and 0 <= r.position <= 1
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), dict(weights)
    while open_:  # water filling: sources at their limit leave the rest to the others
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] >= 2 * sizes[s]]
        if not full:
            goal |= {s: level * w for s, w in open_.items()}
            break
        for s in full:
            goal[s] = 2 * sizes[s]
            left -= goal[s]
            del open_[s]
    largest = max(len(plain_words(r.text)) for r in before)
    assert all(abs(taken.get(s, 0) - goal[s]) <= largest / 2 + 1 for s in sizes)


def test_encoding(staged):
    before, after, _, _ = staged[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(pipeline.BPE_RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(r.doc_id), r.copy, tuple(own.encode_ordinary(r.text or ""))) for r in before)
    assert sorted((str(r.doc_id), r.copy, tuple(r.ids)) for r in after) == want and all(r.n_tokens == len(r.ids) for r in after)


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0


def test_columns_with_clashing_names(spark):
    from trackfields.llm import byte_bpe, line_dedup, ngram_join

    rows = [(1, "a b c d e f g h", 1, 2, 3, 4, "x", "y"), (2, "a b c d e f g h\nanother line", 5, 6, 7, 8, "x", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, doc int, lines int, kept_lines int, gone int, bpe string, n_lines string")
    got = {r.doc_id: r for r in line_dedup.dedup(d).collect()}
    assert got[2].text == "another line" and (got[2].doc, got[2].lines, got[2].kept_lines) == (5, 6, 7) and got[2].n_lines == 2
    assert {r.doc_id: r.gone for r in ngram_join.keep_first(d).collect()} == {1: 4, 2: 8}
    assert [r.bpe for r in byte_bpe.encode(d, pipeline.BPE_RANKS).select(F.col("bpe")).collect()] == ["x", "x"]
