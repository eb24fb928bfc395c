"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the words (runs of letters, lower case) of the labelled examples, all of them. A term's weight in a text is
``(1 + log tf) * idf * tell``: idf counts all documents, and ``tell`` is the absolute log odds of the labels given the term,
from the examples. Without ``tell``, chance repeats of rare words outweigh what the labels are about. Examples are sorted into blocks of
``BLOCK``; a term's posting list is cut into these blocks, each with its greatest weight. What the ``COMMON`` commonest terms add
to the cosines is a matrix product over all examples, as their lists cover most blocks anyway; of the other terms a text adds up
the greatest weights. Both make a bound per block. A text scores its ``FIRST`` best blocks exactly, and then all blocks whose bound
reaches the k-th best cosine so far, so the neighbours found are the true ones. Votes are weighted by cosine and made into
probabilities by a logistic curve that is fitted on the examples themselves, each left out of its own neighbours; tasks score
them, the driver solves for the curve's three numbers.

The labelled examples are a bounded sample, taken by hash of the id: at most ``EXAMPLES`` rows, and as many as together have
``SAMPLE_WORDS`` words (the first in any case). They are what the classifier is fitted on; their index, which is broadcast,
has a posting for each word of theirs at most.

Edge cases: null and empty texts have no terms and get the score of a text without neighbours; rows without a label, or with
another label than 0 and 1, are no examples; a document labelled twice counts as toxic if either says so; of several texts of an
example's id the least by hash counts; without examples of both kinds every score is 0.25. Other columns pass through unless called
``toxicity``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import LETTER, class_table
from .common import small_batches, words_count
from .fingerprints import _INVERSE, ODD, _mix, _powers

EXAMPLES, SAMPLE_WORDS = 4096, 1 << 21
BLOCK, FIRST, NEIGHBOURS = 256, 2, 16
#: Terms whose weights in all examples are held as a matrix.
COMMON = 256
#: Examples that a task scores at once, for the calibration.
STRETCH = 8
#: Characters handled together; what they expand to should stay in a core's cache.
SLICE = 60_000


class Model(NamedTuple):
    terms: np.ndarray  # sorted hashes
    weight: np.ndarray  # idf * tell, by term
    cuts: np.ndarray  # by term: where its blocks begin in the next two
    block: np.ndarray
    most: np.ndarray  # the greatest weight of the term in the block
    posts: np.ndarray  # by block of a term: where its postings begin in the next two
    example: np.ndarray
    value: np.ndarray  # weights of the examples' unit vectors
    labels: np.ndarray
    ids: np.ndarray
    curve: np.ndarray  # of the logistic calibration: 1, vote, nearness


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text is no multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


@lru_cache(1)
def _letters() -> np.ndarray:
    """A number for each code point."""
    return _mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(ODD))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, in order, and the number of the text it belongs to."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le"), np.uint32)
    letter = class_table()[points] == LETTER
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_letters()[points] * _powers(ODD, len(points)), out=sums[1:])
    hashes = _mix((sums[stops] - sums[starts]) * _powers(_INVERSE, len(points))[starts]) if len(starts) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in lower])
    return hashes, np.searchsorted(ends, starts, side="right")


def slices(texts: list[str]) -> Iterator[list[str]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield texts[begin:i]
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield texts[begin:]


def counts(texts: list[str], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the known terms, by text and term."""
    hashes, of = words(texts)
    if not len(terms):
        return (np.zeros(0, np.int64),) * 3
    place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    good = terms[place] == hashes
    pair, n = np.unique(of[good] * len(terms) + place[good], return_counts=True)
    return pair // len(terms), pair % len(terms), n


def _texts(s: pd.Series) -> list[str]:
    return ["" if t is None else t for t in s.where(s.notna(), None)]


def _ranges(begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the length of each range."""
    n = stop - begin
    out = np.repeat(begin - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out, n


def unit(of: np.ndarray, term: np.ndarray, n: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The weights of (text, term, count) in unit vectors."""
    w = (1 + np.log(n)) * weight[term]
    return w / np.maximum(np.sqrt(np.bincount(of, w * w, texts)), 1e-12)[of]


def indexed(of: np.ndarray, term: np.ndarray, value: np.ndarray, terms: int) -> dict[str, np.ndarray]:
    """The posting lists of examples' vectors, cut into blocks."""
    order = np.lexsort((of, term))
    of, term, value = of[order], term[order], value[order]
    key = term * (1 << 20) + of // BLOCK
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(value, first) if len(first) else np.zeros(0)
    return {
        "cuts": np.searchsorted(term[first], np.arange(terms + 1)), "block": (of[first] // BLOCK).astype(np.int32), "most": most.astype(np.float32) * np.float32(1 + 1e-6),
        "posts": np.append(first, len(of)), "example": of.astype(np.int32), "value": value.astype(np.float32),
    }


def common(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(place by term, -1 for the others; values by place and example) of the terms that most examples have, ``COMMON`` at most."""
    many = m.posts[m.cuts[1:]] - m.posts[m.cuts[:-1]] if len(m.terms) else np.zeros(0, np.int64)
    chosen = np.argsort(-many, kind="stable")[:COMMON]
    chosen = chosen[many[chosen] * 32 >= len(m.ids)]
    place = np.full(len(m.terms), -1)
    place[chosen] = np.arange(len(chosen))
    post, n = _ranges(m.posts[m.cuts[chosen]], m.posts[m.cuts[chosen + 1]])
    values = np.zeros((len(chosen), -(-len(m.ids) // BLOCK) * BLOCK))
    values[np.repeat(np.arange(len(chosen)), n), m.example[post]] = m.value[post]
    return place, values


def nearest(
    m: Model, of: np.ndarray, term: np.ndarray, value: np.ndarray, texts: int, skip: np.ndarray | None = None, dense: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, example, cosine) of each text's nearest examples with a positive cosine, nearest first, ties to the earlier example.

    ``skip``: for each text an example that doesn't count. ``dense``: ``common(m)``, if it is at hand.
    """
    place, values = common(m) if dense is None else dense
    blocks, at = -(-len(m.ids) // BLOCK), place[term]
    often = at >= 0
    mine = np.zeros((texts, len(values)))
    mine[of[often], at[often]] = value[often]
    shared = mine @ values  # of the common terms: exact for every example, so only the other terms need bounds
    of, term, value = of[~often], term[~often], value[~often]
    entry, n = _ranges(m.cuts[term], m.cuts[term + 1])
    where, weight = np.repeat(of * blocks, n) + m.block[entry], np.repeat(value, n)
    bound = np.bincount(where, m.most[entry] * weight, texts * blocks).reshape(texts, blocks) + shared.reshape(texts, blocks, BLOCK).max(2)

    def exact(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = chosen.ravel()
        slot = np.cumsum(flat) - 1
        here = flat[where]
        e = entry[here]
        post, n = _ranges(m.posts[e], m.posts[e + 1])
        # An example's place in its block, in the slot of the text and the block.
        spot, part = np.repeat(slot[where[here]] * BLOCK - m.block[e] * BLOCK, n), np.repeat(weight[here], n)
        spot += m.example.take(post)
        part *= m.value.take(post)
        every = np.bincount(spot, part, (slot[-1] + 1) * BLOCK if len(slot) else 0).reshape(-1, BLOCK) + shared.reshape(-1, BLOCK)[flat]
        # The product's last bits depend on how many texts share it; rounded, equal examples stay equal.
        every = np.round(every.ravel(), 9)
        good = np.flatnonzero(every > 1e-9)
        which = np.flatnonzero(flat)[good // BLOCK]
        t, x, cos = which // blocks, which % blocks * BLOCK + good % BLOCK, every[good]
        if skip is not None:
            keep = x != skip[t]
            t, x, cos = t[keep], x[keep], cos[keep]
        return t, x, cos

    def best(t: np.ndarray, x: np.ndarray, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((x, -cos, t))
        t, x, cos = t[order], x[order], cos[order]
        keep = np.arange(len(t)) - np.searchsorted(t, t) < NEIGHBOURS
        return t[keep], x[keep], cos[keep]

    some = np.zeros_like(bound, bool)
    np.put_along_axis(some, np.argpartition(-bound, min(FIRST, blocks) - 1, axis=1)[:, :FIRST], True, 1)
    t, x, cos = best(*exact(some & (bound > 0)))
    kth = np.zeros(texts)
    last = np.searchsorted(t, np.arange(texts)) + NEIGHBOURS - 1
    full = np.bincount(t, minlength=texts) >= NEIGHBOURS
    kth[full] = cos[last[full]]
    rest = exact((bound > 0) & (bound >= kth[:, None] - 1e-6) & ~some)
    high = rest[2] >= kth[rest[0]]
    return best(*(np.concatenate([u, v[high]]) for u, v in zip((t, x, cos), rest)))


def evidence(m: Model, t: np.ndarray, x: np.ndarray, cos: np.ndarray, texts: int) -> np.ndarray:
    """1, the cosine-weighted vote (minus a half) and how near the neighbours are; 1, -0.5, 0 without neighbours."""
    n, total = np.bincount(t, minlength=texts), np.bincount(t, cos, texts)
    vote = np.bincount(t, cos * m.labels[x], texts) / np.maximum(total, 1e-12) - 0.5
    return np.stack([np.ones(texts), vote, total / np.maximum(n, 1)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps of a logistic regression with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
    return w


def examples(docs: DataFrame, labels: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, toxic, text) of the labelled sample."""
    named = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = named.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(EXAMPLES)
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    one = chosen.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.text")
    # A running count over EXAMPLES rows at most.
    before = F.sum(words_count(F.col("text"))).over(Window.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return one.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE_WORDS).drop("before")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    d = small_batches(docs)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for some in slices(_texts(rows["text"])):
                hashes, of = words(some)
                cut = np.searchsorted(of, np.arange(len(some) + 1))
                out += [tuple(v.view(np.int64) for v in np.unique(hashes[i:j], return_counts=True)) for i, j in zip(cut, cut[1:])]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "toxic": rows["toxic"], "terms": [x for x, _ in out], "n": [y for _, y in out]})

    # As Arrow: a list of Python numbers per example would take several times the driver's memory.
    rows = examples(d, labels, text, key).mapInPandas(bags, "doc_id long, toxic int, terms array<long>, n array<long>").toArrow().sort_by("doc_id").combine_chunks()
    ids, y = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(float)
    none = np.zeros(0, np.int64)
    if not 0 < y.sum() < len(y):
        return Model(none.view(np.uint64), none, np.zeros(1, np.int64), none, none, np.zeros(1, np.int64), none, none, none, none, np.array([np.log(1 / 3), 0, 0]))
    sizes, total = pc.list_value_length(rows["terms"]).to_numpy(), len(ids)
    of, n = np.repeat(np.arange(total), sizes), pc.list_flatten(rows["n"]).to_numpy()
    terms, term = np.unique(pc.list_flatten(rows["terms"]).to_numpy().view(np.uint64), return_inverse=True)
    del rows
    shared = d.sparkSession.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        df, seen = np.zeros(len(known), np.int64), 0
        for rows in batches:
            texts = _texts(rows["text"])
            seen += len(texts)
            for some in slices(texts):
                df += np.bincount(counts(some, known)[1], minlength=len(known))
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": np.concatenate([[-1], at]), "n": np.concatenate([[seen], df[at]])})

    found = d.select(F.col(text).alias("text")).mapInPandas(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the sample
    at, seen = found["at"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(len(terms))
    df[at[at >= 0]] = seen[at >= 0]
    idf = np.log((1 + float(seen[at < 0].sum())) / (1 + df))
    pos, every = np.bincount(term, y[of], len(terms)), np.bincount(term, minlength=len(terms))
    odds = np.log((pos + 0.5) / (every - pos + 0.5)) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    weight = np.maximum(idf, 1e-3) * np.abs(odds)
    value = unit(of, term, n, weight, total)
    # Like examples share blocks, which keeps the bounds tight: they are sorted by their heaviest term.
    heavy = np.lexsort((value, of))[np.cumsum(sizes)[sizes > 0] - 1]
    top = np.full(total, -1)
    top[of[heavy]] = term[heavy]
    order = np.lexsort((ids, top))
    rank = np.argsort(order)
    model = Model(terms, weight, **indexed(rank[of], term, value, len(terms)), labels=y[order], ids=ids[order], curve=np.zeros(3))
    return model._replace(curve=_logistic(_left_out(d.sparkSession, model, sizes, term, value, rank), y))


def _left_out(spark: SparkSession, model: Model, sizes: np.ndarray, term: np.ndarray, value: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The evidence of each example without itself, found by tasks of ``STRETCH`` examples at once."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    shared = spark.sparkContext.broadcast((model, cuts, term.astype(np.int32), value, rank))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cuts, term, value, rank = shared.value
        dense = common(m)
        for rows in batches:
            for i in rows["id"].tolist():
                part = np.arange(i * STRETCH, min((i + 1) * STRETCH, len(rank)))
                here = slice(cuts[part[0]], cuts[part[-1] + 1])
                of = np.repeat(np.arange(len(part)), np.diff(cuts[part[0] : part[-1] + 2]))
                seen = evidence(m, *nearest(m, of, term[here].astype(np.int64), value[here], len(part), rank[part], dense), len(part))
                yield pd.DataFrame({"at": part, "vote": seen[:, 1], "near": seen[:, 2]})

    stretches = -(-len(rank) // STRETCH)
    found = spark.range(0, stretches, 1, min(stretches, 64)).mapInPandas(run, "at long, vote double, near double").toArrow()
    shared.destroy()
    out = np.ones((len(rank), 3))
    out[found["at"].to_numpy(), 1:] = np.stack([found["vote"].to_numpy(), found["near"].to_numpy()], axis=1)
    return out


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``: (score, neighbours: the ids of the nearest examples, cosines)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        dense = common(m)
        for s in batches:
            p, near, cosines = [], [], []
            for some in slices(_texts(s)):
                of, term, n = counts(some, m.terms)
                t, x, cos = nearest(m, of, term, unit(of, term, n, m.weight, len(some)), len(some), dense=dense) if len(m.ids) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
                z = evidence(m, t, x, cos, len(some)) @ m.curve
                p.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                cut = np.searchsorted(t, np.arange(len(some) + 1))
                near += [m.ids[x[i:j]] for i, j in zip(cut, cut[1:])]
                cosines += [cos[i:j] for i, j in zip(cut, cut[1:])]
            yield pd.DataFrame({"score": np.concatenate(p) if p else np.zeros(0), "neighbours": near, "cosines": cosines})

    return small_batches(docs).withColumn(name, F.pandas_udf(run, "score double, neighbours array<bigint>, cosines array<double>")(F.col(text)))
