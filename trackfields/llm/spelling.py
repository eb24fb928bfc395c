"""Groups spelling variants: words one edit apart, each under its most frequent form.

Candidates come from a trie of letter-group counts. Letters are cut into groups; a word's vector holds how many of its letters
fall into each (``MOST`` at most), and words are arranged by these counts, one group per level. One inserted code point adds one to
one count, a deleted one takes one away, a replaced one does both or neither, so a depth-first search from a word's vector spends
at most a surplus and a deficit of one on its way down. Of two words the search starts from the one whose first differing count is the smaller, so a
surplus is spent before a deficit and each pair is met once, or from both sides where the vectors are equal. A block of words
goes down together. The words of the leaves reached are verified letter by letter.

The first ``TOP`` levels deal the vocabulary to shards: a word lies in one of them and is looked up in those that its budget
reaches (4 at most). A shard of over ``TILE`` words is cut into tiles by hash, and so are the words looked up in it: a task holds
one tile of each, whatever the vocabulary's size, and every word meets every tile of the shards it reaches, so nothing is lost.

Edge cases: null and empty texts have no words; a null id counts as an empty one in the hash; repeated rows count as often as they
occur; among near words of equal frequency the first in code-point order is the form; an empty table gives no rows;
extra columns are dropped; a very long run of letters is one word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of similar total frequency in each group; all others go to the last one.
GROUPS = ("e", "a", "i", "n", "r", "s", "t", "o", "l", "u", "d", "c", "m", "p", "g", "h", "b", "vf", "kw", "jqxyz")
LEVELS, TOP, MOST = len(GROUPS) + 1, 2, 7
TILE, BUCKET, BLOCK, PAIRS = 100_000, 4, 10_000, 200_000
#: Letters that verification compares at once; longer words are compared one by one.
WIDTH = 32
#: Of two words one edit apart, of HEAD + TAIL letters or more, the first HEAD letters agree or the last TAIL ones.
HEAD, TAIL = 4, 3
LEAST_LENGTH, LEAST_N, FACTOR, EVERY = 7, 2, 10, 31
#: The largest number of forms that can follow each other, as powers of FACTOR within 64 bits, is below 2 to this.
DOUBLINGS = 5


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH letters; a run whose crc32 with the document's id EVERY divides loses one letter."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}+"), F.lit(0))
    d = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
    cut = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run")))).otherwise(F.col("run"))
    d = d.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return d.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


def top_counts(word: Column) -> list[Column]:
    return [(F.length(word) - F.length(F.translate(word, g, ""))).cast("int") for g in GROUPS[:TOP]]


def shard(counts: list[Column]) -> Column:
    """A number for the counts of the first groups, each held within 0 and MOST."""
    out = F.lit(0)
    for c in counts:
        out = out * (MOST + 1) + F.greatest(F.lit(0), F.least(c, F.lit(MOST)))
    return out


def reached(counts: list[Column]) -> Column:
    """The shards that a surplus and then a deficit reach."""
    moves = [()] + [(i,) for i in range(TOP)] + [(i, j) for i in range(TOP) for j in range(i + 1, TOP)]
    step = lambda m, i: (m[:1] == (i,)) - (m[1:] == (i,))
    return F.array_distinct(F.array(*[shard([c + step(m, i) for i, c in enumerate(counts)]) for m in moves]))


LETTERS = np.full(256, len(GROUPS))
for _i, _g in enumerate(GROUPS):
    LETTERS[[ord(c) for c in _g]] = _i


class Words:
    """A tile's words: their letters from the left and from the right, and their vectors."""

    def __init__(self, words: list[str]):
        self.words, self.size = words, np.array([len(w) for w in words])
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)  # all letters are within Latin-1
        of = np.repeat(np.arange(len(words)), self.size)
        counts = np.bincount(of * LEVELS + LETTERS[letters], minlength=len(words) * LEVELS).reshape(-1, LEVELS)
        self.counts = np.minimum(counts, MOST)
        self.key = np.zeros(len(words), np.int64)  # the vector as one number, in the same order
        for c in self.counts.T:
            self.key = self.key * (MOST + 1) + c
        at = np.arange(len(letters)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        back = self.size[of] - 1 - at
        self.left, self.right = np.zeros((2, len(words), WIDTH), np.uint8)
        self.left[of[at < WIDTH], at[at < WIDTH]] = letters[at < WIDTH]
        self.right[of[back < WIDTH], back[back < WIDTH]] = letters[back < WIDTH]


class Trie:
    """Nodes of the vectors' successive counts down to ``BUCKET`` words; ``child`` is -1 where no word goes on."""

    def __init__(self, words: Words):
        self.order = np.argsort(words.key, kind="stable")
        key = words.key[self.order]
        begin, end, node = np.zeros(1, int), np.full(1, len(key)), np.zeros(1, int)
        self.begin, self.end, leaf, children = [begin], [end], [np.array([len(key) <= BUCKET])], []
        total = 1
        for level in range(LEVELS):
            open_ = (~leaf[-1]).nonzero()[0]
            size = end[open_] - begin[open_]
            row = np.arange(size.sum()) + np.repeat(begin[open_] - (np.cumsum(size) - size), size)
            of, prefix = np.repeat(node[open_], size), key[row] // (MOST + 1) ** (LEVELS - 1 - level)
            new = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1])]) if len(row) else np.zeros(0, int)
            begin, end = row[new], row[np.r_[new[1:] - 1, len(row) - 1]] + 1 if len(row) else np.zeros(0, int)
            node = total + np.arange(len(new))
            total += len(new)
            children.append((of[new], prefix[new] % (MOST + 1), node))
            self.begin.append(begin)
            self.end.append(end)
            leaf.append((end - begin <= BUCKET) | (level == LEVELS - 1))
        self.begin, self.end, self.leaf = np.concatenate(self.begin), np.concatenate(self.end), np.concatenate(leaf)
        self.child = np.full((total, MOST + 3), -1, np.int32)  # a count of -1 and one above MOST are never there
        for of, count, to in children:
            self.child[of, count + 1] = to

    def leaves(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a block of vectors: (vector, word) of all leaves within a surplus and then a deficit of one each, depth first."""
        who, which = [], []
        open_ = [(0, 0, np.arange(len(counts)), np.zeros(len(counts), np.int32))]
        while open_:
            level, spent, q, node = open_.pop()
            done = self.leaf[node]
            if done.any():
                size = (self.end - self.begin)[node[done]]
                who.append(np.repeat(q[done], size))
                which.append(np.arange(size.sum()) + np.repeat(self.begin[node[done]] - (np.cumsum(size) - size), size))
                q, node = q[~done], node[~done]
            if not len(q):
                continue
            at = counts[q, level] + 1
            for step, after in ((0, spent), *(((1, 1),) if spent == 0 else ((-1, 2),) if spent == 1 else ())):
                to = self.child[node, at + step]
                good = to >= 0
                if good.any():
                    open_.append((level + 1, after, q[good], to[good]))
        who, which = (np.concatenate(x) if x else np.zeros(0, int) for x in (who, which))
        return who, self.order[which]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def verified(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of words that are one edit apart."""
    good = np.abs(a.size[i] - b.size[j]) <= 1
    i, j = i[good], j[good]
    ends = (a.left[i, :HEAD] == b.left[j, :HEAD]).all(1) | (a.right[i, :TAIL] == b.right[j, :TAIL]).all(1) | (np.minimum(a.size[i], b.size[j]) < HEAD + TAIL)
    i, j = i[ends], j[ends]
    differ = a.left[i] != b.left[j]
    back = a.right[i] != b.right[j]
    same = np.where(differ.any(1), differ.argmax(1), WIDTH) + np.where(back.any(1), back.argmax(1), WIDTH)  # letters that agree from both ends
    good = np.where(a.size[i] == b.size[j], differ.sum(1) == 1, same >= np.minimum(a.size[i], b.size[j]))
    for k in np.flatnonzero(np.maximum(a.size[i], b.size[j]) > WIDTH):
        good[k] = one_edit(a.words[i[k]], b.words[j[k]])
    return i[good], j[good]


NEAR = "word string, near string, near_n long"


def look_up(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """(word, near, its n): the pairs between asked words and entries, both ways, as far as the search starts from the asked word."""
    none = pd.DataFrame({"word": np.zeros(0, object), "near": np.zeros(0, object), "near_n": np.zeros(0, np.int64)})
    if not len(entries) or not len(asked):
        return none
    b = Words(entries["word"].tolist())
    tree = Trie(b)
    out = []
    for begin in range(0, len(asked), BLOCK):
        block = asked[begin : begin + BLOCK]
        a = Words(block["asked"].tolist())
        i, j = tree.leaves(a.counts)
        parts = len(i) // PAIRS + 1
        found = [verified(a, some, b, others) for some, others in zip(np.array_split(i, parts), np.array_split(j, parts))]
        i, j = (np.concatenate(x) for x in zip(*found))
        mine = b.key[j] >= a.key[i]
        both = b.key[j] > a.key[i]
        x, y = block["asked"].to_numpy(object), entries["word"].to_numpy(object)
        n, m = block["asked_n"].to_numpy(np.int64), entries["n"].to_numpy(np.int64)
        out.append(pd.DataFrame({"word": np.concatenate([x[i[mine]], y[j[both]]]), "near": np.concatenate([y[j[mine]], x[i[both]]]), "near_n": np.concatenate([m[j[mine]], n[i[both]]])}))
    return pd.concat(out)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words (word, n) one edit apart, both ways."""
    counts = top_counts(F.col("word"))
    entries = words.select("word", "n", shard(counts).alias("shard"))
    asked = words.select(F.col("word").alias("asked"), F.col("n").alias("asked_n"), F.explode(reached(counts)).alias("shard"))
    # (MOST + 1) ** TOP rows at most.
    sizes = entries.groupBy("shard").agg(F.ceil(F.count("*") / TILE).cast("int").alias("a")).join(asked.groupBy("shard").agg(F.ceil(F.count("*") / TILE).cast("int").alias("b")), "shard")
    sizes = F.broadcast(sizes)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    entries = entries.join(sizes, "shard").select("shard", F.pmod(F.xxhash64("word"), F.col("a")).cast("int").alias("i"), every("b").alias("j"), "word", "n")
    asked = asked.join(sizes, "shard").select("shard", every("a").alias("i"), F.pmod(F.xxhash64("asked"), F.col("b")).cast("int").alias("j"), "asked", "asked_n")
    tile = ["shard", "i", "j"]
    return entries.groupBy(*tile).cogroup(asked.groupBy(*tile)).applyInPandas(look_up, NEAR)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form_n, form): the most frequent near word of each word (word, n), whatever its frequency; null if none."""
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    return words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.n")).alias("form_n"), F.col("best.near").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by doubling the steps."""
    t = saved(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    for _ in range(DOUBLINGS):
        step = t.alias("a").join(t.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        far = saved(step.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "spelling-roots")
        if far.where("moved").isEmpty():
            return t
        t = far.select("word", "root")
    return t


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n, n_near, form, form_n, root: every word that occurs often enough, its near words, its form and the last of its forms."""
    words = saved(occurrences(docs, text, key), "spelling-words")
    near = near_words(words)
    good = F.col("form_n") >= FACTOR * F.col("n")
    d = saved(near.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "spelling-near")
    return d.join(roots(d.where("form is not null")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
