"""N-gram Jaccard join: documents whose sets of word shingles are similar, as components.

A ``Rule`` says how many words a shingle has and what similarity links two sets, in percent. Equal sets are collapsed to one
representative first. Two similar sets share a shingle among the first ``n - ceil(similarity * n) + 1`` of each in a common
order (rare ones first, by counts over all documents in a hash table of fixed size), so each set is dealt to a tile per such
shingle. A tile is sorted by set size and worked in bands of compatible sizes: a set meets only those from its lower size
bound on. A pair is tested on hashed bitmaps of the sets first, whose bit counts bound the overlap from above, and then by
intersecting the sorted arrays of shingle hashes.

Tiles are worked in rounds, so a tile of many near copies does not make all its pairs: first each set meets a few
neighbours by size; then, with the components so far, each set meets the one set of another component that its bitmap finds
likeliest, which joins nearly all that belong together; at last all sets of still different components meet. The later
rounds work in tiles of bounded size, and leave out those whose sets have all met. Within one component nothing more can change the result. Components are found by
minimum labels with pointer jumping. A shingle of more than ``HOT`` sets is dealt to several tasks in every round.

Shingles are compared by 64-bit hashes, sets by 128 bits. Arrays are made again from texts, for candidates only; a bit table
of fixed size keeps most other texts out of the shuffle.

Edge cases: documents without words or with a null text have size 0 and link with nothing; fewer words than a shingle has
make one shingle of the whole sequence; rows that share a doc_id count as linked, each text with its own set; a null
doc_id has a null component and takes no part; ids are below 2**62; other columns are dropped by ``components`` and kept by
``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, discard, free, in_table, saved, small_batches
from .fingerprints import _BYTES, _INVERSE, ODD, _mix, _powers


class Rule(NamedTuple):
    words: int = 5
    percent: int = 80


BUCKETS, BITS = 1 << 18, 1 << 24
#: How many rows back a set meets others in its tile at first; rounds in which it meets its likeliest partner, before all that are left meet.
BACK, LIKELIEST = 6, 2
#: Sets of a shingle that one task holds while they meet their neighbours.
HOT = 16_384
#: Rows of a tile that one task compares; pairs that it holds at once.
TILE, PAIRS = 2_000, 500_000
#: Bytes of text handled together.
SLICE = 500_000


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raws = [(t or "").encode() for t in texts]
    out, begin, held = [], 0, 0
    for i, r in enumerate(raws):
        if held and held + len(r) > SLICE:
            out += _shingles(raws[begin:i], words)
            begin, held = i, 0
        held += len(r) + 1
    return out + (_shingles(raws[begin:], words) if begin < len(raws) else [])


def _shingles(raws: list[bytes], words: int) -> list[np.ndarray]:
    steps = [np.uint64(pow(ODD, 2 * k + 3, 1 << 64)) for k in range(words)]
    b = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    b = b + ((b >= 65) & (b <= 90)) * np.uint8(32)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * _powers(ODD, len(b)), out=sums[1:])
    w = _mix((sums[stops] - sums[starts]) * _powers(_INVERSE, len(b))[starts] if len(starts) else np.zeros(0, np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raws])
    cut = np.concatenate([[0], np.searchsorted(starts, ends)])
    full = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        full += w[k : k + len(full)] * steps[k]
    full = _mix(full)
    out = []
    for i, j in zip(cut.tolist(), cut[1:].tolist()):
        if j - i >= words:
            out.append(np.unique(full[i : j - words + 1]))
        elif j > i:
            out.append(_mix(np.array([(w[i:j] * np.array(steps[: j - i])).sum() + np.uint64(j - i)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(a: np.ndarray) -> bytes:
    """A bit per shingle hash; two bits of room per shingle, rounded up to a power of two."""
    size = max(64, 1 << (2 * len(a) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(a >> np.uint64(20)).astype(np.int64) & (size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(x: bytes, n: int, y: bytes, m: int) -> int:
    """No overlap of the sets can be larger: each bit that only one bitmap has is a shingle that only that set has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):  # a larger bitmap folds onto a smaller one
        a = np.bitwise_or.reduce(a.reshape(-1, len(b)), axis=0)
    elif len(b) > len(a):
        b = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    only = np.bitwise_count(np.stack([a & ~b, b & ~a])).sum(axis=1)
    return min(n - int(only[0]), m - int(only[1]))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _rarity(docs: DataFrame, rule: Rule) -> bytes:
    """For each bucket of hashes a byte that grows with its count over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for rows in batches:
            for a in shingles(rows["text"].tolist(), rule.words):
                np.add.at(total, _bucket(a), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"b": at, "n": total[at]})

    found = docs.select("text").mapInPandas(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
    found = found.select("b", F.least(F.lit(255), F.round(8 * F.log2(1 + F.col("n")))).cast("int").alias("r"))
    table = np.zeros(BUCKETS, np.uint8)
    rows = found.toPandas()  # BUCKETS rows at most
    table[rows["b"].to_numpy(int)] = rows["r"].to_numpy(int)
    return table.tobytes()


def _sets(docs: DataFrame, rarity: bytes, rule: Rule) -> DataFrame:
    """doc, n, two set hashes, the first shingles by rarity, bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.frombuffer(shared.value, np.uint8)
        for rows in batches:
            out = []
            for doc, a in zip(rows["doc"], shingles(rows["text"].tolist(), rule.words)):
                n = len(a)
                first = n - -(-rule.percent * n // 100) + 1 if n else 0
                order = np.lexsort((a, rank[_bucket(a)]))[:first]
                h = int(a.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(_mix(a * np.uint64(ODD)))) if n else 0
                out.append((doc, n, *(x - (1 << 64) if x >> 63 else x for x in h), a[order].view(np.int64), bitmap(a) if n else b""))
            yield pd.DataFrame(out, columns=["doc", "n", "h1", "h2", "first", "bits"])

    return docs.mapInPandas(run, "doc long, n int, h1 long, h2 long, first array<long>, bits binary")


def _bounded(pairs: DataFrame, bits: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that the bitmaps leave."""
    both = pairs.join(bits.select(F.col("doc").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x")), "a")
    both = both.join(bits.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            most = np.array([overlap_bound(*r) for r in rows[["x", "n", "y", "m"]].itertuples(index=False)], np.int64)
            both = (rows["n"] + rows["m"]).to_numpy(np.int64)
            yield rows.loc[100 * most >= rule.percent * (both - most), ["a", "b"]]

    return both.mapInPandas(keep, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are links, by intersecting their sorted arrays."""
    ends = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    table = bit_table(ends.select(F.xxhash64("doc").alias("h")), BITS)
    some = docs.where(in_table(table, F.xxhash64("doc"))).join(ends, "doc", "left_semi")

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc": rows["doc"], "s": [a.tobytes() for a in shingles(rows["text"].tolist(), rule.words)]})

    sets = saved(some.mapInPandas(arrays, "doc long, s binary").dropDuplicates(["doc"]), "ngram-arrays")
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("s").alias("y")), "b")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            good = []
            for x, y in zip(rows["x"], rows["y"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * same >= rule.percent * (len(p) + len(q) - same))
            yield rows.loc[np.array(good, bool), ["a", "b"]]

    return both.mapInPandas(test, "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) of the nodes of ``links`` (a, b)."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        ends = both.join(labels.select(F.col("node").alias("b"), "component"), "b").join(labels.select(F.col("node").alias("a"), F.col("component").alias("was")), "a")
        # All nodes of a label move together, to the least label that any of them is linked with and on to that one's own label.
        least = ends.groupBy("was").agg(F.min("component").alias("least")).select("was", F.least("was", "least").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        moves = least.join(jump, "to").select("was", F.least("to", "far").alias("component"))
        new = saved(labels.withColumnRenamed("component", "was").join(moves, "was").select("node", "component", "was"), "labels")
        if new.where(F.col("component") != F.col("was")).isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _sizes_fit(n: Column, m: Column, rule: Rule) -> Column:
    return (100 * n >= rule.percent * m) & (100 * m >= rule.percent * n)


def _places_fit(n: Column, i: Column, m: Column, j: Column, rule: Rule) -> Column:
    """Positional filter: what follows the shared shingle in both orders can make up the overlap needed."""
    return F.least(n - i, m - j) >= F.ceil((n + m) * rule.percent / (100 + rule.percent) - 1e-9)


def _overlap_bounds(bits: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``overlap_bound`` of many pairs of rows; ``bits`` holds the rows' bitmaps as bytes."""
    sizes = np.fromiter(map(len, bits), np.int64, len(bits))
    out = np.zeros(len(x), np.int64)
    shapes = sizes[x] * (1 << 32) + sizes[y]
    for shape in np.unique(shapes):
        at = np.flatnonzero(shapes == shape)
        k, m = int(shape >> 32), int(shape & 0xFFFFFFFF)
        step = max(1, (8 << 20) // max(k, m))
        for part in np.split(at, range(step, len(at), step)):
            a = np.frombuffer(b"".join(bits[x[part]]), np.uint64).reshape(len(part), -1)
            b = np.frombuffer(b"".join(bits[y[part]]), np.uint64).reshape(len(part), -1)
            if k > m:  # a larger bitmap folds onto a smaller one
                a = np.bitwise_or.reduce(a.reshape(len(part), -1, m // 8), axis=1)
            elif m > k:
                b = np.bitwise_or.reduce(b.reshape(len(part), -1, k // 8), axis=1)
            only_a, only_b = (np.bitwise_count(v).sum(1, dtype=np.int64) for v in (a & ~b, b & ~a))
            out[part] = np.minimum(n[x[part]] - only_a, n[y[part]] - only_b)
    return out


def _survivors(rows: pd.DataFrame, tile: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows within tiles, of different components and blocks, that sizes, places and bitmaps leave, and their bounds in parts of 10,000.

    ``rows`` are in order of tile and size, so a row's partners are the stretch from its lower size bound up to itself.
    """
    doc, n, i, c, block = (rows[x].to_numpy(np.int64) for x in ("doc", "n", "i", "c", "block"))
    whole, bits = (rows["t1"] == rows["t2"]).to_numpy(), rows["bits"].to_numpy()
    key = tile * (1 << 32)
    low = np.searchsorted(key + n, key + -(-rule.percent * n // 100))
    count = np.arange(len(n)) - low
    ends = np.cumsum(count)
    begin = 0
    while begin < len(n):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
        x = np.repeat(np.arange(begin, stop), count[begin:stop])
        y = np.arange(len(x)) - np.repeat(np.cumsum(count[begin:stop]) - count[begin:stop], count[begin:stop]) + low[x]
        need = -(-rule.percent * (n[x] + n[y]) // (100 + rule.percent))
        keep = (c[y] != c[x]) & (doc[y] != doc[x]) & (np.minimum(n[x] - i[x], n[y] - i[y]) >= need) & (whole[x] | (block[y] != block[x]))
        x, y, need = x[keep], y[keep], need[keep]
        most = _overlap_bounds(bits, n, x, y)
        good = most >= need
        x, y, most = x[good], y[good], most[good]
        yield x, y, 10_000 * most // (n[x] + n[y] - most)
        begin = stop


def _all_pairs(rows: pd.DataFrame, tile: np.ndarray, rule: Rule) -> Iterator[pd.DataFrame]:
    doc = rows["doc"].to_numpy(np.int64)
    for x, y, _ in _survivors(rows, tile, rule):
        yield pd.DataFrame({"a": np.maximum(doc[x], doc[y]), "b": np.minimum(doc[x], doc[y])}).drop_duplicates()


def _likeliest(rows: pd.DataFrame, tile: np.ndarray, rule: Rule) -> Iterator[pd.DataFrame]:
    """For each row that has any, the partner of the greatest bound (ties: the greatest doc)."""
    doc = rows["doc"].to_numpy(np.int64)
    best, other = np.full(len(doc), -1, np.int64), np.zeros(len(doc), np.int64)
    for x, y, bound in _survivors(rows, tile, rule):
        row, to, value = np.concatenate([x, y]), np.concatenate([doc[y], doc[x]]), np.concatenate([bound, bound])
        order = np.lexsort((to, value, row))
        last = order[np.flatnonzero(np.append(row[order][1:] != row[order][:-1], True))] if len(order) else order
        at = row[last]
        better = (value[last] > best[at]) | ((value[last] == best[at]) & (to[last] > other[at]))
        best[at[better]], other[at[better]] = value[last][better], to[last][better]
    some = best >= 0
    yield pd.DataFrame({"a": doc[some], "b": other[some], "bound": best[some]})


def _within_tiles(mixed: DataFrame, bits: DataFrame, rule: Rule, likeliest: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that the filters leave, or each set's likeliest of them. Tiles beyond TILE rows are cut into pairs of blocks."""
    found = _likeliest if likeliest else _all_pairs
    parts = F.ceil(F.col("rows") / TILE).cast("int")
    block = F.pmod(F.xxhash64("doc"), parts).cast("int")
    cut = mixed.withColumn("parts", parts).withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("w", F.least("block", "o").alias("t1"), F.greatest("block", "o").alias("t2"), "block", "n", "i", "doc", "c")
    cut = cut.join(bits.select("doc", "bits"), "doc").repartition("w", "t1", "t2").sortWithinPartitions("w", "t1", "t2", "n", "doc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last, count = None, 0

        def work() -> Iterator[pd.DataFrame]:
            rows = pd.concat(held, ignore_index=True)
            tile = np.cumsum((rows[["w", "t1", "t2"]] != rows[["w", "t1", "t2"]].shift()).any(axis=1).to_numpy())
            yield from found(rows, tile, rule)

        for rows in batches:
            keys = rows[["w", "t1", "t2"]].to_numpy()
            changes = np.flatnonzero((keys != np.concatenate([keys[:1] if last is None else last, keys[:-1]])).any(axis=1))
            if count + len(rows) > 2 * TILE and len(changes):  # whole tiles only
                cut = int(changes[-1])
                held.append(rows.iloc[:cut])
                yield from work()
                held, count, rows = [], 0, rows.iloc[cut:]
            held.append(rows)
            count += len(rows)
            last = keys[-1:]
        if count:
            yield from work()

    if not likeliest:
        return cut.mapInPandas(run, "a long, b long").distinct()
    best = cut.mapInPandas(run, "a long, b long, bound long").groupBy("a").agg(F.max(F.struct("bound", "b")).alias("best"))
    return best.select(F.greatest("a", "best.b").alias("a"), F.least("a", "best.b").alias("b")).distinct()


def _dealt(tiles: DataFrame, rarity: bytes, every: Callable[[Column], DataFrame] | None = None) -> DataFrame:
    """``tiles`` with ``parts`` and ``part``: how many tasks share the shingle, 1 for up to HOT sets, and the set's own.

    Buckets of the rarity table that hold few shingles need no count; for the others, shingles are counted. ``every``
    gives the tiles' rows (w, doc) under a condition by a plan that shuffles no others.
    """
    full = np.frombuffer(rarity, np.uint8) >= int(8 * np.log2(1 + HOT))
    few = lambda d: d.withColumn("parts", F.lit(1)).withColumn("part", F.lit(0))
    if not full.any():
        return few(tiles)
    table = tiles.sparkSession.createDataFrame([(np.packbits(full, bitorder="little").view(np.int64).tolist(),)], "t array<bigint>").scalar()
    may = in_table((table, BUCKETS), F.call_function("shiftright", "w", F.lit(40)).bitwiseAND(F.lit(BUCKETS - 1)))
    counts = (tiles.where(may) if every is None else every(may)).groupBy("w").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT)
    counts = saved(counts.select("w", F.ceil(F.col("rows") / HOT).cast("int").alias("parts")), "ngram-hot")
    if counts.isEmpty():
        return few(tiles)
    some = tiles.where(may).join(counts, "w", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return few(tiles.where(~may)).unionByName(some.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")))


def _mixed(tiles: DataFrame, so_far: DataFrame) -> DataFrame:
    """w, i, n, doc, c (component), rows of the tiles that hold several components. Counts are combined before they are shuffled.

    In a tile of one task and no more than ``BACK`` + 1 sets, all have met at first, so it is left out.
    """
    mine = tiles.join(so_far, tiles["doc"] == so_far["node"], "left").select("w", "i", "n", "doc", F.coalesce("component", "doc").alias("c"))
    several = mine.groupBy("w").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("rows")).where("lo < hi").where(F.col("rows") > min(BACK + 1, HOT))
    return saved(mine.join(several.select("w", "rows"), "w"), "ngram-mixed")


def _one_text_each(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``d`` (doc, text) with a new id for each further text of an id, above all ids; and (doc, new) of those."""
    mark = F.coalesce(F.xxhash64("text"), F.lit(0))
    lowest = d.where("doc is not null").groupBy("doc").agg(F.min(mark).alias("lowest"))
    top = d.agg(F.max("doc")).head()[0] or 0
    fresh = F.lit(top + 1) + F.pmod(F.xxhash64("doc", mark), F.lit((1 << 62) - 1))
    both = d.join(lowest, "doc", "left").withColumn("new", F.when(mark == F.col("lowest"), F.col("doc")).otherwise(F.when(F.col("doc").isNotNull(), fresh)))
    both = saved(both.select("doc", "new", "text"), "ngram-texts")
    return both.select(F.col("new").alias("doc"), "text"), both.where("doc <> new").select("doc", "new").distinct()


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id per row of ``docs``."""
    d = small_batches(docs).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    rarity = _rarity(d, rule)
    sets = saved(_sets(d, rarity, rule), "ngram-sets")
    several = sets.where("doc is not null").groupBy("doc").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi")
    known, more = sets, None
    if not several.isEmpty():
        d, more = _one_text_each(d)
        rarity = _rarity(d, rule)
        known = saved(_sets(d, rarity, rule), "ngram-sets")
    real = known.where((F.col("n") > 0) & F.col("doc").isNotNull())
    classes = real.groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"))
    members = saved(real.select("doc", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("doc", "rep").distinct(), "ngram-members")
    first = members.where("doc = rep").select("doc")
    reps = real.join(first, "doc", "left_semi").dropDuplicates(["doc"])
    bits = reps.select("doc", "n", "bits")
    some = lambda may: real.select(F.explode("first").alias("w"), "doc").where(may).join(first, "doc", "left_semi").distinct()
    tiles = _dealt(reps.select(F.posexplode("first").alias("i", "w"), "n", "doc"), rarity, some)
    band = Window.partitionBy("w", "part").orderBy("n", "doc")
    near = tiles.withColumn("before", F.lag("n").over(band)).withColumn("after", F.lead("n").over(band))
    # A set without a neighbour of a compatible size in its tile has no partner there at all; a tile that is dealt to several tasks keeps all.
    fits = [F.coalesce(_sizes_fit(F.col("n"), F.col(x), rule), F.lit(False)) for x in ("before", "after")]
    near = saved(near.where(fits[0] | fits[1] | (F.col("parts") > 1)).drop("before", "after", "parts"), "ngram-tiles")
    back = near.withColumn("back", F.collect_list(F.struct("i", "n", "doc")).over(band.rowsBetween(-BACK, -1))).withColumn("b", F.explode("back"))
    back = back.where(_sizes_fit(F.col("n"), F.col("b.n"), rule) & _places_fit(F.col("n"), F.col("i"), F.col("b.n"), F.col("b.i"), rule))
    tried = saved(back.select(F.greatest("doc", "b.doc").alias("a"), F.least("doc", "b.doc").alias("b")).where("a <> b").distinct(), "ngram-pairs")
    left = saved(_bounded(tried, bits, rule), "ngram-pairs")
    links = saved(_verified(left, d, rule), "ngram-links")
    discard(left)
    mixed, grown = near, True
    for likeliest in [True] * LIKELIEST + [False]:
        if grown:
            so_far = connected(links)
            # Each node's link to its component says as much as all links so far.
            links = so_far.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            mixed = _mixed(mixed.select("w", "i", "n", "doc"), so_far)
            if mixed.isEmpty():
                break
        elif likeliest:  # the same partners again
            continue
        pairs = saved(_within_tiles(mixed, bits, rule, likeliest).join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
        tried, grown = tried.unionByName(pairs), False
        if not pairs.isEmpty():
            more_links = saved(_verified(pairs, d, rule), "ngram-links")
            grown = not more_links.isEmpty()
            links = links.unionByName(more_links)
    ties = members.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    if more is not None:
        ties = ties.unionByName(more.select(F.col("new").alias("a"), F.col("doc").alias("b")))
    final = connected(links.unionByName(ties).distinct()).withColumnRenamed("node", "id")
    out = sets.select("doc", F.col("n").cast("long").alias("n_shingles")).join(final, F.col("doc") == F.col("id"), "left")
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component", "doc").alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that are first of their component (or have no id); repeated rows of one id stay together."""
    (gone,) = free(docs, "gone")
    rest = components(docs, text, key, rule).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(rest, F.col(key) == F.col(gone), "left_anti")
