"""Permutation tests and bootstraps as replicates spread over tasks.

Draws come from hashes of the replicate and the row's key, so any engine repeats them and no task holds a generator's state.
Where rows times replicates would be too many, rows stay where they are and a task works all replicates over its rows as arrays;
only sums per task and replicate are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sources, stats
from .clean import finite

# The distribution function of a Poisson variable of mean 1, at 0 to 7.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    h = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def replicated(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n))))


def poisson_weight(*keys: Column) -> Column:
    """How often a unit is drawn in a bootstrap: Poisson with mean 1, so units are drawn independently of each other."""
    u = uniform(*keys)
    return F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda p: p <= u))


#: Rows of a small chunk of the bootstrap, how many of them make a large one, and the chunks of an arm between the two.
CHUNK, LARGE, CHUNKS = 8_192, 64, 16
#: Replicates that a task works at once, and draws.
AT_ONCE, DRAWS = 250, 1 << 24
#: Rows of a tile, and its scores with positive rows.
TILE, CUTS = 1_024, 16


def halves(key: Column) -> list[Column]:
    """Two 32-bit numbers of a key, from which ``draws`` go on."""
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return [F.conv(F.substring(h, at, 8), 16, 10).cast("long").alias(name) for at, name in ((1, "h1"), (9, "h2"))]


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(2246822507)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(3266489909)
    return x ^ (x >> np.uint32(16))


def draws(h1: np.ndarray, h2: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A 32-bit number for each key (rows) and replicate (columns)."""
    first = h1.astype(np.uint32)[:, None] + r.astype(np.uint32)[None] * np.uint32(2654435769)
    return _mix(_mix(first) ^ h2.astype(np.uint32)[:, None])


LIMITS = np.ceil(np.array(POISSON) * 2**32).astype(np.uint64)


def weights(h1: np.ndarray, h2: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How often each cluster is drawn in each replicate, from 0 to 8: Poisson with mean 1. Some clusters at a time, so that numbers stay near the CPU."""
    out, limits = np.empty((len(h1), len(r)), np.uint8), LIMITS[LIMITS < 2**32].astype(np.uint32)
    first, second, add = h1.astype(np.uint32)[:, None], h2.astype(np.uint32)[:, None], r.astype(np.uint32)[None] * np.uint32(2654435769)
    some = max(1, 65_536 // max(len(r), 1))
    numbers, spare, over = np.empty((some, len(r)), np.uint32), np.empty((some, len(r)), np.uint32), np.empty((some, len(r)), bool)
    for i in range(0, len(h1), some):
        drawn = out[i : i + some]
        x, y, z = numbers[: len(drawn)], spare[: len(drawn)], over[: len(drawn)]
        np.add(first[i : i + some], add, out=x)
        for part in (0, 1):  # as in ``draws``
            if part:
                np.bitwise_xor(x, second[i : i + some], out=x)
            for shift, by in ((16, 2246822507), (13, 3266489909), (16, None)):
                np.bitwise_xor(x, np.right_shift(x, np.uint32(shift), out=y), out=x)
                if by:
                    np.multiply(x, np.uint32(by), out=x)
        drawn[:] = 0
        for limit in limits:
            np.add(drawn, np.greater_equal(x, limit, out=z).view(np.uint8), out=drawn)
    return out


def _tail(d: DataFrame, extreme: Column, n: int) -> DataFrame:
    return d.agg(((F.count(F.when(extreme, 1)) + 1) / (n + 1)).alias("p"))


def sign_flip(df: DataFrame, d: str, key: str, n: int) -> DataFrame:
    """p of a mean difference of 0, two-sided and of one as low (p_less), one added to both counts."""
    flipped = F.when(uniform(F.col("r"), F.col(key)) < 0.5, F.col(d)).otherwise(-F.col(d))
    seen = df.agg(F.avg(d).alias("observed"))
    means = replicated(df.select(key, d), n).groupBy("r").agg(F.avg(flipped).alias("m")).crossJoin(F.broadcast(seen))  # one row
    share = lambda c: ((F.count(F.when(c, 1)) + 1) / (n + 1))
    return means.agg(share(F.abs("m") >= F.abs("observed") - 1e-12).alias("p"), share(F.col("m") <= F.col("observed") + 1e-12).alias("p_less"), F.max("observed").alias("observed"))


def sign_flip_by(df: DataFrame, d: str, key: str, n: int, *by: str) -> DataFrame:
    """by, n, observed and the two-sided p of a mean difference of 0 in each group; a replicate turns a key around in all groups alike."""
    flipped = F.when(uniform(F.col("r"), F.col(key)) < 0.5, F.col(d)).otherwise(-F.col(d))
    means = replicated(df.select(*by, key, d), n).groupBy(*by, "r").agg(F.avg(flipped).alias("m"))
    seen = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("observed"))
    out = stats.with_group(means, seen, *by)
    p = (F.count(F.when(F.abs("m") >= F.abs("observed") - 1e-12, 1)) + 1) / (n + 1)
    return out.groupBy(*by).agg(F.max("n").alias("n"), F.max("observed").alias("observed"), p.alias("p"))


def fall(df: DataFrame, key: str, lag: str, d: str, hours: int) -> DataFrame:
    """n, mean, t and p of how much a key's difference changes within so many hours, over all lags that have both ends."""
    w = Window.partitionBy(key).orderBy(lag).rangeBetween(hours, hours)
    return stats.paired_t(df.withColumn("_fall", F.min(d).over(w) - F.col(d)).where("_fall is not null"), "_fall")


def label_permutation(df: DataFrame, x: str, label: str, key: str, n: int) -> DataFrame:
    """Two-sided p of the difference of the medians of label 1 and 0 under permuted labels."""
    medians = lambda d, y, *by: d.groupBy(*by).agg((F.median(F.when(y, F.col(x))) - F.median(F.when(~y, F.col(x)))).alias("m"))
    seen = medians(df, F.col(label) == 1).withColumnRenamed("m", "observed")
    ones = df.agg(F.sum(label).alias("ones"))
    order = Window.partitionBy("r").orderBy(F.md5(F.concat_ws(":", "r", key)), key)
    drawn = replicated(df, n).withColumn("k", F.row_number().over(order)).crossJoin(F.broadcast(ones))  # one row
    return _tail(medians(drawn, F.col("k") <= F.col("ones"), "r").crossJoin(F.broadcast(seen)), F.abs("m") >= F.abs("observed") - 1e-12, n).crossJoin(seen)


def _length(angle: Column) -> Column:
    c, s = F.avg(F.cos(F.radians(angle))), F.avg(F.sin(F.radians(angle)))
    return F.sqrt(c * c + s * s)


def pairing_permutation(df: DataFrame, a: str, b: str, key: str, n: int) -> DataFrame:
    """p of a resultant length of the angle differences at least as great when the second angles are dealt out anew."""
    seen = df.agg(_length(F.col(a) - F.col(b)).alias("observed"))
    first = replicated(df.select(key, a), n).withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(key)))
    second = replicated(df.select(F.col(key).alias("_o"), b), n).withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy(F.md5(F.concat_ws(":", "r", "_o")), "_o")))
    lengths = first.join(second, ["r", "k"]).groupBy("r").agg(_length(F.col(a) - F.col(b)).alias("m")).crossJoin(F.broadcast(seen))  # one row
    return _tail(lengths, F.col("m") >= F.col("observed") - 1e-12, n).crossJoin(seen)


def random_points(df: DataFrame, key: str, half: float, n: int) -> DataFrame:
    """p of a median distance to the peak (lat, lon) as small from random points of the box around the centre (clat, clon), and the observed one.

    A replicate's median is only compared with the observed one: how many of its distances lie at or under that says it, or, where half
    of them do, the two in the middle. So one pass sums a row per task and replicate, and no task holds a replicate's distances.
    """
    at = lambda c, name: (F.col(c) + (2 * uniform(F.col("r"), F.col(key), F.lit(name)) - 1) * half).alias(c)
    km = stats.haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))
    once = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731  # else the hashes are computed anew wherever the value is used
    seen = stats.quantiles(df.select(km.alias("_km")), "_km", {"observed": 0.5})
    d = replicated(df.select(key, "clat", "clon", "lat", "lon"), n).select("r", "lat", "lon", once(F.struct(at("clat", "y"), at("clon", "x")), "at")).select("r", "lat", "lon", "at.*")
    d = d.select("r", once(km, "x")).crossJoin(F.broadcast(seen))  # one row
    top = F.col("observed") + 1e-9
    under, above = F.when(F.col("x") <= top, F.col("x")), F.when(F.col("x") > top, F.col("x"))
    m = d.groupBy("r").agg(F.count(under).alias("under"), F.count(above).alias("above"), F.max(under).alias("low"), F.min(above).alias("high"), F.max("observed").alias("observed"))
    middle = F.col("low") + (F.col("high") - F.col("low")) * 0.5
    small = (F.col("under") > F.col("above")) | ((F.col("under") == F.col("above")) & (middle <= F.col("observed") + 1e-9))
    return _tail(m, small, n).crossJoin(F.broadcast(seen))


def _chunks(df: DataFrame, cluster: str, scores: tuple[str, ...], *by: str) -> DataFrame:
    """A row per chunk (key, arm, chunk, hot, h, at, begin, pos, neg) of the scores in order, from the highest, equal scores together.

    ``h`` holds the chunk's clusters, ``at`` the cluster of each row and ``begin`` each score's first row. A chunk has about ``CHUNK`` to ``LARGE`` times as many
    rows, so that ``CHUNKS`` come from an arm if they can: the larger, the less often a cluster's draws are repeated. A score of more rows has chunks of its own (``hot``), whose order does not matter.
    """
    arms = F.explode(F.array(*[F.struct(F.lit(x).alias("arm"), finite(F.col(x).cast("double")).alias("t")) for x in scores]))
    h1, h2 = halves(F.col(cluster))
    d = df.where(F.col("y").isNotNull()).select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("key") if by else F.lit("").alias("key"), h1, h2, "y", arms.alias("x"))
    d = d.select("key", F.shiftleft("h1", 32).bitwiseOR(F.col("h2")).alias("h"), "y", "x.arm", "x.t").where("t is not null").groupBy("key", "arm", "t", "h").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    sizes = stats.cumulative(d.groupBy("key", "arm", "t").agg(F.count("*").alias("m")), "t", ["m"], "key", "arm", descending=True)
    rows = F.greatest(F.lit(CHUNK), F.least(F.lit(CHUNK * LARGE), F.ceil(F.col("m_total") / CHUNKS)))
    hot = F.col("m") > rows
    sizes = sizes.select("key", "arm", "t", hot.alias("hot"), (2 * F.floor(F.col("m_before") / rows) + hot.cast("long")).alias("chunk"), F.ceil(F.col("m") / rows).cast("int").alias("pieces"))
    d = d.join(sizes, ["key", "arm", "t"]).withColumn("piece", F.when(F.col("hot"), F.pmod(F.xxhash64("h"), F.col("pieces"))).otherwise(0).cast("int"))
    d = d.select(*OF, (-F.col("t")).alias("o"), "h", "pos", "neg").repartition(*OF).sortWithinPartitions(*OF, "o", "h")
    return d.mapInPandas(_packed, "key string, arm string, chunk long, hot boolean, h array<long>, at array<int>, begin array<int>, pos array<double>, neg array<double>")


OF = ("key", "arm", "chunk", "hot", "piece")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks' rows, sorted, as a row per chunk."""

    def row() -> pd.DataFrame:
        o, h, pos, neg = (np.concatenate(x) for x in zip(*parts))
        h, at = np.unique(h, return_inverse=True)
        begin = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        return pd.DataFrame({**dict(zip(OF[:4], last)), "h": [h], "at": [at.ravel().astype(np.int32)], "begin": [begin.astype(np.int32)], "pos": [pos], "neg": [neg]})

    last, parts = None, []
    for rows in batches:
        if not len(rows):
            continue
        of = rows[list(OF)]
        starts = np.flatnonzero(np.r_[True, (of.to_numpy()[1:] != of.to_numpy()[:-1]).any(1)])
        for i, j in zip(starts, np.r_[starts[1:], len(rows)]):
            now = tuple(of.iloc[i])
            if parts and now != last:
                yield row()
                parts = []
            last = now
            parts.append([rows[c].to_numpy()[i:j] for c in ("o", "h", "pos", "neg")])
    if parts:
        yield row()


def _blocks(n: int, clusters: int) -> list[np.ndarray]:
    step = max(1, min(AT_ONCE, DRAWS // max(clusters, 1)))
    return [np.arange(i, min(i + step, n + 1)) for i in range(1, n + 1, step)]


def _drawn(h: np.ndarray, r: np.ndarray, kind: type) -> np.ndarray:
    """The clusters' weights in replicates."""
    h = h.view(np.uint64)
    return weights(h >> np.uint64(32), h & np.uint64(2**32 - 1), r).astype(kind)


def _kind(*counts: np.ndarray) -> type:
    """Floats that hold sums of counts times weights exactly."""
    return np.float32 if sum(map(np.sum, counts)) * len(POISSON) < 2**24 else np.float64


def _totals(n: int):
    """(key, arm, chunk, r, pos, neg): each chunk's drawn counts in each replicate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                h, at = np.asarray(row.h, np.int64), np.asarray(row.at)
                kind = _kind(row.pos, row.neg)
                counts = np.stack([np.bincount(at, np.asarray(x, float), len(h)) for x in (row.pos, row.neg)]).astype(kind)
                for r in _blocks(n, len(h)):
                    pos, neg = counts @ _drawn(h, r, kind)
                    yield pd.DataFrame({"key": row.key, "arm": row.arm, "chunk": row.chunk, "hot": row.hot, "r": r, "pos": pos.astype(float), "neg": neg.astype(float)})

    return run


def _tiles(begin: np.ndarray, pos: np.ndarray, neg: np.ndarray, kind: type) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of whole scores, and what to sum of them: at each score with positive rows (a cut) positives and negatives from the tile's first row to the score's last, then the
    score's own negatives, and at the end all positives and negatives. A tile has ``TILE`` rows and ``CUTS`` cuts at most; a longer score is a tile."""
    ends = np.r_[begin[1:], len(pos)]
    cuts = np.r_[0, np.cumsum(np.add.reduceat(pos, begin) > 0)]  # before each score
    score, n = 0, len(begin)
    while score < n:
        stop = min(np.searchsorted(ends, begin[score] + TILE, "right"), np.searchsorted(cuts, cuts[score] + CUTS, "right") - 1)
        stop = max(score + 1, stop)
        rows = slice(begin[score], ends[stop - 1])
        at = score + np.flatnonzero(np.diff(cuts[score : stop + 1]))
        place = np.arange(rows.start, rows.stop)
        upto = place < ends[at][:, None]
        own = upto & (place >= begin[at][:, None])
        yield rows, np.concatenate([upto * pos[rows], upto * neg[rows], own * neg[rows], [pos[rows], neg[rows]]]).astype(kind)
        score = stop


def _parts(n: int):
    """(key, arm, r, pos, neg, wins, found): each chunk's part of the areas, given the counts above it in each replicate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples():
                h, at, above, under = np.asarray(row.h, np.int64), np.asarray(row.at), np.asarray(row.tp, float), np.asarray(row.fp, float)
                kind = _kind(row.pos, row.neg)
                tiles = list(_tiles(np.asarray(row.begin), np.asarray(row.pos, float), np.asarray(row.neg, float), kind))
                for r in _blocks(n, len(h)):
                    w = _drawn(h, r, kind)
                    tp0, fp0, wins, found = above[r - 1], under[r - 1], np.zeros(len(r)), np.zeros(len(r))
                    for of, what in tiles:
                        sums = sum(what[:, i : i + TILE] @ w[at[of][i : i + TILE]] for i in range(0, what.shape[1], TILE)).astype(float)
                        if k := len(what) // 3:  # cuts
                            tp, fp, own = sums[:k] + tp0, sums[k : 2 * k] + fp0, sums[2 * k : 3 * k]
                            pos = np.diff(tp, axis=0, prepend=tp0[None])
                            wins += (pos * (own / 2 - fp)).sum(0)
                            found += (pos * tp / np.maximum(tp + fp, 1)).sum(0)
                        tp0, fp0 = tp0 + sums[-2], fp0 + sums[-1]
                    yield pd.DataFrame({"key": row.key, "arm": row.arm, "r": r, "pos": tp0 - above[r - 1], "neg": fp0 - under[r - 1], "wins": wins, "found": found})

    return run


def replicate_areas(df: DataFrame, cluster: str, scores: tuple[str, ...], n: int, *by: str) -> DataFrame:
    """(key, arm, r, roc_auc, pr_auc) of every replicate; both null where it has one class only.

    Two passes over the chunks: the first sums each chunk's counts per replicate, the second adds up areas with what lies above.
    A row is never multiplied by replicates in a shuffle: tasks give one row per chunk and replicate.
    """
    chunks = sources.saved(_chunks(df, cluster, scores, *by), "bootstrap-chunks", 1)
    tasks = max(1, chunks.select("hot").count())  # a chunk for each
    t = chunks.repartitionByRange(tasks, "key", "arm", "chunk").mapInPandas(_totals(n), "key string, arm string, chunk long, hot boolean, r int, pos double, neg double").groupBy("key", "arm", "chunk", "hot", "r").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    t = sources.saved(t, "bootstrap-totals")
    before = Window.partitionBy("key", "arm", "r").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    t = t.withColumns({"tp": F.coalesce(F.sum("pos").over(before), F.lit(0.0)), "fp": F.coalesce(F.sum("neg").over(before), F.lit(0.0))})
    above = t.where("not hot").groupBy("key", "arm", "chunk").agg(F.array_sort(F.collect_list(F.struct("r", "tp", "fp"))).alias("x"))  # n at most
    d = chunks.where("not hot").join(above.select("key", "arm", "chunk", F.col("x.tp").alias("tp"), F.col("x.fp").alias("fp")), ["key", "arm", "chunk"]).repartitionByRange(tasks, "key", "arm", "chunk")
    d = d.mapInPandas(_parts(n), "key string, arm string, r int, pos double, neg double, wins double, found double")
    tp, fp = F.col("tp") + F.col("pos"), F.col("fp") + F.col("neg")
    same = t.where("hot").select("key", "arm", "r", "pos", "neg", (F.col("pos") * (F.col("neg") / 2 - fp)).alias("wins"), (F.col("pos") * tp / F.greatest(tp + fp, F.lit(1.0))).alias("found"))
    d = d.unionByName(same).groupBy("key", "arm", "r").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "wins", "found")])
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return d.select("key", "arm", "r", F.when(both, F.col("wins") / (F.col("pos") * F.col("neg")) + 1).alias("roc_auc"), F.when(both, F.col("found") / F.col("pos")).alias("pr_auc"))


def cluster_bootstrap(df: DataFrame, cluster: str, a: str, b: str, n: int, *by: str) -> DataFrame:
    """endpoint (roc_auc, pr_auc), mean difference of two scores over groups (seeds), its 95 % interval, replicates used and skipped, verdict.

    Clusters are drawn, not rows, and a replicate draws the same ones in every group; replicates in which a group has one class only are skipped.
    """
    arm = lambda name, c: F.max(F.when(F.col("arm") == name, F.col(c)))
    areas = replicate_areas(df, cluster, (a, b), n, *by).groupBy("key", "r").agg(*[(arm(a, c) - arm(b, c)).alias(c) for c in ("roc_auc", "pr_auc")])
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("endpoint"), F.col(c).alias("d")) for c in ("roc_auc", "pr_auc")]))
    means = areas.select("r", ends.alias("e")).groupBy("r", "e.endpoint").agg(F.when(F.count("e.d") == F.count("*"), F.avg("e.d")).alias("d"))
    out = means.groupBy("endpoint").agg(F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), F.count("d").alias("used"), (F.lit(n) - F.count("d")).alias("skipped"))
    return out.withColumn("verdict", F.when(F.col("lo") > 0, "first").when(F.col("hi") < 0, "second").otherwise("none"))


#: Newton steps at most, and the step below which they end.
NEWTON, SMALL = 40, 1e-10


def pair_coefficients(df: DataFrame, columns: tuple[str, ...], key: str, n: int) -> DataFrame:
    """(coefficient, beta, p, pairs, converged) of a conditional logit on matched pairs' differences, p two-sided by turning pairs around at random.

    A Newton step reads the pairs once for all ``n`` replicates: a task sums likelihood, gradient and Hessian of its pairs per
    replicate, and the driver, which holds n + 1 replicates of d + d (d + 1) / 2 numbers, solves them. A step that lowers a likelihood is halved. Where a
    combination of columns separates the pairs, coefficients grow until the steps end: ``converged`` is false. Pairs with a
    value that is not finite take no part.
    """
    good = [finite(F.col(c).cast("double")).alias(c) for c in columns]
    pairs = sources.saved(df.select(*halves(F.col(key)), *good).na.drop(), "pairs")
    k, at = len(columns), [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    beta, old, step, best = np.zeros((n + 1, k)), np.zeros((n + 1, k)), np.zeros((n + 1, k)), np.full(n + 1, -np.inf)
    open_ = np.ones(n + 1, bool)

    def sums(beta: np.ndarray, which: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(which), 1 + k + len(at)))
            for rows in batches:
                x = rows[list(columns)].to_numpy(float)
                for some in np.array_split(np.arange(len(which)), -(-len(which) // AT_ONCE)):
                    r = which[some]
                    s = np.where((draws(rows["h1"].to_numpy(), rows["h2"].to_numpy(), r) < 2**31) | (r == 0), 1.0, -1.0)
                    z = s * (x @ beta[some].T)
                    p = np.exp(-np.logaddexp(0, z))
                    out[some, 0] -= np.logaddexp(0, -z).sum(0)
                    out[some, 1 : k + 1] += (x.T @ (s * p)).T
                    out[some, k + 1 :] += np.stack([(x[:, i] * x[:, j]) @ (p * (1 - p)) for i, j in at], 1)
            yield pd.DataFrame({"r": which, "sums": list(out)})

        return run

    for _ in range(NEWTON):
        which = np.flatnonzero(open_)
        got = pairs.mapInPandas(sums(beta[which], which), "r int, sums array<double>").groupBy("r").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(1 + k + len(at))]).toPandas()  # n + 1 rows at most
        if not len(got):
            break
        got = got.sort_values("r").drop(columns="r").to_numpy(float)
        worse = got[:, 0] < best[which] - 1e-12 * np.abs(best[which])
        step[which[worse]] /= 2
        better = which[~worse]
        best[better], old[better] = got[~worse, 0], beta[better]
        bend = np.zeros((len(better), k, k))
        for m, (i, j) in enumerate(at):
            bend[:, i, j] = bend[:, j, i] = got[~worse, k + 1 + m]
        step[better] = np.einsum("rij,rj->ri", np.linalg.pinv(bend, hermitian=True), got[~worse, 1 : k + 1])
        beta[which] = old[which] + step[which]
        open_[which] = np.abs(step[which]).max(1) > SMALL
        if not open_.any():
            break
    p = (1 + (np.abs(beta[1:]) >= np.abs(beta[0]) - 1e-12).sum(0)) / (n + 1)
    count = pairs.count()
    return df.sparkSession.createDataFrame([(c, float(beta[0, i]), float(p[i]), count, not bool(open_[0])) for i, c in enumerate(columns)], "coefficient string, beta double, p double, pairs long, converged boolean")


def conditional_logit(df: DataFrame, d: str, steps: int = 12, *by: str) -> DataFrame:
    """by, beta: the coefficient of matched pairs' differences, by Newton steps over aggregates; a step reads the pairs once."""
    beta = df.select(*by).distinct().withColumn("beta", F.lit(0.0)) if by else df.sparkSession.range(1).select(F.lit(0.0).alias("beta"))
    for _ in range(steps):
        p = 1 / (1 + F.exp(F.col("beta") * F.col(d)))  # of the other order
        x = stats.with_group(df.select(*by, d), beta, *by)
        slope, bend = F.sum(F.col(d) * p), F.sum(F.col(d) * F.col(d) * p * (1 - p))
        beta = x.groupBy(*by).agg((F.first("beta") + F.coalesce(slope / F.nullif(bend, F.lit(0.0)), F.lit(0.0))).alias("beta"))
    return beta


def conditional_logit_p(df: DataFrame, d: str, key: str, n: int, steps: int = 12) -> DataFrame:
    """beta and its two-sided permutation p, pairs turned around at random."""
    turned = replicated(df.select(key, d), n).withColumn(d, F.when(uniform(F.col("r"), F.col(key)) < 0.5, F.col(d)).otherwise(-F.col(d)))
    seen = conditional_logit(df, d, steps).withColumnRenamed("beta", "observed")
    return _tail(conditional_logit(turned, d, steps, "r").crossJoin(F.broadcast(seen)), F.abs("beta") >= F.abs("observed") - 1e-12, n).crossJoin(seen)
