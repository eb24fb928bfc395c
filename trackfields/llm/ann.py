"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a balanced k-means on a bounded sample (``SAMPLE`` rows by hash of the id; at most ``MOST_LISTS``
centroids), in which a list pays for being longer than its share; vectors are posted at the same prices. A vector near a
boundary also goes to its second nearest list; the boundary is set so that a share ``TWICE`` of the sample does. A query
searches the centroids over an in-memory neighbour graph, best first, and scans the lists whose centroid is at most ``reach``
times as far as the nearest one, exactly and in double precision. ``reach`` is calibrated: for ``ASKED`` of the queries (by hash; all,
if fewer) the true neighbours among all rows are computed, and ``reach`` lets ``RECALL`` of them be found. Rows of the table say too little for
that, since queries may lie elsewhere, between clusters say. The search over the graph itself is held against the same neighbours and goes
on for longer until it loses at most ``LOST`` of them. A query that finds fewer than ``k`` rows goes on to all lists.

Lists are worked in bundles; bundles and the queries that probe them are cut into tiles of about ``TILE_ROWS`` by
``TILE_QUERIES``, so a list that holds a third of all rows is many tasks; each tile returns ``k`` rows per query. The
centroids and their graph, at most MOST_LISTS rows, are all that is broadcast.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do those of another
dimension than most; fewer candidates than k give fewer neighbours; ties go to the smaller id; an id that
occurs twice is one candidate per distinct vector, and never its own neighbour; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SAMPLE, MOST_LISTS, PER_LIST = 20_000, 4_096, 100
TWICE, RECALL, PROOF = 0.3, 0.97, 400
ASKED, LOST = 200, 0.005
LINKS, BUNDLE = 16, 8
#: How much farther (squared) than the limit the search over the graph still goes on, and how many centroids it opens at least.
SLACK, BEAM = (1.1, 1.5, 2.0, 4.0), 64
TILE_ROWS, TILE_QUERIES = 8_000, 1_000
#: How fast the price of a list follows its size.
STEP = 0.03
#: Rows whose distances to all centroids a worker holds at once.
CHUNK = 256


class Index(NamedTuple):
    centroids: np.ndarray
    prices: np.ndarray  # what a row pays, in squared distance, to enter a list
    graph: np.ndarray  # neighbours of each centroid
    entries: np.ndarray  # where a search begins
    boundary: float = 1.0  # of the second nearest list's distance to the nearest one's
    reach: float = 1.0
    least: float = 0.0  # the nearest centroid counts as at least that far
    slack: float = SLACK[0]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, by one product; good for choosing lists, not for scores."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and prices of a k-means in which entering a list costs the more, the longer it is."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    price = np.zeros(k)
    for _ in range(rounds):
        own, near = np.zeros(len(x), int), np.zeros(len(x))
        for part in np.array_split(np.arange(len(x)), max(1, len(x) // 4096)):
            d = _distances(x[part], c)
            own[part] = (d + price).argmin(1)
            near[part] = d[np.arange(len(part)), own[part]]
        size = np.bincount(own, minlength=k)
        spread = near.mean()
        price = np.maximum(0, price + STEP * spread * np.minimum(size * k / len(x) - 1, 2)).clip(max=2 * spread)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c, price


def neighbour_graph(c: np.ndarray, price: np.ndarray) -> Index:
    """Nearest centroids of each, half of the links; the other half spread over ever farther ones, so no part is cut off."""
    near = np.argsort(_distances(c, c), axis=1, kind="stable")[:, 1:]
    n = near.shape[1]
    picks = np.unique(np.concatenate([np.arange(min(n, LINKS)), np.geomspace(1, max(n, 1), LINKS).astype(int) - 1])) if n else np.zeros(0, int)
    step = max(1, len(c) // 8)
    return Index(c, price, near[:, picks[picks < n]], np.arange(0, len(c), step))


def lists_of(x: np.ndarray, index: Index) -> np.ndarray:
    """The nearest list of each row at the prices, and the second one or -1, as two columns."""
    out = np.full((len(x), 2), -1, np.int32)
    for begin in range(0, len(x), CHUNK):
        d = _distances(x[begin : begin + CHUNK], index.centroids)
        at = np.arange(len(d))
        order = d + index.prices
        first = order.argmin(1)
        out[begin : begin + CHUNK, 0] = first
        if d.shape[1] > 1:
            order[at, first] = np.inf
            second = order.argmin(1)
            close = np.sqrt(d[at, second]) <= index.boundary * np.sqrt(d[at, first]) + 1e-12
            out[begin : begin + CHUNK, 1] = np.where(close, second, -1)
    return out


def calibrated(index: Index, x: np.ndarray, k: int = 10) -> Index:
    """``index`` with boundary and reach from a sample."""
    if len(index.centroids) < 2:
        return index
    proof = x[:: max(1, len(x) // PROOF)]  # ``fitted`` leaves these out
    every = index._replace(boundary=np.inf)
    pair = lists_of(proof, every)
    gap = np.linalg.norm(proof - index.centroids[pair[:, 1]], axis=1) / np.maximum(np.linalg.norm(proof - index.centroids[pair[:, 0]], axis=1), 1e-12)
    index = index._replace(boundary=float(np.quantile(gap, TWICE)))
    posted = lists_of(x, index)
    far = np.sqrt(_distances(proof, index.centroids))
    least = float(np.median(far.min(1)))
    ratios = []
    for q, d in zip(proof, far):
        near = np.argsort(((x - q) ** 2).sum(1), kind="stable")[1 : k + 1]  # the first is the query's own row
        own = posted[near]
        best = np.minimum(d[own[:, 0]], np.where(own[:, 1] >= 0, d[own[:, 1]], np.inf))
        ratios.append(best / max(d.min(), least))
    return index._replace(reach=max(1.0, float(np.quantile(np.concatenate(ratios), RECALL))), least=least)


def search_centroids(index: Index, q: np.ndarray) -> list[int]:
    """The centroids within ``reach`` of a query, found best first over the graph; the search ends once nothing near its limit is open."""

    def reach(ids: np.ndarray) -> list[tuple[float, int]]:
        diff = index.centroids[ids] - q
        return list(zip(np.einsum("ij,ij->i", diff, diff).tolist(), ids.tolist()))

    if np.isinf(index.slack):
        d = np.sqrt(_distances(q[None], index.centroids)[0])
        return np.flatnonzero(d <= index.reach * max(d.min(), index.least) + 1e-9).tolist()
    seen = np.zeros(len(index.centroids), bool)
    seen[index.entries] = True
    open_ = reach(index.entries)
    heapq.heapify(open_)
    found = list(open_)
    nearest, opened = open_[0][0], 0
    while open_:
        d, at = heapq.heappop(open_)
        opened += 1
        limit = (index.reach * max(np.sqrt(nearest), index.least)) ** 2
        if d > max(limit, nearest) * index.slack and opened > BEAM:
            break
        ids = index.graph[at]
        ids = ids[~seen[ids]]
        seen[ids] = True
        for x in reach(ids) if len(ids) else ():
            heapq.heappush(open_, x)
            found.append(x)
            nearest = min(nearest, x[0])
    limit = (index.reach * max(np.sqrt(nearest), index.least)) ** 2
    return [i for d, i in found if d <= limit + 1e-12]


def usable(vectors: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(id, v: array<double>) of the vectors that take part: those of ``size`` components, or of as many as most have."""
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    d = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.coalesce(good, F.lit(False)))
    if size is None:
        most = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
        size = most["n"] if most else 0
    return d.where(F.size("v") == size)


def fitted(x: np.ndarray, lists: int, k: int = 10) -> Index:
    """An index of about ``lists`` lists, calibrated on rows that its centroids have not seen."""
    seen = np.ones(len(x), bool)
    seen[:: max(1, len(x) // PROOF)] = len(x) <= 4 * PROOF
    return calibrated(neighbour_graph(*balanced_means(x[seen], lists)), x, k)


def fit(d: DataFrame, k: int = 10) -> Index | None:
    n = d.count()
    if not n:
        return None
    # Only about as many rows as the sample needs are sorted.
    some = d.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 1.2 * SAMPLE / n + 1e-6) * (1 << 30)))
    rows = some.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    x = np.array([r["v"] for r in rows], float)
    return fitted(x, max(1, min(MOST_LISTS, n // PER_LIST, len(x) // 4)), k)


def true_neighbours(d: DataFrame, asked: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of ``ASKED`` queries; the vectors of their k nearest among all rows, and of which of the queries each is one."""
    some = asked.orderBy(F.xxhash64("id"), "id", "v").limit(ASKED).collect()
    if not some:
        return np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0, int)
    ids, q = np.array([r["id"] for r in some]), np.array([r["v"] for r in some], float)
    shared = d.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        far, near, v = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64), np.zeros((len(q), k, q.shape[1]))
        for rows in batches:
            x, own = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy()
            for begin in range(0, len(x), CHUNK * 4):
                part, names = x[begin : begin + CHUNK * 4], own[begin : begin + CHUNK * 4]
                dist = np.where(names == ids[:, None], np.inf, _distances(q, part))
                for i in np.flatnonzero((dist < far[:, -1:]).any(1)):
                    at = np.flatnonzero(dist[i] < far[i, -1])
                    at = at[np.argsort(dist[i][at], kind="stable")[:k]]
                    order = np.argsort(np.concatenate([far[i], dist[i][at]]), kind="stable")[:k]
                    far[i], near[i], v[i] = np.concatenate([far[i], dist[i][at]])[order], np.concatenate([near[i], names[at]])[order], np.concatenate([v[i], part[at]])[order]
        i, j = np.nonzero(np.isfinite(far))
        yield pd.DataFrame({"at": i, "far": far[i, j], "id": near[i, j], "v": list(v[i, j])})

    found = d.mapInPandas(run, "at int, far double, id long, v array<double>")
    rank = F.row_number().over(Window.partitionBy("at").orderBy("far", "id"))
    rows = found.withColumn("rank", rank).where(F.col("rank") <= k).select("at", "v").collect()  # k rows for each of ASKED queries
    return q, np.array([r["v"] for r in rows], float).reshape(len(rows), q.shape[1]), np.array([r["at"] for r in rows], int)


def proved(index: Index, d: DataFrame, asked: DataFrame, k: int) -> Index:
    """``index`` with a reach that lets RECALL of the true neighbours of the queries be found, and a slack that loses few of them."""
    if len(index.centroids) < 2:
        return index
    q, near, of = true_neighbours(d, asked, k)
    if not len(near):
        return index
    far, own = np.sqrt(_distances(q, index.centroids)), lists_of(near, index)
    best = np.minimum(far[of, own[:, 0]], np.where(own[:, 1] >= 0, far[of, own[:, 1]], np.inf))
    least = float(np.median(far.min(1)))
    ratios = best / np.maximum(np.maximum(far.min(1)[of], least), 1e-12)
    index = index._replace(reach=max(1.0, float(np.quantile(ratios, RECALL, method="higher"))) * (1 + 1e-9), least=least)
    for slack in SLACK:
        index = index._replace(slack=slack)
        lists = [np.array(search_centroids(index, x)) for x in q]
        found = np.mean([np.isin(o, lists[i]).any() for i, o in zip(of, own)])
        if found >= RECALL - LOST:
            return index
    return index._replace(slack=np.inf)


def post(d: DataFrame, index: Index) -> DataFrame:
    """(list, id, v): every vector in its nearest list and, near a boundary, in the second one."""
    shared = d.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            both = lists_of(np.stack(s.to_numpy()), shared.value) if len(s) else np.zeros((0, 2), np.int32)
            yield pd.Series([a[a >= 0] for a in both], dtype=object)

    return d.withColumn("list", F.explode(F.pandas_udf(run, "array<int>")("v")))


def probe(queries: DataFrame, index: Index) -> DataFrame:
    """(list, id, v): the lists that each query scans."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([np.array(search_centroids(shared.value, q), np.int32) for q in s], dtype=object)

    return queries.withColumn("list", F.explode(F.pandas_udf(run, "array<int>")("v")))


def _nearest(rows: pd.DataFrame, asks: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query within a tile, among the lists that it probes, with exact distances."""
    ids, v, lists = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()), rows["list"].to_numpy()
    asked = asks.drop_duplicates(["id", "u"])
    q = np.stack(asked["v"].to_numpy())
    names = np.unique(lists)
    probed = np.zeros((len(asked), len(names)), bool)
    place = pd.Series(np.arange(len(asked)), index=pd.MultiIndex.from_frame(asked[["id", "u"]]))
    who = place.loc[pd.MultiIndex.from_frame(asks[["id", "u"]])].to_numpy()
    col = np.searchsorted(names, asks["list"].to_numpy())
    good = (col < len(names)) & (names[np.minimum(col, len(names) - 1)] == asks["list"].to_numpy())
    probed[who[good], col[good]] = True
    which = np.searchsorted(names, lists)
    repeats = int(np.unique(ids, return_counts=True)[1].max())  # an id is here once per list that it is posted to, and per vector
    out = []
    for x, one, mine in zip(q, asked["id"], probed):
        at = np.flatnonzero(mine[which] & (ids != one))
        if not len(at):
            continue
        near = v[at]
        rough = (near * near).sum(1) - 2 * near @ x
        if len(at) > k * repeats:
            at = at[rough <= np.partition(rough, k * repeats - 1)[k * repeats - 1] + 1e-9 * (1 + np.abs(rough).max())]
        diff = v[at] - x
        dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        best = np.lexsort((ids[at], dist))
        best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])[:k]]  # each id once, at its least distance
        out.append(pd.DataFrame({"query_id": one, "vec_id": ids[at][best], "score": dist[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def scan(lists: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest rows of each query in each tile of the lists it probes."""
    lists, probes = (d.withColumn("bundle", F.floor(F.col("list") / BUNDLE).cast("int")) for d in (lists, probes))
    # Rows and probes per bundle: MOST_LISTS / BUNDLE rows at most.
    sizes = lists.groupBy("bundle").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("rows"))
    sizes = sizes.join(probes.groupBy("bundle").agg(F.ceil(F.count_distinct("id") / TILE_QUERIES).cast("int").alias("asks")), "bundle")
    sizes = F.broadcast(sizes)
    # An id may stand for several vectors, so a query is an id and a hash of its vector.
    mine, asked = F.pmod(F.xxhash64("id"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("id"), F.col("asks")).cast("int")
    left = lists.join(sizes, "bundle").select("bundle", mine.alias("r"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("a"), "list", "id", "v")
    right = probes.join(sizes, "bundle").select("bundle", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), asked.alias("a"), "list", "id", F.xxhash64("v").alias("u"), "v")
    none = "query_id long, vec_id long, score double"

    def tile(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return _nearest(rows, asks, k)

    return left.groupBy("bundle", "r", "a").cogroup(right.groupBy("bundle", "r", "a")).applyInPandas(tile, none)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, its own row excluded."""
    spark = vectors.sparkSession
    d = saved(usable(vectors, key, vector).dropDuplicates(["id", "v"]), "ann-vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    index = fit(d, k)
    if index is None:
        return spark.createDataFrame([], schema)
    asked = usable(queries, key, vector, index.centroids.shape[1]).dropDuplicates(["id", "v"])
    index = proved(index, d, asked, k)
    lists = post(d, index)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def best(near: DataFrame) -> DataFrame:
        near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    found = best(scan(lists, probe(asked, index), k))
    n = len(index.centroids)
    if n == 1:
        return found
    found = saved(found, "ann-found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = saved(asked.join(full, "id", "left_anti"), "ann-short")
    if short.isEmpty():
        return found
    again = best(scan(lists, short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), k))
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
