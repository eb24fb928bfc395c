"""Exact top-k search by integer inner product with a KD-tree per shard.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of id and vector, and each shard becomes a KD-tree: median splits along
the widest side, a tight bounding box at every node, leaves of at most ``LEAF`` rows (more only where all of them are equal). A
query's product with any row of a box is at most the sum of its products with the better end of each side. A query opens nodes
best bound first and stops at the first bound below its k-th score; equal bounds are still opened, since ties go to smaller ids.

Each block of queries first searches one shard; its k-th scores go with it to all other shards, which a task visits in spans of
``SPAN`` one after the other, so that the k-th score rises from shard to shard. A task holds one block of queries and one span,
whatever the table's size; it returns ``k`` rows per query at most. Every row meets every query, which is the query set's own
size: boxes spare work only where the vectors have clusters.

Edge cases: vectors that are null, empty, of another length than most or hold null or non-finite components take no part, as rows
or as queries, nor do rows without an id; zero vectors do. An id of several vectors is one candidate, at its best score, and never
its own; equal rows count once. Fewer candidates than k give fewer rows. Components beyond 64 bits are held at the end of that
range, and scores too. An empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SHARD_ROWS, LEAF = 4_096, 128
SPAN, BLOCK = 4, 1_024
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53
LIMITS = (-(2**63), 2**63 - 1)


class Tree(NamedTuple):
    ids: np.ndarray
    points: np.ndarray  # in the order of the leaves
    low: np.ndarray  # of each node's box
    high: np.ndarray
    children: np.ndarray  # two nodes, or -1
    begin: np.ndarray
    end: np.ndarray


def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
    """A KD-tree over the rows of ``x``; node 0 is the root."""
    order = np.arange(len(x))
    nodes, open_ = [], [(0, len(x), -1, 0)]
    children = []
    while open_:
        begin, end, parent, side = open_.pop()
        at = len(nodes)
        if parent >= 0:
            children[parent][side] = at
        mine = x[order[begin:end]]
        low, high = mine.min(0), mine.max(0)
        nodes.append((low, high, begin, end))
        children.append([-1, -1])
        width = high - low
        axis = int(np.argmax(width))
        if end - begin > leaf and width[axis] > 0:
            middle = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(mine[:, axis], middle)]
            open_ += [(begin, begin + middle, at, 0), (begin + middle, end, at, 1)]
    low, high, begin, end = (np.array(c) for c in zip(*nodes))
    return Tree(ids[order], x[order], low, high, np.array(children), begin, end)


class Found:
    """The best k ids of a query so far."""

    def __init__(self, k: int, least: float | None):
        self.k, self.ids, self.scores, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), least

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), int)
        ids, scores = ids[order], scores[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[: self.k]  # each id at its best score
        self.ids, self.scores = ids[first], scores[first]
        if len(first) == self.k and (self.least is None or self.scores[-1] > self.least):
            self.least = self.scores[-1]


def visit(tree: Tree, q: np.ndarray, own: int, bounds: np.ndarray, found: Found) -> None:
    """Opens the tree's nodes for a query, best bound first, down to the k-th score."""
    open_ = [(-bounds[0], 0)]
    while open_:
        bound, at = heapq.heappop(open_)
        if found.least is not None and -bound < found.least:
            return
        if tree.children[at, 0] >= 0:
            for child in tree.children[at]:
                heapq.heappush(open_, (-bounds[child], int(child)))
            continue
        begin, end = tree.begin[at], tree.end[at]
        scores = tree.points[begin:end] @ q
        good = tree.ids[begin:end] != own
        if found.least is not None:
            good &= scores >= found.least
        if good.any():
            found.add(tree.ids[begin:end][good], scores[good])


def _numbers(x: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles where all products are exact in them, else as Python's own."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return x.astype(float) if largest**2 * x.shape[1] < EXACT else x.astype(object)


def whole(vector: Column, scale: float) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(scale) * x))


def usable(vectors: DataFrame, key: str, vector: str, scale: float = 64.0) -> DataFrame:
    """(id, v: array<bigint>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    d = vectors.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"))
    return d.dropDuplicates(["id", "v"])


def trees(d: DataFrame, shards: int) -> DataFrame:
    """(shard, ids, points, low, high, children, begin, end): a row per shard."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        t = build(rows["id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), **{name: [np.asarray(x).ravel()] for name, x in t._asdict().items()}})

    schema = "shard int, ids array<bigint>, points array<bigint>, low array<bigint>, high array<bigint>, children array<bigint>, begin array<bigint>, end array<bigint>"
    return d.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(one, schema)


def _tree(row) -> Tree:
    n, nodes = len(row.ids), len(row.begin)
    box = lambda x: _numbers(np.asarray(x).reshape(nodes, -1))
    return Tree(np.asarray(row.ids), _numbers(np.asarray(row.points).reshape(n, -1)), box(row.low), box(row.high), np.asarray(row.children).reshape(-1, 2), np.asarray(row.begin), np.asarray(row.end))


FOUND = "query_id long, u long, vec_id long, score long"


def search_tile(shards: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best rows of a span of shards for a block of queries (id, u, v, least)."""
    none = pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in FOUND.split(", ")})
    if not len(shards) or not len(queries):
        return none
    q = _numbers(np.stack(queries["v"].to_numpy()).astype(np.int64))
    ids = queries["id"].to_numpy(np.int64)
    found = [Found(k, None if pd.isna(x) else x) for x in queries["least"]]
    for row in shards.sort_values("shard").itertuples():
        t = _tree(row)
        if object in (q.dtype, t.points.dtype) or np.abs(q).max() * np.abs(t.points).max() * q.shape[1] >= EXACT:
            # Python's whole numbers: exact at any size.
            a, t = q.astype(np.int64).astype(object), t._replace(**{n: getattr(t, n).astype(np.int64).astype(object) for n in ("points", "low", "high")})
        else:
            a = q
        bounds = np.maximum(a, 0) @ t.high.T + np.minimum(a, 0) @ t.low.T
        for i in range(len(a)):
            visit(t, a[i], ids[i], bounds[i], found[i])
    sizes = [len(f.ids) for f in found]
    if not sum(sizes):
        return none
    scores = [min(max(int(s), LIMITS[0]), LIMITS[1]) for f in found for s in f.scores]
    return pd.DataFrame({"query_id": np.repeat(ids, sizes), "u": np.repeat(queries["u"].to_numpy(np.int64), sizes), "vec_id": np.concatenate([f.ids for f in found]), "score": np.array(scores, np.int64)})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the greatest inner product with each query, components turned into floor(scale * x)."""
    spark = vectors.sparkSession
    d = usable(vectors, key, vector, scale)
    sizes = d.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").head()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size, rows = sizes
    d, asked = d.where(F.size("v") == size), usable(queries, key, vector, scale).where(F.size("v") == size)
    shards, blocks = max(1, -(-rows // SHARD_ROWS)), max(1, -(-asked.count() // BLOCK))
    spans = -(-shards // SPAN)
    index = saved(trees(d, shards), "top-k-trees").withColumn("span", F.floor(F.col("shard") / SPAN).cast("int"))
    u = F.xxhash64("id", "v")
    asked = asked.select("id", u.alias("u"), "v", F.pmod(u, F.lit(blocks)).cast("int").alias("block"), F.lit(None).cast("long").alias("least"))
    home = F.pmod(F.col("block"), F.lit(shards))
    tile = lambda a, b: search_tile(a, b, k)
    # First one shard for each block of queries.
    near = index.where(F.col("shard") < blocks).withColumn("block", F.explode(F.sequence(F.col("shard"), F.lit(blocks - 1), F.lit(shards))))
    near = near.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(tile, FOUND)
    near = saved(near, "top-k-near")
    if shards == 1:
        found = near
    else:
        least = near.groupBy(F.col("query_id").alias("id"), "u").agg(F.when((F.count("*") == k) & (F.abs(F.min("score")) < int(EXACT)), F.min("score")).alias("least"))
        asked = asked.drop("least").join(least, ["id", "u"], "left").withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
        rest = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(home != F.col("shard"))
        found = near.unionByName(rest.groupBy("span", "block").cogroup(asked.groupBy("span", "block")).applyInPandas(tile, FOUND))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
