"""Leakage-safe splits, folds and samples by hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_fraction(key: Column) -> Column:
    """A stable number in [0, 1) of a text: the first 16 hex digits of its SHA-256, modulo 10**8."""
    digits = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (digits % F.lit(100_000_000)).cast("double") / F.lit(1e8)


def assign(key: Column, train: float = 0.7, val: float = 0.15, test: float = 0.15) -> Column:
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("the shares of a split must add up to 1")
    f = hash_fraction(key)
    return F.when(f < train, "train").when(f < train + val, "val").otherwise("test")


def make_splits(df: DataFrame, key: str, frozen: DataFrame | None = None, **shares: float) -> DataFrame:
    """Rows with ``split``: that of the frozen map (key, split) where it has the key, else by hash."""
    own = assign(F.col(key), **shares)
    if frozen is None:
        return df.withColumn("split", own)
    return df.join(frozen.select(key, F.col("split").alias("_frozen")), key, "left").withColumn("split", F.coalesce("_frozen", own)).drop("_frozen")


def folds(df: DataFrame, group: str, label: str, n: int = 5, seed: int = 0) -> DataFrame:
    """(group, fold): no group in two folds; positives and sizes dealt out in serpentine order."""
    g = df.groupBy(group).agg(F.sum(F.coalesce(F.col(label), F.lit(0))).alias("positives"), F.count("*").alias("size"))
    # Numbered within parts of equal positives and size by a stretch of the hash, then across parts: no window holds all groups.
    g = g.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))).withColumn("_part", F.substring("_h", 1, 2))
    parts = g.groupBy("positives", "size", "_part").count()  # 256 rows for each pair of positives and size
    earlier = F.coalesce(F.sum("count").over(Window.orderBy(F.desc("positives"), F.desc("size"), "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.join(parts.select("positives", "size", "_part", earlier.alias("_earlier")), ["positives", "size", "_part"])
    k = F.col("_earlier") + F.row_number().over(Window.partitionBy("positives", "size", "_part").orderBy("_h", group)) - 1
    place = (k % n).cast("int")
    return g.select(group, "positives", "size", F.when(F.floor(k / n) % 2 == 0, place).otherwise(n - 1 - place).cast("int").alias("fold"))


def fold_plan(df: DataFrame, group: str, label: str, n: int, seeds: tuple[int, ...]) -> DataFrame:
    """seed, fold, n_train, n_val, n_pos_val."""
    out = None
    for seed in seeds:
        f = folds(df, group, label, n, seed).groupBy("fold").agg(F.sum("size").alias("n_val"), F.sum("positives").alias("n_pos_val"))
        rest = F.sum("n_val").over(Window.partitionBy()) - F.col("n_val")  # a row per fold
        f = f.select(F.lit(seed).alias("seed"), "fold", rest.alias("n_train"), "n_val", "n_pos_val")
        out = f if out is None else out.unionByName(f)
    return out


def sample(df: DataFrame, stratum: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows per stratum, the least by a hash of seed and key: a seeded sample that any engine repeats."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows (all, if fewer): an equal share of each stratum, one at least, and the rest by rank over all others.

    Ranks are by a hash of seed and key, so any engine repeats the sample. Strata of fewer rows than their share give all of
    them. More strata than ``n`` give a row each. A null stratum is one.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    strata = sizes.count()
    share = max(1, n // max(1, strata))
    first = sizes.agg(F.sum(F.least(F.col("_n"), F.lit(share)))).head()[0] or 0
    w = Window.partitionBy(stratum).orderBy("_h", key)  # held to ``share`` rows before the shuffle
    ranked = df.withColumn("_h", h)
    own = ranked.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= share).drop("_k")
    rest = ranked.join(own.select(F.col(key).alias("_own")), F.col(key) == F.col("_own"), "left_anti")
    return own.unionByName(rest.orderBy("_h", key).limit(max(0, n - first))).drop("_h")
