"""Joins of tracks and fields: exact, nearest in time, windows in space, anti-ranges, and comparisons of two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import epoch_s


def compared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with where each key is found: both, left_only, right_only."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    found = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    return x.join(y, keys, "full").select(*keys, found.alias("found"))


def filled_basin(df: DataFrame, raw: DataFrame, order: str) -> DataFrame:
    """Blank basins filled with the storm's first basin in ``raw``; other values stay."""
    first = raw.groupBy("sid").agg(F.min_by("basin", order).alias("_first"))
    blank = F.coalesce(F.trim("basin"), F.lit("")) == ""
    return df.join(first, "sid", "left").withColumn("basin", F.when(blank, F.coalesce("_first", "basin")).otherwise(F.col("basin"))).drop("_first")


def nearest_time(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, span: int = 30 * 86_400) -> DataFrame:
    """For each row of ``left`` the ``value`` of the row of ``right`` nearest in time with equal keys; the earlier on ties.

    One union, no range join. A key's rows are worked in stretches of ``span`` seconds; what lies nearest outside a stretch is carried
    over from a table of one row per key and stretch, so a hot key is many tasks.
    """
    s = epoch_s(F.col(ts)).alias("_s")
    a = left.select("*", s, F.lit(None).cast("struct<s:bigint,v:double>").alias("_r"), F.lit(1).alias("_own"))
    b = right.select(*keys, s, F.struct(epoch_s(F.col(ts)).alias("s"), F.col(value).cast("double").alias("v")).alias("_r"), F.lit(0).alias("_own"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_s") / span))
    at = [*keys, "_b"]
    stretches = both.groupBy(*at).agg(F.max("_r").alias("_hi"), F.min("_r").alias("_lo"))
    order = Window.partitionBy(*keys).orderBy("_b")
    before, after = F.last("_hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.first("_lo", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    stretches = stretches.select(*at, before.alias("_before"), after.alias("_after"))
    w, v = Window.partitionBy(*at).orderBy("_s", "_own"), Window.partitionBy(*at).orderBy(F.col("_s").desc(), "_own")
    both = both.withColumn("_p", F.last("_r", True).over(w)).withColumn("_n", F.last("_r", True).over(v)).where("_own = 1").join(stretches, at, "left")
    both = both.withColumn("_p", F.coalesce("_p", "_before")).withColumn("_n", F.coalesce("_n", "_after"))
    take = F.when(F.col("_n").isNull() | (F.col("_s") - F.col("_p.s") <= F.col("_n.s") - F.col("_s")), F.col("_p")).otherwise(F.col("_n"))
    return both.withColumn("_t", take).select(*left.columns, F.col("_t.s").alias("found_s"), F.col("_t.v").alias("found"))


def outside_run_up(df: DataFrame, flag: str, hours: int = 24, ts: str = "ts") -> DataFrame:
    """Rows that are no onset and not within ``hours`` before an onset of their storm."""
    s = epoch_s(F.col(ts))
    ahead = Window.partitionBy("sid").orderBy("_s").rangeBetween(1, hours * 3600)
    near = F.max(F.when(F.col(flag), 1)).over(ahead)
    return df.withColumn("_s", s).withColumn("_near", near).where(~F.col(flag) & F.col("_near").isNull()).drop("_s", "_near")


def windows(events: DataFrame, grid: DataFrame, size: int) -> DataFrame:
    """Grid cells of the ``size`` x ``size`` window around each event: rows i - size/2 up to, not including, i + size/2.

    ``events``: event_id, time, ci, cj; ``grid``: time, i, j and fields. Both are dealt by time and tile, where a tile is as
    wide as a window, so an event touches four tiles at most and one hot time is many keys.
    """
    half = size // 2
    tiles = lambda c: F.sequence(F.floor((c - half) / size), F.floor((c + half - 1) / size))
    e = events.withColumn("ti", F.explode(tiles(F.col("ci")))).withColumn("tj", F.explode(tiles(F.col("cj"))))
    g = grid.withColumn("ti", F.floor(F.col("i") / size)).withColumn("tj", F.floor(F.col("j") / size))
    near = (F.col("i") >= F.col("ci") - half) & (F.col("i") < F.col("ci") + half) & (F.col("j") >= F.col("cj") - half) & (F.col("j") < F.col("cj") + half)
    return e.join(g, ["time", "ti", "tj"]).where(near).drop("ti", "tj")


def with_peaks(predictions: DataFrame, peaks: DataFrame, keys: list[str], accepted: tuple[str, ...]) -> DataFrame:
    """``predictions`` with ``outcome``: used, no_peak, or the status that excludes the peak."""
    d = predictions.join(peaks.select(*keys, "status"), keys, "left")
    return d.withColumn("outcome", F.when(F.col("status").isNull(), "no_peak").when(F.col("status").isin(*accepted), "used").otherwise(F.concat(F.lit("status_"), "status")))
