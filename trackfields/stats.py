"""Statistics on tables: distances on the sphere, circular means, ranks, paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tails
from .clean import finite

EARTH_KM = 6371.0
#: Rows of a range, the most quantiles of a group, their accuracy, and how many limits are passed at a step.
ROWS, QUANTILES, ACCURACY, STEP = 20_000, 1_024, 10_000, 32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def circular(df: DataFrame, angle: str, *by: str) -> DataFrame:
    """n, mean direction in [0, 360) and resultant length."""
    c, s = F.avg(F.cos(F.radians(angle))), F.avg(F.sin(F.radians(angle)))
    return df.groupBy(*by).agg(F.count(angle).alias("n"), F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)).alias("mean_deg"), F.sqrt(c * c + s * s).alias("length"))


def cumulative(d: DataFrame, t: str, columns: list[str], *by: str, descending: bool = False) -> DataFrame:
    """``d``, one row per group and value of ``t``, with c_before (the sum over the rows before it in the group) and c_total for each column.

    Running sums go in two passes, over value ranges and within them, so no task holds a whole group. Each group has ranges of its
    own, about ``ROWS`` rows in each: their limits are approximate quantiles of the group (``QUANTILES`` at most), and where that is too few for the group's rows, each
    range is cut into equal widths. Results do not depend on the limits. All is one plan; no job runs while it is built.
    """
    limits = d.groupBy(*by).agg(F.count("*").alias("_rows"), F.percentile_approx(F.col(t).cast("double"), [i / QUANTILES for i in range(1, QUANTILES)], ACCURACY).alias("_all"))
    ranges = F.greatest(F.lit(1), F.least(F.lit(QUANTILES), F.ceil(F.col("_rows") / ROWS))).cast("int")
    some = F.transform(F.sequence(F.lit(1), ranges - 1), lambda i: F.element_at("_all", F.floor(i * QUANTILES / ranges).cast("int")))
    limits = limits.select(*by, F.when(ranges > 1, F.array_distinct(some)).otherwise(F.array().cast("array<double>")).alias("_limits"), F.ceil(F.col("_rows") / (ROWS * ranges)).cast("int").alias("_cuts"))
    limits = limits.withColumn("_coarse", F.transform(F.sequence(F.lit(1), F.floor(F.size("_limits") / STEP).cast("int") + 1), lambda i: F.get("_limits", i * STEP - 1)))
    d = with_group(d, limits, *by)
    x, coarse = F.col(t).cast("double"), F.col("_coarse")
    skip = F.size(F.filter(coarse, lambda v: v < x)) * STEP  # limits below x, counted by the step and then one by one
    at = F.when(F.size("_limits") > 0, skip + F.size(F.filter(F.slice(F.col("_limits"), skip + 1, F.lit(STEP)), lambda v: v < x))).otherwise(0)
    low, high = F.get("_limits", F.col("_at") - 1), F.get("_limits", F.col("_at"))
    part = F.when((F.col("_cuts") > 1) & (high > low), F.least(F.col("_cuts") - 1, F.floor((x - low) / (high - low) * F.col("_cuts"))))
    d = d.withColumn("_at", at).withColumn("_range", F.struct("_at", F.coalesce(part, F.lit(0)).cast("int").alias("part"))).drop("_at", "_limits", "_cuts", "_coarse")
    sums = d.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in columns])
    way = F.desc if descending else F.asc
    before = Window.partitionBy(*by).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    whole = Window.partitionBy(*by)
    sums = sums.select(*by, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(c).over(whole).alias(f"{c}_total") for c in columns])
    d = with_group(d, sums, *by, "_range")
    own = Window.partitionBy(*by, "_range").orderBy(way(t)).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumns({f"{c}_before": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in columns}).drop("_range", *[f"_b_{c}" for c in columns])


def quantiles(df: DataFrame, x: str, shares: dict[str, float], *by: str) -> DataFrame:
    """by and, for each name, the exact quantile with linear interpolation, over finite values."""
    v = finite(F.col(x).cast("double"))
    d = cumulative(df.select(*by, v.alias("_x")).where("_x is not null").groupBy(*by, "_x").agg(F.count("*").alias("_n")), "_x", ["_n"], *by)
    out = []
    for name, q in shares.items():
        place = q * (F.col("_n_total") - 1)
        at = lambda k: F.max(F.when((F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col("_n")), F.col("_x")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return d.groupBy(*by).agg(*out)


def summary(df: DataFrame, x: str, *by: str) -> DataFrame:
    """n, mean, median, population deviation, min, max, p10, p90, over finite values."""
    d = df.withColumn(x, finite(F.col(x))).where(F.col(x).isNotNull())
    plain = d.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    q = quantiles(d, x, {"median": 0.5, "p10": 0.1, "p90": 0.9}, *by)
    both = with_group(plain, q, *by)
    return both.select(*by, "n", "mean", "median", "sd", "lo", "hi", "p10", "p90")


def with_group(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """One row of ``b`` beside each row of ``a`` of the same group (null is a group)."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row
    b = b.select(*[F.col(c).alias(f"_g_{c}") if c in by else F.col(c) for c in b.columns])
    on = F.lit(True)
    for c in by:
        on = on & a[c].eqNullSafe(b[f"_g_{c}"])
    return a.join(b, on).drop(*[f"_g_{c}" for c in by])


def average_rank(df: DataFrame, x: str, name: str, *by: str, ties: str | None = None) -> DataFrame:
    """Ranks from 1 within each group; ties share their average, and ``ties`` counts them. Rows without a finite value are dropped."""
    d = df.withColumn(x, finite(F.col(x).cast("double"))).where(F.col(x).isNotNull())
    r = cumulative(d.groupBy(*by, x).agg(F.count("*").alias("_n")), x, ["_n"], *by)
    rank = (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name)
    return with_group(d, r.select(*by, x, rank, *([F.col("_n").alias(ties)] if ties else [])), *by, x)


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """n, rho and its two-sided p by Student's distribution, over rows where both are finite.

    Both columns are ranked in one pass over (column, value) counts; equal pairs of values go through it once.
    """
    a, b = finite(F.col(x).cast("double")), finite(F.col(y).cast("double"))
    d = df.select(*by, a.alias("_x"), b.alias("_y")).where("_x is not null and _y is not null").groupBy(*by, "_x", "_y").agg(F.count("*").alias("_w"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.col("_x").alias("_v")), F.struct(F.lit(1).alias("_side"), F.col("_y").alias("_v"))))
    counts = d.select(*by, "_w", sides.alias("_s")).groupBy(*by, F.col("_s._side").alias("_side"), F.col("_s._v").alias("_v")).agg(F.sum("_w").alias("_n"))
    ranks = cumulative(counts, "_v", ["_n"], *by, "_side").withColumn("_r", F.col("_n_before") + (F.col("_n") - F.col("_n_total")) / 2)
    for side, column, name in ((0, "_x", "_rx"), (1, "_y", "_ry")):
        d = with_group(d, ranks.where(F.col("_side") == side).select(*by, F.col("_v").alias(column), F.col("_r").alias(name)), *by, column)
    # Both columns' ranks lie around (n + 1) / 2.
    p, q, w = F.col("_rx"), F.col("_ry"), F.col("_w")
    out = d.groupBy(*by).agg(F.sum("_w").alias("n"), (F.sum(w * p * q) / F.nullif(F.sqrt(F.sum(w * p * p) * F.sum(w * q * q)), F.lit(0.0))).alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    p = F.when(F.abs("rho") >= 1, F.when(F.col("n") > 2, 0.0)).otherwise(tails.student_two_sided(t, F.col("n") - 2))
    return out.withColumn("p", p)


def mann_whitney(df: DataFrame, x: str, label: str, *by: str) -> DataFrame:
    """U of the rows with label 1 over those with 0, Cliff's delta, and z and p of the one-sided test that label 1 is greater.

    z has the correction for ties and half a rank of continuity; it is null where all values are equal.
    """
    d = average_rank(df.where(F.col(x).isNotNull() & F.col(label).isin(0, 1)), x, "_r", *by, ties="_t")
    y = F.col(label) == 1
    tied = F.sum(F.pow(F.col("_t").cast("double"), 2) - 1)  # over rows: t * (t * t - 1) for each value
    d = d.groupBy(*by).agg(F.sum(F.when(y, F.col("_r"))).alias("r"), F.count(F.when(y, 1)).alias("m"), F.count(F.when(~y, 1)).alias("n"), tied.alias("tied"))
    m, n = F.col("m"), F.col("n")
    u = F.col("r") - m * (m + 1) / 2
    every = (m + n).cast("double")
    spread = F.sqrt(m.cast("double") * n / 12 * (every + 1 - F.col("tied") / F.nullif(every * (every - 1), F.lit(0.0))))
    z = (u - m * n / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    return d.select(*by, "m", "n", u.alias("u"), (2 * u / F.nullif(m * n, F.lit(0)) - 1).alias("delta"), z.alias("z")).withColumn("p_greater", tails.normal_tail(F.col("z")))


def paired_t(df: DataFrame, d: str, *by: str) -> DataFrame:
    """n, dropped (rows without a finite difference), mean, Student's t of a mean of 0 and its two-sided p."""
    x = finite(F.col(d).cast("double"))
    t = F.avg(x) / F.nullif(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.count(F.when(x.isNull(), 1)).alias("dropped"), F.avg(x).alias("mean"), t.alias("t"))
    return out.withColumn("p", tails.student_two_sided(F.col("t"), F.col("n") - 1))


def drop_report(df: DataFrame, a: str, b: str, *by: str, level: float = 0.05) -> DataFrame:
    """Of two arms' drops: pairs, rows left out, both means, the difference with t and p, how often ``a`` is stronger, and whether it is so at the level."""
    x, y = finite(F.col(a).cast("double")), finite(F.col(b).cast("double"))
    both = x.isNotNull() & y.isNotNull()
    means = df.groupBy(*by).agg(F.avg(F.when(both, x)).alias(f"mean_{a}"), F.avg(F.when(both, y)).alias(f"mean_{b}"), F.avg((x > y).cast("double")).alias("stronger"))
    out = with_group(paired_t(df.withColumn("_d", x - y), "_d", *by).withColumnRenamed("mean", "difference"), means, *by)
    return out.withColumn("significant", F.coalesce((F.col("p") < level) & (F.col("difference") > 0), F.lit(False)))


def share_within(df: DataFrame, x: str, limits: tuple[float, ...]) -> DataFrame:
    return df.agg(*[F.avg((F.col(x) <= v).cast("double")).alias(f"within_{v:g}") for v in limits])


def paired_skill(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """n, pairs, paired means, mean difference and the share of pairs in which ``a`` is closer."""
    x, y = finite(F.col(a)), finite(F.col(b))
    both = x.isNotNull() & y.isNotNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(both, 1)).alias("paired"), F.avg(F.when(both, x)).alias("mean_a"), F.avg(F.when(both, y)).alias("mean_b"), F.avg(x - y).alias("difference"), F.avg((x < y).cast("double")).alias("closer")
    )


def across_runs(df: DataFrame, run: str, *metrics: str) -> DataFrame:
    """metric, mean, population deviation, min, max, runs, and the runs' values in order."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))
    d = df.select(F.col(run).alias("run"), rows.alias("r"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("run", "r.x"))), lambda v: v["x"])  # a value per run
    return d.groupBy("r.metric").agg(F.avg("r.x").alias("mean"), F.stddev_pop("r.x").alias("sd"), F.min("r.x").alias("lo"), F.max("r.x").alias("hi"), F.count("*").alias("runs"), values.alias("values"))


def strata(df: DataFrame, x: str, d: str, least: int) -> DataFrame:
    """stratum (quarter of ``x``), n and the mean of ``d``, null in strata of fewer than ``least`` rows."""
    edges = quantiles(df, x, {"_a": 0.25, "_b": 0.5, "_c": 0.75})
    above = sum(((F.col(x) > F.col(e)).cast("int") for e in ("_a", "_b", "_c")), F.lit(0))
    return df.crossJoin(F.broadcast(edges)).groupBy(above.alias("stratum")).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.avg(d)).alias("mean"))  # one row of edges
