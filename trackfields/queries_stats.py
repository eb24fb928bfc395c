"""Queries on metrics, calibration, fitted models, permutation tests and bootstraps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import labels, metrics, models, resampling, splits, stats
from .queries import HAVERSINE, LABELLED, SCORES, STEPS, TRACK, _r, _steps, labelled, query, scores, track

U = "('0x' || substr(md5({k}), 1, 8))::bigint / 4294967296"
POISSON = "(" + " + ".join(f"({U.format(k='{k}')} >= {p!r})::int" for p in resampling.POISSON) + ")"


@query("m13_core", f"""with {SCORES}, s as (select * from scores where event_id % 3 = 0), g as (select score as t, sum(y) as pos, sum(1 - y) as neg from s group by 1), c as (select *, sum(pos) over (order by t desc) as tp, sum(neg) over (order by t desc) as fp, sum(pos) over () as p, sum(neg) over () as n from g),
  r as (select sum(pos * (n - fp + neg / 2)) / any_value(p * n) as roc_auc, sum(pos / p * tp / (tp + fp)) as pr_auc from c), b as (select avg(pow(score - y, 2)) as brier, sum((score >= 0.1)::int * y) as tp, sum((score >= 0.1)::int * (1 - y)) as fp, sum((score < 0.1)::int * y) as fn from s),
  k as (select least(floor(score * 10), 9) as bin, count(*) as n, abs(avg(score) - avg(y)) as gap from s group by 1), e as (select sum(n * gap) / sum(n) as ece, max(gap) as mce from k)
  select round(roc_auc, 9) as roc_auc, round(pr_auc, 9) as pr_auc, round(brier, 9) as brier, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall, round(2 * tp / (2 * tp + fp + fn), 9) as f1, round(ece, 9) as ece, round(mce, 9) as mce from r, b, e""")
def m13_core(spark, sf_dir):
    d = metrics.core(scores(spark, sf_dir).where("event_id % 3 = 0"), 0.1)
    return _r(d, *d.columns, digits=9)


@query("m14_platt")
def m14_platt(spark, sf_dir):
    s = scores(spark, sf_dir).where("score > 0 and score < 1").withColumn("z", F.log(F.col("score") / (1 - F.col("score"))))
    d = models.calibrated(s, *models.platt(s.where("event_id % 2 = 0")))
    return d.where("event_id % 2 = 1").select("event_id", "y", "score", "calibrated")


@query("m15_baseline")
def m15_baseline(spark, sf_dir):
    d = labels.past_change(labelled(spark, sf_dir), 10, 14, "past12").where("label is not null and wind_kt is not null")
    of = splits.folds(d, "sid", "label", 3).select("sid", "fold")
    rows = d.join(of, "sid").select("sid", "h", F.col("label").alias("y"), "wind_kt", "past12", "lat", "fold")
    return models.out_of_fold(rows, ["wind_kt", "past12", "lat"], [0, 1, 2]).select("sid", "h", "y", "fold", F.round("score", 6).alias("score"))


DIFFS = f"{TRACK}, df as (select sid, avg(case when h % 12 = 0 then wind_kt end) - avg(case when h % 12 <> 0 then wind_kt end) as d, sid::bigint % 2 as g, avg(wind_kt) as x from track group by 1), diffs as (select * from df where d is not null)"


def _diffs(spark, sf_dir):
    w = F.col("wind_kt")
    d = track(spark, sf_dir).groupBy("sid").agg((F.avg(F.when(F.col("h") % 12 == 0, w)) - F.avg(F.when(F.col("h") % 12 != 0, w))).alias("d"), F.avg(w).alias("x"))
    return d.where("d is not null").withColumn("g", F.col("sid").cast("long") % 2)


@query("t10_sign_flip", f"with {DIFFS}, m as (select r, avg(case when {U.format(k="r || ':' || sid")} < 0.5 then d else -d end) as m from diffs, range(1, 101) q(r) group by 1), o as (select avg(d) as observed from diffs) select round((sum((abs(m) >= abs(observed) - 1e-12)::int) + 1) / 101, 9) as p, round((sum((m <= observed + 1e-12)::int) + 1) / 101, 9) as p_less, round(any_value(observed), 6) as observed from m, o")
def t10_sign_flip(spark, sf_dir):
    return _r(_r(resampling.sign_flip(_diffs(spark, sf_dir), "d", "sid", 100), "p", "p_less", digits=9), "observed")


@query("t11_label_permutation", f"""with {DIFFS}, k as (select r, sid, x, row_number() over (partition by r order by md5(r || ':' || sid), sid) as k from diffs, range(1, 41) q(r)), n as (select sum(g) as ones from diffs), m as (select r, median(case when k <= ones then x end) - median(case when k > ones then x end) as m from k, n group by 1),
  o as (select median(case when g = 1 then x end) - median(case when g = 0 then x end) as observed from diffs) select round((sum((abs(m) >= abs(observed) - 1e-12)::int) + 1) / 41, 9) as p, round(any_value(observed), 6) as observed from m, o""")
def t11_label_permutation(spark, sf_dir):
    return _r(_r(resampling.label_permutation(_diffs(spark, sf_dir), "x", "g", "sid", 40), "p", digits=9), "observed")


ANGLES = f"{STEPS}, ang as (select sid, avg(bg) as a, max(bg) as b from steps group by 1)"


def _angles(spark, sf_dir):
    half = F.when(F.col("bearing") > 180, F.col("bearing") - 360).otherwise(F.col("bearing"))
    return _steps(spark, sf_dir).groupBy("sid").agg(F.avg(half).alias("a"), F.max(half).alias("b"))


@query("t12_pairing_permutation", f"""with {ANGLES}, x as (select r, sid, a, row_number() over (partition by r order by sid) as k from ang, range(1, 41) q(r)), y as (select r, b, row_number() over (partition by r order by md5(r || ':' || sid), sid) as k from ang, range(1, 41) q(r)),
  m as (select r, sqrt(pow(avg(cos(radians(a - b))), 2) + pow(avg(sin(radians(a - b))), 2)) as m from x join y using (r, k) group by 1), o as (select sqrt(pow(avg(cos(radians(a - b))), 2) + pow(avg(sin(radians(a - b))), 2)) as observed from ang)
  select round((sum((m >= observed - 1e-12)::int) + 1) / 41, 9) as p, round(any_value(observed), 6) as observed from m, o""")
def t12_pairing_permutation(spark, sf_dir):
    return _r(_r(resampling.pairing_permutation(_angles(spark, sf_dir), "a", "b", "sid", 40), "p", digits=9), "observed")


@query("t13_random_points", f"""with {STEPS}, e as (select sid || '_' || h as id, lat as clat, lon as clon, blat as lat, blon as lon from nx where blat is not null), d as (select r, lat as blat, lon as blon, clat + (2 * {U.format(k="r || ':' || id || ':y'")} - 1) * 5 as alat, clon + (2 * {U.format(k="r || ':' || id || ':x'")} - 1) * 5 as alon from e, range(1, 41) q(r)),
  m as (select r, median({HAVERSINE.format(a='a', b='b')}) as m from d group by 1), o as (select median({HAVERSINE.format(a='c', b='')}) as observed from e) select round((sum((m <= observed + 1e-9)::int) + 1) / 41, 9) as p, round(any_value(observed), 5) as observed from m, o""")
def t13_random_points(spark, sf_dir):
    w = Window.partitionBy("sid").orderBy("h")
    t = track(spark, sf_dir).withColumns({"blat": F.lead("lat").over(w), "blon": F.lead("lon").over(w)}).where("blat is not null")
    e = t.select(F.concat_ws("_", "sid", "h").alias("id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.col("blat").alias("lat"), F.col("blon").alias("lon"))
    return _r(_r(resampling.random_points(e, "id", 5.0, 40), "p", digits=9), "observed", digits=5)


def _mixed(x: str, *, steps: tuple = ((16, 2246822507), (13, 3266489909))) -> str:
    """``resampling._mix`` of column x (ubigint) as the last of a chain of subqueries' columns."""
    for shift, by in steps:
        x = f"((xor({x}, {x} >> {shift}) * {by}::ubigint) & 4294967295::ubigint)"
    return f"xor({x}, {x} >> 16)"


def _boot(seeds: str, b: str, n: int) -> str:
    return f"""with {SCORES}, s as (select seed, sid, y, score as a, {b} as b from scores, (select unnest([{seeds}]) as seed)), k as (select distinct sid, ('0x' || substr(md5(sid), 1, 8))::ubigint as h1, ('0x' || substr(md5(sid), 9, 8))::ubigint as h2 from scores),
  q as (select r, sid, h2, ((h1 + r::ubigint * 2654435769::ubigint) & 4294967295::ubigint) as x from k, range(1, {n + 1}) q(r)), q2 as (select r, sid, xor({_mixed("x")}, h2) as x from q), q3 as (select r, sid, {_mixed("x")}::double / 4294967296 as u from q2),
  w as (select r, sid, {" + ".join(f"(u >= {p!r})::int" for p in resampling.POISSON)} as w from q3),
  l as (select r, seed, arm, t, sum(w * y) as pos, sum(w * (1 - y)) as neg from (select r, seed, w, y, 'a' as arm, a as t from s join w using (sid) union all select r, seed, w, y, 'b', b from s join w using (sid)) where w > 0 group by 1, 2, 3, 4),
  c as (select *, sum(pos) over o as tp, sum(neg) over o as fp, sum(pos) over (partition by r, seed, arm) as p, sum(neg) over (partition by r, seed, arm) as n from l window o as (partition by r, seed, arm order by t desc)),
  u as (select r, seed, arm, sum(pos * (n - fp + neg / 2)) / nullif(any_value(p * n), 0) as roc_auc, case when any_value(p * n) > 0 then sum(pos * tp / (tp + fp)) / any_value(p) end as pr_auc from c group by 1, 2, 3),
  e as (unpivot u on roc_auc, pr_auc into name endpoint value v), g as (select endpoint, r, seed, max(case when arm = 'a' then v end) - max(case when arm = 'b' then v end) as d from e group by 1, 2, 3), m as (select endpoint, r, case when count(d) = count(*) then avg(d) end as d from g group by 1, 2),
  o as (select endpoint, avg(d) as mean, quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi, count(d) as used, ({n} - count(d))::bigint as skipped from m group by 1) select endpoint, round(mean, 9) as mean, round(lo, 9) as lo, round(hi, 9) as hi, used, skipped, case when lo > 0 then 'first' when hi < 0 then 'second' else 'none' end as verdict from o"""


def _two_arms(spark, sf_dir):
    return scores(spark, sf_dir).select("sid", "y", F.col("score").alias("a"), F.round((F.col("score") * 7 + F.col("event_id") % 10) / 17, 9).alias("b"))


@query("t14_cluster_bootstrap", _boot("1", "round((score * 7 + event_id % 10) / 17, 9)", 100))
def t14_cluster_bootstrap(spark, sf_dir):
    return _r(resampling.cluster_bootstrap(_two_arms(spark, sf_dir), "sid", "a", "b", 100), "mean", "lo", "hi", digits=9)


@query("t14_ten_thousand")
def t14_ten_thousand(spark, sf_dir):
    return _r(resampling.cluster_bootstrap(_two_arms(spark, sf_dir), "sid", "a", "b", 10_000), "mean", "lo", "hi", digits=9)


@query("t15_across_seeds", _boot("1, 2, 3", "round((score * 7 + event_id * seed % 10) / 17, 9)", 40))
def t15_across_seeds(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    s = s.select("seed", "sid", "y", F.col("score").alias("a"), F.round((F.col("score") * 7 + F.col("event_id") * F.col("seed") % 10) / 17, 9).alias("b"))
    return _r(resampling.cluster_bootstrap(s, "sid", "a", "b", 40, "seed"), "mean", "lo", "hi", digits=9)


PAIRS = f"{TRACK}, f as (select *, h - min(h) over (partition by sid) as lag from track), pairs as (select a.sid, a.lag, a.wind_kt as x, b.wind_kt as z, a.wind_kt - b.wind_kt as d from f a join f b on b.sid::bigint = a.sid::bigint + 1 and a.lag = b.lag where a.sid::bigint % 2 = 0)"


def _pairs(spark, sf_dir):
    t = track(spark, sf_dir).withColumn("lag", F.col("h") - F.min("h").over(Window.partitionBy("sid")))
    u = F.col("sid").cast("long")
    a, b = t.where(u % 2 == 0).select("sid", "lag", F.col("wind_kt").alias("x")), t.where(u % 2 == 1).select((u - 1).cast("string").alias("sid"), "lag", F.col("wind_kt").alias("z"))
    return a.join(b, ["sid", "lag"]).withColumn("d", F.col("x") - F.col("z"))


@query("t16_lag_profile", f"""with {PAIRS}, l as (select lag, x as v, 1 as y from pairs where d is not null union all select lag, z, 0 from pairs where d is not null), r as (select lag, y, rank() over (partition by lag order by v) + (count(*) over (partition by lag, v) - 1) / 2 as r from l),
  c as (select lag, 2 * (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) - 1 as delta from r group by 1) select lag, count(d) as n, round(avg(d), 6) as mean, round(any_value(delta), 9) as delta from pairs join c using (lag) where d is not null group by 1""")
def t16_lag_profile(spark, sf_dir):
    p = _pairs(spark, sf_dir).where("d is not null")
    sides = F.explode(F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("y")), F.struct(F.col("z").alias("v"), F.lit(0).alias("y"))))
    delta = stats.mann_whitney(p.select("lag", sides.alias("s")).select("lag", "s.*"), "v", "y", "lag").select("lag", "delta")
    return _r(_r(p.groupBy("lag").agg(F.count("d").alias("n"), F.avg("d").alias("mean")).join(delta, "lag"), "mean"), "delta", digits=9)


@query("t17_strata", f"with {PAIRS}, q as (select quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as b, quantile_cont(x, 0.75) as c from pairs where d is not null), s as (select (x > a)::int + (x > b)::int + (x > c)::int as stratum, d from pairs, q where d is not null) select stratum, count(*) as n, case when count(*) >= 20 then round(avg(d), 6) end as mean from s group by 1")
def t17_strata(spark, sf_dir):
    return _r(stats.strata(_pairs(spark, sf_dir).where("d is not null"), "x", "d", 20), "mean")


def _pair_differences(spark, sf_dir):
    """Standardised differences of matched pairs: wind, its change since the fix before, and latitude."""
    w = Window.partitionBy("sid").orderBy("h")
    t = track(spark, sf_dir).withColumns({"lag": F.col("h") - F.min("h").over(Window.partitionBy("sid")), "trend": F.col("wind_kt") - F.lag("wind_kt").over(w)})
    u, names = F.col("sid").cast("long"), ("wind_kt", "trend", "lat")
    a, b = t.where(u % 2 == 0).select("sid", "lag", *names), t.where(u % 2 == 1).select((u - 1).cast("string").alias("sid"), "lag", *[F.col(c).alias(f"_{c}") for c in names])
    d = a.join(b, ["sid", "lag"]).select(F.concat_ws("_", "sid", "lag").alias("id"), *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in names]).na.drop()
    scale = d.agg(*[F.stddev_pop(c).alias(f"_{c}") for c in names])
    return d.crossJoin(F.broadcast(scale)).select("id", *[(F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in names])  # one row


@query("t18_conditional_logit")
def t18_conditional_logit(spark, sf_dir):
    d = resampling.pair_coefficients(_pair_differences(spark, sf_dir), ("wind_kt", "trend", "lat"), "id", 500)
    return _r(_r(d, "beta"), "p", digits=9)
