"""Queries on labels' versions, alignments, censuses, splits, eligibility and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import audit, clean, grid, joins, labels, metrics, splits, stats, summary
from .queries import FIXES, LABELLED, ONSETS, PATCH, POSITIONAL, SCORES, STEPS, TRACK, _onsets, _r, _steps, _versions, fixes, labelled, patches, query, scores, track

SPLIT = "case when ((('0x' || substr(sha256({k}), 1, 16))::ubigint % 100000000) / 1e8) < 0.7 then 'train' when ((('0x' || substr(sha256({k}), 1, 16))::ubigint % 100000000) / 1e8) < 0.7 + 0.15 then 'val' else 'test' end"
OF_SID, OF_EVENT = SPLIT.format(k="sid"), SPLIT.format(k="event_id::varchar")


@query("p11_covered", f"with {LABELLED} select sid, h, label from labelled where month(ts) in (1, 2, 3, 6, 7) and lat between 12 and 30 and lon between -55 and -15 and label is not null")
def p11_covered(spark, sf_dir):
    d = clean.in_box(labelled(spark, sf_dir), 30, -55, 12, -15)
    return d.where(F.month("ts").isin(1, 2, 3, 6, 7) & F.col("label").isNotNull()).select("sid", "h", "label")


@query("p12_search", f"with {TRACK}, s as (select sid, 'Storm ' || sid as name, year(min(ts))::varchar as year, min(h) as first_h from track group by 1) select * from s where contains(lower(name), '12') or contains(year, '12')")
def p12_search(spark, sf_dir):
    s = track(spark, sf_dir).groupBy("sid").agg(F.year(F.min("ts")).cast("string").alias("year"), F.min("h").alias("first_h"))
    return summary.search(s.select("sid", F.concat(F.lit("Storm "), "sid").alias("name"), "year", "first_h"), "12").orderBy(F.desc("first_h"), "sid")


@query("p13_rounding", f"with {TRACK} select sid, h, round_even(wind_kt, 1) as wind, round_even(lat / 3, 4) as lat, round_even(wind_kt / 7, 2) as env from track")
def p13_rounding(spark, sf_dir):
    t = track(spark, sf_dir)
    return t.select("sid", "h", F.bround("wind_kt", 1).alias("wind"), F.bround((F.col("lat") / 3).cast("double"), 4).alias("lat"), F.bround(F.col("wind_kt") / 7, 2).alias("env"))


SPLITS = f"{POSITIONAL}, vs as (select *, (p12 >= 0)::int as old, {OF_SID} as split from versions)"


def _by_split(spark, sf_dir):
    return _versions(spark, sf_dir).withColumn("old", (F.col("p12") >= 0).cast("int")).withColumn("split", splits.assign(F.col("sid")))


@query("l13_lost_by_split", f"with {SPLITS}, s as (select sid, split, sum(old) as before, sum(coalesce(label, 0)) as after from vs group by 1, 2) select split, sum((before > 0 and after = 0)::int)::bigint as lost, sum((before = 0 and after > 0)::int)::bigint as gained, count(*) as storms from s group by 1")
def l13_lost_by_split(spark, sf_dir):
    s = _by_split(spark, sf_dir).groupBy("sid", "split").agg(F.sum("old").alias("before"), F.sum(F.coalesce("label", F.lit(0))).alias("after"))
    n = lambda c, name: F.sum(F.expr(c).cast("long")).alias(name)
    return s.groupBy("split").agg(n("before > 0 and after = 0", "lost"), n("before = 0 and after > 0", "gained"), F.count("*").alias("storms"))


@query("l15_applied", f"with {POSITIONAL} select sid, h, basin, label, round(dv24, 6) as value, (label is distinct from label_v1 or dv24 is distinct from p24)::int as changed from versions where h % 12 = 0 union all select sid, h, basin, label_v1, round(p24, 6), 0 from versions where h % 12 <> 0")
def l15_applied(spark, sf_dir):
    v = _versions(spark, sf_dir)
    old = v.select("sid", "h", "basin", F.col("label_v1").alias("label"), F.col("p24").alias("value"))
    new = v.where("h % 12 = 0").select("sid", "h", "label", F.col("dv24").alias("value"))
    return _r(audit.applied(old, new, ["sid", "h"], ["label", "value"]), "value")


@query("l15_untouched", f"with {POSITIONAL} select 0::bigint as lost, 0::bigint as gained, count(*) as n from versions")
def l15_untouched(spark, sf_dir):
    v = _versions(spark, sf_dir)
    old = v.select("sid", "h", "basin", "wind_kt", F.col("label_v1").alias("label"))
    after = audit.applied(old, v.select("sid", "h", "label"), ["sid", "h"], ["label"])
    return audit.differing_rows(old, after, ["sid", "h", "basin", "wind_kt"]).crossJoin(old.agg(F.count("*").alias("n")))  # one row each


@query("l17_transitions", f"with {SPLITS} select split, basin, coalesce(old::varchar, 'undefined') as old, coalesce(label::varchar, 'undefined') as label, count(*) as count from vs group by 1, 2, 3, 4")
def l17_transitions(spark, sf_dir):
    return labels.transitions(_by_split(spark, sf_dir), "old", "label", "split", "basin")


@query("j1_dev_events", f"with {LABELLED} select sid || '_' || h as event_id, {OF_SID} as split, label from labelled where h % 12 = 0 and label is not null and {OF_SID} <> 'test'")
def j1_dev_events(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("event_id", F.concat_ws("_", "sid", "h"))
    of = d.select("event_id", splits.assign(F.col("sid")).alias("split")).where("split <> 'test'")
    return of.join(d.where("h % 12 = 0").select("event_id"), "event_id").join(d.where("label is not null").select("event_id", "label"), "event_id")


@query("j10_frozen_rows", f"with {TRACK} select sid, h, wind_kt from track where sid::bigint % 3 = 0 and h % 12 = 0")
def j10_frozen_rows(spark, sf_dir):
    t = track(spark, sf_dir)
    return t.join(t.where("cast(sid as long) % 3 = 0 and h % 12 = 0").select("sid", "h"), ["sid", "h"], "left_semi").select("sid", "h", "wind_kt")


@query("j11_alignment", "select (count(*) + sum((event_id % 41 = 0)::int))::bigint as n, sum((event_id % 41 = 0)::int)::bigint as duplicated, sum((event_id % 37 = 0)::int)::bigint as unmatched, sum((event_id % 50 = 0 and event_id % 37 <> 0)::int)::bigint as mismatched from events")
def j11_alignment(spark, sf_dir):
    s = scores(spark, sf_dir).select("event_id", "y")
    truth = s.where("event_id % 37 <> 0").withColumn("y", F.when(F.col("event_id") % 50 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    return audit.alignment(s.unionByName(s.where("event_id % 41 = 0")), truth, "event_id", "y")


@query("j12_arms_aligned", "with k as (select unnest([1, 2, 3]) as seed), d as (select seed, sum((seed = 2 and event_id % 97 = 0)::int)::bigint as only_a, sum((seed = 3 and event_id % 89 = 0)::int)::bigint as labels_differ from events, k group by 1) select seed, only_a, 0::bigint as only_b, labels_differ, (only_a + labels_differ = 0)::int as usable from d")
def j12_arms_aligned(spark, sf_dir):
    s = scores(spark, sf_dir).select("event_id", "y").withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("arm", F.explode(F.array(F.lit("cnn"), F.lit("rows"))))
    s = s.where("not (arm = 'rows' and seed = 2 and event_id % 97 = 0)").withColumn("y", F.when(F.expr("arm = 'rows' and seed = 3 and event_id % 89 = 0"), 1 - F.col("y")).otherwise(F.col("y")))
    return audit.arms_aligned(s, "cnn", "rows")


@query("j13_exclusions", f"""with {STEPS}, d as (select sid, h, km, case when sid::bigint % 6 = 0 then null when h % 5 = 0 then 'invalid_all_nan' when h % 7 = 0 then 'qc_flagged' else 'ok' end as status from steps)
  select coalesce(case when status is null then 'no_peak' when status = 'invalid_all_nan' then 'status_' || status end, 'used') as outcome, count(*) as n, round(avg(km), 6) as km from d group by 1""")
def j13_exclusions(spark, sf_dir):
    s = _steps(spark, sf_dir)
    status = F.when(F.col("h") % 5 == 0, "invalid_all_nan").when(F.col("h") % 7 == 0, "qc_flagged").otherwise("ok")
    peaks = s.where("cast(sid as long) % 6 <> 0").select("sid", "h", status.alias("status"))
    d = joins.with_peaks(s.select("sid", "h", "km"), peaks, ["sid", "h"], ("ok", "qc_flagged"))
    return _r(d.groupBy("outcome").agg(F.count("*").alias("n"), F.avg("km").alias("km")), "km")


def _passes(band: float) -> str:
    """The passes of ``audit.matched_controls`` over a0 (cases) and b0 (controls): m1 to m9."""
    out = []
    for n, (stage, width, by, side) in enumerate(((k + 1, w, by, side) for k, (w, by) in enumerate(((band, ("basin",)), (band, ()), (1.5 * band, ()))) for side in (0, 1, -1)), 1):
        part = ", ".join((*by, "block"))
        order = "md5('0:' || id), id" if side == 0 else "value, md5('0:' || id), id"
        for kind, shift in (("a", 0), ("b", side)):
            out.append(f"{kind}n{n} as materialized (select *, row_number() over (partition by {part} order by {order}) as k, count(*) over (partition by {part}) as m from (select *, floor(value / {width}) - {shift} as block from {kind}{n - 1}))")
        place = lambda x, far: f"{x}.m - {x}.k" if far else f"{x}.k - 1"
        keys = " and ".join(f"x.{c} = y.{c}" for c in (*by, "block"))
        out.append(f"m{n} as materialized (select x.id as case_id, y.id as control_id, {stage} as pass from an{n} x join bn{n} y on {keys} and {place('x', side > 0)} = {place('y', side < 0)} and abs(x.value - y.value) <= {width})")
        out.append(f"a{n} as materialized (select * from a{n - 1} where id not in (select case_id from m{n}))")
        out.append(f"b{n} as materialized (select * from b{n - 1} where id not in (select control_id from m{n}))")
    return ", ".join(out) + " " + " union all ".join(f"select * from m{n}" for n in range(1, 10))


@query("j15_matched_controls", f"""with {ONSETS}, r as (select *, sid || '_' || h as id, wind_kt as value from onsets where wind_kt is not null), a0 as (select id, basin, value from r where onset),
  b0 as (select id, basin, value from r where not onset and label = 0), {_passes(20.0)}""")
def j15_matched_controls(spark, sf_dir):
    d = _onsets(spark, sf_dir).where("wind_kt is not null").withColumns({"id": F.concat_ws("_", "sid", "h"), "value": F.col("wind_kt")})
    return audit.matched_controls(d.where("onset").select("id", "basin", "value"), d.where("not onset and label = 0").select("id", "basin", "value"), 20.0)


@query("j16_repaired", f"with {TRACK}, f as (select sid, arg_min(basin, h) as fixed from track where sid::bigint % 5 <> 0 group by 1) select sid, h, coalesce(fixed, basin) as basin, case when fixed is null then 'unmatched' when fixed = basin then 'unchanged' else 'updated' end as outcome from track left join f using (sid)")
def j16_repaired(spark, sf_dir):
    t = track(spark, sf_dir)
    first = t.where("cast(sid as long) % 5 <> 0").groupBy("sid").agg(F.min_by("basin", "h").alias("basin"))
    return audit.repaired(t, first, "sid", "basin").select("sid", "h", "basin", "outcome")


@query("a4_missing_months", f"""with {TRACK}, need as (select distinct year(ts)::int as year, month(ts)::int as month from track), have as (select year, month, 1.5 * month as mb from need where month % 3 = 0)
  select n.year, count(*) as missing, round(count(*) * (select avg(mb) from have), 6) as mb from need n left join have v using (year, month) where v.mb is null group by 1""")
def a4_missing_months(spark, sf_dir):
    need = track(spark, sf_dir).select(F.year("ts").alias("year"), F.month("ts").alias("month")).distinct()
    have = need.where("month % 3 = 0").withColumn("mb", 1.5 * F.col("month"))
    return _r(summary.missing_months(need, have, "mb"), "mb")


@query("a5_genesis_basins", f"with {TRACK}, f as (select sid, arg_min(basin, h) as basin from track group by 1) select basin, count(*) as storms from f group by 1")
def a5_genesis_basins(spark, sf_dir):
    return track(spark, sf_dir).groupBy("sid").agg(F.min_by("basin", "h").alias("basin")).groupBy("basin").agg(F.count("*").alias("storms"))


@query("a7_value_transitions", f"with {TRACK}, d as (select case when h % 12 = 0 then 'blank' else basin end as old, first_value(basin) over (partition by sid order by h) as new from track) select old, new, count(*) as count from d group by 1, 2")
def a7_value_transitions(spark, sf_dir):
    t = track(spark, sf_dir)
    first = t.groupBy("sid").agg(F.min_by("basin", "h").alias("new"))
    return t.join(first, "sid").groupBy(F.when(F.col("h") % 12 == 0, "blank").otherwise(F.col("basin")).alias("old"), "new").count()


@query("a9_irregular_census", f"""with {TRACK}, g as (select basin, year(ts)::int as year, {OF_SID} as split, coalesce(h - lag(h) over (partition by sid order by h) <> 6, false)::int as odd from track)
  select 'basin' as dimension, basin as value, count(*) as n, sum(odd)::bigint as flagged from g group by basin union all select 'year', year::varchar, count(*), sum(odd)::bigint from g group by year union all select 'split', split, count(*), sum(odd)::bigint from g group by split""")
def a9_irregular_census(spark, sf_dir):
    d = summary.gaps(track(spark, sf_dir), ["h"]).withColumns({"odd": F.coalesce(F.col("gap_h") != 6, F.lit(False)), "year": F.year("ts"), "split": splits.assign(F.col("sid"))})
    return audit.census(d, "odd", "basin", "year", "split")


@query("a10_sortedness", f"with {FIXES}, l as (select sid, s, lag(s) over (partition by sid order by src_seq) as before from fixes), k as (select sid, s, count(*) as c from fixes group by 1, 2) select (select count(*) from l where s < before) as unsorted, (select count(*) from k where c > 1) as duplicated")
def a10_sortedness(spark, sf_dir):
    f = fixes(spark, sf_dir).withColumn("s", clean.epoch_s(F.col("ts")))
    back = f.withColumn("before", F.lag("s").over(Window.partitionBy("sid").orderBy("src_seq"))).agg(F.sum(F.coalesce(F.col("s") < F.col("before"), F.lit(False)).cast("long")).alias("unsorted"))
    return back.crossJoin(summary.duplicates(f, "sid", "s").agg(F.count("*").alias("duplicated")))  # one row each


COVER = f"{LABELLED}, cover as (select sid, h, year(ts)::int as year, {OF_SID} as split, dv24 is not null and wind_kt > 5 as has from labelled)"


def _cover(spark, sf_dir):
    return labelled(spark, sf_dir).select("sid", "h", F.year("ts").alias("year"), splits.assign(F.col("sid")).alias("split"), (F.col("dv24").isNotNull() & (F.col("wind_kt") > 5)).alias("has"))


@query("a11_census", f"with {COVER} select year, sum((split = 'train')::int)::bigint as train, sum((split = 'val')::int)::bigint as val, sum((split = 'test')::int)::bigint as test, sum((not has)::int)::bigint as lacking, case when bool_and(has) then 'pass' else 'fail' end as verdict from cover group by 1")
def a11_census(spark, sf_dir):
    d, n = _cover(spark, sf_dir), lambda c, name: F.sum(c.cast("long")).alias(name)
    counts = [n(F.col("split") == s, s) for s in ("train", "val", "test")]
    return d.groupBy("year").agg(*counts, n(~F.col("has"), "lacking"), F.when(F.every("has"), "pass").otherwise("fail").alias("verdict"))


@query("w5_first_offenders", f"with {COVER}, k as (select *, row_number() over (partition by split order by h, sid) as k from cover where not has) select split, sid, h from k where k <= 20")
def w5_first_offenders(spark, sf_dir):
    return audit.first_of_each(_cover(spark, sf_dir).where("not has"), "split", ["h", "sid"]).select("split", "sid", "h")


NAN = f"{PATCH}, pn as (select * replace (case when event_id % 9 = 4 and i = 3 and j = 3 then 'nan'::double else v end as v), {OF_EVENT} as split, (event_id % 3)::int as fold from patch)"


def _with_nan(spark, sf_dir):
    p = patches(spark, sf_dir)
    v = F.when((F.col("event_id") % 9 == 4) & (F.col("i") == 3) & (F.col("j") == 3), float("nan")).otherwise(F.col("v"))
    return p.withColumns({"v": v, "split": splits.assign(F.col("event_id")), "fold": (F.col("event_id") % 3).cast("int")})


@query("a16_train_stats", f"""with {NAN}, bad as (select distinct event_id from pn where isnan(u) or isnan(v) or u is null or v is null), good as (select * from pn where split = 'train' and event_id not in (select event_id from bad)),
  l as (select 'u' as channel, u as x from good union all select 'v', v from good) select channel, count(x) as n, round(avg(x), 9) as mean, round(sqrt(greatest(var_pop(x), 1e-12)), 9) as sd from l group by 1""")
def a16_train_stats(spark, sf_dir):
    p = _with_nan(spark, sf_dir).where("split = 'train'")
    return _r(grid.normalisation(grid.whole_events(p, ["u", "v"]), ["u", "v"]), "mean", "sd", digits=9)


@query("a16_skipped", f"with {NAN}, e as (select event_id, bool_or(u is null or v is null) as absent, bool_or(coalesce(isnan(u), false) or coalesce(isnan(v), false)) as odd from pn where split = 'train' group by 1) select case when odd then 'not_finite' when absent then 'missing' else 'used' end as outcome, count(*) as n from e group by 1")
def a16_skipped(spark, sf_dir):
    return grid.event_outcomes(_with_nan(spark, sf_dir).where("split = 'train'"), ["u", "v"])


@query("a16_by_fold", f"with {NAN}, bad as (select distinct event_id from pn where isnan(u) or isnan(v) or u is null or v is null), good as (select * from pn where event_id not in (select event_id from bad)) select k.fold, count(u) as n, round(avg(u), 9) as mean from good g join (select unnest([0, 1, 2]) as fold) k on g.fold <> k.fold group by 1")
def a16_by_fold(spark, sf_dir):
    p = grid.whole_events(_with_nan(spark, sf_dir), ["u", "v"])
    left_out = F.filter(F.array(*map(F.lit, (0, 1, 2))), lambda k: k != F.col("fold"))
    return _r(p.select(F.explode(left_out).alias("fold"), "u").groupBy("fold").agg(F.count("u").alias("n"), F.avg("u").alias("mean")), "mean", digits=9)


@query("a17_extra_stats", f"with {NAN} select count(p) as n, round(avg(p), 9) as mean, round(greatest(stddev_pop(p), 1e-6), 9) as sd from pn where split = 'train' and p is not null and not isnan(p)")
def a17_extra_stats(spark, sf_dir):
    p = _with_nan(spark, sf_dir).where("split = 'train'").select(clean.finite(F.col("p")).alias("p"))
    return _r(p.agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.greatest(F.stddev_pop("p"), F.lit(1e-6)).alias("sd")), "mean", "sd", digits=9)


@query("a20_skill", f"with {STEPS}, d as (select basin, km as a, wind_kt * 2 as b from steps) select basin, count(*) as n, count(b) as paired, round(avg(case when b is not null then a end), 6) as mean_a, round(avg(b), 6) as mean_b, round(avg(a - b), 6) as difference, round(avg((a < b)::int), 9) as closer from d group by 1")
def a20_skill(spark, sf_dir):
    d = _steps(spark, sf_dir).select("basin", F.col("km").alias("a"), (F.col("wind_kt") * 2).alias("b"))
    return _r(_r(stats.paired_skill(d, "a", "b", "basin"), "mean_a", "mean_b", "difference"), "closer", digits=9)


@query("a21_across_runs", f"with {SCORES}, r as (select event_id % 5 as run, avg(y) as rate, avg(pow(score - y, 2)) as brier from scores group by 1), l as (select 'rate' as metric, run, rate as x from r union all select 'brier', run, brier from r) select metric, round(avg(x), 9) as mean, round(stddev_pop(x), 9) as sd, round(min(x), 9) as lo, round(max(x), 9) as hi, count(*) as runs from l group by 1")
def a21_across_runs(spark, sf_dir):
    s = scores(spark, sf_dir).groupBy((F.col("event_id") % 5).alias("run")).agg(F.avg("y").alias("rate"), F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("brier"))
    return _r(stats.across_runs(s, "run", "rate", "brier").drop("values"), "mean", "sd", "lo", "hi", digits=9)


@query("a22_counts", f"with {LABELLED} select count(*) as rows, count(distinct sid) as storms, sum(label)::bigint as positives, sum((label is null)::int)::bigint as undefined, min(year(ts))::int as first_year, max(year(ts))::int as last_year, 1 as checked from labelled")
def a22_counts(spark, sf_dir):
    d = labelled(spark, sf_dir)
    plain = d.select("sid", "label").groupBy("sid").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("storms")).head()  # the same numbers another way
    return audit.counted(summary.totals(d), {"rows": plain["rows"] or 0, "storms": plain["storms"]})


@query("w4_sorted", f"with {TRACK} select sid, h, basin from track")
def w4_sorted(spark, sf_dir):
    return track(spark, sf_dir).select("sid", "h", "basin").orderBy(F.desc("h"), "basin", "sid")


@query("w8_union", f"with {TRACK} select sid, h, 'slow' as part from track where wind_kt < 50 union all select sid, h, 'fast' from track where wind_kt > 200")
def w8_union(spark, sf_dir):
    t = track(spark, sf_dir)
    return t.where("wind_kt < 50").select("sid", "h", F.lit("slow").alias("part")).unionByName(t.where("wind_kt > 200").select("sid", "h", F.lit("fast").alias("part")))


@query("f4_split_audit", f"""with {TRACK}, a as (select distinct sid, {OF_SID} as own, case when sid::bigint % 10 = 0 then 'test' end as frozen from track), d as (select sid, case when sid::bigint % 13 = 0 then 'val' else coalesce(frozen, own) end as split, own, frozen from a),
  e as (select *, coalesce(frozen, own) as want from d) select count(*) as storms, sum((sid::bigint % 17 = 0 and split <> 'train')::int)::bigint as several, sum(coalesce(case when sid::bigint % 17 = 0 and split <> 'train' then least(split, 'train') else split end <> frozen, false)::int)::bigint as frozen_moved,
  sum((case when sid::bigint % 17 = 0 then least(split, 'train') else split end <> want)::int)::bigint as misplaced, round(avg((case when sid::bigint % 17 = 0 then least(split, 'train') else split end = want)::int), 9) as agreement from e""")
def f4_split_audit(spark, sf_dir):
    s = track(spark, sf_dir).select("sid").distinct()
    frozen = s.where("cast(sid as long) % 10 = 0").select("sid", F.lit("test").alias("split"))
    made = splits.make_splits(s, "sid", frozen).withColumn("split", F.when(F.col("sid").cast("long") % 13 == 0, "val").otherwise(F.col("split")))
    made = made.unionByName(made.where("cast(sid as long) % 17 = 0").withColumn("split", F.lit("train")))
    return _r(audit.split_audit(made, frozen), "agreement", digits=9)


@query("f6_fold_plan", f"""with {LABELLED}, g as (select sid, sum(coalesce(label, 0))::bigint as positives, count(*) as size from labelled group by 1), k as (select unnest([0, 1]) as seed),
  o as (select *, row_number() over (partition by seed order by positives desc, size desc, md5(seed || ':' || sid), sid) - 1 as k from g, k), f as (select seed, (case when k // 5 % 2 = 0 then k % 5 else 4 - k % 5 end)::int as fold, sum(size) as n, sum(positives) as p from o group by 1, 2)
  select seed, fold, (sum(n) over (partition by seed) - n)::bigint as n_train, n::bigint as n_val, p::bigint as n_pos_val from f""")
def f6_fold_plan(spark, sf_dir):
    return splits.fold_plan(labelled(spark, sf_dir), "sid", "label", 5, (0, 1))


@query("f7_eligibility", f"""with {NAN}, e as (select event_id, count(distinct t_idx) as steps, max(abs(p)) as most, bool_or(coalesce(isnan(u), false) or coalesce(isnan(v), false)) as odd, bool_or(u is null or v is null) as absent from pn group by 1)
  select event_id, array_to_string(list_filter([case when odd then 'not_finite' end, case when most > 0.3 then 'out_of_range' end, case when absent then 'missing_input' end, case when steps < 2 then 'too_few_steps' end], lambda x: x is not null).list_sort(), ',') as reasons from e""")
def f7_eligibility(spark, sf_dir):
    return _eligibility(spark, sf_dir).select("event_id", F.array_join("reasons", ",").alias("reasons"))


def _eligibility(spark, sf_dir):
    return grid.eligibility(_with_nan(spark, sf_dir), ["u", "v"], {"p": 0.3}, 2)


@query("f8_manifests", f"""with {NAN}, e as (select event_id, count(distinct t_idx) as steps, max(abs(p)) as most, bool_or(coalesce(isnan(u), false) or coalesce(isnan(v), false)) as odd, bool_or(u is null or v is null) as absent from pn group by 1),
  l as (select unnest([case when odd then 'not_finite' end, case when most > 0.3 then 'out_of_range' end, case when absent then 'missing_input' end, case when steps < 2 then 'too_few_steps' end, case when not odd and most <= 0.3 and not absent and steps >= 2 then 'valid' end]) as reason from e) select reason, count(*) as n from l where reason is not null group by 1""")
def f8_manifests(spark, sf_dir):
    e = _eligibility(spark, sf_dir)
    valid, rejected = e.where(F.size("reasons") == 0), e.where(F.size("reasons") > 0)
    return audit.reason_counts(rejected).unionByName(valid.groupBy(F.lit("valid").alias("reason")).agg(F.count("*").alias("n")))


@query("f9_quality", f"with {NAN} select count(*) as cells, round(avg(coalesce(isnan(v), true)::int), 9) as v_missing, round(avg((u is null)::int), 9) as u_missing, sum(coalesce(abs(u) > 0.25, false)::int)::bigint as u_breaches from pn")
def f9_quality(spark, sf_dir):
    d = _with_nan(spark, sf_dir)
    share = lambda c: F.avg(clean.finite(F.col(c)).isNull().cast("double"))
    return _r(d.agg(F.count("*").alias("cells"), share("v").alias("v_missing"), share("u").alias("u_missing"), F.sum(F.coalesce(F.abs("u") > 0.25, F.lit(False)).cast("long")).alias("u_breaches")), "v_missing", "u_missing", digits=9)


@query("f9_steps", f"with {TRACK}, g as (select sid, h - lag(h) over (partition by sid order by h) as gap from track) select sid, count(*) as n, bool_and(coalesce(gap = 6, true)) as six_hourly from g group by 1")
def f9_steps(spark, sf_dir):
    s = track(spark, sf_dir).groupBy("sid").agg(F.array_sort(F.collect_list("h")).alias("t"))  # a storm's times in one row
    return s.select("sid", F.size("t").cast("long").alias("n"), summary.evenly_spaced("t", 6).alias("six_hourly"))


@query("f10_artifacts", f"with {TRACK} select sid, h, case when h % 18 = 0 then 'not_extracted' when wind_kt < 100 then 'invalid' else 'extracted' end as status from track where wind_kt is not null")
def f10_artifacts(spark, sf_dir):
    t = track(spark, sf_dir).where("wind_kt is not null").withColumn("event_id", F.concat_ws("_", "sid", "h"))
    found = t.where("h % 18 <> 0").select("event_id", "wind_kt")
    return audit.artifact_status(t.select("event_id", "sid", "h"), found, "event_id", F.col("wind_kt") >= 100).select("sid", "h", "status")


@query("f11_temporal", f"with {TRACK} select sid, h, h % 24 <> 0 as whole from track")
def f11_temporal(spark, sf_dir):
    t = track(spark, sf_dir)
    chosen = F.array("h", F.col("h") - 6, F.when(F.col("h") % 24 == 0, F.col("h")).otherwise(F.col("h") - 12))
    return t.select("sid", "h", summary.all_distinct(chosen, 3).alias("whole"))


@query("f12_recomputed", f"with {LABELLED} select case when h % 30 = 0 then 'not_stored' when h % 42 = 0 then 'differs' else 'equal' end as status, count(*) as n from labelled where dv24 is not null group by 1")
def f12_recomputed(spark, sf_dir):
    d = labelled(spark, sf_dir).where("dv24 is not null").select("sid", "h", "dv24")
    stored = d.where("h % 30 <> 0").withColumn("dv24", F.when(F.col("h") % 42 == 0, F.col("dv24") + 1).otherwise(F.col("dv24") + 1e-9))
    return audit.compared_values(stored, d, ["sid", "h"], "dv24", 1e-6).groupBy("status").agg(F.count("*").alias("n"))


@query("f14_features", f"""with {TRACK}, p as (select a.sid, a.h, a.wind_kt, a.basin, a.ts, round(coalesce(a.wind_kt - arg_max(b.wind_kt, b.h), 0), 6) as ps_past12, (max(b.h) is null)::int as ps_past12_missing from track a left join track b on a.sid = b.sid and b.h between a.h - 14 and a.h - 10 group by a.sid, a.h, a.wind_kt, a.basin, a.ts)
  select sid, h, wind_kt as st_wind, (basin = 'view')::int as st_basin_view, (basin = 'purchase')::int as st_basin_purchase, round(sin(2 * pi() * dayofyear(ts) / 365), 9) as st_doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365), 9) as st_doy_cos, ps_past12, ps_past12_missing from p""")
def f14_features(spark, sf_dir):
    d = labels.past_change(track(spark, sf_dir), 10, 14, "ps_past12")
    angle = 2 * F.pi() * F.dayofyear("ts") / 365
    out = d.select("sid", "h", F.col("wind_kt").alias("st_wind"), *[(F.col("basin") == b).cast("int").alias(f"st_basin_{b}") for b in ("view", "purchase")], F.round(F.sin(angle), 9).alias("st_doy_sin"), F.round(F.cos(angle), 9).alias("st_doy_cos"), "ps_past12", "ps_past12_missing")
    audit.feature_sets(out.columns, {"state": ("st_",), "persistence": ("ps_",), "both": ("st_", "ps_")})
    return _r(out, "ps_past12")


@query("m16_two_arms", f"""with {SCORES}, arms as (select event_id % 4 as fold, y, score as a, round((score * 7 + event_id % 10) / 17, 9) as b from scores), l as (select fold, 'a' as arm, a as t, y from arms union all select fold, 'b', b, y from arms),
  g as (select fold, arm, t, sum(y) as pos, sum(1 - y) as neg from l group by 1, 2, 3), c as (select *, sum(neg) over (partition by fold, arm order by t desc) as fp, sum(pos) over (partition by fold, arm) as p, sum(neg) over (partition by fold, arm) as n from g),
  r as (select fold, arm, sum(pos * (n - fp + neg / 2)) / (any_value(p) * any_value(n)) as auc from c group by 1, 2), w as (select fold, max(case when arm = 'a' then auc end) as a, max(case when arm = 'b' then auc end) as b from r group by 1)
  select count(*) as folds, sum((a > b)::int)::bigint as won, round(avg(a - b), 9) as mean, round(stddev_samp(a - b), 9) as sd from w""")
def m16_two_arms(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("fold", F.col("event_id") % 4)
    b = F.round((F.col("score") * 7 + F.col("event_id") % 10) / 17, 9)
    arms = F.explode(F.array(F.struct(F.lit("a").alias("arm"), F.col("score").alias("t")), F.struct(F.lit("b").alias("arm"), b.alias("t"))))
    return _r(metrics.arms_by_fold(s.select("fold", "y", arms.alias("x")).select("fold", "y", "x.arm", F.col("x.t").alias("score")), "a", "b"), "mean", "sd", digits=9)
