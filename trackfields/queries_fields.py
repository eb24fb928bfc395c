"""Queries on fields around events, from the given vectors as patches, cells and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import clean, fields, grid, stats
from .queries import HAVERSINE, PATCH, TRACK, _r, _read, patches, query, track

CELLS = "cells as (select vec_id, 10 + 0.25 * (vec_id % 120) as lat, (vec_id * 7 % 720) / 2 as lon, embedding[1]::double as x from embeddings where embedding[1] is not null)"
GRID = "g as (select (vec_id // 64) * 6 as time, vec_id % 64 // 8 as i, vec_id % 8 as j, embedding[1]::double as x from embeddings)"
LEVELS = "pl as (select vec_id // 5 as event_id, case vec_id % 5 when 0 then 850 when 1 then 700 when 2 then 600 when 3 then 500 else 200 end as level, embedding[1]::double as u, embedding[2]::double as v, embedding[3]::double as r from embeddings)"


def _first(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", *[F.try_element_at("embedding", F.lit(k)).cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])


def _cells(spark, sf_dir):
    return _first(spark, sf_dir).where("x is not null").select("vec_id", (10 + 0.25 * (F.col("vec_id") % 120)).alias("lat"), ((F.col("vec_id") * 7 % 720) / 2).alias("lon"), "x")


def _grid(spark, sf_dir):
    v = F.col("vec_id")
    return _first(spark, sf_dir).select((F.floor(v / 64) * 6).alias("time"), F.floor(v % 64 / 8).cast("int").alias("i"), (v % 8).cast("int").alias("j"), "x")


def _levels(spark, sf_dir):
    v = F.col("vec_id")
    level = F.when(v % 5 == 0, 850).when(v % 5 == 1, 700).when(v % 5 == 2, 600).when(v % 5 == 3, 500).otherwise(200)
    return _first(spark, sf_dir).select(F.floor(v / 5).alias("event_id"), level.alias("level"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("r"))


@query("j5_nearest_index", f"with {TRACK}, p as (select sid, h, lat * 1.01 as y, lon * 0.97 as x from track) select sid, h, (select min(k) from range(121) r(k) where abs(10 + 0.25 * k - y) = (select min(abs(10 + 0.25 * q - y)) from range(121) z(q)))::int as i, (select min(k) from range(201) r(k) where abs(-60 + 0.25 * k - x) = (select min(abs(-60 + 0.25 * q - x)) from range(201) z(q)))::int as j from p")
def j5_nearest_index(spark, sf_dir):
    t = track(spark, sf_dir)
    return t.select("sid", "h", fields.nearest_index(F.col("lat") * 1.01, 10, 0.25, 121).alias("i"), fields.nearest_index(F.col("lon") * 0.97, -60, 0.25, 201).alias("j"))


@query("j7_degree_box", f"with {TRACK}, {CELLS}, c as (select sid, h, lat as clat, lon + 60 as clon from track) select sid, h, count(*) as n, round(sum(x), 6) as total from c join cells g on abs(g.lat - clat) <= 2.5 and least(abs(g.lon - clon), 360 - abs(g.lon - clon)) <= 2.5 group by 1, 2")
def j7_degree_box(spark, sf_dir):
    c = track(spark, sf_dir).select("sid", "h", F.col("lat").alias("clat"), (F.col("lon") + 60).alias("clon"))
    return _r(fields.degree_box(c, _cells(spark, sf_dir), 2.5).groupBy("sid", "h").agg(F.count("*").alias("n"), F.sum("x").alias("total")), "total")


@query("j8_nearest_level", "select vec_id, case vec_id % 4 when 0 then 850.0 when 1 then 700.0 when 2 then null else 200.0 end::double as wanted from embeddings")
def j8_nearest_level(spark, sf_dir):
    v = F.col("vec_id")
    d = _read(spark, sf_dir, "embeddings").select("vec_id", F.when(v % 4 == 0, 850.6).when(v % 4 == 1, 699.5).when(v % 4 == 2, 601.5).otherwise(200.0).alias("level"))
    return fields.nearest_level(d, "level", (850.0, 700.0, 600.0, 500.0, 200.0)).select("vec_id", "wanted")


@query("g1_extracted", f"""with {TRACK}, {GRID}, e as (select sid || '_' || h as event_id, (h // 6 % 12) * 6 as time, (sid::bigint + h // 6) % 8 as ci, (sid::bigint * 3 + h // 6) % 8 as cj from track), o as (select unnest([0, -6, -12]) as offset_)
  select event_id, offset_ as "offset", count(*) as n, round(sum(x), 6) as total from e, o join g on g.time = e.time + offset_ and i >= ci - 2 and i < ci + 2 and j >= cj - 2 and j < cj + 2 group by 1, 2""")
def g1_extracted(spark, sf_dir):
    u, k = F.col("sid").cast("long"), F.floor(F.col("h") / 6)
    e = track(spark, sf_dir).select(F.concat_ws("_", "sid", "h").alias("event_id"), (k % 12 * 6).alias("time"), ((u + k) % 8).alias("ci"), ((u * 3 + k) % 8).alias("cj"))
    return _r(fields.extracted(e, _grid(spark, sf_dir), 4, (0, -6, -12)).groupBy("event_id", "offset").agg(F.count("*").alias("n"), F.sum("x").alias("total")), "total")


@query("g2_padded", f"with {PATCH}, m as (select k, case when k = 0 then 1 when k = 9 then 6 else k - 1 end as old from range(10) r(k)) select event_id, t_idx::int as t_idx, a.k::int as i, b.k::int as j, round(u, 6) as u from patch join m a on a.old = i join m b on b.old = j where t_idx = 0")
def g2_padded(spark, sf_dir):
    return _r(fields.padded(patches(spark, sf_dir).where("t_idx = 0").select("event_id", "t_idx", "i", "j", "u"), 8, 10), "u")


@query("g3_units", f"with {PATCH}, c as (select *, t * 10 + case when event_id % 2 = 0 then 26 else 300 end as sst, p * 10 + case when event_id % 3 = 0 then 1010 else 101000 end as msl from patch) select event_id, t_idx::int as t_idx, i::int as i, j::int as j, round(sst + case when avg(sst) over w < 150 then 273.15 else 0 end, 6) as sst, round(msl * case when avg(msl) over w < 2000 then 100 else 1 end, 4) as msl from c window w as (partition by event_id, t_idx)")
def g3_units(spark, sf_dir):
    e = F.col("event_id")
    d = patches(spark, sf_dir).withColumns({"sst": F.col("t") * 10 + F.when(e % 2 == 0, 26).otherwise(300), "msl": F.col("p") * 10 + F.when(e % 3 == 0, 1010).otherwise(101000)})
    return d.select("event_id", "t_idx", "i", "j", F.round(grid.kelvin("sst"), 6).alias("sst"), F.round(grid.pascal("msl"), 4).alias("msl"))


@query("g5_centre_inside", f"with {PATCH}, c as (select event_id, t_idx, lat, lon + 60 + 179 as lon, 10 + event_id % 5 as clat, case when event_id % 3 = 0 then -180.0 when event_id % 3 = 1 then 180.25 else 10 end as clon from patch), d as (select *, lon - clon + 180 - 360 * floor((lon - clon + 180) / 360) - 180 as east from c) select event_id, t_idx::int as t_idx, min(lat) <= any_value(clat) and max(lat) >= any_value(clat) and min(east) <= 0 and max(east) >= 0 as inside from d group by 1, 2")
def g5_centre_inside(spark, sf_dir):
    e = F.col("event_id")
    d = patches(spark, sf_dir).select("event_id", "t_idx", "lat", (F.col("lon") + 60 + 179).alias("lon"), (10 + e % 5).alias("clat"), F.when(e % 3 == 0, -180.0).when(e % 3 == 1, 180.25).otherwise(10.0).alias("clon"))
    return fields.centre_inside(d, "event_id", "t_idx")


@query("g15_diagnostics", f"with {PATCH} select event_id, t_idx::int as t_idx, i::int as i, j::int as j, round(t - avg(t) over (partition by event_id, t_idx), 6) as t_anomaly, round(sqrt(u * u + v * v), 6) as wind_speed from patch")
def g15_diagnostics(spark, sf_dir):
    return _r(grid.diagnostics(patches(spark, sf_dir), ["t_anomaly", "wind_speed"]), "t_anomaly", "wind_speed")


@query("g16_shear", f"with {LEVELS}, e as (select event_id, max(case when level = 850 then u end) - max(case when level = 200 then u end) as du, max(case when level = 850 then v end) - max(case when level = 200 then v end) as dv from pl group by 1) select event_id, round(sqrt(du * du + dv * dv), 6) as shear from e")
def g16_shear(spark, sf_dir):
    return _r(fields.shear(_levels(spark, sf_dir), "event_id"), "shear")


@query("g17_humidity", f"with {LEVELS} select event_id, case when count(r) = 3 then round(avg(r), 6) end as humidity from pl where level in (500, 600, 700) and (event_id % 4 <> 0 or level <> 600) group by 1")
def g17_humidity(spark, sf_dir):
    return _r(fields.middle_humidity(_levels(spark, sf_dir).where("event_id % 4 <> 0 or level <> 600"), "event_id"), "humidity")


@query("g18_appended", f"with {LEVELS}, n as (select event_id, count(*) as c from pl where event_id % 7 <> 0 or level <> 200 group by 1) select case when event_id % 5 = 0 then 'present' when c = 5 then 'appended' else 'incomplete' end as outcome, count(*) as events, sum(case when event_id % 5 <> 0 and c = 5 then 5 else 0 end)::bigint as rows from n group by 1")
def g18_appended(spark, sf_dir):
    pl = _levels(spark, sf_dir)
    rows, outcomes = fields.appended(pl.where("event_id % 5 = 0"), pl.where("event_id % 7 <> 0 or level <> 200"), "event_id", 5)
    added = rows.groupBy("event_id").agg(F.count("*").alias("n"))
    return outcomes.join(added, "event_id", "left").groupBy("outcome").agg(F.count("*").alias("events"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


POINTS = "pt as (select event_id, k, (event_id * 3 + k * 5) % 31 / 4.0 as y, (event_id * 7 + k * 3) % 31 / 4.0 as x from (select distinct event_id from patch) e, range(6) r(k))"


def _points(spark, sf_dir):
    e = patches(spark, sf_dir).select("event_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return e.select("event_id", "k", ((F.col("event_id") * 3 + F.col("k") * 5) % 31 / 4).alias("y"), ((F.col("event_id") * 7 + F.col("k") * 3) % 31 / 4).alias("x"))


@query("j14_resampled", f"""with {PATCH}, {POINTS}, c as (select pt.*, a, b, (case when a = 1 then y - floor(y) else 1 - y + floor(y) end) * (case when b = 1 then x - floor(x) else 1 - x + floor(x) end) as w from pt, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b)),
  d as (select c.*, p.u as u_ from c left join patch p on p.event_id = c.event_id and p.t_idx = 0 and p.i = floor(y) + a and p.j = floor(x) + b where w > 0) select event_id, k::int as k, case when count(u_) = count(*) then round(sum(u_ * w), 6) end as u from d group by event_id, k""")
def j14_resampled(spark, sf_dir):
    cells = patches(spark, sf_dir).where("t_idx = 0").select("event_id", "i", "j", "u")
    return _r(fields.bilinear(_points(spark, sf_dir), cells, ["event_id"], "u").select("event_id", "k", "u"), "u")


SIGMA = 0.5
WEIGHT = f"exp(-0.5 * pow(d / {SIGMA}, 2))"
SMOOTH = f"""{PATCH}, ph as (select event_id, t_idx, i, j, case when (event_id + i * 3 + j) % 11 = 0 then null else u end as u from patch), o as (select d, {WEIGHT} / (select sum({WEIGHT}) from range(-2, 3) r(d)) as w from range(-2, 3) r(d)),
fold as (select k, d, w, case when k + d < 0 then -1 - (k + d) when k + d > 7 then 15 - (k + d) else k + d end as s from range(8) q(k), o),
sm as (select p.event_id, p.t_idx, a.k as i, b.k as j, sum(case when u is not null then u * a.w * b.w end) / nullif(sum(case when u is not null then a.w * b.w end), 0) as x from ph p join fold a on a.s = p.i join fold b on b.s = p.j group by 1, 2, 3, 4)"""


def _holed(spark, sf_dir):
    hole = (F.col("event_id") + F.col("i") * 3 + F.col("j")) % 11 == 0
    return patches(spark, sf_dir).withColumn("u", F.when(hole, None).otherwise(F.col("u")))


@query("g22_smoothed", f"with {SMOOTH} select event_id, t_idx::int as t_idx, (i * 8 + j)::int as cell, round(x, 6) as x from sm")
def g22_smoothed(spark, sf_dir):
    m = fields.smoothed(fields.maps(_holed(spark, sf_dir), "u", 8), 8, SIGMA)
    return _r(m.select("event_id", "t_idx", F.posexplode("map").alias("cell", "x")), "x")


@query("g23_local_peaks", f"""with {SMOOTH}, st as (select * replace (round(x, 10) as x) from sm), n as (select a.*, max(b.x) as around from st a left join st b on b.event_id = a.event_id and b.t_idx = a.t_idx and abs(b.i - a.i) <= 1 and abs(b.j - a.j) <= 1 and (b.i <> a.i or b.j <> a.j) group by all),
  r as (select *, i between 1 and 6 and j between 1 and 6 and x > around as local, row_number() over (partition by event_id, t_idx order by (i between 1 and 6 and j between 1 and 6 and x > around) desc, x desc, i, j) as k from n where x is not null)
  select r.event_id, r.t_idx::int as t_idx, r.i::int as i, r.j::int as j, round(p.u, 6) as value, local from r join ph p on p.event_id = r.event_id and p.t_idx = r.t_idx and p.i = r.i and p.j = r.j where k = 1""")
def g23_local_peaks(spark, sf_dir):
    return _r(fields.peaks(fields.maps(_holed(spark, sf_dir), "u", 8), 8, SIGMA), "value").withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value")))


@query("g25_detrended_peaks")
def g25_detrended_peaks(spark, sf_dir):
    return fields.peaks(fields.maps(_holed(spark, sf_dir), "u", 8), 8, SIGMA, detrend=2.0)


@query("g26_g28_window_quality", f"""with {SMOOTH}, q as (select event_id, t_idx, count(*) as n, avg((u is null)::int) as missing, min(u) as lo, max(u) as hi, avg(u) as mean, stddev_pop(u) as sd, max(case when i = 4 and j = 4 then u end) as centre from ph group by 1, 2)
  select event_id, t_idx::int as t_idx, n, round(missing, 9) as missing, round(lo, 6) as lo, round(hi, 6) as hi, round(mean, 6) as mean, round(sd, 6) as sd, round(centre, 6) as centre,
  array_to_string(list_filter([case when hi > 0.3 then 'above_range' end, case when lo < -0.3 then 'below_range' end, case when missing > 0.1 then 'many_missing' end], lambda x: x is not null), ',') as flags,
  case when mean is null then 'invalid_all_nan' when hi > 0.3 or lo < -0.3 or missing > 0.1 then 'qc_flagged' else 'ok' end as status from q""")
def g26_g28_window_quality(spark, sf_dir):
    d = _holed(spark, sf_dir)
    s = fields.plausible(fields.window_stats(d, "u", *grid.STEP), -0.3, 0.3, 0.1)
    at = [fields.nearest_index(F.lit(11.01), 10, 0.25, 8), fields.nearest_index(F.lit(-58.99), -60, 0.25, 8)]
    centre = d.where((F.col("i") == at[0]) & (F.col("j") == at[1])).select(*grid.STEP, clean.finite(F.col("u")).alias("centre"))
    out = s.join(centre, list(grid.STEP), "left").withColumn("flags", F.array_join("flags", ","))
    return _r(_r(out, "lo", "hi", "mean", "sd", "centre"), "missing", digits=9)


@query("g29_preferred", f"with {TRACK}, s as (select distinct year(ts)::int + (sid::bigint % 5)::int as year, basin as source from track where basin in ('view', 'purchase', 'click') and not (basin = 'purchase' and sid::bigint % 5 = 1)) select year, arg_min(source, case source when 'purchase' then 1 when 'click' then 2 else 3 end) as source from s group by 1")
def g29_preferred(spark, sf_dir):
    u = F.col("sid").cast("long")
    s = track(spark, sf_dir).where(~((F.col("basin") == "purchase") & (u % 5 == 1))).select((F.year("ts") + u % 5).cast("int").alias("year"), F.col("basin").alias("source")).distinct()
    return fields.preferred(s, "year", "source", ("purchase", "click", "view"))


@query("g30_enriched", f"""with {PATCH}, k as (select *, row_number() over (partition by event_id, t_idx order by u desc, i, j) as r from patch where u is not null and event_id % 6 <> 0), b as (select event_id, t_idx, lat, lon, u, 10.875 as clat, -59.125 as clon from k where r = 1)
  select event_id, t_idx::int as t_idx, round(u, 6) as peak, round({HAVERSINE.format(a='c', b='')}, 5) as km from b""")
def g30_enriched(spark, sf_dir):
    d = patches(spark, sf_dir)
    todo = d.join(d.where("event_id % 6 = 0").select("event_id").distinct(), "event_id", "left_anti")  # what is done is left alone
    p = grid.peak(todo, "u")
    km = stats.haversine_km(F.lit(10.875), F.lit(-59.125), F.col("lat"), F.col("lon"))
    return p.select("event_id", "t_idx", F.round("peak", 6).alias("peak"), F.round(km, 5).alias("km"))


@query("g31_filled", f"with {PATCH}, h as (select event_id, t_idx, i, j, case when event_id % 3 = 0 and i < 5 then null when event_id % 3 = 1 and i < 2 then null else u end as u from patch), s as (select *, avg((u is not null)::int) over w as share, avg(u) over w as mean from h window w as (partition by event_id, t_idx)) select event_id, t_idx::int as t_idx, i::int as i, j::int as j, share >= 0.5 as kept, round(case when share >= 0.5 then coalesce(u, mean) end, 6) as u from s")
def g31_filled(spark, sf_dir):
    e, i = F.col("event_id") % 3, F.col("i")
    hole = ((e == 0) & (i < 5)) | ((e == 1) & (i < 2))
    d = patches(spark, sf_dir).withColumn("u", F.when(hole & (i == 0), float("nan")).when(hole, None).otherwise(F.col("u")))
    return _r(fields.filled(d.select("event_id", "t_idx", "i", "j", "u"), "u").select("event_id", "t_idx", "i", "j", "kept", "u"), "u")


@query("g32_soft_geo", f"with {PATCH}, w as (select *, exp((u - max(u) over (partition by event_id, t_idx)) / 0.1) as w from patch where u is not null), s as (select event_id, t_idx, sum(i * w) / sum(w) as y, sum(j * w) / sum(w) as x from w group by 1, 2) select event_id, t_idx::int as t_idx, 10 + 0.25 * ceil(round(y, 6) - 0.5) as lat, -60 + 0.25 * ceil(round(x, 6) - 0.5) as lon from s")
def g32_soft_geo(spark, sf_dir):
    d = _r(grid.soft_argmax(patches(spark, sf_dir).where("u is not null"), "u", 0.1), "i", "j")
    return d.select("event_id", "t_idx", (10 + 0.25 * fields.nearest_index(F.col("i"), 0, 1, 8)).alias("lat"), (-60 + 0.25 * fields.nearest_index(F.col("j"), 0, 1, 8)).alias("lon"))


@query("g33_geographic", f"with {PATCH}, {POINTS}, b as (select event_id, min(lat) as lat0, max(lat) as lat1, min(lon) as lon0, max(lon) as lon1 from patch group by 1) select event_id, k::int as k, round(lat0 + (lat1 - lat0) * least(y / 7, 1), 6) as lat, round(lon0 + (lon1 - lon0) * least(x / 7, 1), 6) as lon from pt join b using (event_id)")
def g33_geographic(spark, sf_dir):
    b = patches(spark, sf_dir).groupBy("event_id").agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    p = _points(spark, sf_dir).select("event_id", "k", (F.col("y") / 7).alias("ny"), (F.col("x") / 7).alias("nx")).join(b, "event_id")
    return _r(fields.geographic(p, 8).select("event_id", "k", "lat", "lon"), "lat", "lon")


RANKED = "rank() over (partition by event_id, t_idx order by {c}) + (count(*) over (partition by event_id, t_idx, {c}) - 1) / 2"


@query("g35_map_spearman", f"with {PATCH}, r as (select event_id, t_idx, {RANKED.format(c='u')} as x, {RANKED.format(c='v')} as y from patch where u is not null and v is not null) select event_id, t_idx::int as t_idx, count(*) as n, round(corr(x, y), 6) as rho from r group by 1, 2")
def g35_map_spearman(spark, sf_dir):
    return _r(stats.spearman(patches(spark, sf_dir), "u", "v", *grid.STEP).drop("p"), "rho")


@query("g37_scaled_masks", f"with {PATCH}, m as (select *, row_number() over (partition by event_id, t_idx order by t desc, i, j) <= 6 as top from patch where t is not null) select event_id, t_idx::int as t_idx, i::int as i, j::int as j, round(case when top then u * 0.75 else u end, 6) as u from m")
def g37_scaled_masks(spark, sf_dir):
    d = grid.extreme_masks(patches(spark, sf_dir).where("t is not null"), "t", 0.1)
    return _r(fields.masked(d, "top", ["u"], 0.25).select("event_id", "t_idx", "i", "j", "u"), "u")


@query("a13_flagged_stats", f"with {PATCH}, s as (select event_id, avg(u) as m, stddev_pop(u) as d, count(u) as n from patch where event_id % 4 <> 0 group by 1), e as (select distinct event_id from patch) select event_id, round(coalesce(m, 0), 6) as u_mean, round(coalesce(d, 0), 6) as u_sd, (n is null or n = 0)::int as u_missing from e left join s using (event_id)")
def a13_flagged_stats(spark, sf_dir):
    d = patches(spark, sf_dir).withColumn("u", F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("u")))
    return _r(grid.flagged_stats(d, ["u"]).select("event_id", "u_mean", "u_sd", "u_missing"), "u_mean", "u_sd")


@query("a14_t0_means", f"with {PATCH} select event_id, round_even(avg(t * 10 + 300) - 273.15, 2) as t_c from patch where t_idx = 0 group by 1")
def a14_t0_means(spark, sf_dir):
    d = patches(spark, sf_dir).withColumn("t", F.col("t") * 10 + 300).where("t_idx = 0")
    return d.groupBy("event_id").agg(F.bround(clean.finite(F.avg("t")) - 273.15, 2).alias("t_c"))


@query("a15_lag_features", f"with {PATCH}, s as (select event_id, t_idx, min(p) as lowest, avg(u) as shear, max(t) as warmest from patch group by 1, 2) select event_id, round(max(case when t_idx = 0 then lowest end), 6) as lowest_h0, round(max(case when t_idx = 1 then lowest end), 6) as lowest_h6, round(max(case when t_idx = 0 then shear end), 6) as shear_h0, round(max(case when t_idx = 1 then shear end), 6) as shear_h6, round(max(case when t_idx = 0 then warmest end), 6) as warmest_h0, round(max(case when t_idx = 1 then warmest end), 6) as warmest_h6 from s group by 1")
def a15_lag_features(spark, sf_dir):
    d = fields.lag_features(patches(spark, sf_dir), {0: "h0", 1: "h6"}, lowest=F.min("p"), shear=F.avg("u"), warmest=F.max("t"))
    return _r(d, *[c for c in d.columns if c != "event_id"])


PEAKS = f"{PATCH}, pu as (select event_id, t_idx, lat, lon from (select *, row_number() over (partition by event_id, t_idx order by u desc, i, j) as r from patch where u is not null) where r = 1), pt as (select event_id, t_idx, lat, lon from (select *, row_number() over (partition by event_id, t_idx order by t desc, i, j) as r from patch where t is not null) where r = 1)"


@query("t4_displacement", f"with {PEAKS}, d as (select event_id, t_idx, 10.875 as alat, -59.125 as alon, lat as blat, lon as blon from pu) select event_id, t_idx::int as t_idx, round({HAVERSINE.format(a='a', b='b')}, 5) as km from d")
def t4_displacement(spark, sf_dir):
    p = grid.peak(patches(spark, sf_dir), "u")
    centre = p.select(*grid.STEP, F.lit(10.875).alias("lat"), F.lit(-59.125).alias("lon"))
    return _r(fields.displacement(centre, p).select(*grid.STEP, "km"), "km", digits=5)


@query("t19_colocation", f"""with {PEAKS}, d as (select u.event_id, u.lat as alat, u.lon as alon, t.lat as blat, t.lon as blon, 10.875 as clat, -59.125 as clon from pu u join pt t using (event_id, t_idx)),
  k as (select event_id, {HAVERSINE.format(a='a', b='b')} as peaks, {HAVERSINE.format(a='c', b='b')} as centre from d) select event_id % 2 = 0 as positive, count(*) as n, round(median(peaks), 5) as peaks, round(median(centre), 5) as centre, round(avg((round(peaks, 5) < round(centre, 5))::int), 9) as closer from k group by 1""")
def t19_colocation(spark, sf_dir):
    d = patches(spark, sf_dir)
    u, t = grid.peak(d, "u"), grid.peak(d, "t")
    centre = t.select(*grid.STEP, F.lit(10.875).alias("lat"), F.lit(-59.125).alias("lon"))
    k = fields.displacement(u, t).select(*grid.STEP, F.round("km", 5).alias("peaks")).join(fields.displacement(centre, t).select(*grid.STEP, F.round("km", 5).alias("centre")), list(grid.STEP))
    out = k.groupBy((F.col("event_id") % 2 == 0).alias("positive")).agg(F.count("*").alias("n"), F.median("peaks").alias("peaks"), F.median("centre").alias("centre"), F.avg((F.col("peaks") < F.col("centre")).cast("double")).alias("closer"))
    return _r(_r(out, "peaks", "centre", digits=5), "closer", digits=9)
