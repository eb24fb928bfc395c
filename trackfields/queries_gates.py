"""Queries on recompute gates, files, stratified samples, profiles of lags and the co-location study."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import audit, fields, labels, resampling, sources, splits, stats
from .queries import LABELLED, PATCH, POSITIONAL, TRACK, _r, _read, _versions, labelled, normal_tail_sql, patches, query, student_sql, track
from .queries_stats import PAIRS, U, _pairs

# Recompute gates: tables with planted differences against what is computed anew.

CHANNELS = ("u", "v", "p", "t")
LONG = " union all ".join(f"select event_id, t_idx, i, j, '{c}' as c, {c} as x from patch" for c in CHANNELS)
GATED = 'select "column", status, count(*) as n, min(k) as first from g group by 1, 2'


@query("f12_statistics", f"""with {PATCH}, l as ({LONG}), s as (select c, name from (select distinct c from l), (select unnest(['n', 'mean', 'sd']) as name)),
  g as (select name as "column", case when c = 't' then 'not_stored' when c = 'v' and name = 'mean' then 'differs' else 'equal' end as status, c as k from s) {GATED}""")
def f12_statistics(spark, sf_dir):
    s = audit.statistics(patches(spark, sf_dir).where("event_id % 3 <> 0"), list(CHANNELS)).withColumnRenamed("column", "channel")
    stored = s.where("channel <> 't'").withColumns({"mean": F.col("mean") + F.when(F.col("channel") == "v", 1e-3).otherwise(0.0), "sd": F.col("sd") + 1e-8})
    return audit.gate(stored, s, ["channel"], ["n", "mean", "sd"], 1e-6)


@query("f12_t0_means", f"""with {PATCH}, m as (select event_id, avg(u) as u, avg(t) as t from patch where t_idx = 0 group by 1), s as (select event_id, unnest(['u', 't']) as "column", unnest([u, t]) as x from m),
  g as (select "column", case when event_id % 7 = 0 then 'not_stored' when event_id % 5 = 0 and "column" = 'u' and x is not null then 'differs' else 'equal' end as status, event_id::varchar as k from s
        union all select "column", 'not_recomputed', (event_id + 1000000)::varchar from s where event_id % 4 = 1) {GATED}""")
def f12_t0_means(spark, sf_dir):
    m = patches(spark, sf_dir).where("t_idx = 0").groupBy("event_id").agg(F.avg("u").alias("u"), F.avg("t").alias("t"))
    stored = m.where("event_id % 7 <> 0").withColumns({"u": F.col("u") + F.when(F.col("event_id") % 5 == 0, 0.05).otherwise(0.005), "t": F.col("t") - 0.005})
    extra = m.where("event_id % 4 = 1").withColumn("event_id", F.col("event_id") + 1_000_000)
    return audit.gate(stored.unionByName(extra), m, ["event_id"], ["u", "t"], 0.01)


@query("f12_patch_cells", f"""with {PATCH}, l as ({LONG}), g as (select c as "column", case when event_id % 9 = 4 and i = 0 then 'not_stored' when (i + j) % 5 = 0 and c in ('u', 'p') and x is not null then 'differs' else 'equal' end as status,
  event_id || ':' || t_idx || ':' || i || ':' || j as k from l) {GATED}""")
def f12_patch_cells(spark, sf_dir):
    d = patches(spark, sf_dir).select("event_id", "t_idx", "i", "j", *CHANNELS)
    off = F.when((F.col("i") + F.col("j")) % 5 == 0, 1e-4).otherwise(1e-6)
    stored = d.where("event_id % 9 <> 4 or i <> 0").withColumns({"u": F.col("u") + off, "p": F.col("p") - off, "v": F.col("v") + 1e-7})
    return audit.gate(stored, d, ["event_id", "t_idx", "i", "j"], list(CHANNELS), 1e-5)


# Files: pages written as text files, read back as bytes, hashed, and compared with a manifest.

PAGES = "pg as (select page_id % 64 as part, string_agg(html || chr(10), '' order by page_id) as content, count(*) as lines from pages where html is not null and not contains(html, chr(10)) and not contains(html, chr(13)) group by 1)"


def _page_files(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").where("html is not null and not contains(html, '\\n') and not contains(html, '\\r')")
    path = sources.scratch(spark, "pages")
    sources.write_texts(p.select("page_id", (F.col("page_id") % 64).alias("part"), "html"), "part", "page_id", "html", path)
    return sources.artifacts(sources.files(spark, path, "*.txt", 1))


@query("s10_file_hashes", f"with {PAGES} select 'part=' || part as folder, octet_length(encode(content))::bigint as size, sha256(content) as sha256 from pg")
def s10_file_hashes(spark, sf_dir):
    return _page_files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("folder"), "size", "sha256")


@query("s11_file_manifest", f"with {PAGES}, s as (select 'part=' || part as path, case when part % 11 = 0 then 'unlisted' when part % 5 = 0 then 'changed' else 'same' end as status from pg) select * from s union all select path || '/gone', 'missing' from s where status = 'same' and substr(path, 6)::int % 7 = 1")
def s11_file_manifest(spark, sf_dir):
    found = _page_files(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("path"), "sha256")
    part = F.substring("path", 6, 9).cast("int")
    stored = found.where(part % 11 != 0).withColumn("sha256", F.when(part % 5 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    gone = found.where((part % 11 != 0) & (part % 5 != 0) & (part % 7 == 1)).withColumn("path", F.concat("path", F.lit("/gone")))
    return sources.verified(stored.unionByName(gone), found)


# Samples, label versions.


@query("w6_topped_up", f"""with {TRACK}, r as (select sid, h, sid || '_' || h as id, year(ts) * 100 + month(ts) * 10 + sid::bigint % 3 as stratum from track), k as (select *, md5('3:' || id) as m, row_number() over (partition by stratum order by md5('3:' || id), id) as k from r),
  s as (select greatest(1, 500 // count(distinct stratum)) as share from r), o as (select * from k, s where k <= share), e as (select * from k, s where k > share order by m, id limit (select greatest(0, 500 - count(*)) from o)) select sid, h from o union all select sid, h from e""")
def w6_topped_up(spark, sf_dir):
    t = track(spark, sf_dir).withColumns({"id": F.concat_ws("_", "sid", "h"), "stratum": F.year("ts") * 100 + F.month("ts") * 10 + F.col("sid").cast("long") % 3})
    return splits.stratified_sample(t, "stratum", "id", 500, 3).select("sid", "h")


@query("l11_effects", f"""with {POSITIONAL}, e as (select basin, case when label is null then 'undefined' when label_v1 <> label then 'flip' when abs(dv24 - p24) > 1e-9 then 'drift' else 'none' end as effect, abs(dv24 - p24) as x from versions)
  select basin, effect, count(*) as n, round(min(x), 6) as lo, round(max(x), 6) as hi, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.95), 6) as p95 from e group by 1, 2""")
def l11_effects(spark, sf_dir):
    return _r(labels.change_effects(_versions(spark, sf_dir), "label_v1", "label", "p24", "dv24", "basin"), "lo", "hi", "median", "p95")


@query("l14_both_deltas", f"""with {POSITIONAL} select sid, h, case when label_v1 = 1 and label = 0 then 'flip_1_to_0' when label_v1 = 0 and label = 1 then 'flip_0_to_1' when label is null then 'null_no_partner'
  when dv24 is null or abs(p24 - dv24) > 1e-9 or dv12 is null or abs(p12 - dv12) > 1e-9 then 'dv_drift' else 'unchanged' end as reason from versions""")
def l14_both_deltas(spark, sf_dir):
    d = _versions(spark, sf_dir)
    return d.select("sid", "h", labels.reason(F.col("label_v1"), F.col("label"), (F.col("p24"), F.col("dv24")), (F.col("p12"), F.col("dv12"))).alias("reason"))


# Lags.


@query("t16_sign_flip_by_lag", f"""with {PAIRS}, p as (select * from pairs where d is not null), m as (select lag, r, avg(case when {U.format(k="r || ':' || sid")} < 0.5 then d else -d end) as m from p, range(1, 41) q(r) group by 1, 2), o as (select lag, avg(d) as observed, count(*) as n from p group by 1)
  select lag, any_value(n) as n, round(any_value(observed), 6) as observed, round((sum((abs(m) >= abs(observed) - 1e-12)::int) + 1) / 41, 9) as p from m join o using (lag) group by 1""")
def t16_sign_flip_by_lag(spark, sf_dir):
    return _r(_r(resampling.sign_flip_by(_pairs(spark, sf_dir).where("d is not null"), "d", "sid", 40, "lag"), "observed"), "p", digits=9)


@query("t16_fall_24h", f"""with {PAIRS}, q as (select sid, lag, d from pairs), fl as (select a.sid, a.lag, b.d - a.d as fall from q a join q b on a.sid = b.sid and b.lag = a.lag + 24 where a.d is not null and b.d is not null),
  g as (select count(*) as n, avg(fall) as mean, avg(fall) / (stddev_samp(fall) / sqrt(count(*))) as t, (count(*) - 1)::double as v from fl) select n, round(mean, 6) as mean, round(t, 6) as t, round({student_sql("t", "v")}, 7) as p from g""")
def t16_fall_24h(spark, sf_dir):
    return _r(_r(resampling.fall(_pairs(spark, sf_dir), "sid", "lag", "d", 24).drop("dropped"), "mean", "t"), "p", digits=7)


# Co-location.

BEARING = "degrees(atan2(sin(radians({b}lon - {a}lon)) * cos(radians({b}lat)), cos(radians({a}lat)) * sin(radians({b}lat)) - sin(radians({a}lat)) * cos(radians({b}lat)) * cos(radians({b}lon - {a}lon))))"


def _extreme(name: str, c: str, way: str) -> str:
    far = f"case when abs(lat - 10.75) >= 1e-6 or abs(lon + 59.25) >= 1e-6 then {BEARING.format(a='c', b='')} end"
    return f"{name} as (select event_id, t_idx, {far} as bg from (select *, 10.75 as clat, -59.25 as clon, row_number() over (partition by event_id, t_idx order by {c} {way}, i, j) as r from patch where {c} is not null) where r = 1)"


@query("t4_extreme_bearings", f"""with {PATCH}, {_extreme("hi", "u", "desc")}, {_extreme("lo", "p", "asc")}, k as (select distinct event_id, t_idx from patch)
  select event_id, t_idx::int as t_idx, round(hi.bg - 360 * floor(hi.bg / 360), 5) as u_max, round(lo.bg - 360 * floor(lo.bg / 360), 5) as p_min from k left join hi using (event_id, t_idx) left join lo using (event_id, t_idx)""")
def t4_extreme_bearings(spark, sf_dir):
    d = fields.extreme_bearings(patches(spark, sf_dir), 10.75, -59.25, {"u_max": ("u", False), "p_min": ("p", True)})
    return _r(d, "u_max", "p_min", digits=5)


CENTRES = f"{PATCH}, centre as (select event_id, t_idx, round(u, 2) as u, t, (event_id % 2)::int as y from patch where i = 3 and j = 3)"


def _centres(spark, sf_dir):
    d = patches(spark, sf_dir).where("i = 3 and j = 3")
    return d.select("event_id", "t_idx", F.round("u", 2).alias("u"), "t", (F.col("event_id") % 2).cast("int").alias("y"))


@query("t19_proxy", f"""with {CENTRES}, c as (select * from centre where u is not null and t is not null), r as (select t_idx, rank() over (partition by t_idx order by u) + (count(*) over (partition by t_idx, u) - 1) / 2 as x, rank() over (partition by t_idx order by t) + (count(*) over (partition by t_idx, t) - 1) / 2 as y from c),
  s as (select t_idx, count(*) as n, corr(x, y) as rho from r group by 1), t as (select *, rho * sqrt((n - 2) / (1 - rho * rho)) as t, (n - 2)::double as v from s) select t_idx::int as t_idx, n, round(rho, 6) as rho, round({student_sql("t", "v")}, 7) as p from t""")
def t19_proxy(spark, sf_dir):
    return _r(_r(stats.spearman(_centres(spark, sf_dir), "u", "t", "t_idx"), "rho"), "p", digits=7)


@query("t19_contrast", f"""with {CENTRES}, w as (select * from centre where u is not null), r as (select t_idx, y, u, rank() over (partition by t_idx order by u) + (count(*) over (partition by t_idx, u) - 1) / 2 as r from w), e as (select t_idx, sum(pow(c, 3) - c) as tied from (select t_idx, u, count(*)::double as c from w group by 1, 2) group by 1),
  g as (select t_idx, sum(case when y = 1 then r end) as r, sum(y)::bigint as m, sum(1 - y)::bigint as n, median(case when y = 1 then u end) as median_1, median(case when y = 0 then u end) as median_0 from r group by 1),
  z as (select t_idx, m, n, median_1, median_0, r - m * (m + 1) / 2 as u, (r - m * (m + 1) / 2 - m * n / 2 - 0.5) / sqrt(m * n / 12 * (m + n + 1 - tied / ((m + n)::double * (m + n - 1)))) as z from g join e using (t_idx))
  select t_idx::int as t_idx, m, n, round(u, 3) as u, round({normal_tail_sql("z")}, 7) as p_greater, round(median_1, 6) as median_1, round(median_0, 6) as median_0 from z""")
def t19_contrast(spark, sf_dir):
    c = _centres(spark, sf_dir)
    w = stats.mann_whitney(c, "u", "y", "t_idx").select("t_idx", "m", "n", "u", "p_greater")
    q = stats.quantiles(c, "u", {"median": 0.5}, "t_idx", "y")
    side = lambda y: q.where(F.col("y") == y).select("t_idx", F.col("median").alias(f"median_{y}"))
    return _r(_r(_r(w.join(side(1), "t_idx", "left").join(side(0), "t_idx", "left"), "u", digits=3), "p_greater", digits=7), "median_1", "median_0")
