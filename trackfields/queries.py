"""Queries over the driver's tables, one or more per operator family, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clean, grid, joins, labels, metrics, splits, stats, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "l4_event_list"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Adapters: the same tables in both engines.


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as irregular fixes: src_seq, sid, ts, wind_kt, basin."""
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("src_seq"), F.col("user_id").cast("string").alias("sid"), F.col("ts"), F.col("value").alias("wind_kt"), F.col("event_type").alias("basin"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` floored to six hours: sid, ts, h (hours since 1970), wind_kt, basin, lat, lon."""
    f = fixes(spark, sf_dir).withColumn("h", F.floor(clean.epoch_s(F.col("ts")) / 21600) * 6)
    t = f.groupBy("sid", "h").agg(F.max("wind_kt").alias("wind_kt"), F.min("basin").alias("basin"))
    u = F.col("sid").cast("long")
    ts = F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, cast(h as int), 0, 0)")
    return t.select("sid", ts.alias("ts"), "h", "wind_kt", "basin", (10 + u % 30 + 0.25 * (F.col("h") / 6 % 40)).alias("lat"), (-60 + 0.25 * ((u * 7 + F.col("h") / 6) % 200)).alias("lon"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels.strict_deltas(track(spark, sf_dir))
    return d.withColumn("label", labels.three_state(F.col("dv24")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("sid"), (F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("value") / 500).alias("score"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 8 x 8 patches; four vectors in a row are u, v, p, T of an event's time step."""
    v = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x")).where("x is not null")
    e = v.groupBy(F.floor(F.col("vec_id") / 8).alias("event_id"), F.floor(F.col("vec_id") / 4 % 2).cast("int").alias("t_idx"), "k").agg(
        *[F.max(F.when(F.col("vec_id") % 4 == i, F.col("x").cast("double"))).alias(c) for i, c in enumerate(("u", "v", "p", "t"))]
    )
    i, j = F.floor(F.col("k") / 8).cast("int"), (F.col("k") % 8).cast("int")
    return e.select("event_id", "t_idx", i.alias("i"), j.alias("j"), (10 + 0.25 * i).alias("lat"), (-60 + 0.25 * j).alias("lon"), "u", "v", "p", "t")


FIXES = "fixes as (select event_id as src_seq, user_id::varchar as sid, ts, floor(epoch(ts))::bigint as s, value as wind_kt, event_type as basin from events)"
TRACK = f"""{FIXES}, t0 as (select sid, (s // 21600) * 6 as h, max(wind_kt) as wind_kt, min(basin) as basin from fixes group by 1, 2),
track as (select sid, h, make_timestamp(h * 3600000000) as ts, wind_kt, basin, 10 + sid::bigint % 30 + 0.25 * (h // 6 % 40) as lat, -60 + 0.25 * ((sid::bigint * 7 + h // 6) % 200) as lon from t0)"""
LABELLED = f"""{TRACK}, labelled as (select a.*, b.wind_kt - a.wind_kt as dv12, c.wind_kt - a.wind_kt as dv24,
  case when c.wind_kt - a.wind_kt is null then null when c.wind_kt - a.wind_kt >= 30 then 1 else 0 end as label
  from track a left join track b on a.sid = b.sid and b.h = a.h + 12 left join track c on a.sid = c.sid and c.h = a.h + 24)"""
SCORES = "scores as (select event_id, user_id::varchar as sid, (event_type = 'purchase')::int as y, value / 500 as score from events)"
CURVE = f"""{SCORES}, g as (select score as t, sum(y) as pos, sum(1 - y) as neg from scores group by 1),
curve as (select *, sum(pos) over (order by t desc) as tp, sum(neg) over (order by t desc) as fp, sum(pos) over () as p, sum(neg) over () as n from g),
pts as (select t, tp / (tp + fp) as precision, tp / p as recall, fp / n as fpr, 100 * (tp + fp) / (p + n) as alerts, 2 * (tp / (tp + fp)) * (tp / p) / nullif(tp / (tp + fp) + tp / p, 0) as f1 from curve)"""
PATCH = """pv as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as k from embeddings),
patch as (select vec_id // 8 as event_id, vec_id // 4 % 2 as t_idx, k // 8 as i, k % 8 as j, 10 + 0.25 * (k // 8) as lat, -60 + 0.25 * (k % 8) as lon,
  max(case when vec_id % 4 = 0 then x::double end) as u, max(case when vec_id % 4 = 1 then x::double end) as v, max(case when vec_id % 4 = 2 then x::double end) as p, max(case when vec_id % 4 = 3 then x::double end) as t
  from pv where x is not null group by vec_id // 8, vec_id // 4 % 2, k)"""


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Cleaning and predicates.


@query("p1_p3_clean", f"""with {FIXES} select src_seq, case when basin in ('nan', 'None', '<NA>') then 'none' else coalesce(basin, 'none') end as basin,
  round((wind_kt * 3 + 180) - 360 * floor((wind_kt * 3 + 180) / 360) - 180, 6) as lon180, round(wind_kt * 3 - 360 * floor(wind_kt * 3 / 360), 6) as lon360 from fixes""")
def p1_p3_clean(spark, sf_dir):
    f = fixes(spark, sf_dir)
    return _r(f.select("src_seq", clean.clean_text(F.col("basin"), "none").alias("basin"), clean.longitude_180(F.col("wind_kt") * 3).alias("lon180"), clean.longitude_360(F.col("wind_kt") * 3).alias("lon360")), "lon180", "lon360")


@query("p2_coerce", "select event_id, try_cast(event_type as double) as number, try_cast(substr(props, 1, 1) as double) as first_char from events")
def p2_coerce(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", clean.number(F.col("event_type")).alias("number"), clean.number(F.substring("props", 1, 1)).alias("first_char"))


@query("p4_p8_filters", f"with {TRACK} select sid, h, wind_kt from track where wind_kt is not null and hour(ts) in (0, 6, 12, 18) and wind_kt >= 20 and basin like '%c%' and lat between 12 and 35 and lon between -55 and -20 and year(ts) between 2023 and 2024")
def p4_p8_filters(spark, sf_dir):
    d = clean.required(track(spark, sf_dir), "ts", "lat", "lon", "wind_kt")
    d = clean.in_years(clean.in_box(clean.at_hours(d), 35, -55, 12, -20), 2023, 2024)
    return d.where((F.col("wind_kt") >= 20) & F.col("basin").contains("c")).select("sid", "h", "wind_kt")


@query("p9_p10_event_ids", f"with {TRACK} select sid, h, 'era5_' || strftime(ts, '%Y_%m_%d_%H%M') || '_' || sid as event_id, year(ts)::int as year, strftime(ts, '%Y_%m_%d_%H%M') as stamp, sid as parsed_sid from track")
def p9_p10_event_ids(spark, sf_dir):
    d = track(spark, sf_dir).withColumn("event_id", clean.event_id(F.col("ts"), F.col("sid"))).withColumn("x", clean.parse_event_id(F.col("event_id")))
    return d.select("sid", "h", "event_id", "x.year", "x.stamp", F.col("x.sid").alias("parsed_sid"))


@query("p13_p14_output", f"""with {TRACK}, d as (select *, lead(wind_kt) over (partition by sid order by h) - wind_kt as dv6 from track)
  select sid, h, round(dv6, 3) as dv6, case when dv6 > 0 then 'strengthening' when dv6 < 0 then 'weakening' else 'steady' end as trend from d""")
def p13_p14_output(spark, sf_dir):
    d = labels.positional_deltas(track(spark, sf_dir), {"dv6": 1}, ["h"])
    return d.select("sid", "h", F.round("dv6", 3).alias("dv6"), clean.trend(F.col("dv6")).alias("trend"))


# Labels.


@query("l4_event_list", f"with {LABELLED} select sid, h, wind_kt, round(dv12, 6) as dv12, round(dv24, 6) as dv24, label from labelled where lat between 10 and 45")
def l4_event_list(spark, sf_dir):
    d = clean.at_hours(clean.required(track(spark, sf_dir), "ts", "wind_kt"))
    d = labels.strict_deltas(d).withColumn("label", labels.three_state(F.col("dv24")))
    return _r(d.where(F.col("lat").between(10, 45)).select("sid", "h", "wind_kt", "dv12", "dv24", "label"), "dv12", "dv24")


@query("l3_defined_only", f"with {LABELLED} select sid, h, label from labelled where dv12 is not null and dv24 is not null")
def l3_defined_only(spark, sf_dir):
    return labelled(spark, sf_dir).dropna(subset=["dv12", "dv24"]).select("sid", "h", "label")


POSITIONAL = f"{LABELLED}, both_ as (select *, lead(wind_kt, 2) over w - wind_kt as p12, lead(wind_kt, 4) over w - wind_kt as p24, coalesce(lead(h, 4) over w - h <> 24, false) as off from labelled window w as (partition by sid order by h)), versions as (select *, case when p24 >= 30 then 1 else 0 end as label_v1 from both_ where p12 is not null and p24 is not null)"


def _versions(spark, sf_dir):
    d = labels.positional_deltas(labelled(spark, sf_dir), {"p12": 2, "p24": 4}, ["h"])
    return d.dropna(subset=["p12", "p24"]).withColumn("label_v1", (F.col("p24") >= 30).cast("int"))


@query("l5_positional", f"with {POSITIONAL} select sid, h, round(p12, 6) as p12, round(p24, 6) as p24, label_v1 from versions")
def l5_positional(spark, sf_dir):
    return _r(_versions(spark, sf_dir).select("sid", "h", "p12", "p24", "label_v1"), "p12", "p24")


@query("l7_persistence", f"""with {TRACK} select a.sid, a.h, round(coalesce(a.wind_kt - arg_max(b.wind_kt, b.h), 0), 6) as past12, (max(b.h) is null)::int as past12_missing
  from track a left join track b on a.sid = b.sid and b.h between a.h - 14 and a.h - 10 group by a.sid, a.h, a.wind_kt""")
def l7_persistence(spark, sf_dir):
    return _r(labels.past_change(track(spark, sf_dir), 10, 14, "past12").select("sid", "h", "past12", "past12_missing"), "past12")


@query("l8_lagged", f"with {TRACK}, l as (select unnest([-12, 6, 24]) as lag_h) select a.sid, a.h, l.lag_h, b.wind_kt as then from track a cross join l left join track b on a.sid = b.sid and b.h = a.h + l.lag_h")
def l8_lagged(spark, sf_dir):
    return labels.lagged(track(spark, sf_dir), (-12, 6, 24)).select("sid", "h", "lag_h", "then")


IRREGULAR = f"""{FIXES}, irregular as (select src_seq, sid, s // 21600 * 6 as h, case when src_seq % 7 > 0 then wind_kt end as wind_kt from fixes),
firsts as (select * from irregular qualify row_number() over (partition by sid, h order by src_seq) = 1)"""


def irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with several at one instant, some without a value, in the order of src_seq."""
    h = F.floor(clean.epoch_s(F.col("ts")) / 21600) * 6
    ts = F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, cast(h as int), 0, 0)")
    return fixes(spark, sf_dir).withColumn("h", h).select("src_seq", "sid", "h", ts.alias("ts"), F.when(F.col("src_seq") % 7 > 0, F.col("wind_kt")).alias("wind_kt"))


@query("l1_first_in_order", f"""with {IRREGULAR} select a.src_seq, b.wind_kt - a.wind_kt as dv12, c.wind_kt - a.wind_kt as dv24, case when c.wind_kt - a.wind_kt >= 30 then 1 when c.wind_kt - a.wind_kt < 30 then 0 end as label
  from irregular a left join firsts b on b.sid = a.sid and b.h = a.h + 12 left join firsts c on c.sid = a.sid and c.h = a.h + 24""")
def l1_first_in_order(spark, sf_dir):
    d = labels.strict_deltas(irregular(spark, sf_dir), order="src_seq")
    return d.select("src_seq", "dv12", "dv24", labels.three_state(F.col("dv24")).alias("label"))


@query("l8_first_in_order", f"with {IRREGULAR}, l as (select unnest([-12, 6, 24]) as lag_h) select a.src_seq, l.lag_h, b.wind_kt as then from irregular a cross join l left join firsts b on a.sid = b.sid and b.h = a.h + l.lag_h")
def l8_first_in_order(spark, sf_dir):
    return labels.lagged(irregular(spark, sf_dir), (-12, 6, 24), order="src_seq").select("src_seq", "lag_h", "then")


ONSETS = f"{LABELLED}, onsets as (select *, coalesce(label = 1 and coalesce(lag(label) over (partition by sid order by h), 0) = 0, false) as onset from labelled)"


def _onsets(spark, sf_dir):
    return labelled(spark, sf_dir).withColumn("onset", F.coalesce(labels.onset("label", "h"), F.lit(False)))


@query("l9_onsets", f"with {ONSETS} select sid, h, dv24 is not null as defined from onsets where onset")
def l9_onsets(spark, sf_dir):
    return _onsets(spark, sf_dir).where("onset").select("sid", "h", F.col("dv24").isNotNull().alias("defined"))


@query("l10_misaligned", f"with {TRACK}, m as (select *, coalesce(lead(h, 4) over (partition by sid order by h) - h <> 24, false) as off from track) select basin, count(*) as n, sum(off::int)::bigint as off from m group by 1")
def l10_misaligned(spark, sf_dir):
    t = track(spark, sf_dir)
    return t.withColumn("off", labels.misaligned(4, 24, ["h"])).groupBy("basin").agg(F.count("*").alias("n"), F.sum(F.col("off").cast("int")).alias("off"))


@query("l11_transitions", f"with {POSITIONAL} select coalesce(label_v1::varchar, 'undefined') as label_v1, coalesce(label::varchar, 'undefined') as label, count(*) as count from versions group by 1, 2")
def l11_transitions(spark, sf_dir):
    return labels.transitions(_versions(spark, sf_dir), "label_v1", "label")


@query("l12_concentration", f"with {POSITIONAL} select basin, year(ts)::int // 10 * 10 as decade, count(*) as n, sum((label is distinct from label_v1)::int)::bigint as changed from versions group by 1, 2")
def l12_concentration(spark, sf_dir):
    d = _versions(spark, sf_dir)
    return d.groupBy("basin", (F.floor(F.year("ts") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"), F.sum((~F.col("label").eqNullSafe(F.col("label_v1"))).cast("int")).alias("changed"))


@query("l13_lost_positives", f"with {POSITIONAL} select sid, sum(label_v1)::bigint as before, sum(coalesce(label, 0))::bigint as after from versions group by 1 having sum(label_v1) > 0 and sum(coalesce(label, 0)) = 0")
def l13_lost_positives(spark, sf_dir):
    return labels.lost_positives(_versions(spark, sf_dir), "label_v1", "label")


@query("l14_diff_manifest", f"""with {POSITIONAL} select sid, h, case when label_v1 = 1 and label = 0 then 'flip_1_to_0' when label_v1 = 0 and label = 1 then 'flip_0_to_1' when label is null then 'null_no_partner'
  when dv24 is null or abs(p24 - dv24) > 1e-9 then 'dv_drift' else 'unchanged' end as reason from versions""")
def l14_diff_manifest(spark, sf_dir):
    return _versions(spark, sf_dir).select("sid", "h", labels.reason(F.col("label_v1"), F.col("label"), (F.col("p24"), F.col("dv24"))).alias("reason"))


@query("l16_version_counts", f"""with {POSITIONAL} select basin, sum((label_v1 = 1 and label = 0)::int)::bigint as flip_1_to_0, sum((label_v1 = 0 and label = 1)::int)::bigint as flip_0_to_1, sum((label is null)::int)::bigint as to_null,
  sum((label_v1 = 1 and label is null)::int)::bigint as positive_to_null, sum(label_v1)::bigint as positive_before, sum(coalesce(label, 0))::bigint as positive_after from versions group by 1""")
def l16_version_counts(spark, sf_dir):
    return labels.version_counts(_versions(spark, sf_dir), "label_v1", "label", "basin")


# Joins.


@query("j2_compared", f"with {TRACK}, a as (select distinct sid, h from track where wind_kt < 300), b as (select distinct sid, h from track where wind_kt > 100) select sid, h, case when a.h is null then 'right_only' when b.h is null then 'left_only' else 'both' end as found from a full join b using (sid, h)")
def j2_compared(spark, sf_dir):
    t = track(spark, sf_dir)
    return joins.compared(t.where("wind_kt < 300"), t.where("wind_kt > 100"), ["sid", "h"])


@query("j3_basin_fill", f"with {TRACK}, f as (select sid, arg_min(basin, h) as b from track group by 1) select sid, h, case when h % 12 = 0 then coalesce(f.b, '') else basin end as basin from track left join f using (sid)")
def j3_basin_fill(spark, sf_dir):
    t = track(spark, sf_dir)
    blank = t.withColumn("basin", F.when(F.col("h") % 12 == 0, F.lit(" ")).otherwise(F.col("basin")))
    return joins.filled_basin(blank, t, "h").select("sid", "h", "basin")


@query("j4_nearest_time", f"""with {FIXES}, n as (select a.src_seq, b.s as found_s, b.wind_kt as found, row_number() over (partition by a.src_seq order by abs(a.s - b.s), b.s, b.wind_kt) as k
  from fixes a join (select sid, s, max(wind_kt) as wind_kt from fixes where basin = 'view' group by 1, 2) b using (sid)) select src_seq, found_s, found from n where k = 1""")
def j4_nearest_time(spark, sf_dir):
    f = fixes(spark, sf_dir)
    right = f.where("basin = 'view'").groupBy("sid", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("wind_kt").alias("wind_kt"))
    return joins.nearest_time(f, right, ["sid"], "ts", "wind_kt", 5 * 86_400).where("found_s is not null").select("src_seq", "found_s", "found")


@query("j6_window_join", f"""with {TRACK}, e as (select sid || '_' || h as event_id, h % 24 as time, (sid::bigint * 7 + h) % 60 as ci, (sid::bigint * 13 + h) % 80 as cj from track),
  g as (select t.time, i, j, (7 * i + 13 * j + 3 * t.time) % 101 as x from (select unnest([0, 6, 12, 18]) as time) t, range(60) r(i), range(80) q(j))
  select event_id, count(*) as n, sum(x)::bigint as total from e join g on e.time = g.time and i >= ci - 4 and i < ci + 4 and j >= cj - 4 and j < cj + 4 group by 1""")
def j6_window_join(spark, sf_dir):
    t = track(spark, sf_dir)
    u = F.col("sid").cast("long")
    e = t.select(F.concat_ws("_", "sid", "h").alias("event_id"), (F.col("h") % 24).alias("time"), ((u * 7 + F.col("h")) % 60).alias("ci"), ((u * 13 + F.col("h")) % 80).alias("cj"))
    times = t.select((F.col("h") % 24).alias("time")).distinct()
    g = times.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(79)))).withColumn("x", (7 * F.col("i") + 13 * F.col("j") + 3 * F.col("time")) % 101)
    return joins.windows(e, g, 8).groupBy("event_id").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query("j9_outside_run_up", f"with {ONSETS} select a.sid, a.h from onsets a where not onset and not exists (select 1 from onsets b where b.sid = a.sid and b.onset and b.h > a.h and b.h <= a.h + 24)")
def j9_outside_run_up(spark, sf_dir):
    return joins.outside_run_up(_onsets(spark, sf_dir), "onset").select("sid", "h")


# Splits and samples.

FRACTION = "(('0x' || substr(sha256({k}), 1, 16))::ubigint % 100000000) / 1e8"


@query("f1_f3_splits", f"""with {TRACK}, k as (select sid, {FRACTION.format(k='sid')} as f, count(*) as n from track group by sid)
  select sid, n, round(f, 8) as fraction, case when sid::bigint % 10 = 0 then 'test' when f < 0.7 then 'train' when f < 0.7 + 0.15 then 'val' else 'test' end as split from k""")
def f1_f3_splits(spark, sf_dir):
    s = track(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("n"))
    frozen = s.where(F.col("sid").cast("long") % 10 == 0).select("sid", F.lit("test").alias("split"))
    return splits.make_splits(s, "sid", frozen).select("sid", "n", F.round(splits.hash_fraction(F.col("sid")), 8).alias("fraction"), "split")


@query("f5_f6_folds", f"""with {LABELLED}, g as (select sid, sum(coalesce(label, 0))::bigint as positives, count(*) as size from labelled group by 1),
  o as (select *, row_number() over (order by positives desc, size desc, md5('0:' || sid), sid) - 1 as k from g)
  select (case when k // 5 % 2 = 0 then k % 5 else 4 - k % 5 end)::int as fold, count(*) as storms, sum(positives)::bigint as positives, sum(size)::bigint as events from o group by 1""")
def f5_f6_folds(spark, sf_dir):
    return splits.folds(labelled(spark, sf_dir), "sid", "label").groupBy("fold").agg(F.count("*").alias("storms"), F.sum("positives").alias("positives"), F.sum("size").alias("events"))


@query("w6_sample", f"with {TRACK}, r as (select sid, h, basin, row_number() over (partition by basin order by md5('7:' || sid || '_' || h), sid || '_' || h) as k from track) select sid, h, basin from r where k <= 5")
def w6_sample(spark, sf_dir):
    t = track(spark, sf_dir).withColumn("id", F.concat_ws("_", "sid", "h"))
    return splits.sample(t, "basin", "id", 5, 7).select("sid", "h", "basin")


@query("w3_first_of", f"with {FIXES}, r as (select sid, basin, src_seq, row_number() over (partition by sid, basin order by ts, src_seq) as k from fixes) select sid, basin, src_seq from r where k = 1")
def w3_first_of(spark, sf_dir):
    return clean.first_of(fixes(spark, sf_dir), ["sid", "basin"], ["ts", "src_seq"]).select("sid", "basin", "src_seq")


@query("w7_difference", f"with {TRACK} (select sid, h from track where wind_kt > 50) except all (select sid, h from track where basin = 'view')")
def w7_difference(spark, sf_dir):
    t = track(spark, sf_dir)
    return t.where("wind_kt > 50").select("sid", "h").exceptAll(t.where("basin = 'view'").select("sid", "h"))


# Summaries.


@query("a1_storms", f"with {LABELLED} select sid, min(h) as first_h, max(h) as last_h, max(wind_kt) as max_wind, max((coalesce(label, 0) = 1)::int) as any_positive, count(*) as n, arg_min(basin, h) as basin, (max(h) - min(h)) // 24 || 'd ' || (max(h) - min(h)) % 24 || 'h' as lasted from labelled group by 1")
def a1_storms(spark, sf_dir):
    s = summary.storms(labelled(spark, sf_dir))
    h = lambda c: (clean.epoch_s(F.col(c)) / 3600).cast("long")
    return s.select("sid", h("start").alias("first_h"), h("end").alias("last_h"), "max_wind", "any_positive", "n", "basin", summary.duration_text(h("end") - h("start")).alias("lasted"))


@query("a2_totals", f"with {LABELLED} select count(*) as rows, count(distinct sid) as storms, sum(label)::bigint as positives, sum((label is null)::int)::bigint as undefined, min(year(ts))::int as first_year, max(year(ts))::int as last_year from labelled")
def a2_totals(spark, sf_dir):
    return summary.totals(labelled(spark, sf_dir))


@query("a3_required_times", f"with {TRACK} select distinct year(ts)::int as year, month(ts)::int as month, day(ts)::int as day, hour(ts)::int as hour from track")
def a3_required_times(spark, sf_dir):
    return track(spark, sf_dir).select(F.year("ts").alias("year"), F.month("ts").alias("month"), F.day("ts").alias("day"), F.hour("ts").alias("hour")).distinct()


@query("a6_several_basins", f"with {TRACK} select sid, string_agg(distinct basin, ',' order by basin) as basins from track group by 1 having count(distinct basin) > 1")
def a6_several_basins(spark, sf_dir):
    return summary.several_basins(track(spark, sf_dir))


@query("a8_gap_census", f"with {TRACK}, g as (select h - lag(h) over (partition by sid order by h) as gap_h from track) select gap_h::double as gap_h, count(*) as n from g where gap_h is not null group by 1")
def a8_gap_census(spark, sf_dir):
    return summary.gaps(track(spark, sf_dir), ["h"]).where("gap_h is not null").groupBy("gap_h").agg(F.count("*").alias("n"))


@query("a10_duplicates", f"with {FIXES} select sid, s // 3600 as hour, count(*) as count from fixes group by 1, 2 having count(*) > 1")
def a10_duplicates(spark, sf_dir):
    return summary.duplicates(fixes(spark, sf_dir).withColumn("hour", F.floor(clean.epoch_s(F.col("ts")) / 3600)), "sid", "hour")


@query("a11_coverage", f"with {LABELLED} select basin, month(ts)::int as month, count(*) as n, sum((dv24 is not null)::int)::bigint as having_, round(avg((dv24 is not null)::int), 6) as share, (min((dv24 is not null)::int) = 1)::int as passed from labelled group by 1, 2")
def a11_coverage(spark, sf_dir):
    d = summary.coverage(labelled(spark, sf_dir), F.col("dv24").isNotNull(), "basin", F.month("ts").alias("month"))
    return _r(d, "share").withColumnRenamed("having", "having_")


@query("n1_geojson")
def n1_geojson(spark, sf_dir):
    return summary.geojson(labelled(spark, sf_dir), ["wind_kt", "dv12", "dv24", "label"])


# Scores.


@query("m1_m2_areas", f"with {CURVE} select round(sum(pos * ((n - fp) + neg / 2)) / (max(p) * max(n)), 9) as roc_auc, round(sum(pos / p * tp / (tp + fp)), 9) as pr_auc from curve")
def m1_m2_areas(spark, sf_dir):
    c = metrics.curve(scores(spark, sf_dir))
    return _r(metrics.roc_auc(c).crossJoin(metrics.average_precision(c)), "roc_auc", "pr_auc", digits=9)


@query("m3_brier", f"with {SCORES} select round(avg((score - y) * (score - y)), 9) as brier from scores")
def m3_brier(spark, sf_dir):
    return _r(metrics.brier(scores(spark, sf_dir)), "brier", digits=9)


@query("m4_at_threshold", f"""with {SCORES}, c as (select sum((score >= 0.1 and y = 1)::int)::bigint as tp, sum((score >= 0.1 and y = 0)::int)::bigint as fp, sum((score < 0.1 and y = 1)::int)::bigint as fn, sum((score < 0.1 and y = 0)::int)::bigint as tn from scores)
  select *, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall, round(2 * tp / (2 * tp + fp + fn), 9) as f1 from c""")
def m4_at_threshold(spark, sf_dir):
    return _r(metrics.at_threshold(scores(spark, sf_dir), 0.1), "precision", "recall", "f1", digits=9)


@query("m5_thresholds", f"""with {CURVE}, a as (select t, precision, recall from pts where recall >= 0.8 order by precision desc, t limit 1), b as (select t, f1 from pts order by f1 desc nulls last, t limit 1)
  select round(a.t, 9) as threshold, round(a.precision, 9) as precision, round(a.recall, 9) as recall, round(b.t, 9) as f1_threshold, round(b.f1, 9) as f1 from a, b""")
def m5_thresholds(spark, sf_dir):
    c = metrics.curve(scores(spark, sf_dir))
    d = metrics.threshold_for_recall(c, 0.8).crossJoin(metrics.threshold_for_f1(c).withColumnRenamed("threshold", "f1_threshold"))
    return _r(d, "threshold", "precision", "recall", "f1_threshold", "f1", digits=9)


@query("m6_curve_points", f"with {CURVE} select round(t, 9) as t, round(precision, 9) as precision, round(recall, 9) as recall, round(fpr, 9) as fpr from pts")
def m6_curve_points(spark, sf_dir):
    return _r(metrics.points(metrics.curve(scores(spark, sf_dir))).select("t", "precision", "recall", "fpr"), "t", "precision", "recall", "fpr", digits=9)


BIN = "len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[], lambda e: score >= e))"


@query("m7_m9_reliability", f"""with {SCORES}, r as (select {BIN}::int as bin, count(*) as n, avg(score) as ms, avg(y) as rate from scores group by 1)
  select bin, n, round(ms, 9) as mean_score, round(rate, 9) as rate, round(sum(n * abs(ms - rate)) over () / sum(n) over (), 9) as ece, round(max(abs(ms - rate)) over (), 9) as mce from r""")
def m7_m9_reliability(spark, sf_dir):
    r = metrics.reliability(scores(spark, sf_dir))
    return _r(r.crossJoin(F.broadcast(metrics.calibration_errors(r))), "mean_score", "rate", "ece", "mce", digits=9)


@query("m8_quantile_bins", f"""with {SCORES}, e as (select quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from scores)
  select greatest(len(list_filter(q, lambda x: score >= x)) - 1, 0)::int as bin, count(*) as n, round(avg(score), 9) as mean_score, round(avg(y), 9) as rate from scores, e group by 1""")
def m8_quantile_bins(spark, sf_dir):
    return _r(metrics.quantile_reliability(scores(spark, sf_dir)), "mean_score", "rate", digits=9)


@query("m10_brier_parts", f"""with {SCORES}, b as (select {BIN} as bin, count(*) as n, avg(score) as f, avg(y) as o, var_pop(score) as v, covar_pop(score, y) as c from scores group by 1), m as (select sum(n) as n_all, sum(n * o) / sum(n) as m from b)
  select round(sum(n / n_all * (f - o) * (f - o)), 9) as rel, round(sum(n / n_all * (o - m) * (o - m)), 9) as res, round(max(m * (1 - m)), 9) as unc, round(sum(n / n_all * v), 9) as wbv, round(sum(n / n_all * 2 * c), 9) as wbc from b, m""")
def m10_brier_parts(spark, sf_dir):
    return _r(metrics.brier_parts(scores(spark, sf_dir)), "rel", "res", "unc", "wbv", "wbc", digits=9)


@query("m11_score_summary", f"with {SCORES} select y, count(*) as n, round(min(score), 9) as lo, round(max(score), 9) as hi, " + ", ".join(f"round(quantile_cont(score, {q}), 9) as q{int(q * 100)}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " from scores group by 1")
def m11_score_summary(spark, sf_dir):
    d = metrics.score_summary(scores(spark, sf_dir))
    return _r(d, *[c for c in d.columns if c not in ("y", "n")], digits=9)


@query("m12_operating_points", f"""with {CURVE}, w as (select unnest([0.9, 0.8, 0.5]::double[]) as target), r as (select target, pts.*, row_number() over (partition by target order by abs(recall - target), t) as k from w, pts)
  select target, round(t, 9) as t, round(precision, 9) as precision, round(recall, 9) as recall, round(fpr, 9) as fpr, round(alerts, 9) as alerts from r where k = 1""")
def m12_operating_points(spark, sf_dir):
    return _r(metrics.operating_points(metrics.curve(scores(spark, sf_dir)), (0.9, 0.8, 0.5)), "t", "precision", "recall", "fpr", "alerts", digits=9)


@query("m16_auc_by_fold", f"""with {SCORES}, f as (select *, sid::bigint % 4 as fold from scores), g as (select fold, score as t, sum(y) as pos, sum(1 - y) as neg from f group by 1, 2),
  c as (select *, sum(pos) over (partition by fold order by t desc) as tp, sum(neg) over (partition by fold order by t desc) as fp, sum(pos) over (partition by fold) as p, sum(neg) over (partition by fold) as n from g)
  select fold, round(sum(pos * ((n - fp) + neg / 2)) / (max(p) * max(n)), 9) as roc_auc, round(sum(pos / p * tp / (tp + fp)), 9) as pr_auc from c group by 1""")
def m16_auc_by_fold(spark, sf_dir):
    d = scores(spark, sf_dir).withColumn("fold", F.col("sid").cast("long") % 4)
    return _r(metrics.auc_by(d, "fold"), "roc_auc", "pr_auc", digits=9)


# Statistics.

HAVERSINE = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2), 1.0)))"
STEPS = f"{TRACK}, nx as (select *, lead(lat) over w as blat, lead(lon) over w as blon from track window w as (partition by sid order by h)), steps as (select sid, h, basin, wind_kt, {HAVERSINE.format(a='', b='b')} as km, degrees(atan2(sin(radians(blon - lon)) * cos(radians(blat)), cos(radians(lat)) * sin(radians(blat)) - sin(radians(lat)) * cos(radians(blat)) * cos(radians(blon - lon)))) as bg from nx where blat is not null)"


def _steps(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("sid").orderBy("h")
    d = track(spark, sf_dir).withColumns({"blat": F.lead("lat").over(w), "blon": F.lead("lon").over(w)}).where("blat is not null")
    at = [F.col(c) for c in ("lat", "lon", "blat", "blon")]
    return d.select("sid", "h", "basin", "wind_kt", stats.haversine_km(*at).alias("km"), stats.bearing_deg(*at).alias("bearing"))


@query("t1_t2_steps", f"with {STEPS} select sid, h, round(km, 5) as km, round(bg - 360 * floor(bg / 360), 5) as bearing from steps")
def t1_t2_steps(spark, sf_dir):
    return _r(_steps(spark, sf_dir).select("sid", "h", "km", "bearing"), "km", "bearing", digits=5)


@query("t3_circular", f"with {STEPS} select basin, count(*) as n, round(sqrt(pow(avg(cos(radians(bg))), 2) + pow(avg(sin(radians(bg))), 2)), 6) as length from steps group by 1")
def t3_circular(spark, sf_dir):
    return _r(stats.circular(_steps(spark, sf_dir), "bearing", "basin").drop("mean_deg"), "length")


@query("t5_a19_summary", f"with {STEPS} select basin, count(*) as n, round(avg(km), 6) as mean, round(median(km), 6) as median, round(stddev_pop(km), 6) as sd, round(min(km), 6) as lo, round(max(km), 6) as hi, round(quantile_cont(km, 0.1), 6) as p10, round(quantile_cont(km, 0.9), 6) as p90 from steps group by 1")
def t5_a19_summary(spark, sf_dir):
    return _r(stats.summary(_steps(spark, sf_dir), "km", "basin"), "mean", "median", "sd", "lo", "hi", "p10", "p90")


def normal_tail_sql(z: str) -> str:
    """P(Z > z) by Simpson's rule."""
    return f"(0.5 - sign({z}) * least(abs({z}), 12) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow(least(abs({z}), 12) * i / 2000, 2) / 2))) / sqrt(2 * pi()))"


def student_sql(t: str, v: str) -> str:
    """P(|T| > |t|) by Simpson's rule."""
    return f"(1 - 2 * least(abs({t}), 60) / 24000 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * list_sum(list_transform(range(0, 8001), lambda i: (case when i in (0, 8000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(1 + pow(least(abs({t}), 60) * i / 8000, 2) / {v}, -({v} + 1) / 2))))"


@query("t6_spearman", f"""with {STEPS}, r as (select basin, rank() over (partition by basin order by km) + (count(*) over (partition by basin, km) - 1) / 2 as x, rank() over (partition by basin order by wind_kt) + (count(*) over (partition by basin, wind_kt) - 1) / 2 as y from (select basin, wind_kt, round(km, 5) as km from steps where wind_kt is not null)),
  s as (select basin, count(*) as n, corr(x, y) as rho from r group by 1), t as (select *, rho * sqrt((n - 2) / (1 - rho * rho)) as t, (n - 2)::double as v from s) select basin, n, round(rho, 6) as rho, round({student_sql("t", "v")}, 7) as p from t""")
def t6_spearman(spark, sf_dir):
    d = stats.spearman(_r(_steps(spark, sf_dir), "km", digits=5), "km", "wind_kt", "basin")
    return _r(_r(d, "rho"), "p", digits=7)


@query("t7_t8_mann_whitney", f"""with {LABELLED}, w as (select basin, label, wind_kt from labelled where label is not null), r as (select basin, label, rank() over (partition by basin order by wind_kt) + (count(*) over (partition by basin, wind_kt) - 1) / 2 as r from w),
  e as (select basin, sum(pow(c, 3) - c) as tied from (select basin, wind_kt, count(*)::double as c from w group by 1, 2) group by 1),
  g as (select basin, sum(case when label = 1 then r end) as r, sum(label)::bigint as m, sum(1 - label)::bigint as n from r group by 1),
  z as (select basin, m, n, r - m * (m + 1) / 2 as u, (r - m * (m + 1) / 2 - m * n / 2 - 0.5) / sqrt(m * n / 12 * (m + n + 1 - tied / ((m + n)::double * (m + n - 1)))) as z from g join e using (basin))
  select basin, m, n, round(u, 3) as u, round(2 * u / (m * n) - 1, 9) as delta, round(z, 7) as z, round({normal_tail_sql("z")}, 9) as p_greater from z""")
def t7_t8_mann_whitney(spark, sf_dir):
    d = stats.mann_whitney(labelled(spark, sf_dir), "wind_kt", "label", "basin")
    return _r(_r(_r(d, "u", digits=3), "delta", "p_greater", digits=9), "z", digits=7)


@query("t9_paired_t", f"""with {LABELLED}, g as (select basin, count(dv24) as n, count(*) - count(dv24) as dropped, avg(dv24) as mean, avg(dv24) / (stddev_samp(dv24) / sqrt(count(dv24))) as t, (count(dv24) - 1)::double as v from labelled group by 1)
  select basin, n, dropped, round(mean, 6) as mean, round(t, 6) as t, round({student_sql("t", "v")}, 7) as p from g""")
def t9_paired_t(spark, sf_dir):
    return _r(_r(stats.paired_t(labelled(spark, sf_dir), "dv24", "basin"), "mean", "t"), "p", digits=7)


@query("t9_drop_report", f"""with {LABELLED}, d as (select basin, dv24, dv12, dv24 - dv12 as d from labelled), b as (select * from d where d is not null),
  g as (select basin, count(*) as n, avg(d) as difference, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t, (count(*) - 1)::double as v, avg(dv24) as mean_dv24, avg(dv12) as mean_dv12, avg((dv24 > dv12)::int) as stronger from b group by 1),
  p as (select *, {student_sql("t", "v")} as p from g) select basin, n, (select count(*) from d x where x.basin = p.basin) - n as dropped, round(difference, 6) as difference, round(t, 6) as t, round(p, 7) as p, round(mean_dv24, 6) as mean_dv24, round(mean_dv12, 6) as mean_dv12, round(stronger, 9) as stronger, p < 0.05 and difference > 0 as significant from p""")
def t9_drop_report(spark, sf_dir):
    d = stats.drop_report(labelled(spark, sf_dir), "dv24", "dv12", "basin")
    return _r(_r(_r(d, "difference", "t", "mean_dv24", "mean_dv12"), "p", digits=7), "stronger", digits=9)


@query("t20_share_within", f"with {STEPS} select round(avg((km <= 100)::int), 9) as within_100, round(avg((km <= 222.4)::int), 9) as within_222_4 from steps")
def t20_share_within(spark, sf_dir):
    d = stats.share_within(_steps(spark, sf_dir), "km", (100, 222.4)).withColumnRenamed("within_222.4", "within_222_4")
    return _r(d, "within_100", "within_222_4", digits=9)


# Patches.


@query("g8_g12_fields", f"with {PATCH} select event_id, t_idx::int as t_idx, i::int as i, j::int as j, round(sqrt(u * u + v * v), 6) as speed, round(t - avg(t) over (partition by event_id, t_idx), 6) as anomaly from patch")
def g8_g12_fields(spark, sf_dir):
    d = patches(spark, sf_dir).select("event_id", "t_idx", "i", "j", grid.wind_speed().alias("speed"), grid.anomaly("t").alias("anomaly"))
    return _r(d, "speed", "anomaly")


DIFF = """case when lag({c}) over {w} is not null and lead({c}) over {w} is not null then (lead({c}) over {w} - lag({c}) over {w}) / 50 when lead({c}) over {w} is not null then (lead({c}) over {w} - {c}) / 25 when lag({c}) over {w} is not null then ({c} - lag({c}) over {w}) / 25 end"""
GX, GY = (lambda c: DIFF.format(c=c, w="wx")), (lambda c: DIFF.format(c=c, w="wy"))


@query("g7_g11_derivatives", f"""with {PATCH}, d as (select *, {GX('u')} as ux, {GX('v')} as vx, {GX('p')} as px, {GY('u')} as uy, {GY('v')} as vy, {GY('p')} as py from patch
  window wx as (partition by event_id, t_idx, i order by j), wy as (partition by event_id, t_idx, j order by i))
  select event_id, t_idx::int as t_idx, i::int as i, j::int as j, round(vx - uy, 7) as vorticity, round(ux + vy, 7) as divergence, round(sqrt(px * px + py * py), 7) as gradient from d""")
def g7_g11_derivatives(spark, sf_dir):
    dx = dy = F.lit(25.0)
    d = patches(spark, sf_dir).select("event_id", "t_idx", "i", "j", grid.vorticity(dx, dy).alias("vorticity"), grid.divergence(dx, dy).alias("divergence"), grid.gradient_magnitude("p", dx, dy).alias("gradient"))
    return _r(d, "vorticity", "divergence", "gradient", digits=7)


@query("g6_spacing", f"with {PATCH} select event_id, t_idx::int as t_idx, round(0.25 * 111320.0 * cos(radians(avg(lat))), 4) as dx, round(0.25 * 111320.0, 4) as dy from patch group by 1, 2")
def g6_spacing(spark, sf_dir):
    return _r(grid.spacing(patches(spark, sf_dir)), "dx", "dy", digits=4)


@query("g13_g14_fluxes", f"""with {PATCH}, s as (select event_id, t_idx, i, j, 300 + 5 * t as sst, 100000 + 1000 * p as pr, sqrt(u * u + v * v) * 10 as w from patch),
  q as (select *, 611.2 * exp(17.67 * (sst - 273.15) / (sst - 29.65)) as es, 611.2 * exp(17.67 * (sst - 3 - 273.15) / (sst - 3 - 29.65)) as ea from s),
  h as (select *, 1.2 * 2.5e6 * 1.2e-3 * w * (0.622 * es / (pr - 0.378 * es) - 0.622 * ea / (pr - 0.378 * ea)) as latent, 1.2 * 1005.0 * 1.2e-3 * w * 1 as sensible from q)
  select event_id, t_idx::int as t_idx, i::int as i, j::int as j, round(latent, 4) as latent, round(sensible, 4) as sensible, round(latent + sensible, 4) as total from h""")
def g13_g14_fluxes(spark, sf_dir):
    none = F.lit(None).cast("double")
    d = patches(spark, sf_dir).withColumn("f", grid.heat_fluxes(300 + 5 * F.col("t"), none, none, 100000 + 1000 * F.col("p"), grid.wind_speed() * 10))
    return _r(d.select("event_id", "t_idx", "i", "j", "f.latent", "f.sensible", "f.total"), "latent", "sensible", "total", digits=4)


@query("g19_g21_prior", f"""with {PATCH}, a as (select *, greatest(t - avg(t) over (partition by event_id, t_idx), 0) * sqrt(u * u + v * v) * (1 + 0.5 * greatest(-p, 0)) as raw from patch)
  select event_id, t_idx::int as t_idx, i::int as i, j::int as j, round(case when max(raw) over w - min(raw) over w < 1e-8 then 0 else (raw - min(raw) over w) / (max(raw) over w - min(raw) over w + 1e-8) end, 6) as scaled,
  round(raw / nullif(sum(raw) over w, 0), 6) as mass from a window w as (partition by event_id, t_idx)""")
def g19_g21_prior(spark, sf_dir):
    d = patches(spark, sf_dir).withColumns({"anom": grid.anomaly("t"), "speed": grid.wind_speed()}).withColumn("raw", grid.prior("anom", "speed", "p", 0.5))
    return _r(d.select("event_id", "t_idx", "i", "j", grid.scaled("raw").alias("scaled"), grid.distribution("raw").alias("mass")), "scaled", "mass")


@query("g24_peaks", f"with {PATCH}, r as (select *, row_number() over (partition by event_id, t_idx order by t desc nulls last, i, j) as k from patch) select event_id, t_idx::int as t_idx, lat, lon, round(t, 6) as peak from r where k = 1 and t is not null")
def g24_peaks(spark, sf_dir):
    return _r(grid.peak(patches(spark, sf_dir), "t"), "peak")


@query("g32_soft_argmax", f"with {PATCH}, w as (select *, exp((t - max(t) over (partition by event_id, t_idx)) / 0.1) as w from patch) select event_id, t_idx::int as t_idx, round(sum(i * w) / sum(w), 6) as i, round(sum(j * w) / sum(w), 6) as j from w group by 1, 2")
def g32_soft_argmax(spark, sf_dir):
    return _r(grid.soft_argmax(patches(spark, sf_dir), "t", 0.1), "i", "j")


@query("g34_overlap", f"with {PATCH}, r as (select event_id, t_idx, row_number() over (partition by event_id, t_idx order by u desc nulls last, i, j) as a, row_number() over (partition by event_id, t_idx order by v desc nulls last, i, j) as b from patch) select event_id, t_idx::int as t_idx, sum((a <= 10 and b <= 10)::int) / 10 as overlap from r group by 1, 2")
def g34_overlap(spark, sf_dir):
    return grid.overlap_top_k(patches(spark, sf_dir), "u", "v")


@query("g36_correlation", f"with {PATCH} select event_id, t_idx::int as t_idx, round(corr(u, v), 6) as r from patch where u is not null and v is not null group by 1, 2 having count(*) >= 10")
def g36_correlation(spark, sf_dir):
    d = patches(spark, sf_dir).dropna(subset=["u", "v"]).groupBy(*grid.STEP).agg(F.count("*").alias("n"), F.corr("u", "v").alias("r"))
    return _r(d.where("n >= 10").drop("n"), "r")


@query("g37_masks", f"with {PATCH}, r as (select *, row_number() over (partition by event_id, t_idx order by t desc nulls last, i, j) as a, row_number() over (partition by event_id, t_idx order by t nulls first, i, j) as b, floor(count(*) over (partition by event_id, t_idx) * 0.1) as n from patch) select event_id, t_idx::int as t_idx, i::int as i, j::int as j, (a <= n)::int as top, (b <= n)::int as bottom from r where a <= n or b <= n")
def g37_masks(spark, sf_dir):
    return grid.extreme_masks(patches(spark, sf_dir), "t").where("top = 1 or bottom = 1").select("event_id", "t_idx", "i", "j", "top", "bottom")


@query("g4_ranges", f"with {PATCH} select event_id, t_idx::int as t_idx, avg((u is null)::int) as u_missing, min((coalesce(u between -0.2 and 0.2, true))::int) as u_ok from patch group by 1, 2")
def g4_ranges(spark, sf_dir):
    return grid.ranges(patches(spark, sf_dir), {"u": (-0.2, 0.2)})


@query("a12_channel_stats", f"with {PATCH} select event_id, " + ", ".join(f"round(coalesce({f}({c}), 0), 6) as {c}_{n}" for c in "uvt" for n, f in (("mean", "avg"), ("sd", "stddev_pop"), ("lo", "min"), ("hi", "max"))) + " from patch group by 1")
def a12_channel_stats(spark, sf_dir):
    d = grid.channel_stats(patches(spark, sf_dir), ["u", "v", "t"], "event_id")
    return _r(d, *[c for c in d.columns if c != "event_id"])


@query("a16_a18_normalised", f"""with {PATCH}, s as (select avg(u) as m, sqrt(greatest(var_pop(u), 1e-12)) as sd from patch where event_id % 3 <> 0)
  select event_id, round(avg(coalesce((u - m) / sd, 0)), 6) as mean_u from patch, s group by 1""")
def a16_a18_normalised(spark, sf_dir):
    d = patches(spark, sf_dir)
    norm = grid.normalisation(d.where("event_id % 3 <> 0"), ["u"])
    return _r(grid.standardised(d, norm, ["u"]).groupBy("event_id").agg(F.avg("u").alias("mean_u")), "mean_u")


# The other query modules register theirs in the same tables.
from . import queries_audit, queries_fields, queries_gates, queries_io, queries_stats  # noqa: E402, F401
