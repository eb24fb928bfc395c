"""Queries on sources, sinks, nested output and incremental runs. What they read back, they have written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import clean, labels, sources, summary
from .queries import LABELLED, TRACK, _r, _read, labelled, query, track


def _raw_file(spark, sf_dir) -> str:
    """``track`` as a raw file: a units row, ``NA`` as a basin, blank pressures, names that stand for none."""
    t = track(spark, sf_dir)
    s = lambda c: c.cast("string")
    name = F.when(F.col("sid").cast("long") % 7 == 0, "nan").otherwise(F.concat(F.lit("S"), "sid"))
    rows = t.select(
        F.col("sid").alias("SID"), name.alias("NAME"), F.when(F.col("h") % 12 == 0, "NA").otherwise(F.col("basin")).alias("BASIN"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ISO_TIME"),
        s(F.col("lat")).alias("LAT"), s(F.col("lon")).alias("LON"), s(F.col("wind_kt")).alias("USA_WIND"), F.when(F.col("h") % 36 == 0, " ").otherwise(s(900 + F.col("h") % 100)).alias("USA_PRES"),
    )
    units = t.limit(1).select(*[F.lit(u).alias(c) for c, u in zip(rows.columns, (" ", " ", " ", "Year-Month-Day", "degrees_north", "degrees_east", "kts", "mb"))])
    path = sources.scratch(spark, "tracks")
    sources.write_csv(rows.unionByName(units), path)
    return path


def _built(spark, sf_dir):
    """The whole event list from the raw file: filters first, then deltas and labels."""
    d = sources.best_track(sources.raw_tracks(spark, _raw_file(spark, sf_dir)))
    d = clean.at_hours(clean.required(d, "ts", "lat", "lon", "wind_kt"))
    d = clean.in_years(clean.in_box(d.where(F.col("wind_kt") >= 5), 36, -58, 11, -14), 2000, 2100)
    d = labels.strict_deltas(d).withColumn("label", labels.three_state(F.col("dv24")))
    return d.withColumn("h", (clean.epoch_s(F.col("ts")) / 3600).cast("long"))


BUILT = f"""{TRACK}, f as (select * from track where wind_kt >= 5 and lat between 11 and 36 and lon between -58 and -14),
built as (select a.*, b.wind_kt - a.wind_kt as dv12, c.wind_kt - a.wind_kt as dv24, case when c.wind_kt - a.wind_kt is null then null when c.wind_kt - a.wind_kt >= 30 then 1 else 0 end as label
  from f a left join f b on a.sid = b.sid and b.h = a.h + 12 left join f c on a.sid = c.sid and c.h = a.h + 24)"""


@query("s1_s2_best_track", f"""with {TRACK} select sid, case when sid::bigint % 7 = 0 then 'UNNAMED' else 'S' || sid end as name, case when h % 12 = 0 then 'NA' else basin end as basin, h, lat::double as lat, lon::double as lon, wind_kt,
  case when h % 36 = 0 then null else (900 + h % 100)::double end as pressure_mb from track""")
def s1_s2_best_track(spark, sf_dir):
    d = sources.best_track(sources.raw_tracks(spark, _raw_file(spark, sf_dir)))
    return d.select("sid", "name", "basin", (clean.epoch_s(F.col("ts")) / 3600).cast("long").alias("h"), "lat", "lon", "wind_kt", "pressure_mb")


@query("l4_built", f"with {BUILT} select sid, h, wind_kt, round(dv12, 6) as dv12, round(dv24, 6) as dv24, label from built")
def l4_built(spark, sf_dir):
    return _r(_built(spark, sf_dir).select("sid", "h", "wind_kt", "dv12", "dv24", "label"), "dv12", "dv24").orderBy("sid", "h")


@query("l4_summary", f"with {BUILT} select count(*) as rows, count(distinct sid) as storms, sum(label)::bigint as positives, sum((label is null)::int)::bigint as undefined, min(year(ts))::int as first_year, max(year(ts))::int as last_year from built")
def l4_summary(spark, sf_dir):
    return summary.totals(_built(spark, sf_dir))


@query("s3_event_list", f"with {LABELLED} select sid, h, label from labelled")
def s3_event_list(spark, sf_dir):
    odd = F.col("h") % 12 == 0
    rows = labelled(spark, sf_dir).select("sid", F.when(odd, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.when(~odd, F.date_format("ts", "yyyyMMdd HHmm")).alias("datetime"), "label")
    path = sources.scratch(spark, "events")
    sources.write_csv(rows, path)
    d = sources.event_list(spark, path, "sid string, timestamp string, datetime string, label int")
    return d.select("sid", (clean.epoch_s(F.col("ts")) / 3600).cast("long").alias("h"), "label")


@query("s4_sidecars", f"with {LABELLED} select sid || '_' || h as event_id, sid, label as ri_label, 3 as n_times, wind_kt > 50 as ok, null::int as missing from labelled")
def s4_sidecars(spark, sf_dir):
    t = labelled(spark, sf_dir)
    times = F.array(*[F.date_format(F.col("ts") - F.expr(f"interval {k} hours"), "yyyy-MM-dd HH:mm") for k in (0, 6, 12)])
    record = F.struct(F.concat_ws("_", "sid", "h").alias("event_id"), "sid", F.col("label").alias("ri_label"), times.alias("timestamps"), F.struct((F.col("wind_kt") > 50).alias("ok")).alias("qc_flags"), F.lit("x").alias("later_key"))
    path = sources.scratch(spark, "sidecars")
    t.select(F.to_json(record)).write.text(path)
    return sources.sidecars(spark, path).select("event_id", "sid", "ri_label", F.size("timestamps").alias("n_times"), F.col("qc_flags.ok").alias("ok"), F.col("qc_flags.missing").alias("missing"))


@query("s5_npy_rows", "select vec_id, k::int as cell, x::float as value from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as k from embeddings)")
def s5_npy_rows(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select("vec_id", sources.npy_bytes(F.col("embedding").cast("array<float>")).alias("content"))
    return sources.npy_rows(v)


@query("s6_s7_year_shards", f"with {TRACK} select sid, h, year(ts)::int as year from track where year(ts) = (select min(year(ts)) from track)")
def s6_s7_year_shards(spark, sf_dir):
    t = track(spark, sf_dir).withColumn("year", F.year("ts"))
    path = sources.scratch(spark, "shards")
    t.select("sid", "h", "year").write.partitionBy("year").parquet(path)
    d = spark.read.parquet(path)
    first = d.agg(F.min("year")).head()[0]
    return d.where(F.col("year") == first)  # reads that year's files only


@query("s8_audit_lines", f"with {TRACK} select sid, h, 'first' as note from track where wind_kt > 300 union all select sid, h, 'second' from track where wind_kt < 20")
def s8_audit_lines(spark, sf_dir):
    t, path = track(spark, sf_dir), sources.scratch(spark, "audit")
    for condition, note in (("wind_kt > 300", "first"), ("wind_kt < 20", "second")):
        sources.append_audit(t.where(condition).select("sid", "h", F.lit(note).alias("note")), path)
    return spark.read.schema("sid string, h long, note string").json(path)


@query("s9_strict_json", """select event_id, '{"event_id":' || event_id || ',"v":' || case when event_id % 3 = 0 then 'null' else floor(value)::double::varchar end || '}' as json from events""")
def s9_strict_json(spark, sf_dir):
    v = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 0, F.lit(float("-inf"))).otherwise(F.floor("value").cast("double"))
    d = _read(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return d.select("event_id", sources.strict_json(d, "v").alias("json"))


@query("s10_artifact_hashes", "select page_id::varchar as path, octet_length(encode(html))::bigint as size, sha256(html) as sha256 from pages")
def s10_artifact_hashes(spark, sf_dir):
    return sources.artifacts(_read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content")))


@query("s11_verified_hashes", "select page_id::varchar as path, case when page_id % 11 = 0 then 'unlisted' when page_id % 7 = 0 then 'missing' when page_id % 5 = 0 then 'changed' else 'same' end as status from pages where html is not null")
def s11_verified_hashes(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").where("html is not null").select("page_id", F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    stored = sources.artifacts(p.where("page_id % 11 <> 0"))
    now = p.where("page_id % 7 <> 0 or page_id % 11 = 0").withColumn("content", F.when(F.col("page_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return sources.verified(stored, sources.artifacts(now))


@query("n2_n3_points", f"""with {LABELLED} select sid, strftime(ts, '%Y-%m-%dT%H:%M') as t, round_even(lat, 4) as lat, round_even(lon, 4) as lon, wind_kt, label, case when h % 24 = 0 then null else (h % 17)::double / 4 end as env_sst_c from labelled""")
def n2_n3_points(spark, sf_dir):
    d = labelled(spark, sf_dir)
    env = d.where("h % 24 <> 0").select("sid", "h", ((F.col("h") % 17).cast("double") / 4).alias("env_sst_c"))
    tracks = summary.geojson(d.join(env, ["sid", "h"], "left"), ["wind_kt", "label", "env_sst_c"])
    return summary.points(tracks, "wind_kt double, label int, env_sst_c double")


@query("n4_channels", """with e as (select vec_id, embedding as x from embeddings where len(embedding) >= 3) select vec_id, x[2]::double as second, x[1]::double as first, true as complete, vec_id % 2 = 0 as has_extra from e""")
def n4_channels(spark, sf_dir):
    extra = F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>"))
    d = _read(spark, sf_dir, "embeddings").where(F.size("embedding") >= 3).select("vec_id", F.concat(F.array(F.lit("u"), F.lit("v"), F.lit("p")), extra).alias("channels"), F.col("embedding").alias("x"))
    return d.select("vec_id", *[summary.channel("channels", "x", c).cast("double").alias(n) for c, n in (("v", "second"), ("u", "first"))], summary.has_channels("channels", "u", "v", "p").alias("complete"), summary.has_channels("channels", "extra").alias("has_extra"))


YEARS = f"{TRACK}, y as (select *, year(ts)::int - year(ts)::int % 1 + (sid::bigint % 12)::int as year from track), span as (select min(year) as a, max(year) as b from y), w as (select y0, least(y0 + 4, b) as y1 from (select unnest(range(a, b + 1, 5)) as y0, b from span))"


def _years(spark, sf_dir):
    return track(spark, sf_dir).withColumn("year", (F.year("ts") + F.col("sid").cast("long") % 12).cast("int"))


@query("i1_windows", f"with {YEARS} select y0::int as y0, y1::int as y1, count(*) as n from w join y on year between y0 and y1 group by 1, 2")
def i1_windows(spark, sf_dir):
    y = _years(spark, sf_dir)
    w = sources.windows(y, "year", 5)  # a row per five years
    return y.join(F.broadcast(w), F.col("year").between(F.col("y0"), F.col("y1"))).groupBy("y0", "y1").agg(F.count("*").alias("n"))


@query("i2_runs", f"with {YEARS}, n as (select y0, y1, count(*) as n, row_number() over (order by y0) as k from w join y on year between y0 and y1 group by 1, 2) select y0::int as y0, y1::int as y1, case when k = 1 then 'skipped' else 'completed' end as status from n")
def i2_runs(spark, sf_dir):
    y, path = _years(spark, sf_dir), sources.scratch(spark, "runs")
    spans = [(r.y0, r.y1) for r in sources.windows(y, "year", 5).orderBy("y0").collect()]

    def work(a: int, b: int) -> None:
        y.where(F.col("year").between(a, b)).select("sid", "h", "year").write.parquet(f"{path}/y0={a}")

    def check(a: int, b: int) -> bool:
        return spark.read.parquet(f"{path}/y0={a}").where(~F.col("year").between(a, b)).isEmpty()

    done = sources.run_windows(spans, set(spans[:1]), work, check)
    return spark.createDataFrame(done, "y0 int, y1 int, status string")


@query("i2_resumed", f"""with {YEARS}, n as (select y0, y1, count(*) as n, count(case when sid::bigint % 2 = 0 then 1 end) as half, row_number() over (order by y0) as k from w join y on year between y0 and y1 group by 1, 2)
  select 1 as run, y0::int as y0, y1::int as y1, case when k < 2 then 'completed' else 'failed' end as status, case when k < 2 then n else half end as n from n where k <= 2 union all
  select 2, y0::int, y1::int, case when k < 2 then 'skipped' else 'completed' end, n from n union all select 3, y0::int, y1::int, 'in the table', n from n""")
def i2_resumed(spark, sf_dir):
    y, path = _years(spark, sf_dir).select("sid", "h", "year"), sources.scratch(spark, "windows")
    second = [r.y0 for r in sources.windows(y, "year", 5).orderBy("y0").limit(2).collect()][-1]
    lossy = lambda rows, y0, y1: rows.where("cast(sid as long) % 2 = 0") if y0 == second else rows
    first = sources.run_resumable(y, "year", 5, path, lossy)  # loses rows of the second window, which ends the run
    again = sources.run_resumable(y, "year", 5, path, lambda rows, y0, y1: rows)
    runs = spark.createDataFrame([(1, *r) for r in first] + [(2, *r) for r in again], "run int, y0 int, y1 int, status string, n long")
    at = sources.written(spark, path, y).groupBy(F.col("_y0").alias("y0")).agg(F.count("*").alias("n"))
    ends = sources.manifest(spark, f"{path}/manifest").select("y0", "y1")
    return runs.unionByName(at.join(ends, "y0").select(F.lit(3).alias("run"), "y0", "y1", F.lit("in the table").alias("status"), "n"))


@query("i3_pending", f"with {TRACK} select sid, h from track where not (sid::bigint % 4 = 0 and h % 12 = 0)")
def i3_pending(spark, sf_dir):
    t = track(spark, sf_dir).select("sid", "h")
    return sources.pending(t, t.where("cast(sid as long) % 4 = 0 and h % 12 = 0"), ["sid", "h"])
