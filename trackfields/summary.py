"""Summaries, censuses and published forms of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import epoch_s


def storms(df: DataFrame, label: str = "label") -> DataFrame:
    """One row per storm: start, end, extremes, any positive label, number of fixes, first basin."""
    return df.groupBy("sid").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("wind_kt").alias("max_wind"), F.max((F.coalesce(F.col(label), F.lit(0)) == 1).cast("int")).alias("any_positive"),
        F.count("*").alias("n"), F.min_by("basin", "ts").alias("basin"),
    )


def totals(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct("sid").alias("storms"), F.sum(F.col(label)).alias("positives"), F.count(F.when(F.col(label).isNull(), 1)).alias("undefined"), F.min(F.year("ts")).alias("first_year"), F.max(F.year("ts")).alias("last_year"))


def several_basins(df: DataFrame) -> DataFrame:
    s = df.groupBy("sid").agg(F.array_sort(F.collect_set("basin")).alias("b"))
    return s.where(F.size("b") > 1).select("sid", F.array_join("b", ",").alias("basins"))


def gaps(df: DataFrame, order: list, ts: str = "ts") -> DataFrame:
    """Rows with ``gap_h``, hours since the storm's row before."""
    s = epoch_s(F.col(ts))
    return df.withColumn("gap_h", (s - F.lag(s).over(Window.partitionBy("sid").orderBy(*order))) / 3600)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def coverage(df: DataFrame, have: Column, *by: str) -> DataFrame:
    """n, with, share and whether all rows have it."""
    y = have.cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("having"), F.avg(y.cast("double")).alias("share"), (F.min(y) == 1).cast("int").alias("passed"))


def geojson(df: DataFrame, properties: list[str]) -> DataFrame:
    """(sid, geojson): a FeatureCollection of the track's line and its points in time order.

    A track's points are collected in one row, which its length bounds.
    """
    rows = df.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("ts", "lon", "lat", *properties))).alias("p"))
    spot = lambda x: F.array(F.bround(x["lon"], 4), F.bround(x["lat"], 4))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform("p", spot).alias("coordinates")))
    point = lambda x: F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), spot(x).alias("coordinates")).alias("geometry"),
        F.struct(F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm").alias("t"), *[x[c].alias(c) for c in properties]).alias("properties"),
    )
    points = F.transform("p", lambda x: F.to_json(point(x), {"ignoreNullFields": "false"}))
    head = F.concat(F.lit('{"type":"Feature","geometry":'), line, F.lit(',"properties":{"sid":"'), F.col("sid"), F.lit('"}}'))
    return rows.select("sid", F.concat(F.lit('{"type":"FeatureCollection","features":['), head, F.lit(","), F.array_join(points, ","), F.lit("]}")).alias("geojson"))


def duration_text(hours: Column) -> Column:
    return F.concat(F.floor(hours / 24).cast("string"), F.lit("d "), F.pmod(hours, F.lit(24)).cast("int").cast("string"), F.lit("h"))


def points(tracks: DataFrame, properties: str, geojson: str = "geojson") -> DataFrame:
    """The points of each track's FeatureCollection: sid, t, lat, lon and the properties asked for."""
    one = f"struct<geometry: struct<type: string, coordinates: string>, properties: struct<t: string, {properties.replace(' ', ': ').replace(',:', ',')}>>"
    names = [p.split()[0] for p in properties.split(",")]
    f = tracks.select("sid", F.explode(F.from_json(geojson, f"struct<features: array<{one}>>")["features"]).alias("f")).where("f.geometry.type = 'Point'")
    place = F.from_json("f.geometry.coordinates", "array<double>")
    return f.select("sid", "f.properties.t", place[1].alias("lat"), place[0].alias("lon"), *[f"f.properties.{n}" for n in names])


def channel(names: str, values: str, name: str) -> Column:
    """The value of a named channel; null where the channel is absent."""
    at = F.array_position(names, name)
    return F.when(at > 0, F.try_element_at(values, at.cast("int")))


def has_channels(names: str, *wanted: str) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), names)) == 0


def search(storms: DataFrame, text: str) -> DataFrame:
    """Storms whose name, in either case, or start year contains the text."""
    return storms.where(F.lower("name").contains(text.lower()) | F.col("year").contains(text))


def missing_months(need: DataFrame, have: DataFrame, size: str) -> DataFrame:
    """Per year: months needed that are not there, and their size at the mean of those that are."""
    mean = have.agg(F.avg(size).alias("mean"))  # one row
    gone = need.join(have.select("year", "month"), ["year", "month"], "left_anti").groupBy("year").agg(F.count("*").alias("missing"))
    return gone.crossJoin(F.broadcast(mean)).select("year", "missing", (F.col("missing") * F.col("mean")).alias(size))


def evenly_spaced(times: str, step: int) -> Column:
    """Whether sorted numbers follow each other at the step."""
    later = F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0)))
    return F.forall(F.zip_with(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), later, lambda a, b: b - a), lambda d: d == step)


def all_distinct(values: Column, n: int) -> Column:
    return F.size(F.array_distinct(values)) == n
