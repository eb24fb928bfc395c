"""Cleaning, filters and ids of track records. All expressions are built in and push down where the source allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts that stand for a missing name.
MISSING_TEXTS = ("nan", "None", "<NA>")


def epoch_s(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clean_text(c: Column, default: str) -> Column:
    return F.when(c.isin(*MISSING_TEXTS), F.lit(default)).otherwise(F.coalesce(c, F.lit(default)))


def number(c: Column) -> Column:
    """Text as a double; what is none becomes null."""
    return c.try_cast("double")


def longitude_180(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def longitude_360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def resolve(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rename the first present candidate of each wanted column; an error lists all that are missing."""
    found = {name: next((c for c in cands if c in df.columns), None) for name, cands in wanted.items()}
    if missing := [f"{n} (any of {', '.join(wanted[n])})" for n, c in found.items() if c is None]:
        raise ValueError("columns not found: " + "; ".join(missing))
    return df.select(*[F.col(c).alias(n) for n, c in found.items()])


def required(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def at_hours(df: DataFrame, hours: tuple[int, ...] = (0, 6, 12, 18), ts: str = "ts") -> DataFrame:
    """Rows whose hour is one of ``hours``; minutes don't matter."""
    return df.where(F.hour(ts).isin(*hours))


def in_box(df: DataFrame, north: float, west: float, south: float, east: float) -> DataFrame:
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def in_years(df: DataFrame, first: int, last: int, ts: str = "ts") -> DataFrame:
    return df.where(F.year(ts).between(first, last))


def event_id(ts: Column, sid: Column, prefix: str = "era5") -> Column:
    """prefix_yyyy_MM_dd_HHmm_sid; an empty sid is an error."""
    checked = F.when(F.length(F.trim(sid)) > 0, sid).otherwise(F.raise_error(F.lit("an event id needs a sid")))
    return F.concat_ws("_", F.lit(prefix), F.date_format(ts, "yyyy_MM_dd_HHmm"), checked)


def parse_event_id(c: Column, prefix: str = "era5") -> Column:
    """struct(year, stamp, sid); null parts where the text is no event id."""
    pattern = rf"^{prefix}_(\d{{4}}_\d{{2}}_\d{{2}}_\d{{4}})_(.*)$"
    part = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return F.struct(F.substring(part(1), 1, 4).cast("int").alias("year"), part(1).alias("stamp"), part(2).alias("sid"))


def trend(dv6: Column) -> Column:
    return F.when(dv6 > 0, "strengthening").when(dv6 < 0, "weakening").otherwise("steady")


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
