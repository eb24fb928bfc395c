"""Fields around events: nearest cells and levels, windows, resampling, smoothing, peaks and their quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid, stats
from .audit import reasons
from .clean import finite
from .grid import STEP
from .joins import windows


def nearest_index(x: Column, first: float, step: float, n: int) -> Column:
    """The index of the nearest point of a regular axis; the first on ties, the ends for what lies outside."""
    at = F.ceil((x - first) / step - 0.5)
    return F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("int")


def nearest_level(df: DataFrame, level: str, wanted: tuple[float, ...], within: float = 1.0) -> DataFrame:
    """Rows with ``wanted``: the level asked for that is within so many hPa, else null."""
    gaps = F.array(*[F.struct(F.abs(F.col(level) - w).alias("gap"), F.lit(w).alias("level")) for w in wanted])
    best = F.array_min(gaps)
    return df.withColumn("wanted", F.when(best["gap"] <= within, best["level"]))


def degree_box(centres: DataFrame, cells: DataFrame, degrees: float) -> DataFrame:
    """Cells within ``degrees`` in latitude and longitude of each centre, across the date line too.

    Both carry lat and lon (the centres as clat, clon), with longitudes in [0, 360). Dealt by tiles as wide as the box.
    """
    size = 2 * degrees
    around = int(np.ceil(360 / size))
    tile = lambda c: F.floor(c / size)
    near = lambda c: F.array_distinct(F.array(tile(c - degrees), tile(c + degrees)))
    c = centres.withColumn("ti", F.explode(near(F.col("clat")))).withColumn("tj", F.explode(F.array_distinct(F.transform(F.sequence(tile(F.col("clon") - degrees) - 1, tile(F.col("clon") + degrees) + 1), lambda t: F.pmod(t, F.lit(around))))))
    g = cells.withColumns({"ti": tile(F.col("lat")), "tj": F.pmod(tile(F.col("lon")), F.lit(around))})
    apart = F.abs(F.col("lon") - F.col("clon"))
    inside = (F.abs(F.col("lat") - F.col("clat")) <= degrees) & (F.least(apart, 360 - apart) <= degrees)
    return c.join(g, ["ti", "tj"]).where(inside).drop("ti", "tj")


def extracted(events: DataFrame, grid: DataFrame, size: int, offsets: tuple[int, ...]) -> DataFrame:
    """Window cells of each event at each time offset in hours. ``events``: event_id, time, ci, cj; ``grid``: time, i, j and fields."""
    e = events.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("time", F.col("time") + F.col("offset"))
    return windows(e, grid, size)


def padded(df: DataFrame, size: int, to: int, *keys: str) -> DataFrame:
    """Maps of ``size`` x ``size`` cells (i, j) as ``to`` x ``to``: mirrored beyond the edges without repeating them, or cut from the centre."""
    before = (to - size) // 2 if to >= size else -((size - to) // 2)
    # The new places of each old index; a mirrored index may have several.
    places: dict[int, list[int]] = {}
    for k in range(to):
        old, period = k - before, 2 * (size - 1)
        old = abs(old) % period if period else 0
        places.setdefault(min(old, period - old) if period else 0, []).append(k)
    table = F.array(*[F.array(*map(F.lit, places.get(k, []))).cast("array<int>") for k in range(size)])
    out = df.withColumn("_i", F.explode(table[F.col("i")])).withColumn("_j", F.explode(table[F.col("j")]))
    return out.withColumns({"i": F.col("_i"), "j": F.col("_j")}).drop("_i", "_j")


def centre_inside(df: DataFrame, *keys: str) -> DataFrame:
    """keys, inside: whether the centre (clat, clon) lies within the cells' latitudes and longitudes, taken relative to the centre."""
    east = F.pmod(F.col("lon") - F.col("clon") + 180, F.lit(360.0)) - 180
    return df.groupBy(*keys).agg((F.min("lat").alias("a") <= F.first("clat")).alias("s"), (F.max("lat") >= F.first("clat")).alias("n"), (F.min(east) <= 0).alias("w"), (F.max(east) >= 0).alias("e")).select(*keys, F.expr("s and n and w and e").alias("inside"))


def shear(df: DataFrame, *keys: str) -> DataFrame:
    """Difference of the winds at 850 and 200 hPa; null without either."""
    at = lambda c, p: F.max(F.when(F.col("level") == p, F.col(c)))
    du, dv = at("u", 850) - at("u", 200), at("v", 850) - at("v", 200)
    return df.groupBy(*keys).agg(F.sqrt(du * du + dv * dv).alias("shear"))


def middle_humidity(df: DataFrame, *keys: str) -> DataFrame:
    """Mean humidity of 700, 600 and 500 hPa; null unless all three are there."""
    d = df.where(F.col("level").isin(700, 600, 500))
    return d.groupBy(*keys).agg(F.when(F.count_distinct(F.when(F.col("r").isNotNull(), F.col("level"))) == 3, F.avg("r")).alias("humidity"))


def appended(have: DataFrame, new: DataFrame, key: str, cells: int) -> tuple[DataFrame, DataFrame]:
    """(rows to add, (key, outcome)): all cells of an event or none; events that are there already are left alone."""
    counts = new.groupBy(key).agg(F.count("*").alias("_n"))
    d = counts.join(have.select(key).distinct().withColumn("_have", F.lit(1)), key, "full")
    outcome = F.when(F.col("_have").isNotNull(), "present").when(F.col("_n") == cells, "appended").otherwise("incomplete")
    outcomes = d.select(key, outcome.alias("outcome"))
    return new.join(outcomes.where("outcome = 'appended'").select(key), key, "left_semi"), outcomes


def bilinear(points: DataFrame, cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``points`` (keys, y, x: places in units of cells) with ``value`` between the four cells around; null outside or next to a missing cell."""
    at = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    p = points.withColumn("_k", F.monotonically_increasing_id()) if "_k" not in points.columns else points
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    n = p.withColumn("_c", F.explode(at)).withColumns({"i": (F.floor("y") + F.col("_c.a")).cast("int"), "j": (F.floor("x") + F.col("_c.b")).cast("int")})
    n = n.withColumn("_w", F.when(F.col("_c.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("_c.b") == 1, fx).otherwise(1 - fx)).where("_w > 0")
    d = n.join(cells.select(*keys, "i", "j", F.col(value).alias("_v")), [*keys, "i", "j"], "left")
    total = F.when(F.count(finite(F.col("_v"))) == F.count("*"), F.sum(F.col("_v") * F.col("_w")))
    return d.groupBy(*points.columns).agg(total.alias(value))


def geographic(points: DataFrame, size: int) -> DataFrame:
    """lat, lon of normalised places (ny, nx in [0, 1]) on a patch with regular axes (lat0, lat1, lon0, lon1)."""
    between = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.least(F.greatest(F.col(t), F.lit(0.0)), F.lit(1.0))
    return points.withColumns({"lat": between("lat0", "lat1", "ny"), "lon": between("lon0", "lon1", "nx")})


def maps(df: DataFrame, c: str, size: int) -> DataFrame:
    """A row per patch with its ``size * size`` values in row order; cells that are not there are null."""
    cells = F.sort_array(F.collect_list(F.struct((F.col("i") * size + F.col("j")).alias("k"), F.col(c).cast("double").alias("x"))))
    d = df.groupBy(*STEP).agg(F.map_from_entries(cells).alias("m"))
    return d.select(*STEP, F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.try_element_at("m", k)).alias("map"))


#: Decimals to which smoothed values count as equal; the first cell wins then.
TIE = 10


def _kernel(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return w / w.sum()


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing of maps (n, rows, columns) over finite cells; edges are mirrored with the edge repeated."""

    def along(a: np.ndarray, axis: int) -> np.ndarray:
        w = _kernel(sigma)
        r = len(w) // 2
        place = np.arange(-r, a.shape[axis] + r) % (2 * a.shape[axis])
        place = np.where(place < a.shape[axis], place, 2 * a.shape[axis] - 1 - place)
        b = np.take(a, place, axis)
        return sum(w[k] * np.take(b, np.arange(k, k + a.shape[axis]), axis) for k in range(len(w)))

    good = np.isfinite(x)
    top, under = (along(along(a, 1), 2) for a in (np.where(good, x, 0.0), good.astype(float)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(under > 1e-12, top / under, np.nan)


def smoothed(m: DataFrame, size: int, sigma: float) -> DataFrame:
    """Maps (see ``maps``) after ``smooth``."""

    def run(s: pd.Series) -> pd.Series:
        x = np.array([np.array(v, float) for v in s]).reshape(-1, size, size)
        return pd.Series([np.where(np.isfinite(v), v, None).tolist() for v in smooth(x, sigma).reshape(len(s), -1)], dtype=object)

    return m.withColumn("map", F.pandas_udf(run, "array<double>")("map"))


def peaks(m: DataFrame, size: int, sigma: float, detrend: float = 0.0) -> DataFrame:
    """STEP, i, j, value, local: the highest local maximum of the smoothed map, else its highest cell, with the raw value there.

    ``detrend``: a wider smoothing that is subtracted first. Null without a finite cell.
    """

    def run(s: pd.Series) -> pd.DataFrame:
        raw = np.array([np.array(v, float) for v in s]).reshape(-1, size, size)
        x = raw - smooth(raw, detrend) if detrend else raw
        x = np.round(smooth(x, sigma) if sigma else x, TIE)
        x = np.where(np.isfinite(x), x, -np.inf)
        edge = np.pad(x, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
        around = np.stack([edge[:, 1 + a : 1 + a + size, 1 + b : 1 + b + size] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
        inner = np.zeros((size, size), bool)
        inner[1:-1, 1:-1] = True
        top = (x > around.max(0)) & inner
        out = []
        for v, r, t in zip(x, raw, top):
            if not np.isfinite(v).any():
                out.append((None, None, None, None))
                continue
            k = int(np.where(t, v, -np.inf).argmax()) if t.any() else int(v.argmax())
            out.append((k // size, k % size, float(r.flat[k]), bool(t.any())))
        return pd.DataFrame(out, columns=["i", "j", "value", "local"]).astype({"i": "Int32", "j": "Int32"})

    return m.withColumn("p", F.pandas_udf(run, "i int, j int, value double, local boolean")("map")).select(*STEP, "p.*")


def window_stats(df: DataFrame, c: str, *by: str) -> DataFrame:
    """n, missing share, min, max, mean and population deviation over finite cells."""
    v = finite(F.col(c))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v.isNull().cast("double")).alias("missing"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def plausible(s: DataFrame, low: float, high: float, most_missing: float) -> DataFrame:
    """``window_stats`` with flags and status: ok, qc_flagged or invalid_all_nan."""
    flags = reasons(below_range=F.col("lo") < low, above_range=F.col("hi") > high, many_missing=F.col("missing") > most_missing)
    return s.withColumn("flags", flags).withColumn("status", F.when(F.col("mean").isNull(), "invalid_all_nan").when(F.size("flags") > 0, "qc_flagged").otherwise("ok"))


def preferred(df: DataFrame, by: str, column: str, order: tuple[str, ...]) -> DataFrame:
    """One row per ``by``: the first source of a fixed order that is there."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    d = df.where(F.col(column).isin(*order)).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(rank)))
    return d.where("_r = 1").drop("_r")


def filled(df: DataFrame, c: str, least: float = 0.5) -> DataFrame:
    """Cells of patches with a finite share of at least ``least``, gaps filled with the patch's mean; and ``kept`` for all."""
    v, w = finite(F.col(c)), Window.partitionBy(*STEP)
    share = F.avg(v.isNotNull().cast("double")).over(w)
    return df.withColumn("kept", share >= least).withColumn(c, F.when(share >= least, F.coalesce(v, F.avg(v).over(w))))


def masked(df: DataFrame, mask: str, channels: list[str], factor: float) -> DataFrame:
    """Channels scaled down by ``factor`` where the mask is 1."""
    return df.withColumns({c: F.when(F.col(mask) == 1, F.col(c) * (1 - factor)).otherwise(F.col(c)) for c in channels})


def lag_features(df: DataFrame, lags: dict[int, str], **features: Column) -> DataFrame:
    """One row per event: each feature aggregated over the patch at each time step, as feature_lag columns."""
    d = df.groupBy(*STEP).agg(*[c.alias(n) for n, c in features.items()])
    return d.groupBy("event_id").agg(*[F.max(F.when(F.col("t_idx") == t, F.col(n))).alias(f"{n}_{name}") for n in features for t, name in lags.items()])


def displacement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance and bearing from the places of ``a`` to those of ``b`` (both STEP, lat, lon)."""
    d = a.alias("a").join(b.alias("b"), list(STEP))
    at = [F.col(c) for c in ("a.lat", "a.lon", "b.lat", "b.lon")]
    return d.select(*STEP, stats.haversine_km(*at).alias("km"), stats.bearing_deg(*at).alias("bearing"))


def extreme_bearings(df: DataFrame, lat: float, lon: float, extremes: dict[str, tuple[str, bool]]) -> DataFrame:
    """STEP and, for each name, the bearing from a centre to the highest (or, if told so, lowest) cell of a channel; null where that is the centre."""
    out = df.select(*STEP).distinct()
    for name, (channel, lowest) in extremes.items():
        p = grid.peak(df.withColumn("_x", -F.col(channel) if lowest else F.col(channel)), "_x")
        away = (F.abs(F.col("lat") - lat) >= 1e-6) | (F.abs(F.col("lon") - lon) >= 1e-6)
        p = p.select(*STEP, F.when(away, stats.bearing_deg(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).alias(name))
        out = out.join(p, list(STEP), "left")
    return out
