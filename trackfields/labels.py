"""Change labels over tracks: exact-time and positional deltas, three-state labels, and audits of label versions.

Windows are partitioned by sid, so one exchange serves all of a storm's deltas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .clean import epoch_s

HOUR = 3600


def _track(sid: str = "sid") -> Window:
    return Window.partitionBy(sid).orderBy("_s")


def _first_at(h: int, value: str, order: str | None) -> Column:
    """The value h hours on: of several fixes at that instant the first by ``order``, whether or not it has a value; without an order the least value."""
    frame = _track().rangeBetween(h * HOUR, h * HOUR)
    return F.min(value).over(frame) if order is None else F.min(F.struct(F.col(order).alias("_o"), F.col(value).alias("_v"))).over(frame)["_v"]


def strict_deltas(df: DataFrame, hours: tuple[int, ...] = (12, 24), value: str = "wind_kt", ts: str = "ts", order: str | None = None) -> DataFrame:
    """dv{h}: the value exactly h hours later in the same storm minus the value now; null where there is no such fix.

    A range frame of one instant finds the partner in the same exchange for every lag. ``order`` is the column of the fixes' order at
    the source, by which the first of several fixes at that instant is the partner, without a value too; tracks with one fix an instant need none.
    """
    out = df.withColumn("_s", epoch_s(F.col(ts)))
    for h in hours:
        partner = _first_at(h, value, order)
        out = out.withColumn(f"dv{h}", partner - F.col(value))
    return out.drop("_s")


def three_state(dv: Column, threshold: float = 30.0) -> Column:
    """1 at the threshold or above, 0 below, null without a delta."""
    return F.when(dv.isNull(), None).when(dv >= threshold, 1).otherwise(0)


def positional_deltas(df: DataFrame, steps: dict[str, int], order: list, value: str = "wind_kt") -> DataFrame:
    """name: the value so many rows later minus the value now."""
    w = Window.partitionBy("sid").orderBy(*order)
    return df.withColumns({n: F.lead(value, k).over(w) - F.col(value) for n, k in steps.items()})


def misaligned(step: int, hours: int, order: list, ts: str = "ts") -> Column:
    """Whether the row so many steps later is not exactly so many hours later."""
    w = Window.partitionBy("sid").orderBy(*order)
    return F.coalesce(F.lead(epoch_s(F.col(ts)), step).over(w) - epoch_s(F.col(ts)) != hours * HOUR, F.lit(False))


def past_change(df: DataFrame, low: int, high: int, name: str, value: str = "wind_kt", ts: str = "ts") -> DataFrame:
    """Change since the latest fix between ``low`` and ``high`` hours before; 0 and a flag where there is none or it has no value."""
    out = df.withColumn("_s", epoch_s(F.col(ts)))
    frame = _track().rangeBetween(-high * HOUR, -low * HOUR)
    then = F.max(F.struct("_s", value)).over(frame)[value]
    change = F.col(value) - then
    return out.withColumns({name: F.coalesce(change, F.lit(0.0)), f"{name}_missing": change.isNull().cast("int")}).drop("_s")


def onset(label: str = "label", order: str = "ts") -> Column:
    """Label 1 where the storm's previous label is 0, null or absent."""
    w = Window.partitionBy("sid").orderBy(order)
    return (F.col(label) == 1) & (F.coalesce(F.lag(label).over(w), F.lit(0)) == 0)


def lagged(df: DataFrame, lags: tuple[int, ...], value: str = "wind_kt", ts: str = "ts", order: str | None = None) -> DataFrame:
    """A row per lag in hours with the value at ts + lag, null where there is no fix; ``order`` as in ``strict_deltas``."""
    out = df.withColumn("_s", epoch_s(F.col(ts)))
    cols = [F.struct(F.lit(h).alias("lag_h"), _first_at(h, value, order).alias("then")) for h in lags]
    return out.withColumn("_l", F.array(*cols)).withColumn("_l", F.explode("_l")).select(*df.columns, "_l.lag_h", "_l.then")


def transitions(df: DataFrame, old: str, new: str, *by: str) -> DataFrame:
    """Counts of (old, new) label pairs, nulls as the state ``undefined``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("undefined")).alias(c)
    return df.groupBy(*by, name(old), name(new)).count()


def reason(old: Column, new: Column, *deltas: tuple[Column, Column], tolerance: float = 1e-9) -> Column:
    """Why a label version differs from another: flip before null before drift before unchanged. The names are fixed values.

    ``deltas`` are (old, new) pairs, such as of 24 and of 12 hours: a pair drifts where both differ or the new one is null.
    """
    flip = F.when((old == 1) & (new == 0), "flip_1_to_0").when((old == 0) & (new == 1), "flip_0_to_1")
    null = F.when(new.isNull() & old.isNotNull(), "null_no_partner")
    moved = [~a.eqNullSafe(b) & (F.abs(F.coalesce(a - b, F.lit(1.0))) > tolerance) for a, b in deltas]
    drift = F.when(reduce(lambda x, y: x | y, moved), "dv_drift")
    return F.coalesce(flip, null, drift, F.lit("unchanged"))


def change_effects(df: DataFrame, old: str, new: str, old_dv: str, new_dv: str, *by: str) -> DataFrame:
    """effect (flip, undefined, drift, none), n, and min, median, p95 and max of the absolute change of the delta, per group.

    The three effects of a label version: another label, no label any more, or the same label from another change.
    """
    o, n, change = F.col(old), F.col(new), F.abs(F.col(new_dv) - F.col(old_dv))
    effect = F.when(o.isNotNull() & n.isNull(), "undefined").when(~o.eqNullSafe(n), "flip").when(change > 1e-9, "drift").otherwise("none")
    d = df.select(*by, effect.alias("effect"), change.alias("change"))
    keys = [*by, "effect"]
    q = stats.quantiles(d, "change", {"median": 0.5, "p95": 0.95}, *keys)
    plain = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("change").alias("lo"), F.max("change").alias("hi"))
    return plain.join(q, keys, "left") if not by else plain.join(q.select(*[F.col(k).alias(f"_{k}") for k in keys], "median", "p95"), reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").drop(*[f"_{k}" for k in keys])


def version_counts(df: DataFrame, old: str, new: str, *by: str) -> DataFrame:
    """Flips both ways, changes to null, positives before and after."""
    o, n = F.col(old), F.col(new)
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return df.groupBy(*by).agg(
        count((o == 1) & (n == 0), "flip_1_to_0"), count((o == 0) & (n == 1), "flip_0_to_1"), count(o.isNotNull() & n.isNull(), "to_null"),
        count((o == 1) & n.isNull(), "positive_to_null"), count(o == 1, "positive_before"), count(n == 1, "positive_after"),
    )


def lost_positives(df: DataFrame, old: str, new: str) -> DataFrame:
    """Storms whose positives all vanish between the versions."""
    s = df.groupBy("sid").agg(F.sum(F.coalesce(F.col(old), F.lit(0))).alias("before"), F.sum(F.coalesce(F.col(new), F.lit(0))).alias("after"))
    return s.where("before > 0 and after = 0")
