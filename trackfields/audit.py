"""Audits: applying and proving label patches, eligibility with reasons, alignment of tables, censuses and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sources, stats
from .clean import finite
from .splits import assign


def applied(df: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` taken from ``new`` where its keys are there (nulls too), and ``changed``."""
    n = new.select(*keys, F.struct(*columns).alias("_new"))
    d = df.join(n, keys, "left")
    here = F.col("_new").isNotNull()
    changed = here & ~F.struct(*columns).eqNullSafe(F.col("_new"))
    return d.withColumn("changed", changed.cast("int")).withColumns({c: F.when(here, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}).drop("_new")


def differing_rows(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(lost, gained): rows of ``before`` that ``after`` lacks in these columns, and the other way round; 0, 0 proves them equal."""
    a, b = (d.groupBy(*columns).count() for d in (before, after))
    both = a.alias("a").join(b.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns], "full")
    n = F.coalesce("a.count", F.lit(0)) - F.coalesce("b.count", F.lit(0))
    return both.agg(F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.greatest(-n, F.lit(0))), F.lit(0)).alias("gained"))


def repaired(df: DataFrame, fixes: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column`` from ``fixes`` by key, and ``outcome``: unchanged, updated or unmatched."""
    d = df.join(fixes.select(key, F.col(column).alias("_fixed"), F.lit(True).alias("_here")), key, "left")
    outcome = F.when(F.col("_here").isNull(), "unmatched").when(F.col("_fixed").eqNullSafe(F.col(column)), "unchanged").otherwise("updated")
    return d.withColumn("outcome", outcome).withColumn(column, F.when(F.col("_here"), F.col("_fixed")).otherwise(F.col(column))).drop("_fixed", "_here")


def alignment(predictions: DataFrame, truth: DataFrame, key: str, label: str) -> DataFrame:
    """One row: predictions, keys predicted more than once, keys without truth, labels that differ."""
    p = predictions.groupBy(key).agg(F.count("*").alias("times"), F.min(label).alias("p"))
    d = p.join(truth.select(key, F.col(label).alias("t"), F.lit(1).alias("known")), key, "left")
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return d.agg(F.sum("times").alias("n"), n(F.col("times") > 1, "duplicated"), n(F.col("known").isNull(), "unmatched"), n(F.col("known").isNotNull() & ~F.col("p").eqNullSafe(F.col("t")), "mismatched"))


def arms_aligned(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per seed, of two arms' rows (arm, seed, event_id, y): events of one arm only, labels that differ, and whether they can be compared."""
    side = lambda name: df.where(F.col("arm") == name).select("seed", "event_id", F.col("y").alias(name), F.lit(1).alias(f"in_{name}"))
    d = side(a).join(side(b), ["seed", "event_id"], "full")
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    out = d.groupBy("seed").agg(n(F.col(f"in_{b}").isNull(), "only_a"), n(F.col(f"in_{a}").isNull(), "only_b"), n((F.col(f"in_{a}") + F.col(f"in_{b}") == 2) & ~F.col(a).eqNullSafe(F.col(b)), "labels_differ"))
    out = out.fillna(0)
    return out.withColumn("usable", (F.col("only_a") + F.col("only_b") + F.col("labels_differ") == 0).cast("int"))


def _numbered(d: DataFrame, seed: int, *by: str) -> DataFrame:
    """``d`` (id, value) with _k, from 1 in each group in the order of value, hash and id, and _m, the group's rows.

    Two passes: counts per value and leading digits of the hash, and places within them, so no task holds a group, be it of one value.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id")))
    d = d.withColumns({"_h": h, "_salt": F.substring(h, 1, 2)})
    counts = d.groupBy(*by, "value", "_salt").agg(F.count("*").alias("_n"))
    values = stats.cumulative(counts.groupBy(*by, "value").agg(F.sum("_n").alias("_c")), "value", ["_c"], *by)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "value").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 256 rows
    places = stats.with_group(counts.withColumn("_b", before), values, *by, "value").select(*by, "value", "_salt", (F.col("_b") + F.col("_c_before")).alias("_b"), F.col("_c_total").alias("_m"))
    own = F.row_number().over(Window.partitionBy(*by, "value", "_salt").orderBy("_h", "id"))
    return stats.with_group(d, places, *by, "value", "_salt").withColumn("_k", F.col("_b") + own).drop("_h", "_salt", "_b")


def _paired(cases: DataFrame, controls: DataFrame, width: float, seed: int, side: int, *by: str) -> DataFrame:
    """(case_id, control_id) of cases with controls of the same block of values (side 0), or of the next one above or below.

    Within a block of one width any two match, and equal places are paired. Across an edge the cases nearest to it are paired with the
    controls nearest to it, place by place, as long as they are within the width: beyond the first pair that is not, none is.
    """
    block = F.floor(F.col("value") / width)
    a, b = cases.withColumn("_block", block), controls.withColumn("_block", block - side)
    value = "value"
    if side == 0:
        a, b = (d.withColumn("_value", F.col("value")).withColumn("value", F.lit(0.0)) for d in (a, b))
        value = "_value"
    keys = [*by, "_block"]
    a, b = _numbered(a, seed, *keys), _numbered(b, seed, *keys)
    place = lambda far: F.col("_m") - F.col("_k") + 1 if far else F.col("_k")
    a = a.select(*keys, place(side > 0).alias("_p"), F.col("id").alias("case_id"), F.col(value).alias("_a"))
    b = b.select(*keys, place(side < 0).alias("_p"), F.col("id").alias("control_id"), F.col(value).alias("_b"))
    return a.join(b, [*keys, "_p"]).where(F.abs(F.col("_a") - F.col("_b")) <= width).select("case_id", "control_id")


def matched_controls(cases: DataFrame, controls: DataFrame, band: float, seed: int = 0) -> DataFrame:
    """(case_id, control_id, pass): 1:1 controls without replacement, of a ``value`` within the band.

    Cases and controls (id, basin, value): first within a basin, then over all, at last within one and a half bands. In each pass the
    values are cut into blocks of one width; a control within the width lies in the case's block or in one beside it, and each of the three
    is paired to the end, so after a pass no case has a free control within its width. Ids are unique; rows without a value take no part.
    """
    cases, controls = (d.where(F.col("value").isNotNull()).select("id", "basin", F.col("value").cast("double").alias("value")) for d in (cases, controls))
    out = []
    for k, (width, by) in enumerate(((band, ["basin"]), (band, []), (1.5 * band, []))):
        for side in (0, 1, -1):
            got = sources.saved(_paired(cases, controls, width, seed, side, *by), "matched").withColumn("pass", F.lit(k + 1))
            out.append(got)
            cases = cases.join(got.select(F.col("case_id").alias("id")), "id", "left_anti")
            controls = controls.join(got.select(F.col("control_id").alias("id")), "id", "left_anti")
        if k < 2:
            cases, controls = sources.saved(cases, "cases"), sources.saved(controls, "controls")
    return reduce(DataFrame.unionByName, out)


def split_audit(df: DataFrame, frozen: DataFrame) -> DataFrame:
    """One row over (sid, split): storms in several splits, frozen ones moved, storms not where their hash puts them, share in place."""
    s = df.groupBy("sid").agg(F.count_distinct("split").alias("n"), F.min("split").alias("split")).join(frozen.select("sid", F.col("split").alias("frozen")), "sid", "left")
    in_place = (F.col("split") == F.coalesce("frozen", assign(F.col("sid")))).cast("long")
    n = lambda c, name: F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias(name)
    return s.agg(F.count("*").alias("storms"), n(F.col("n") > 1, "several"), n(F.col("frozen") != F.col("split"), "frozen_moved"), n(in_place == 0, "misplaced"), F.avg(in_place).alias("agreement"))


def reasons(**tests: Column) -> Column:
    """The names of the tests that hold, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()])))


def reason_counts(df: DataFrame, column: str = "reasons") -> DataFrame:
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def artifact_status(expected: DataFrame, found: DataFrame, key: str, valid: Column) -> DataFrame:
    """``expected`` with status: extracted, invalid or not_extracted."""
    d = expected.join(found.withColumn("_valid", valid).withColumn("_found", F.lit(True)).select(key, "_valid", "_found"), key, "left")
    return d.withColumn("status", F.when(F.col("_found").isNull(), "not_extracted").when(F.col("_valid"), "extracted").otherwise("invalid")).drop("_valid", "_found")


def compared_values(stored: DataFrame, again: DataFrame, keys: list[str], column: str, tolerance: float) -> DataFrame:
    """keys, status: equal (within the tolerance, or both null), differs, not_stored, not_recomputed. Null is a key like others."""
    a = stored.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.col(column).cast("double").alias("_a"), F.lit(1).alias("_x"))
    b = again.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col(column).cast("double").alias("_b"), F.lit(1).alias("_y"))
    same = F.col("_a").eqNullSafe(F.col("_b")) | F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False))
    status = F.when(F.col("_x").isNull(), "not_stored").when(F.col("_y").isNull(), "not_recomputed").when(same, "equal").otherwise("differs")
    on = reduce(lambda x, y: x & y, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    return a.join(b, on, "full").select(*[F.when(F.col("_x").isNull(), F.col(f"_b_{k}")).otherwise(F.col(f"_a_{k}")).alias(k) for k in keys], status.alias("status"))


def gate(stored: DataFrame, again: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """(column, status, n, first): how many cells of each column agree with what is computed anew, and the least key of each status.

    The two tables may have any rows; a cell that only one of them has counts as not stored or not recomputed.
    """
    long = lambda d: d.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "column", "value")
    d = compared_values(long(stored), long(again), [*keys, "column"], "value", tolerance)
    return d.groupBy("column", "status").agg(F.count("*").alias("n"), F.min(F.concat_ws(":", *keys)).alias("first"))


def statistics(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """by, column, n, mean, sd (population): over finite values."""
    d = df.select(*by, *[finite(F.col(c).cast("double")).alias(c) for c in columns]).unpivot(list(by), columns, "column", "x")
    return d.groupBy(*by, "column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def counted(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """``df``, one row of counts; a row that differs from ``expected`` is an error that says where."""
    wrong = F.concat_ws(", ", *[F.when(F.col(c) != n, F.concat(F.lit(f"{c}: "), F.col(c).cast("string"), F.lit(f" instead of {n}"))) for c, n in expected.items()])
    return df.withColumn("checked", F.when(wrong == "", F.lit(1)).otherwise(F.raise_error(wrong)))


def census(df: DataFrame, flag: str, *dimensions: str) -> DataFrame:
    """(dimension, value, n, flagged) for each dimension by itself, in one pass over the rows."""
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return df.withColumn("_d", F.explode(parts)).groupBy("_d.dimension", "_d.value").agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("flagged"))


def first_of_each(df: DataFrame, by: str, order: list, n: int = 20) -> DataFrame:
    """The first ``n`` rows of each category."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def feature_sets(columns: list[str], prefixes: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """Columns by set of prefixes; a column that carries a future change is an error."""
    if leaks := [c for c in columns if "dv12" in c or "dv24" in c]:
        raise ValueError(f"features would leak the label: {', '.join(leaks)}")
    return {name: [c for c in columns if c.startswith(p)] for name, p in prefixes.items()}
