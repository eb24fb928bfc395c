"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule: its sampling weight as a piecewise linear function of training progress u in [0, 1]. The
integral of that weight, scaled to the source's target, is the number of words that training has asked of the source by
u. A copy of a document that covers words [c, c + size) of its source's stream stands at the u at which the demand reaches
the middle of that stretch, found by inverting the integral (a square root within a segment). Copies are range-sorted by u.

The stream of a source runs over all its documents in the order of a hash of the id, again and again, until the
target is met. The running sum is made of sums over buckets of the hash, so no source needs to fit one task.

Edge cases: null texts have size 0; documents of size 0 take no words and stand where their stream position is; a null
source is a source; an empty table gives an empty mix; repeated ids are ordered by text hash and rows equal in id, source and
text are separate documents of the stream; extra columns pass through ``mix``, except ``copy`` and ``position``, which are
replaced. A target of 0 takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, saved, words_count

#: Weights by the rank of a source's name, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words to take, and how often a source may be used at most.
SHARE, MOST = 1.5, 2
#: How a weight changes from the start to the end of training, by the same ranks; the mean is 1, so totals are kept.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Buckets of the hash, per source, for the running sums.
BUCKETS = 256


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): shares by weight, filled up to MOST times the size.

    The sources are taken from the one that reaches its limit first on; each lowers what is left for the others.
    Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    s = sizes.select("source", "source_size").withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * MOST)
    full = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole))
    level = (F.lit(SHARE) * F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    # The level at which a source would stand if all before it were full; the first that stays below its limit sets it.
    s = s.withColumn("level", level).withColumn("stays", F.col("level") * F.col("weight") <= F.col("limit"))
    s = s.withColumn("final", F.min(F.when(F.col("stays"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)["level"])
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("limit").cast("double")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def progress(share: Column, knots: Column) -> Column:
    """The u at which the integral of a schedule reaches ``share`` (0 to 1) of its whole.

    ``knots``: array of (u, weight) by u, from 0 to 1. Integrates segment by segment, then solves the one that holds the share.
    """
    segments = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.element_at(knots, i)["u"].alias("u"),
            (F.element_at(knots, i + 1)["u"] - F.element_at(knots, i)["u"]).alias("du"),
            F.element_at(knots, i)["weight"].alias("w"),
            (F.element_at(knots, i + 1)["weight"] - F.element_at(knots, i)["weight"]).alias("dw"),
        ),
    )
    area = lambda s: s["du"] * (s["w"] + s["dw"] / 2)
    whole = F.aggregate(segments, F.lit(0.0), lambda a, s: a + area(s))

    def step(a: Column, s: Column) -> Column:
        left = F.greatest(a["left"], F.lit(0.0))
        # w t + dw/2 t^2 = left / du with t in [0, 1]; written so that dw = 0 needs no case of its own.
        y = left / F.nullif(s["du"], F.lit(0.0))
        t = F.coalesce(2 * y / F.nullif(s["w"] + F.sqrt(F.greatest(s["w"] * s["w"] + 2 * s["dw"] * y, F.lit(0.0))), F.lit(0.0)), F.lit(0.0))
        here = a["u"].isNull() & (left <= area(s))
        u = F.when(here, s["u"] + s["du"] * F.least(t, F.lit(1.0))).otherwise(a["u"])
        return F.struct((a["left"] - area(s)).cast("double").alias("left"), u.cast("double").alias("u"))

    start = F.struct((share * whole).cast("double").alias("left"), F.lit(None).cast("double").alias("u"))
    return F.coalesce(F.aggregate(segments, start, step)["u"], F.lit(1.0))


def default_schedule(weight: Column) -> Column:
    """Knots for a source of the given weight: the heaviest sources fade, the lightest grow."""
    ramp = F.lit(None)
    for w, (a, b) in zip(WEIGHTS, RAMPS):
        knots = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(w) * x).alias("weight")) for u, x in ((0, a), (1, b))])
        ramp = F.when(weight == w, knots).otherwise(ramp)
    return ramp


def plan(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", schedule=default_schedule) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken and ``positions``, the u of each copy.

    A source is read whole as often as its target allows; what is left goes to the documents whose middle lies
    within it, so a source's words come to its target up to half a document.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_text"))
    d = d.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    d = d.withColumn("_bucket", F.conv(F.substring("_order", 1, 2), 16, 10).cast("int") % BUCKETS)
    d = saved(d, "mix-sizes")  # texts are read once; two steps need their sizes
    sums = d.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    per_source = Window.partitionBy("source")
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(per_source.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goals = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    # One row per source and bucket: BUCKETS times the number of sources, joined by both so that no source is one task's.
    small = sums.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("_source"), F.col("a._bucket").alias("_b"), "_before", "source_size", "weight", "target"
    )
    d = d.join(small, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    run = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.col("_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    d = d.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    left = F.col("target") - F.col("_whole") * F.col("source_size")
    more = ((left > 0) & (F.col("start") + F.col("size") / 2 <= left)).cast("int")
    d = d.withColumn("copies", F.when(F.col("target") > 0, F.col("_whole") + more).otherwise(F.lit(0)))
    middle = F.col("start") + F.col("size") / 2
    positions = F.transform(
        F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.expr("cast(array() as array<int>)")),
        lambda k: progress(F.least((middle + k * F.col("source_size")) / F.col("target"), F.lit(1.0)), schedule(F.col("weight"))),
    )
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), positions.alias("positions"), "start", "_text")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", schedule=default_schedule) -> DataFrame:
    """The columns of ``docs``, a row per copy that the mix takes, with ``copy`` and ``position``, range-sorted by position.

    The plan is joined back by id, source and text; rows equal in all three are numbered on both sides, so each gets the copies
    that the plan gives one of them. Columns called ``copy`` or ``position`` are replaced.
    """
    docs = docs.drop("copy", "position")
    k, src, digest, nth = free(docs, "mix_key", "mix_source", "mix_text", "mix_nth")
    where = plan(docs, text, key, source, schedule).select(F.col("doc_id").alias(k), F.col("source").alias(src), F.col("_text").alias(digest), "start", "positions")
    where = where.withColumn(nth, F.row_number().over(Window.partitionBy(k, digest, src).orderBy("start"))).where(F.size("positions") > 0).drop("start")
    d = docs.withColumn(digest, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    d = d.withColumn(nth, F.row_number().over(Window.partitionBy(key, digest, source).orderBy(F.hash(*docs.columns))))
    here = d.select(*docs.columns, F.col(digest).alias(f"{digest}_own"), F.col(nth).alias(f"{nth}_own"))
    on = here[key].eqNullSafe(where[k]) & (here[f"{digest}_own"] == where[digest]) & here[source].eqNullSafe(where[src]) & (here[f"{nth}_own"] == where[nth])
    out = here.join(where, on).select(*[here[c] for c in docs.columns], F.posexplode("positions").alias("copy", "position"))
    return out.orderBy("position", key, "copy")
