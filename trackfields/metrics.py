"""Scores against labels: ranks, curves, thresholds and calibration.

Everything that needs cumulative counts starts from one table per distinct score, with running sums in two passes
(``stats.cumulative``), so no window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .clean import finite

def curve(df: DataFrame, score: str = "score", label: str = "y", *by: str) -> DataFrame:
    """Per group and distinct score, from the highest: pos, neg, and tp, fp at the threshold score >= t; totals as p, n.

    Rows without a finite score or a label take no part.
    """
    d = df.withColumn("t", finite(F.col(score))).where(F.col("t").isNotNull() & F.col(label).isNotNull())
    d = d.groupBy(*by, "t").agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    return _totalled(d, *by)


def weighted_curve(df: DataFrame, weight: str, score: str, label: str, *by: str) -> DataFrame:
    """As ``curve``, with a weight for each row."""
    d = df.groupBy(*by, F.col(score).alias("t")).agg(F.sum(F.col(label) * F.col(weight)).alias("pos"), F.sum((1 - F.col(label)) * F.col(weight)).alias("neg"))
    return _totalled(d, *by)


def _totalled(d: DataFrame, *by: str) -> DataFrame:
    d = stats.cumulative(d, "t", ["pos", "neg"], *by, descending=True)
    return d.select(*by, "t", "pos", "neg", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"), F.col("pos_total").alias("p"), F.col("neg_total").alias("n"))


def roc_auc(c: DataFrame) -> DataFrame:
    """Area by ranks; tied scores count half."""
    won = F.sum(F.col("pos") * ((F.col("n") - F.col("fp")) + F.col("neg") / 2))
    return c.agg((won / (F.max("p") * F.max("n"))).alias("roc_auc"))


def average_precision(c: DataFrame) -> DataFrame:
    return c.agg(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr_auc"))


def points(c: DataFrame) -> DataFrame:
    """Threshold, precision, recall, false positive rate, alerts per 100, F1."""
    tp, fp = F.col("tp"), F.col("fp")
    precision, recall = tp / (tp + fp), tp / F.nullif(F.col("p"), F.lit(0))
    return c.select(
        "t", precision.alias("precision"), recall.alias("recall"), (fp / F.nullif(F.col("n"), F.lit(0))).alias("fpr"),
        (100 * (tp + fp) / (F.col("p") + F.col("n"))).alias("alerts"), F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)).alias("f1"),
    )


def threshold_for_recall(c: DataFrame, recall: float, fallback: float = 0.5) -> DataFrame:
    """The most precise threshold with at least that recall; the lowest on ties; the fallback without one."""
    p = points(c).where(F.col("recall") >= recall)
    best = p.agg(F.min_by(F.struct("t", "precision", "recall"), F.struct(-F.col("precision"), "t")).alias("b"))
    return best.select(F.coalesce("b.t", F.lit(fallback)).alias("threshold"), F.coalesce("b.precision", F.lit(0.0)).alias("precision"), F.coalesce("b.recall", F.lit(0.0)).alias("recall"))


def threshold_for_f1(c: DataFrame, fallback: float = 0.5) -> DataFrame:
    best = points(c).agg(F.min_by(F.struct("t", "f1"), F.struct(-F.col("f1"), "t")).alias("b"))
    return best.select(F.coalesce("b.t", F.lit(fallback)).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def operating_points(c: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """For each recall target the threshold whose recall is nearest, the higher recall's lower threshold on ties."""
    wanted = [F.min_by(F.struct("t", "precision", "recall", "fpr", "alerts"), F.struct(F.abs(F.col("recall") - r), "t")).alias(f"r{i}") for i, r in enumerate(targets)]
    one = points(c).agg(*wanted)
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("target"), F.col(f"r{i}").alias("at")) for i, r in enumerate(targets)]))
    return one.select(rows.alias("x")).select("x.target", "x.at.*")


def brier(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


def at_threshold(df: DataFrame, t: float, score: str = "score", label: str = "y") -> DataFrame:
    hit, y = F.col(score) >= t, F.col(label) == 1
    d = df.agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("tp", hit & y), ("fp", hit & ~y), ("fn", ~hit & y), ("tn", ~hit & ~y))])
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return d.select("tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def fixed_bin(p: Column, bins: int = 10) -> Column:
    """0-based bin of equal width; edges are compared as numbers, the last bin is closed."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: p >= e))


def reliability(df: DataFrame, bins: int = 10, score: str = "score", label: str = "y") -> DataFrame:
    """bin, n, mean score, observed rate."""
    return df.groupBy(fixed_bin(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def quantile_reliability(df: DataFrame, bins: int = 10, merge_low: bool = True, score: str = "score", label: str = "y") -> DataFrame:
    """As ``reliability`` over quantile bins. ``merge_low`` joins the two lowest bins, as published tables do."""
    q = stats.quantiles(df, score, {f"e{i}": i / bins for i in range(1, bins)})
    edges = q.select(F.array(*[f"e{i}" for i in range(1, bins)]).alias("e"))
    above = F.size(F.filter(F.col("e"), lambda e: F.col(score) >= e))
    which = F.greatest(above - 1, F.lit(0)) if merge_low else above
    d = df.crossJoin(F.broadcast(edges))  # one row
    return d.groupBy(which.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def calibration_errors(table: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_score") - F.col("rate"))
    return table.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier_parts(df: DataFrame, bins: int = 10, score: str = "score", label: str = "y") -> DataFrame:
    """Reliability, resolution, uncertainty, and variance and covariance within the bins."""
    s, y = F.col(score), F.col(label).cast("double")
    b = df.groupBy(fixed_bin(s, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(s).alias("f"), F.avg(y).alias("o"), F.var_pop(s).alias("v"), F.covar_pop(s, y).alias("c"))
    total = b.agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("o")) / F.sum("n")).alias("m"))
    b = b.crossJoin(F.broadcast(total))  # one row
    part = lambda e, name: F.sum(F.col("n") / F.col("all") * e).alias(name)
    return b.agg(
        part((F.col("f") - F.col("o")) * (F.col("f") - F.col("o")), "rel"), part((F.col("o") - F.col("m")) * (F.col("o") - F.col("m")), "res"),
        F.max(F.col("m") * (1 - F.col("m"))).alias("unc"), part(F.col("v"), "wbv"), part(2 * F.col("c"), "wbc"),
    )


def score_summary(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    q = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    plain = df.groupBy(label).agg(F.count("*").alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    return stats.with_group(plain, stats.quantiles(df, score, {f"q{int(x * 100)}": x for x in q}, label), label)


def auc_by(df: DataFrame, *by: str, score: str = "score", label: str = "y") -> DataFrame:
    """ROC-AUC and average precision per group; null for a group of one class."""
    return areas(curve(df, score, label, *by), *by)


def areas(c: DataFrame, *by: str) -> DataFrame:
    won = F.sum(F.col("pos") * ((F.col("n") - F.col("fp")) + F.col("neg") / 2)) / F.nullif(F.max("p") * F.max("n"), F.lit(0))
    return c.groupBy(*by).agg(won.alias("roc_auc"), F.sum(F.col("pos") / F.nullif(F.col("p"), F.lit(0)) * F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("pr_auc"))


def arms_by_fold(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row from (fold, arm, y, score): folds with both classes, folds that arm ``a`` wins, mean and sample deviation of the AUC difference."""
    d = auc_by(df.where(F.col("arm").isin(a, b)), "fold", "arm").groupBy("fold").agg(*[F.max(F.when(F.col("arm") == x, F.col("roc_auc"))).alias(f"_{n}") for n, x in (("a", a), ("b", b))])
    gap = F.col("_a") - F.col("_b")
    return d.agg(F.count(gap).alias("folds"), F.sum((gap > 0).cast("long")).alias("won"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("sd"))


def core(df: DataFrame, threshold: float) -> DataFrame:
    """One row: areas, Brier score, precision, recall and F1 at the threshold, calibration errors."""
    parts = [areas(curve(df)), brier(df), at_threshold(df, threshold).select("precision", "recall", "f1"), calibration_errors(reliability(df))]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out
