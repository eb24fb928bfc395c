"""Tails against tables, running sums by ranges, and rank and mean tests against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackfields import stats, tails


def test_student_and_normal_tails_equal_tabulated_values(spark):
    # Two-sided 5 % and 1 % points of Student's t, and one-sided tails of the normal distribution.
    points = [(12.7062047362, 1, 0.05), (63.6567411629, 1, 0.01), (4.3026527297, 2, 0.05), (2.2281388520, 10, 0.05), (3.1692726726, 10, 0.01), (2.0422724563, 30, 0.05), (1.9839715185, 100, 0.05), (1.9623390808, 1000, 0.05), (1.96, 10**12, 0.0499957902964), (0.0, 5, 1.0), (1.0, 1, 0.5)]
    d = spark.createDataFrame(points, "t double, v long, p double")
    for r in d.withColumn("got", tails.student_two_sided(d.t, d.v)).collect():
        assert r.got == pytest.approx(r.p, rel=1e-7), r
    z = [(0.0, 0.5), (1.0, 0.15865525393145707), (-1.0, 0.8413447460685429), (1.959963984540054, 0.025), (3.0, 0.0013498980316300933), (3.6, 0.00015910859015753364), (6.0, 9.865876450376946e-10), (10.0, 7.61985302416047e-24)]
    d = spark.createDataFrame(z, "z double, p double")
    assert all(r.got == pytest.approx(r.p, rel=1e-10) for r in d.withColumn("got", tails.normal_tail(d.z)).collect())
    none = spark.createDataFrame([(None, 3), (1.0, 0), (1.0, None)], "t double, v long")
    assert {r[0] for r in none.select(tails.student_two_sided(none.t, none.v)).collect()} == {None}
    assert spark.range(1).select(tails.log_gamma(F.lit(0.5))).head()[0] == pytest.approx(math.lgamma(0.5), abs=1e-9)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_by_ranges_of_each_group(spark, monkeypatch, descending):
    monkeypatch.setattr(stats, "ROWS", 50)
    monkeypatch.setattr(stats, "QUANTILES", 64)
    rng = np.random.default_rng(1)
    narrow = 0.5 + np.arange(2000) * 1e-9  # a group in a single narrow span, beside one that is wide
    rows = [("n", float(x), 1) for x in narrow] + [("w", float(x), int(k)) for x, k in zip(np.unique(rng.normal(size=700) * 1e6), rng.integers(1, 5, 700))]
    rows += [(None, float(x), 2) for x in range(130)] + [("one", 1.0, 3)]
    d = spark.createDataFrame(rows, "g string, t double, n int")
    got = stats.cumulative(d, "t", ["n"], "g", descending=descending).collect()
    assert len(got) == len(rows)
    for g in ("n", "w", None, "one"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: -r.t if descending else r.t)
        assert [r.n_before for r in mine] == np.cumsum([0, *[r.n for r in mine]]).tolist()[:-1] and {r.n_total for r in mine} == {sum(r.n for r in mine)}
    # No range holds more than twice its share.
    seen = []
    monkeypatch.setattr(stats, "with_group", lambda a, b, *by, f=stats.with_group: seen.append(a) or f(a, b, *by))
    stats.cumulative(d, "t", ["n"], "g")
    assert max(r["count"] for r in seen[1].groupBy("g", "_range").count().collect()) <= 2 * stats.ROWS
    assert stats.cumulative(d.limit(0), "t", ["n"]).collect() == [] and stats.cumulative(d, "t", ["n"]).where("n_before is null").count() == 0


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_rank_and_mean_tests(spark, monkeypatch):
    monkeypatch.setattr(stats, "ROWS", 7)
    rng = np.random.default_rng(2)
    x, y, label = rng.integers(0, 12, 80) / 4, rng.normal(size=80), rng.integers(0, 2, 80)
    rows = [("a", float(p), float(q), int(k)) for p, q, k in zip(x, y, label)] + [("a", float("nan"), 1.0, 1), ("a", None, 1.0, 0), ("a", 1.0, None, None), ("flat", 1.0, 1.0, 0), ("flat", 1.0, 2.0, 1), ("line", 1.0, 1.0, 0), ("line", 2.0, 2.0, 0), ("line", 3.0, 3.0, 0)]
    d = spark.createDataFrame(rows, "g string, x double, y double, label int")
    s = {r.g: r for r in stats.spearman(d, "x", "y", "g").collect()}
    rho = np.corrcoef(ranks(x), ranks(y))[0, 1]
    assert s["a"].n == 80 and s["a"].rho == pytest.approx(rho, abs=1e-12) and 0 < s["a"].p <= 1
    assert s["flat"].rho is None and s["flat"].p is None and s["line"].rho == pytest.approx(1) and s["line"].p == pytest.approx(0, abs=1e-6)
    w = {r.g: r for r in stats.mann_whitney(d, "x", "label", "g").collect()}
    m, n = int(label.sum()), int((1 - label).sum())
    u = sum((a > b) + (a == b) / 2 for a in x[label == 1] for b in x[label == 0])
    tied = sum(c**3 - c for c in np.unique(x, return_counts=True)[1])
    z = (u - m * n / 2 - 0.5) / math.sqrt(m * n / 12 * (81 - tied / (80 * 79)))
    assert w["a"].u == pytest.approx(u) and w["a"].z == pytest.approx(z) and w["a"].p_greater == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-9)
    assert w["flat"].z is None and w["flat"].p_greater is None and w["line"].delta is None
    t = {r.g: r for r in stats.paired_t(d.withColumn("d", F.col("x") - F.col("y")), "d", "g").collect()}
    e = x - y
    assert t["a"].n == 80 and t["a"].dropped == 3 and t["a"].t == pytest.approx(e.mean() / (e.std(ddof=1) / math.sqrt(80))) and t["line"].t is None
    r = {r.g: r for r in stats.drop_report(d, "x", "y", "g").collect()}["a"]
    assert r.mean_x == pytest.approx(x.mean()) and r.stronger == pytest.approx((x > y).mean()) and r.significant == (r.p < 0.05 and r.difference > 0)
