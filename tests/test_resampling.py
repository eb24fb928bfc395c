"""Cluster bootstraps and conditional logits over tasks against plain versions."""

import hashlib

import numpy as np
import pytest

from trackfields import resampling


def plain_areas(score, y, w):
    p, n = (w * y).sum(), (w * (1 - y)).sum()
    if not p or not n:
        return None, None
    wins = sum(w[i] * y[i] * w[j] * (1 - y[j]) * ((score[i] > score[j]) + (score[i] == score[j]) / 2) for i in range(len(y)) if y[i] and w[i] for j in range(len(y)) if not y[j] and w[j])
    found = 0.0
    for t in np.unique(score):
        mine, up = score == t, score >= t
        if (w * y)[mine].sum():
            found += (w * y)[mine].sum() * (w * y)[up].sum() / w[up].sum()
    return wins / (p * n), found / p


def plain_weights(clusters, r):
    h = [hashlib.md5(str(c).encode()).hexdigest() for c in clusters]
    m = 2**32 - 1

    def mix(x):
        x = (x ^ x >> 16) * 2246822507 & m
        x = (x ^ x >> 13) * 3266489909 & m
        return x ^ x >> 16

    u = [mix(mix(int(k[:8], 16) + r * 2654435769 & m) ^ int(k[8:16], 16)) / 2**32 for k in h]
    return np.array([sum(p <= v for p in resampling.POISSON) for v in u])


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(3)
    n = 160
    cluster, y = rng.integers(0, 25, n), (rng.random(n) < 0.15).astype(int)
    a, b = np.round(y + rng.normal(size=n), 1), np.where(rng.random(n) < 0.5, 0.5, np.round(rng.random(n), 1))  # a score that half of the rows share
    return cluster, y, a, b


@pytest.mark.parametrize(("chunk", "partitions"), [(3, 4), (20, 1), (20, 16), (8192, 4)])
def test_replicates_equal_a_plain_bootstrap(spark, scored, monkeypatch, chunk, partitions):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    monkeypatch.setattr(resampling, "AT_ONCE", 7)
    cluster, y, a, b = scored
    rows = [(int(c), int(k), float(p), float(q)) for c, k, p, q in zip(cluster, y, a, b)] + [(1, None, 0.1, 0.1), (1, 1, float("nan"), None)]
    d = spark.createDataFrame(rows, "sid int, y int, a double, b double").repartition(partitions)
    got = {(r.arm, r.r): (r.roc_auc, r.pr_auc) for r in resampling.replicate_areas(d, "sid", ("a", "b"), 20).collect()}
    for r in range(1, 21):
        w = plain_weights(cluster, r)
        for arm, score in (("a", a), ("b", b)):
            assert got[arm, r] == pytest.approx(plain_areas(score, y, w), abs=1e-12)


def test_verdicts_of_same_and_perfect_arms(spark, scored):
    cluster, y, a, _ = scored
    d = spark.createDataFrame([(int(c), int(k), float(p), float(k), s) for c, k, p in zip(cluster, y, a) for s in (1, None)], "sid int, y int, a double, best double, seed int")
    same = resampling.cluster_bootstrap(d.selectExpr("sid", "y", "a", "a as c", "seed"), "sid", "a", "c", 60, "seed").collect()
    assert len(same) == 2 and all(r.lo <= 0 <= r.hi and r.mean == 0 and r.verdict == "none" for r in same)
    better = resampling.cluster_bootstrap(d, "sid", "best", "a", 60, "seed").collect()
    assert all(r.lo > 0 and r.verdict == "first" and r.used + r.skipped == 60 for r in better)
    one = resampling.cluster_bootstrap(d.where("y = 0"), "sid", "best", "a", 5).collect()
    assert all(r.used == 0 and r.skipped == 5 and r["mean"] is None for r in one)
    assert resampling.cluster_bootstrap(d.limit(0), "sid", "best", "a", 5).count() == 0


def plain_logit(x):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ p)
    return beta


def test_three_coefficients_equal_a_plain_newton(spark):
    x = np.random.default_rng(4).normal(size=(90, 3)) + [0.6, 0.0, -0.2]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(900, None, 1.0, 1.0), (901, float("inf"), 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(3)
    got = {r.coefficient: r for r in resampling.pair_coefficients(d, ("a", "b", "c"), "k", 30).collect()}
    beta = plain_logit(x)
    assert [got[c].beta for c in "abc"] == pytest.approx(beta, abs=1e-8) and all(r.pairs == 90 and r.converged for r in got.values())
    h = np.array([[int(hashlib.md5(str(i).encode()).hexdigest()[j : j + 8], 16) for j in (0, 8)] for i in range(90)])
    sign = np.where(resampling.draws(h[:, 0], h[:, 1], np.arange(1, 31)) < 2**31, 1.0, -1.0)
    turned = np.array([plain_logit(x * sign[:, [r]]) for r in range(30)])
    assert [got[c].p for c in "abc"] == pytest.approx([(1 + (np.abs(turned[:, i]) >= abs(beta[i])).sum()) / 31 for i in range(3)])


def test_separated_pairs_end(spark):
    d = spark.createDataFrame([(i, 1.0 + i / 10, 0.0) for i in range(8)], "k int, a double, b double")
    got = {r.coefficient: r for r in resampling.pair_coefficients(d, ("a", "b"), "k", 5).collect()}
    assert not got["a"].converged and got["a"].beta > 5 and got["b"].beta == 0
    none = resampling.pair_coefficients(d.limit(0), ("a",), "k", 3).collect()
    assert none[0].pairs == 0
