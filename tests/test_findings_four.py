"""What the review of round four found: missing channels of a patch, medians of many replicates, draws of a bootstrap."""

import hashlib
import math
import statistics

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from trackfields import grid, resampling


def test_fluxes_of_missing_temperatures_equal_their_sql(spark, tmp_path):
    vector = lambda i: [0.01 * i + 0.001 * k for k in range(64)]
    rows = [(i, vector(i)) for i in (0, 1, 2, 4, 5, 6, 7, 9, 10, 11)]  # 3 and 8 are missing: a temperature and a wind
    rows[6] = (7, [None, float("nan"), float("inf"), *vector(7)[3:]])
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    name = "g13_g14_fluxes"
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(columns).collect())


def test_fluxes_of_given_air(spark):
    d = spark.createDataFrame([(300.0, 298.0, 5.0), (300.0, None, 5.0), (None, 298.0, 5.0), (None, None, 5.0), (300.0, 298.0, None)], "sst double, air double, wind double")
    got = d.select(grid.heat_fluxes(F.col("sst"), F.col("air"), F.lit(None).cast("double"), F.lit(101_000.0), F.col("wind")).alias("f")).select("f.*").collect()
    degree = 1.2 * 1005 * 1.2e-3 * 5
    assert [r.sensible for r in got] == [pytest.approx(2 * degree), pytest.approx(degree), None, pytest.approx(degree), None]
    assert [r.latent is None for r in got] == [False, False, True, True, True] == [r.total is None for r in got]


def plain_km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(x, 1)))


@pytest.mark.parametrize("points", [1, 2, 3, 4, 8, 9])
def test_random_points_equal_plain_medians(spark, points):
    rows = [(f"k{i}", 10.0 + i, 20.0 - i, 10.0 + i + (i % 3) * 1.2, 20.0 - i + (i * 7 % 5) * 0.8) for i in range(points)]
    u = lambda *k: int(hashlib.md5(":".join(map(str, k)).encode()).hexdigest()[:8], 16) / 2**32
    seen = statistics.median(plain_km(*r[1:]) for r in rows)
    medians = [statistics.median(plain_km(a + (2 * u(r, k, "y") - 1) * 2, b + (2 * u(r, k, "x") - 1) * 2, c, d) for k, a, b, c, d in rows) for r in range(1, 61)]
    d = spark.createDataFrame(rows, "id string, clat double, clon double, lat double, lon double").repartition(3)
    got = resampling.random_points(d, "id", 2.0, 60).collect()
    assert [(r.p, r.observed) for r in got] == [(pytest.approx((sum(m <= seen + 1e-9 for m in medians) + 1) / 61), pytest.approx(seen))]


def test_random_points_hold_no_replicate_in_a_task(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0, 2.0, 2.0)], "id string, clat double, clon double, lat double, lon double")
    plan = resampling.random_points(d, "id", 5.0, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan and "collect_list(" not in plan
    none = resampling.random_points(d.limit(0), "id", 5.0, 4).collect()
    assert [(r.p, r.observed) for r in none] == [(0.2, None)]


def test_large_chunks_draw_a_cluster_seldom(spark, monkeypatch):
    for name, value in (("CHUNK", 5), ("LARGE", 16), ("CHUNKS", 4)):
        monkeypatch.setattr(resampling, name, value)
    rows = [(i % 10, i * 7 % 3 % 2, float(i)) for i in range(400)]
    d = spark.createDataFrame(rows, "sid int, y int, a double").repartition(3)
    got = resampling._chunks(d, "sid", ("a",)).collect()
    assert sorted(len(r["at"]) for r in got) == [80] * 5  # not of 5 rows, nor of 100
    assert sum(len(r.h) for r in got) == 50 and sum(sum(r.pos) + sum(r.neg) for r in got) == 400


@pytest.mark.parametrize(("tile", "cuts", "draws"), [(4, 2, 30), (1024, 16, 1 << 24), (7, 1, 1)])
def test_parts_of_a_chunk_equal_plain_sums(monkeypatch, tile, cuts, draws):
    for name, value in (("TILE", tile), ("CUTS", cuts), ("DRAWS", draws)):
        monkeypatch.setattr(resampling, name, value)
    rng = np.random.default_rng(5)
    h, at = rng.integers(-(2**63), 2**63, 12), rng.integers(0, 12, 90).astype(np.int32)
    begin = np.flatnonzero(np.r_[True, rng.random(89) < 0.3 * (np.arange(1, 90) > 25)]).astype(np.int32)  # the first score is longer than a tile
    score, y, n, big = np.cumsum(np.isin(np.arange(90), begin)), rng.random(90) < 0.3, 9, float(2**22)
    pos, neg = y * big, ~y * 1.0
    above, under = rng.integers(0, 50, n).astype(float), rng.integers(0, 50, n).astype(float)
    row = pd.DataFrame({"key": "", "arm": "a", "chunk": 0, "hot": False, "h": [h], "at": [at], "begin": [begin], "pos": [pos], "neg": [neg], "tp": [above], "fp": [under]})
    parts, totals = (pd.concat(f(n)(iter([row]))).set_index("r") for f in (resampling._parts, resampling._totals))
    halves = h.view(np.uint64)
    w = resampling.draws(halves >> np.uint64(32), halves & np.uint64(2**32 - 1), np.arange(1, n + 1))[at] / 2**32
    w = sum((w >= p).astype(float) for p in resampling.POISSON)
    for r in range(1, n + 1):
        p, q = pos * w[:, r - 1], neg * w[:, r - 1]
        assert (p.sum(), q.sum()) == (parts.pos[r], parts.neg[r]) == (totals.pos[r], totals.neg[r])
        wins = found = 0.0
        for s in np.unique(score):
            tp, fp, mine = above[r - 1] + p[score <= s].sum(), under[r - 1] + q[score <= s].sum(), p[score == s].sum()
            wins, found = wins + mine * (q[score == s].sum() / 2 - fp), found + mine * tp / max(tp + fp, 1)
        assert (parts.wins[r], parts.found[r]) == (pytest.approx(wins, rel=1e-12), pytest.approx(found, rel=1e-12))
