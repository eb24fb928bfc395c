import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackfields import audit, fields, grid, models, resampling, sources, splits, stats

HEADER = "SID,NAME,BASIN,ISO_TIME,LAT,LON,USA_WIND,USA_PRES\n , , ,Year-Month-Day,degrees_north,degrees_east,kts,mb\n"


def test_raw_tracks_keep_na_and_drop_the_units_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "A1,nan,NA,2020-08-01 06:00:00,10.5,190.0,35, \nA1,X,EP,2020-08-01 12:00:00,11,-60, ,990\n")
    rows = sources.best_track(sources.raw_tracks(spark, str(tmp_path))).orderBy("ts").collect()
    assert [(r.name, r.basin, r.lat, r.lon, r.wind_kt, r.pressure_mb) for r in rows] == [("UNNAMED", "NA", 10.5, -170.0, 35.0, None), ("X", "EP", 11.0, -60.0, None, 990.0)]
    with pytest.raises(ValueError, match="wind"):
        sources.best_track(sources.raw_tracks(spark, str(tmp_path)).drop("USA_WIND"))


def test_event_lists_take_either_time_column(spark, tmp_path):
    (tmp_path / "e.csv").write_text("sid,basin,timestamp,datetime,ri_label\nA,NA,2020-08-01 06:00:00,,1\nB,EP,,20200801 1200,\n")
    rows = sources.event_list(spark, str(tmp_path), "sid string, basin string, timestamp string, datetime string, ri_label int").orderBy("sid").collect()
    assert [(r.basin, r.ts.hour, r.ri_label) for r in rows] == [("NA", 6, 1), ("EP", 12, None)]


def test_arrays_and_sidecars(spark, tmp_path):
    out = io.BytesIO()
    np.save(out, np.arange(6, dtype=np.float32).reshape(2, 3))
    (tmp_path / "x.npy").write_bytes(out.getvalue())
    files = spark.read.format("binaryFile").load(str(tmp_path / "x.npy"))
    assert [r.value for r in sources.npy_rows(files.select("path", "content")).orderBy("cell").collect()] == [0, 1, 2, 3, 4, 5]
    assert sources.artifacts(files).head().size == len(out.getvalue())
    (tmp_path / "s.json").write_text('{"event_id":"e1","sid":"S","channels":["u","v"],"unknown":1}')
    assert sources.sidecars(spark, str(tmp_path / "s.json")).select("event_id", "ri_label", F.size("channels").alias("n")).head() == ("e1", None, 2)


def test_runs_stop_at_the_first_failure():
    seen = []
    got = sources.run_windows([(0, 4), (5, 9), (10, 14), (15, 19)], {(0, 4)}, lambda a, b: seen.append(a), lambda a, b: a != 10)
    assert got == [(0, 4, "skipped"), (5, 9, "completed"), (10, 14, "failed")] and seen == [5, 10]


def test_strict_json_has_no_nan(spark):
    d = spark.createDataFrame([(1, math.nan), (2, math.inf), (3, 0.5)], "k int, v double")
    assert [r[0] for r in d.orderBy("k").select(sources.strict_json(d, "v")).collect()] == ['{"k":1,"v":null}', '{"k":2,"v":null}', '{"k":3,"v":0.5}']


def test_errors_say_what_is_wrong(spark):
    with pytest.raises(ValueError, match="fog"):
        grid.diagnostics(spark.range(1), ["u", "fog"])
    with pytest.raises(ValueError, match="st_dv24"):
        audit.feature_sets(["st_wind", "st_dv24"], {"state": ("st_",)})
    one = spark.range(1).select(F.lit(3).alias("rows"))
    assert audit.counted(one, {"rows": 3}).head().checked == 1
    with pytest.raises(Exception, match="instead of 4"):
        audit.counted(one, {"rows": 4}).collect()


def test_ranks_and_quantiles_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(3, size=900), np.round(rng.normal(size=900), 1))] + [(0, math.nan), (1, None)]
    d = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r for r in stats.quantiles(d, "x", {"a": 0.3, "b": 0.5}, "g").collect()}
    for g in range(3):
        x = np.array([v for k, v in rows if k == g and v is not None and v == v])
        assert got[g].a == pytest.approx(np.quantile(x, 0.3)) and got[g].b == pytest.approx(np.median(x))
        ranks = sorted((r.x, r.r) for r in stats.average_rank(d.where(F.col("g") == g), "x", "r", "g").collect())
        order = np.sort(x)
        assert ranks == [(v, (np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2) for v in order]


def test_folds_number_groups_in_order(spark):
    rows = [(f"s{i}", int(i % 7 == 0)) for i in range(60) for _ in range(1 + i % 3)]
    got = splits.folds(spark.createDataFrame(rows, "sid string, y int"), "sid", "y", 4).collect()
    import hashlib

    want = sorted(got, key=lambda r: (-r.positives, -r.size, hashlib.md5(f"0:{r.sid}".encode()).hexdigest()))
    assert [r.fold for r in want] == [(k % 4 if k // 4 % 2 == 0 else 3 - k % 4) for k in range(60)]


def test_smoothing_and_peaks_skip_missing_cells(spark):
    x = np.zeros((1, 6, 6))
    x[0, 2, 3], x[0, 5, 5], x[0, 0, 0] = 5, 9, math.nan
    y = fields.smooth(x, 0.5)
    assert np.isfinite(y).all() and y[0, 2, 3] == y[0, 1:-1, 1:-1].max()
    assert fields.smooth(np.full((1, 4, 4), 2.0), 1.0) == pytest.approx(2.0)
    m = spark.createDataFrame([(1, 0, [None if v != v else float(v) for v in x.ravel()]), (2, 0, [None] * 36)], "event_id long, t_idx int, map array<double>")
    one, two = fields.peaks(m, 6, 0.5).orderBy("event_id").collect()
    assert (one.i, one.j, one.value, one.local) == (2, 3, 5.0, True) and two.i is None
    flat = fields.peaks(m.where("event_id = 1"), 6, 0.5, detrend=3.0).head()
    assert (flat.i, flat.j) == (2, 3)


def test_conditional_logit_and_weights(spark):
    d = [0.5, 1.0, -0.3, 0.8, 0.1, -0.2]
    beta = resampling.conditional_logit(spark.createDataFrame([(x,) for x in d], "d double"), "d").head().beta
    slope = sum(x / (1 + math.exp(beta * x)) for x in d)
    assert slope == pytest.approx(0, abs=1e-9) and beta > 0
    p = resampling.conditional_logit_p(spark.createDataFrame(list(enumerate(d)), "k int, d double"), "d", "k", 20, 8).head()
    assert 0 < p.p <= 1 and p.observed == pytest.approx(beta, abs=1e-6)
    w = spark.range(4000).select(resampling.poisson_weight(F.lit(1), F.col("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).head()
    assert w[0] == pytest.approx(1, abs=0.08) and w[1] == pytest.approx(1, abs=0.15)


def test_platt_and_baseline(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(int)
    d = spark.createDataFrame([(i, float(a), int(b), int(i % 3)) for i, (a, b) in enumerate(zip(z, y))], "id int, z double, y int, fold int")
    slope, intercept = models.platt(d)
    p = 1 / (1 + np.exp(-(slope * z + intercept)))
    assert abs(((y - p) * z).sum()) < 0.05 and abs((y - p).sum()) < 0.05
    s = models.out_of_fold(d, ["z"], [0, 1, 2]).toPandas()
    assert len(s) == 600 and s[s.y == 1].score.mean() > s[s.y == 0].score.mean() + 0.2


def test_geojson_round_trip(spark):
    from datetime import datetime

    from trackfields import summary

    d = spark.createDataFrame([("S", datetime(2024, 1, 1, h), 10.0 + h, -60.0, float(h), None if h else 1) for h in (12, 0, 6)], "sid string, ts timestamp_ntz, lat double, lon double, wind_kt double, label int")
    one = summary.geojson(d, ["wind_kt", "label"])
    assert one.head().geojson.startswith('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[-60.0,10.0],[-60.0,16.0],[-60.0,22.0]]}')
    got = summary.points(one, "wind_kt double, label int").collect()
    assert [(r.t, r.lat, r.lon, r.wind_kt, r.label) for r in got] == [("2024-01-01T00:00", 10.0, -60.0, 0.0, 1), ("2024-01-01T06:00", 16.0, -60.0, 6.0, None), ("2024-01-01T12:00", 22.0, -60.0, 12.0, None)]


def test_statistics_leave_out_what_is_not_finite(spark):
    rows = [(1, 0, 0, j, v) for j, v in enumerate((1.0, 3.0, math.nan, math.inf, None))]
    d = spark.createDataFrame(rows, "event_id long, t_idx int, i int, j int, u double")
    s = grid.channel_stats(d, ["u"], "event_id").head()
    assert (s.u_mean, s.u_sd, s.u_lo, s.u_hi) == (2.0, 1.0, 1.0, 3.0)
    n = grid.normalisation(d, ["u"])
    assert [(r.n, r.mean, r.sd) for r in n.collect()] == [(2, 2.0, 1.0)]
    assert [r.u for r in grid.standardised(d, n, ["u"]).orderBy("j").collect()] == [-1.0, 1.0, 0.0, 0.0, 0.0]
    r = grid.ranges(d, {"u": (0, 2)}).head()
    assert (r.u_missing, r.u_ok) == (0.6, 0)
    assert grid.whole_events(d, ["u"]).count() == 0 and [tuple(x) for x in grid.event_outcomes(d, ["u"]).collect()] == [("not_finite", 1)]
