from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trackfields import clean, grid, joins, labels, metrics, splits, stats


def track(spark, rows):
    return spark.createDataFrame([(s, datetime(2024, 1, d, h, m), float(w)) for s, d, h, m, w in rows], "sid string, ts timestamp_ntz, wind_kt double")


def test_strict_deltas_need_an_exact_partner(spark):
    rows = [("a", 1, 0, 0, 30), ("a", 1, 6, 0, 32), ("a", 1, 12, 15, 35), ("a", 1, 18, 0, 38), ("a", 2, 6, 0, 42), ("a", 2, 12, 0, 45)]
    got = labels.strict_deltas(track(spark, rows)).orderBy("ts").collect()
    assert [r.dv12 for r in got] == [None, 6, None, 4, None, None]
    assert [r.dv24 for r in got] == [None, 10, None, None, None, None]


def test_deltas_stay_within_a_storm_and_labels_have_three_states(spark):
    rows = [(s, 1 + h // 24, h % 24, 0, w + h) for s, w in (("a", 0), ("b", 50)) for h in (0, 24, 48)]
    d = labels.strict_deltas(track(spark, rows)).withColumn("y", labels.three_state(F.col("dv24"), 24))
    assert sorted((r.sid, r.y) for r in d.collect() if r.y is not None) == [("a", 1), ("a", 1), ("b", 1), ("b", 1)]
    edge = spark.createDataFrame([(29.0,), (30.0,), (None,)], "dv double").select(labels.three_state(F.col("dv")).alias("y"))
    assert [r.y for r in edge.collect()] == [0, 1, None]


def test_missing_texts_and_event_ids(spark):
    d = spark.createDataFrame([("NA",), ("nan",), (None,)], "b string").select(clean.clean_text(F.col("b"), "x").alias("b"))
    assert [r.b for r in d.collect()] == ["NA", "x", "x"]
    one = track(spark, [("A_1", 1, 6, 0, 1)]).select(clean.parse_event_id(clean.event_id(F.col("ts"), F.col("sid"))).alias("x")).head().x
    assert (one.year, one.stamp, one.sid) == (2024, "2024_01_01_0600", "A_1")
    with pytest.raises(Exception, match="needs a sid"):
        track(spark, [("", 1, 6, 0, 1)]).select(clean.event_id(F.col("ts"), F.col("sid"))).collect()
    with pytest.raises(ValueError, match="lat"):
        clean.resolve(track(spark, [("a", 1, 0, 0, 1)]), {"lat": ("LAT", "latitude")})


def test_hash_fraction_is_stable_and_frozen_keys_win(spark):
    d = spark.createDataFrame([("2020306N16279",), ("SID000001",)], "sid string")
    got = {r.sid: r.f for r in d.select("sid", splits.hash_fraction(F.col("sid")).alias("f")).collect()}
    assert got == {"2020306N16279": pytest.approx(0.75803207), "SID000001": pytest.approx(0.84569761)}
    frozen = spark.createDataFrame([("SID000001", "train")], "sid string, split string")
    assert {r.sid: r.split for r in splits.make_splits(d, "sid", frozen).collect()} == {"2020306N16279": "val", "SID000001": "train"}
    with pytest.raises(ValueError):
        splits.assign(F.col("sid"), 0.5, 0.1, 0.1)


def test_rotation_and_divergence(spark):
    k, rows = 3e-5, [(1, 0, i, j) for i in range(6) for j in range(6)]
    x, y = (F.col("j") * 25000.0), (F.col("i") * 27000.0)
    d = spark.createDataFrame(rows, "event_id int, t_idx int, i int, j int").withColumns({"u": -k * y, "v": k * x})
    dx, dy = F.lit(25000.0), F.lit(27000.0)
    got = d.select(grid.vorticity(dx, dy).alias("w"), grid.divergence(dx, dy).alias("d")).collect()
    assert all(r.w == pytest.approx(2 * k) and r.d == pytest.approx(0, abs=1e-15) for r in got)


def test_areas_with_ties_and_empty(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)]
    c = metrics.curve(spark.createDataFrame(rows, "score double, y int"))
    assert metrics.roc_auc(c).head()[0] == pytest.approx(0.875)
    none = metrics.curve(spark.createDataFrame([], "score double, y int"))
    assert metrics.threshold_for_recall(none, 0.8).head().threshold == 0.5


def test_distance_bearing_and_onset(spark):
    d = spark.range(1).select(stats.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("km"), stats.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0)).alias("b")).head()
    assert d.km == pytest.approx(6371 * 3.141592653589793 / 2) and d.b == pytest.approx(270)
    t = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, None), ("a", 5, 1)], "sid string, ts int, label int")
    assert [r.ts for r in t.withColumn("o", labels.onset()).where("o").collect()] == [2, 5]


def test_nearest_time_takes_the_earlier_on_ties(spark):
    left = track(spark, [("a", 1, 6, 0, 1), ("b", 1, 6, 0, 1)])
    right = track(spark, [("a", 1, 3, 0, 10), ("a", 1, 9, 0, 20)])
    got = {r.sid: r.found for r in joins.nearest_time(left, right, ["sid"], "ts", "wind_kt").collect()}
    assert got == {"a": 10.0, "b": None}
