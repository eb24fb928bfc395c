"""Control matching, first partners and resumable windows against plain versions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trackfields import audit, labels, sources, stats


@pytest.mark.parametrize(("seed", "spread"), [(1, 100), (2, 400), (3, 12), (4, 0)])
def test_matching_is_maximal(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(stats, "ROWS", 20)
    rng = random.Random(seed)
    make = lambda n, name: [(f"{name}{i}", rng.choice(["x", "y", None]), float(rng.randint(-spread, spread))) for i in range(n)]
    cases, controls = make(120, "a"), make(140, "b")
    schema = "id string, basin string, value double"
    got = audit.matched_controls(spark.createDataFrame([*cases, ("none", "x", None)], schema), spark.createDataFrame(controls, schema), 10.0).collect()
    a, b = {i: (g, v) for i, g, v in cases}, {i: (g, v) for i, g, v in controls}
    assert len({r.case_id for r in got}) == len(got) == len({r.control_id for r in got}) and "none" not in {r.case_id for r in got}
    for r in got:
        (g, v), (h, w) = a[r.case_id], b[r.control_id]
        assert abs(v - w) <= (10.0 if r["pass"] < 3 else 15.0) and (r["pass"] > 1 or (g == h and g is not None))
    # After each pass no case left has a control left within its width: same basin first, then any, then one and a half bands.
    for k, (width, same) in enumerate(((10.0, True), (10.0, False), (15.0, False)), 1):
        used = {x for r in got if r["pass"] <= k for x in (r.case_id, r.control_id)}
        open_a, open_b = [x for i, x in a.items() if i not in used], [x for i, x in b.items() if i not in used]
        assert not any(abs(v - w) <= width and (not same or (g == h and g is not None)) for g, v in open_a for h, w in open_b)


def test_numbering_of_one_frequent_value(spark, monkeypatch):
    monkeypatch.setattr(stats, "ROWS", 20)
    d = spark.createDataFrame([(f"i{k}", 5.0 if k % 3 else float(k)) for k in range(600)], "id string, value double")
    got = audit._numbered(d, 0).collect()
    assert sorted(r._k for r in got) == list(range(1, 601)) and {r._m for r in got} == {600}
    by_place = [r.value for r in sorted(got, key=lambda r: r._k)]
    assert by_place == sorted(by_place)


def test_the_first_fix_in_order_is_the_partner(spark):
    t = lambda h: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=h)
    rows = [(1, "s", t(0), 30.0), (2, "s", t(12), None), (3, "s", t(12), 10.0), (5, "s", t(24), 70.0), (4, "s", t(24), 80.0), (6, "s", t(24.0), 5.0), (7, "s", t(23), 1.0), (8, "u", t(24), 1.0), (9, "s", t(0), 50.0)]
    d = spark.createDataFrame(rows, "src_seq int, sid string, ts timestamp_ntz, wind_kt double")
    got = {r.src_seq: (r.dv12, r.dv24) for r in labels.strict_deltas(d, order="src_seq").collect()}
    assert got[1] == (None, 50.0) and got[9] == (None, 30.0) and got[3] == (70.0, None) and got[7] == (None, None)
    lag = {(r.src_seq, r.lag_h): r.then for r in labels.lagged(d, (0, 12, 24), order="src_seq").collect()}
    assert lag[9, 0] == 30.0 and lag[1, 12] is None and lag[1, 24] == 80.0


def test_windows_resume(spark, tmp_path):
    d = spark.createDataFrame([(i, 2000 + i % 9) for i in range(90)], "k int, year int")
    path, seen = f"file://{tmp_path}/w", []

    def work(rows, y0, y1):
        seen.append(y0)
        return rows

    lossy = lambda rows, y0, y1: rows.where("k > 3") if y0 == 2003 else rows
    assert [(a, b, s) for a, b, s, _ in sources.run_resumable(d, "year", 3, path, lossy)] == [(2000, 2002, "completed"), (2003, 2005, "failed")]
    assert [(a, s) for a, _, s, _ in sources.run_resumable(d, "year", 3, path, work)] == [(2000, "skipped"), (2003, "completed"), (2006, "completed")] and seen == [2003, 2006]
    assert [s for *_, s, _ in sources.run_resumable(d, "year", 3, path, work)] == ["skipped"] * 3 and len(seen) == 2
    assert sorted(map(tuple, sources.written(spark, path, d).drop("_y0").collect())) == sorted(map(tuple, d.collect()))
    assert {r.attempt for r in sources.manifest(spark, f"{path}/manifest").where("y0 = 2003").collect()} == {2}
    # A window cut off before its manifest row is worked again, and the others stay.
    moved = d.withColumn("k", F.col("k") + F.when(F.col("year") == 2007, 100).otherwise(0))
    assert [s for *_, s, _ in sources.run_resumable(moved, "year", 3, f"{path}2", work)] == ["completed"] * 3
    assert sources.run_resumable(d.limit(0), "year", 3, f"{path}3", work) == []


def test_the_shared_folder_is_shared():
    with pytest.raises(ValueError, match="checkpoint"):
        sources._shared("file:/tmp/warehouse")
    assert sources._shared("hdfs://host/warehouse") == "hdfs://host/warehouse"
