"""Recompute gates, samples, label effects and files on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trackfields import audit, labels, resampling, sources, splits


def test_gates_take_null_keys_and_nulls(spark):
    schema = "k int, a double, b int"
    stored = spark.createDataFrame([(1, 1.0, 5), (2, None, 5), (None, 3.0, 5), (4, float("nan"), 5)], schema)
    again = spark.createDataFrame([(1, 1.0 + 1e-9, 5), (2, None, 6), (None, 3.5, 5), (5, 1.0, None)], schema)
    got = {(r.column, r.status): (r.n, r.first) for r in audit.gate(stored, again, ["k"], ["a", "b"], 1e-6).collect()}
    assert got["a", "equal"] == (2, "1") and got["a", "differs"][0] == 1 and got["b", "differs"] == (1, "2") and got["b", "equal"][0] == 2
    assert got["a", "not_recomputed"] == (1, "4") and got["a", "not_stored"] == (1, "5") and got["b", "not_stored"] == (1, "5")
    s = {r.column: (r.n, r["mean"]) for r in audit.statistics(stored, ["a", "b"]).collect()}
    assert s == {"a": (2, 2.0), "b": (4, 5.0)}
    assert audit.gate(stored.limit(0), again.limit(0), ["k"], ["a"], 1.0).count() == 0


@pytest.mark.parametrize(("n", "want"), [(10, 10), (3, 4), (50, 43), (0, 4), (20, 20)])
def test_samples_have_their_size(spark, n, want):
    rows = [(i, "big") for i in range(30)] + [(100 + i, "small") for i in range(2)] + [(200 + i, None) for i in range(10)] + [(300, "one")]
    d = spark.createDataFrame(rows, "id int, g string")
    got = splits.stratified_sample(d, "g", "id", n, 5)
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) == want and {r.g for r in got.collect()} == {"big", "small", None, "one"}
    assert sorted(ids) == sorted(r.id for r in splits.stratified_sample(d.repartition(7), "g", "id", n, 5).collect())
    assert splits.stratified_sample(d.limit(0), "g", "id", n).count() == 0


def test_effects_of_a_label_version(spark):
    rows = [(1, 1, 30.0, 30.0), (1, 0, 30.0, 20.0), (0, None, 5.0, None), (0, 0, 5.0, 8.0), (0, 0, 5.0, 6.0), (1, None, 31.0, None)]
    d = spark.createDataFrame(rows, "old int, new int, a double, b double")
    got = {r.effect: (r.n, r.lo, r.median, r.hi) for r in labels.change_effects(d, "old", "new", "a", "b").collect()}
    assert got == {"none": (1, 0.0, 0.0, 0.0), "flip": (1, 10.0, 10.0, 10.0), "drift": (2, 1.0, 2.0, 3.0), "undefined": (2, None, None, None)}
    pairs = spark.createDataFrame([(1, 1, 1.0, 1.0, 2.0, None), (0, 0, 1.0, 1.0, 2.0, 2.0)], "old int, new int, a double, b double, c double, e double")
    why = [r[0] for r in pairs.select(labels.reason(F.col("old"), F.col("new"), (F.col("a"), F.col("b")), (F.col("c"), F.col("e")))).collect()]
    assert why == ["dv_drift", "unchanged"]


def test_written_files_are_read_back(spark, tmp_path):
    d = spark.createDataFrame([(i, i % 3, f"line {i} é") for i in range(12)], "k int, part int, t string")
    sources.write_texts(d, "part", "k", "t", f"file://{tmp_path}/w")
    got = {r.path.split("/")[0]: (r.size, r.sha256) for r in sources.artifacts(sources.files(spark, f"file://{tmp_path}/w", "*.txt")).collect()}
    for part in range(3):
        content = "".join(f"line {i} é\n" for i in range(part, 12, 3)).encode()
        assert got[f"part={part}"] == (len(content), hashlib.sha256(content).hexdigest())
    assert sources.files(spark, f"file://{tmp_path}/w", "*.txt", 10_000).count() == 0


def test_falls_and_sign_flips_by_group(spark):
    rows = [("a", 0, 1.0), ("a", 24, 4.0), ("a", 30, 9.0), ("b", 0, 2.0), ("b", 24, 4.0), ("c", 0, 0.0), ("c", 24, None)]
    d = spark.createDataFrame(rows, "k string, lag int, d double")
    r = resampling.fall(d, "k", "lag", "d", 24).head()
    assert r.n == 2 and r["mean"] == 2.5 and r.t == pytest.approx(5.0) and r.p == pytest.approx(0.12566591637800234)
    p = {r.lag: (r.n, r.observed, r.p) for r in resampling.sign_flip_by(d.where("d is not null"), "d", "k", 20, "lag").collect()}
    assert p[0][:2] == (3, 1.0) and p[30] == (1, 9.0, 1.0) and 1 / 21 <= p[24][2] <= 1
