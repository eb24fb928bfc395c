"""Cases of the third review."""

import numpy as np
import pytest
from pyspark import TaskContext

from trackfields.llm import ann, licenses, ngram_join, toxicity

from .test_operators import recall_of, words


def between_clusters():
    """Clusters of rows; every hundredth vector, a query, lies apart from them."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, 32))
    x = centres[rng.integers(300, size=4000)] + 0.1 * rng.normal(size=(4000, 32))
    x[::100] += 0.7 * rng.normal(size=(40, 32))
    return x


def test_ann_of_queries_that_lie_elsewhere(spark):
    x = between_clusters()
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(d, d.where("vec_id % 100 = 0")).collect()
    assert recall_of(got, x, np.arange(len(x)), range(0, len(x), 100)) >= 0.95


def test_ann_of_queries_of_another_dimension(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 * i, [1.0, 2.0]) for i in range(3, 10)]  # most queries', but not most rows'
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.query_id for r in ann.search(d, d.where("vec_id % 100 = 0")).collect()} == {0, 100, 200}


def test_ann_goes_on_without_any_calibration(spark, monkeypatch):
    monkeypatch.setattr(ann, "calibrated", lambda index, x, k: index)
    monkeypatch.setattr(ann, "proved", lambda index, d, asked, k: index)  # a query scans its nearest list only
    x = np.concatenate([np.tile([[50.0] * 8], (4, 1)), np.random.default_rng(5).normal(size=(600, 8))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    mine = sorted((r.rank, r.vec_id) for r in ann.search(d, d.where("vec_id = 0")).collect())
    dist = np.sqrt(((x - x[0]) ** 2).sum(1))
    assert [v for _, v in mine] == [i for i in np.lexsort((np.arange(len(x)), dist)) if i][:10]


def test_ann_search_over_the_graph_is_can_be_given_up():
    index = ann.fitted(between_clusters(), 40)._replace(reach=1.5, slack=np.inf)
    q = between_clusters()[100]
    far = np.linalg.norm(index.centroids - q, axis=1)
    assert ann.search_centroids(index, q) == np.flatnonzero(far <= 1.5 * max(far.min(), index.least)).tolist()


def test_license_threshold_comes_from_every_line(spark):
    lines = [words(8, i) for i in range(12_000)] + [f"This program {words(1, i)} is free software you can redistribute it and/or modify it {words(i % 7, i)}" for i in range(60)]
    rows = spark.createDataFrame([(t,) for t in lines], "paragraph string")
    vectors, model, accept = licenses.fit(rows)
    scored = licenses.classify(rows.selectExpr("paragraph", "substring(md5(paragraph), 32, 1) in ('0', '2', '4', '6', '8', 'a', 'c', 'e') as held_out"), vectors, model, accept)
    p = [r.probability for r in scored.where("held_out").select("probability").collect()]
    assert len(p) > 5_000 and accept == pytest.approx(max(0.5, np.quantile(np.round(p, 6), 1 - licenses.FALSE_RATE)), abs=1e-6)


def test_licenses_learn_from_all_documents(spark, monkeypatch):
    seen = []
    fit = licenses.fit
    monkeypatch.setattr(licenses, "fit", lambda rows: seen.append(rows.count()) or fit(rows))
    licenses.scan(spark.createDataFrame([(i, words(5, i)) for i in range(20_000)], "doc_id long, text string")).count()
    assert seen == [20_000]


def _marked(spark):
    texts = [words(40, 700 + i) + (" vilesome" if i % 4 == 0 else "") for i in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return texts, d, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id long, toxic int")


def test_toxicity_is_calibrated_by_tasks(spark, monkeypatch):
    _, d, y = _marked(spark)
    same = toxicity.fit(d, y)

    real = toxicity.nearest

    def in_tasks_only(*given):
        assert TaskContext.get() is not None, "the driver scores examples"
        return real(*given)

    with monkeypatch.context() as m:
        m.setattr(toxicity, "nearest", in_tasks_only)
        model = toxicity.fit(d, y)
    assert np.array_equal(model.curve, same.curve)
    # The evidence of all cosines gives the same curve.
    unit = np.zeros((len(model.ids), len(model.terms)))
    unit[model.example, np.repeat(np.repeat(np.arange(len(model.terms)), np.diff(model.cuts)), np.diff(model.posts))] = model.value
    every = np.round(unit @ unit.T, 9)
    np.fill_diagonal(every, 0)
    seen = []
    for row in every:
        x = np.lexsort((np.arange(len(row)), -row))[: toxicity.NEIGHBOURS]
        x = x[row[x] > 1e-9]
        seen.append(toxicity.evidence(model, np.zeros(len(x), int), x, row[x], 1)[0])
    assert np.allclose(model.curve, toxicity._logistic(np.array(seen), model.labels), atol=1e-4)


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_toxicity_finds_the_same_with_any_common_terms(spark, monkeypatch, most):
    texts, d, y = _marked(spark)
    model = toxicity.fit(d, y)
    of, term, n = toxicity.counts(texts, model.terms)
    value = toxicity.unit(of, term, n, model.weight, len(texts))
    usual = toxicity.nearest(model, of, term, value, len(texts))
    monkeypatch.setattr(toxicity, "COMMON", most)
    got = toxicity.nearest(model, of, term, value, len(texts))
    assert all(np.array_equal(a, b) for a, b in zip(got[:2], usual[:2])) and np.allclose(got[2], usual[2], atol=2e-9)


def test_ngram_join_leaves_out_tiles_whose_sets_have_all_met(spark, monkeypatch):
    rows = [(w, i, 20, 100 * w + i) for w, n in ((1, ngram_join.BACK + 1), (2, ngram_join.BACK + 2)) for i in range(n)]
    tiles = spark.createDataFrame(rows, "w long, i int, n int, doc long")
    so_far = spark.createDataFrame([(100, 100), (101, 100)], "node long, component long")
    assert {r.w for r in ngram_join._mixed(tiles, so_far).collect()} == {2}
    monkeypatch.setattr(ngram_join, "HOT", 3)  # a tile that several tasks share may hold sets that have not met
    assert {r.w for r in ngram_join._mixed(tiles, so_far).collect()} == {1, 2}


@pytest.mark.parametrize("hot", [3, 16_384])
@pytest.mark.parametrize("back", [1, 6])
def test_ngram_join_of_clusters_around_the_neighbours_that_meet(spark, monkeypatch, back, hot):
    monkeypatch.setattr(ngram_join, "BACK", back)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    texts = []
    for c in range(12):  # near copies of which some link only over others, in clusters of 1 to 12
        base = words(60, 40 + c).split()
        texts += [" ".join([f"x{c}y{k}z{j}" if j in (k % 9, 59 - k % 5) else w for j, w in enumerate(base)]) for k in range(c + 1)]
    texts += texts[:5]
    sets = [set(zip(*(t.split()[j:] for j in range(4)))) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                same = len(sets[a] & sets[b])
                if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                    want[a] = want[b] = min(want[a], want[b])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.components(d, rule=ngram_join.Rule(4, 85)).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts)
