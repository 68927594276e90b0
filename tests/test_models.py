import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import features, model
from linkloom.plans import link_prediction


@pytest.fixture(scope="module")
def judged(spark):
    pick = random.Random(9)
    rows = [(k, int(pick.random() < 0.3), round(pick.random(), 1)) for k in range(200)]
    return spark.createDataFrame([(k, y, min(1.0, s + 0.3 * y), int(s + 0.3 * y > 0.6)) for k, y, s in rows], "k long, link int, score double, predicted int").cache()


def test_metrics(judged):
    rows = judged.collect()
    tp, fp = (sum(r.link == y and r.predicted == 1 for r in rows) for y in (1, 0))
    fn, tn = (sum(r.link == y and r.predicted == 0 for r in rows) for y in (1, 0))
    got = model.metrics(judged).first()
    assert got.accuracy == pytest.approx((tp + tn) / 200) and got.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert got.roc_auc_hard == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    assert {(r.label, r.predicted): r.n for r in model.confusion(judged).collect()} == {k: v for k, v in {(1, 1): tp, (0, 1): fp, (1, 0): fn, (0, 0): tn}.items() if v}
    none = model.metrics(judged.limit(0)).first()
    assert none.accuracy is None or none.accuracy == 0


def test_roc_and_youden(judged):
    rows = judged.collect()
    positives = sum(r.link for r in rows)
    curve = {}
    for t in {r.score for r in rows}:
        tp = sum(r.link for r in rows if r.score >= t)
        curve[t] = (tp / positives, (sum(r.score >= t for r in rows) - tp) / (200 - positives))
    got = {r.threshold: (r.tpr, r.fpr) for r in model.roc_curve(judged, "score").collect()}
    assert {k: pytest.approx(v) for k, v in got.items()} == curve
    best = max(round(a - b, 12) for a, b in curve.values())
    assert model.youden(model.roc_curve(judged, "score")).first().threshold == max(t for t, (a, b) in curve.items() if round(a - b, 12) == best)


def test_folds_are_stratified_and_splits_cover(judged):
    dealt = model.folds(judged, "k", "link", 5)
    by = {(r.link, r.fold): r["count"] for r in dealt.groupBy("link", "fold").count().collect()}
    for y in (0, 1):
        sizes = [by[y, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    train, test = model.split(judged, "k")
    assert train.count() + test.count() == 200 and 35 < test.count() < 85
    assert model.class_ratio(judged).first().ratio == pytest.approx(sum(r.link == 0 for r in judged.collect()) / sum(r.link for r in judged.collect()))


def test_tuning_learns_a_planted_rule(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("a"), F.xxhash64("id").cast("double").alias("b")).withColumn("link", F.expr("cast(a >= 6 as int)"))
    best, fitted, scores = model.tune(df, ["a", "b"], {"n_estimators": [2], "max_depth": [1, 2]}, n_splits=2, n_repeats=1)
    assert scores.count() == 4 and min(r.score for r in scores.collect()) > 0.95
    out = model.scored(fitted, model.assembled(df, ["a", "b"]))
    assert out.where("link <> predicted").count() == 0 and 0 < best["threshold"] <= 1
    random_best, _, few = model.tune(df, ["a"], {"n_estimators": [1], "max_depth": [1, 2, 3]}, n_splits=2, n_repeats=1, search_type="random", n_iter_random=1)
    assert few.count() == 2 and set(random_best) == {"n_estimators", "max_depth", "threshold"}


def test_marginals(spark):
    cv = spark.createDataFrame([(1.0, 0.2), (1.0, 0.4), (2.0, 0.5)], "depth double, score double")
    assert {(r.param, r.value): (round(r["mean"], 9), round(r["std"], 9)) for r in model.marginals(cv, ["depth"]).collect()} == {("depth", 1.0): (0.3, 0.1), ("depth", 2.0): (0.5, 0.0)}


def test_whole_analysis(spark):
    pick = random.Random(3)
    rows = []
    for g in range(3):
        own = [f"g{g}n{k}" for k in range(14)]
        for a in own:
            rows += [(a, p, b) for p, b in enumerate(pick.sample([x for x in own if x != a], 7))]
    rows += [(f"g{g}n0", 9, f"g{(g + 1) % 3}n0") for g in range(3)] + [("g0n0", 10, "Help desk")]
    links = spark.createDataFrame(rows, "title string, pos int, link string")
    settings = link_prediction.Settings(depth=4, train_pairs=1200, space={"n_estimators": [2], "max_depth": [2]}, min_links=2, cut=0.0)
    nodes, edges = link_prediction.build_graph(links, "g0n0", settings)
    assert nodes.where("title = 'Help desk'").count() == 0 and nodes.where("node = 0").first().title == "g0n0"
    assert nodes.count() == 42
    cats = spark.createDataFrame([(f"g{g}n{k}", [f"topic {g}", "CS1 x"]) for g in range(3) for k in range(14)], "title string, categories array<string>")
    out = link_prediction.run(nodes, edges, cats, "g0n0", settings)
    assert out.candidates.count() > 0 and out.metrics.count() == 1
    assert out.candidates.join(out.edges.select(F.col("src").alias("i"), F.col("dst").alias("j")), ["i", "j"]).count() == 0
    assert out.reports["overall"].count() == out.candidates.where("similarity > 0").count()


def test_sample_is_topped_up_to_the_candidates(spark, monkeypatch):
    monkeypatch.setattr(features, "SAMPLE_FLOOR", 10)
    monkeypatch.setattr(features, "SAMPLE_MULTIPLE", 1)
    nodes = spark.range(12).select(F.col("id").alias("node"))
    listed = [(a, b) for a in range(12) for b in range(12) if (a + b) % 8]
    found = spark.createDataFrame(listed, "i long, j long")
    rows = features.sample_pairs(spark, nodes, found).collect()
    assert len(rows) >= len(listed) and len({r.k for r in rows}) == len(rows)
    assert not {(r.i, r.j) for r in rows} & set(listed)
    assert {r.k for r in features.sample_pairs(spark, nodes, found, len(listed)).collect()} == {r.k for r in rows if r.k < len(listed)}
    everything = spark.createDataFrame([(a, b) for a in range(12) for b in range(12)], "i long, j long")
    assert features.sample_pairs(spark, nodes, everything).count() == 0
