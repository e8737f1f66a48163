import json
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortry.operators import boosting as B
from cohortry.operators import estimators as E
from cohortry.operators import modelling as M
from cohortry.sources import io


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = []
    for i in range(300):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(5))
        y = float(a + (c in (1.0, 3.0)) + rng.gauss(0, 0.7) > 0.4)
        data.append((i, a, b, c, y, float(min(2, int(a > 0.2) + int(b > 0.3))), i % 3))
    df = spark.createDataFrame(data, "id bigint, a double, b double, c double, label double, k double, fold int")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


def test_margins_of_the_last_round_are_the_model_s(rows):
    indexed = VectorIndexer(inputCol="features", outputCol="x", maxCategories=6).fit(rows).transform(rows)  # c has categories
    model = M.gbt(rounds=6, depth=3).setFeaturesCol("x").fit(indexed)
    own = {r["id"]: r["margins"] for r in B.staged_margins(model, indexed, ["id"], "x").collect()}
    want = model.transform(indexed).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()
    assert all(len(own[r["id"]]) == 6 and abs(own[r["id"]][-1] - r["m"]) < 1e-9 for r in want)
    trees = B.tree_table(model)
    assert trees.where("categories IS NOT NULL").count() > 0 and trees.select("tree").distinct().count() == 6


def test_scores_by_round(rows):
    model = M.gbt(rounds=5, depth=2).fit(rows)
    staged = B.staged_margins(model, rows, ["label"])
    loss = [r["score"] for r in B.round_scores(staged, "log_loss").orderBy("round").collect()]
    assert np.allclose(2 * np.array(loss), model.evaluateEachIteration(rows))
    got = [r["score"] for r in B.round_scores(staged).orderBy("round").collect()]
    data = staged.collect()
    for n in range(5):
        tp = total = area = 0
        for m in sorted({r["margins"][n] for r in data}, reverse=True):
            hit = sum(r["label"] for r in data if r["margins"][n] == m)
            total += sum(r["margins"][n] == m for r in data)
            tp += hit
            area += hit * tp / total
        assert abs(got[n] - area / tp) < 1e-9
    with pytest.raises(ValueError):
        B.round_scores(staged, "other")


def test_stopping_round():
    scores = [(1, 0.5), (2, 0.6), (3, 0.6), (4, 0.59), (5, 0.7)]
    assert B.stopping_round(scores, 10, True) == 5 and B.stopping_round(scores, 2, True) == 2 and B.stopping_round(scores, 10, False) == 1


def test_cross_validated_rounds(rows):
    found = B.cv_rounds(M.gbt(rounds=12, depth=2, rate=0.4), rows, 3, metric="log_loss", patience=3)
    by_round = {}
    for i in range(3):
        model = M.gbt(rounds=12, depth=2, rate=0.4).fit(rows.where(F.col("fold") != i))
        for n, loss in enumerate(model.evaluateEachIteration(rows.where(F.col("fold") == i)), 1):
            by_round.setdefault(n, []).append(loss / 2)
    means = [(n, sum(v) / 3) for n, v in by_round.items()]
    assert found.rounds == B.stopping_round(means, 3, False) and abs(found.score - dict(means)[found.rounds]) < 1e-9
    assert found.model.stages[-1].getNumTrees == found.rounds
    assert [r["round"] for r in found.scores.where("best").collect()] == [found.rounds]


def test_booster_of_classes_is_searched_and_saved(spark, rows, tmp_path):
    booster = E.BoosterOfClasses(classes=3, labelCol="k", maxIter=2)
    found = M.random_search(M.Pipeline(stages=[booster]), rows, {booster.maxDepth: [1, 3], booster.stepSize: [0.1]}, 2, 3, label="k")
    assert found.trials.count() == 2 and found.score > 0.7
    io.save_artifact(found.model, rows.limit(40), str(tmp_path / "m"))
    loaded, held = io.load_artifact(spark, str(tmp_path / "m"))
    a, b = (M.scored_multiclass(m, held, "id", "k").orderBy("id").collect() for m in (found.model, loaded))
    assert a == b and len(a) == 40
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["probability"][r["prediction"]] == r["probability_max"] for r in a)
    scores = M.nested_cv(M.Pipeline(stages=[booster]), rows.withColumn("outer_fold", F.col("id") % 2), {booster.maxDepth: [2]}, 1, 2, 3, label="k")
    assert M.score_summary(scores).first()["mean"] > 0.6


def test_resampling_touches_fitted_rows_only(rows):
    resampler, lr = E.Resampler(labelCol="k", targets=E.Resampler.counts({0: 200, 1: 120}), tomek=False), E.PenalisedLogistic(labelCol="k", maxIter=5)
    pipe = E.TrainingPipeline(stages=[resampler, lr])
    n = {(f, int(k)): rows.where((F.col("fold") != f) & (F.col("k") == k)).count() for f in range(3) for k in range(3)}
    held = {(f, int(k)): rows.where((F.col("fold") == f) & (F.col("k") == k)).count() for f in range(3) for k in range(3)}
    for r in E.fold_counts(pipe, rows, range(3), label="k").collect():
        at = (r["fold"], r["label"])
        want = max(n[at], {0: 200, 1: 120, 2: 0}[r["label"]]) if r["part"] == "train" else held[at]
        assert (r["n"], r["n_synthetic"]) == (want, want - n[at] if r["part"] == "train" else 0)
    model = pipe.fit(rows)
    assert len(model.stages) == 1 and model.transform(rows).count() == 300


def test_targets_are_searched(rows):
    resampler, lr = E.Resampler(labelCol="k"), E.PenalisedLogistic(labelCol="k", maxIter=10)
    space = {resampler.targets: [E.Resampler.counts({0: 150}), E.Resampler.counts({0: 180})], lr.inverseStrength: [1.0]}
    found = M.grid_search(E.TrainingPipeline(stages=[resampler, lr]), rows, space, 3, label="k", parallelism=1)
    tried = [json.loads(json.loads(r["params"])["targets"]) for r in found.trials.orderBy("trial").collect()]
    assert tried == [{"0": 150}, {"0": 180}] and found.score > 0.5
    with pytest.raises(TypeError):
        resampler.fit(rows)


def test_penalised_logistic_follows_the_rows_it_is_fitted_on(rows):
    for penalty, mix in (("l1", 1.0), ("l2", 0.0), ("elasticnet", 0.3)):
        own = E.PenalisedLogistic(inverseStrength=0.5, penalty=penalty, l1Ratio=0.3, maxIter=30).fit(rows)
        assert own.getRegParam() == 1.0 / (0.5 * 300) and own.getElasticNetParam() == mix


def test_list_spaces_are_drawn_without_repeats_and_whole():
    b = E.BoosterOfClasses()
    space = {b.maxDepth: [2, 3, 4], b.maxIter: [50, 100, 200], b.minInstancesPerNode: [20, 50, 100], b.stepSize: [0.01, 0.1]}
    key = lambda m: tuple(sorted((p.name, v) for p, v in m.items()))
    every = [key(m) for m in M.grid_params(space)]
    assert len(set(every)) == len(every) == 54
    for n in (1, 10, 53, 54, 500):
        drawn = [key(m) for m in M.draw_params(space, n)]
        assert len(set(drawn)) == len(drawn) == min(n, 54) and set(drawn) <= set(every)
    assert drawn != every and M.draw_params(space, 9, seed=1) != M.draw_params(space, 9, seed=2)
    assert len(M.draw_params({b.maxDepth: range(1000), b.maxIter: range(10**6)}, 3000)) == 3000


def test_split_importance(rows):
    model = M.fit_gbt(rows.select("a", "b", "label"), M.Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")]), rounds=3, depth=2)
    out = {r["feature"]: r for r in M.feature_importance(model, ["a", "b"]).collect()}
    lines = [x.strip() for x in model.stages[-1].toDebugString.splitlines() if x.strip().startswith("If (feature ")]
    assert [out[n]["splits"] for n in "ab"] == [sum(x.startswith(f"If (feature {i} ") for x in lines) for i in (0, 1)]
    assert np.allclose([out[n]["gain"] for n in "ab"], model.stages[-1].featureImportances.toArray())
    assert out["a"]["mean_gain"] > 0 and out["a"]["cover"] <= 300


def test_tuned_booster_refits_the_best_map_with_its_rounds(rows):
    booster = M.gbt(rounds=4, depth=2, rate=0.4)
    maps = M.grid_params({booster.maxDepth: [1, 3]})
    found = B.tuned_booster(booster, rows, maps, 2, metric="log_loss", patience=2)
    trials = found.trials.orderBy("trial").collect()
    alone = [B.cv_rounds(booster.copy(m), rows, 2, metric="log_loss", patience=2) for m in maps]
    assert [(t["rounds"], t["score"]) for t in trials] == [(a.rounds, a.score) for a in alone]
    best = min(trials, key=lambda t: t["score"])
    assert best["best"] and sum(t["best"] for t in trials) == 1 and json.loads(best["params"]) == found.params
    assert found.model.stages[-1].getNumTrees == found.rounds == best["rounds"]
    assert found.model.stages[-1].trees[0].depth <= found.params["maxDepth"]
    with pytest.raises(ValueError):
        B.tuned_booster(booster, rows, [], 2)
