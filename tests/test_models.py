import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortry.operators import curves as C
from cohortry.operators import modelling as M
from cohortry.operators.importance import _shuffled, permutation_importance
from cohortry.operators.splits import kfold_column
from cohortry.sources import io


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice(["x", "y", "z"])
        y = float(a + (c == "x") + rng.gauss(0, 0.3) > 0.3)
        k = float((a > 0.4) + (a > -0.4))
        data.append((i, a, b if i % 9 else None, c if i % 13 else None, i % 2, float(10 ** (i % 4)), y, k))
    return spark.createDataFrame(data, "id bigint, a double, b double, c string, f int, skewed double, label double, k double").cache()


def transform(rows):
    return M.feature_pipeline(M.plan_features(rows, ["id", "label", "k"], logs=["skewed"]), rows.count())


def test_plan_and_transform(spark, rows):
    plan = M.plan_features(rows, ["id", "label", "k"], logs=["skewed"])
    assert (plan.numbers, plan.texts, plan.flags, plan.logs) == (["a", "b"], ["c"], ["f"], ["skewed"])
    model = transform(rows).fit(rows)
    assert M.feature_names(model) == ["num__a", "num__b", "log__skewed", "hot__c_-9999", "hot__c_x", "hot__c_y", "hot__c_z", "bin__f"]
    x = np.array([r[0] for r in model.transform(rows).select(vector_to_array("features")).collect()])
    assert np.allclose(x[:, :3].mean(axis=0), 0, atol=1e-9) and np.allclose(x[:, :3].std(axis=0), 1)
    unseen = rows.limit(1).withColumn("c", F.lit("new"))
    assert model.transform(unseen).select(vector_to_array("features")).first()[0][3:7] == [0, 0, 0, 0]


def test_booster_beats_chance_and_survives_saving(spark, rows, tmp_path):
    model = M.fit_gbt(M.class_weights(rows, "label", 2.0), transform(rows), rounds=8, depth=2, weight="weight")
    s = M.scored(model, rows, "id", "label")
    assert C.curve_areas(s).first()["roc_auc"] > 0.9
    io.save_artifact(model, rows.limit(50), str(tmp_path / "m"))
    loaded, held = io.load_artifact(spark, str(tmp_path / "m"))
    assert held.count() == 50
    assert {r["id"]: r["score"] for r in M.scored(loaded, rows, "id", "label").collect()} == {r["id"]: r["score"] for r in s.collect()}
    imp = M.feature_importance(model, M.feature_names(model)).collect()
    assert max(imp, key=lambda r: r["gain"])["feature"] == "num__a"
    assert [r["splits"] for r in imp] == sorted(r["splits"] for r in imp) and imp[-1]["splits"] > 0


def test_early_stopping_keeps_fewer_rounds(rows):
    noise = rows.withColumn("label", (F.xxhash64("id") % 2 == 0).cast("double")).withColumn("held", F.col("id") % 3 == 0)
    model = M.fit_gbt(noise, transform(noise.drop("held")), rounds=25, depth=3, validation="held")
    assert M.rounds_used(model) < 25


def test_multiclass_probabilities_add_up(rows):
    model = M.fit_gbt_multiclass(rows, 3, label="k", transform=transform(rows), rounds=4, depth=2)
    out = M.scored_multiclass(model, rows, "id", "k")
    assert C.multiclass_metrics(out).first()["f1"] > 0.8
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out.collect())


def test_lr_coefficients(spark, rows):
    model = M.fit_lr(rows, transform(rows), c=10.0, penalty="l2", rounds=40)
    top = M.top_coefficients(model, M.feature_names(model), 3).collect()
    assert len(top) == 3 and top[-1]["feature"] == "num__a" and [r["coefficient"] for r in top] == sorted(r["coefficient"] for r in top)


def test_search_and_nested_cv(rows):
    data = kfold_column(kfold_column(rows, "label", "id", 2, seed=3, name="outer_fold"), "label", "id", 3)
    stages = transform(rows).getStages()
    lr = M.logistic(rows.count(), rounds=10)
    space = {lr.regParam: [10.0, 0.001], lr.elasticNetParam: [0.0]}
    est = M.Pipeline(stages=[*stages, lr])
    found = M.random_search(est, data, space, 2, 3)
    assert found.params["regParam"] == 0.001 and found.trials.where("best").count() == 1
    scores = M.nested_cv(est, data, space, 2, 2, 3, metric="average_precision")
    assert M.score_summary(scores).first()["mean"] > 0.8


def test_drawn_parameters_lie_in_their_space():
    lr = M.logistic(10)
    maps = M.draw_params({lr.regParam: M.Uniform(1e-4, 1.0, log=True), lr.maxIter: M.Uniform(2, 3, whole=True)}, 20)
    assert len(maps) == 20 and all(1e-4 <= m[lr.regParam] <= 1 and m[lr.maxIter] in (2, 3) for m in maps)
    assert len(M.draw_params({lr.maxIter: [1, 2]}, 10)) == 2


def test_regression(rows):
    model = M.fit_gbt_regressor(rows, transform(rows), label="a", rounds=5)
    assert M.regression_errors(model.transform(rows), "a").first()["r2"] > 0.8


def test_shuffle_is_a_permutation_without_fixed_points(rows):
    out = _shuffled(rows.select("id", "a"), "id", ["a"], 1).collect()
    assert len(out) == 400 and sorted(r["a"] for r in out) == sorted(r["_d_a"] for r in out)
    assert all(r["a"] != r["_d_a"] for r in out)


def test_permutation_importance(rows):
    model = M.fit_lr(rows, transform(rows), label="label", rounds=30)
    out = permutation_importance(model.transform, rows, "id", "label", ["a", "b", "c", "f", "skewed"], repeats=3).collect()
    assert out[-1]["feature"] == "a" and out[-1]["importance"] > 0.1
    assert abs({r["feature"]: r["importance"] for r in out}["b"]) < 0.05
