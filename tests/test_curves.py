import math
import random

import numpy as np
import pytest

from cohortry.operators import curves as C


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    rows = [(i, int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(400)]
    return spark.createDataFrame(rows, "id bigint, label int, score double").repartition(6), rows


def brute(rows):
    out = []
    for t in sorted({s for _, _, s in rows}, reverse=True):
        tp = sum(y for _, y, s in rows if s >= t)
        out.append((t, tp, sum(1 for _, y, s in rows if s >= t) - tp))
    return out


def test_counts_at_every_threshold(scored):
    df, rows = scored
    got = sorted(((r["threshold"], r["tp"], r["fp"]) for r in C.cumulative_counts(df).collect()), reverse=True)
    assert got == brute(rows)
    full = C.roc_curve(df, drop_intermediate=False)
    assert full.count() == len(got)
    assert C.roc_curve(df).count() <= len(got)


def test_areas(scored):
    df, rows = scored
    curve = brute(rows)
    p, n = curve[-1][1], curve[-1][2]
    tpr, fpr = np.array([0] + [c[1] for c in curve]) / p, np.array([0] + [c[2] for c in curve]) / n
    precision = np.array([1.0] + [c[1] / (c[1] + c[2]) for c in curve])
    row = C.curve_areas(df).first()
    assert row["roc_auc"] == pytest.approx(np.trapezoid(tpr, fpr))
    assert row["pr_auc"] == pytest.approx(np.trapezoid(precision, tpr))
    assert row["average_precision"] == pytest.approx((np.diff(tpr) * precision[1:]).sum())
    assert row["no_skill"] == pytest.approx(p / 400)
    pairs = [(a, b) for _, ya, a in rows if ya for _, yb, b in rows if not yb]
    assert row["roc_auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))


def test_best_points(scored):
    df, rows = scored
    curve = brute(rows)
    p, n = curve[-1][1], curve[-1][2]
    g = C.best_gmean(C.roc_curve(df, drop_intermediate=False)).first()
    assert g["gmean"] == pytest.approx(max(math.sqrt(tp / p * (1 - fp / n)) for _, tp, fp in curve))
    f = C.best_fscore(C.pr_curve(df)).first()
    assert f["fscore"] == pytest.approx(max(2 * tp / (tp + fp + p) for _, tp, fp in curve))


def test_collinear_points_are_dropped(spark):
    df = spark.createDataFrame([(i, 1, 1.0 - i / 10) for i in range(5)] + [(9, 0, 0.1)], "id int, label int, score double")
    assert sorted(r["threshold"] for r in C.roc_curve(df).collect()) == pytest.approx([0.1, 0.6, 1.0])


@pytest.mark.parametrize("n", [7, 20, 41])
def test_gains_cut_offs(spark, n):
    rows = [(i, int(i % 3 == 0), 0.5) for i in range(n)]  # all tied: the smaller id comes first
    got = sorted((tuple(r) for r in C.gains_lift(spark.createDataFrame(rows, "id int, label int, score double")).select("fraction", "k", "tp").collect()))
    assert [k for _, k, _ in got] == [-(-i * n // 20) for i in range(1, 21)]
    assert [tp for *_, tp in got] == [sum(y for _, y, _ in rows[:k]) for _, k, _ in got]


def test_a_score_at_the_threshold_is_negative(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.51), (3, 0, 0.6), (4, 0, None)], "id int, label int, score double")
    r = C.confusion(df, 0.5).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"], r["contacted"], r["found_by_chance"]) == (1, 1, 1, 1, 2, 1)


def test_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label int, prediction int")
    per = {r["class"]: r for r in C.class_metrics(df).collect()}
    assert per[1]["precision"] == 0 and per[1]["f1"] == 0 and per[0]["recall"] == 1
    w = C.multiclass_metrics(df).first()
    assert w["recall"] == pytest.approx(0.75) and w["precision"] == pytest.approx((2 * 2 / 3 + 0 + 1) / 4)


def test_multiclass_auc_against_pairs(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, [round(rng.random(), 1) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, label int, probability array<double>")

    def auc(positive, negative):
        pairs = [(a, b) for a in positive for b in negative]
        return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)

    def column(k, labels):
        return [p[k] for _, y, p in rows if y in labels]

    ovr = sum(auc(column(k, {k}), column(k, {0, 1, 2} - {k})) for k in range(3)) / 3
    ovo = sum((auc(column(a, {a}), column(a, {b})) + auc(column(b, {b}), column(b, {a}))) / 2 for a, b in ((0, 1), (0, 2), (1, 2))) / 3
    assert C.auc_ovr(df, 3).first()[0] == pytest.approx(ovr)
    assert C.auc_ovo(df, 3).first()[0] == pytest.approx(ovo)
