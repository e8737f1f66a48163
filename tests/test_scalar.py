import pytest
from pyspark.sql import functions as F

from cohortry.functions import scalar as S
from cohortry.plans import bias as B
from cohortry.plans.presets import BUCKET_EDGES, BUCKET_LABELS


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize("days, label", [
    (-365, "donation_p2yr"), (-364, "donation_p1yr"), (0, "donation_p1yr"), (1, None), (-366, "donation_p2yr"),
    (-1825, "donation_historical"), (-1824, "donation_p5yr"), (None, None)])
def test_bins_are_right_closed(spark, days, label):
    assert one(spark, S.cut("d", BUCKET_EDGES, BUCKET_LABELS), [(days,)], "d int") == [label]


def test_argmax_is_strict_and_null_safe(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2), (0.4, 0.4, 0.2), (0.1, 0.2, 0.7), (0.9, None, 0.1)], "a double, b double, c double")
    got = [tuple(r) for r in df.select(*S.argmax_onehot(["a", "b", "c"], ["x", "y", "z"])).collect()]
    assert got == [(1, 0, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.7, 0.1), (0.71, 0.1), (None, 0.8)], "a double, b double")
    got = [(r["x"], r["y"], r["other"], r["race"]) for r in B.threshold_classes(df, ["a", "b"], ["x", "y"]).collect()]
    assert got == [(0, 0, 1, "other"), (1, 0, 0, "x"), (0, 1, 0, "y")]


def test_ratio_and_logs(spark):
    assert one(spark, S.ratio("a", "b"), [(1.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double") == [None, 0.25, None]
    df = S.log1p10(spark.createDataFrame([(9.0, 1.0), (-1.0, 1.0)], "a double, b double"), ["a", "b"], exclude=["b"])
    assert df.columns == ["a", "b", "log_a"]
    assert [r["log_a"] for r in df.collect()] == [1.0, None]


def test_ordinal_and_recode(spark):
    assert one(spark, S.ordinal("a", ["Low", "High"]), [("Low",), ("High",), ("x",), (None,)], "a string") == [0, 1, None, None]


def test_codes(spark):
    assert one(spark, S.tract_code("a"), [("1001020100",), ("51001020100",), (None,)], "a string") == ["01001020100", "51001020100", None]
    assert one(spark, S.county_of("a"), [("01001020100",)], "a string") == ["001"]


def test_hard_prediction_takes_the_first_largest(spark):
    i, top = S.hard_prediction("p")
    assert [tuple(r) for r in spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>").select(i, top).collect()] == [(1, 0.4)]


def test_hashes_are_uniform_and_fixed(spark):
    df = spark.range(4000).select(S.unit_hash("id", seed=1).alias("u"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.03
    assert df.collect() == df.collect()


def test_column_choice(spark):
    df = spark.createDataFrame([(1, "a", 2.0, "b")], "id int, isClassA string, NetWorth double, topCause string")
    assert S.select_by_name(df, include=["Class", "Cause"]).columns == ["isClassA", "topCause"]
    assert S.select_by_name(df, exclude=["Class", "Cause"]).columns == ["id", "NetWorth"]
    assert S.columns_of(df, "number", ["id"]) == ["NetWorth"]


def test_posterior_falls_back_on_the_default_prior(spark):
    df = spark.createDataFrame([(1, "ng", "A"), (2, "zz", "A"), (3, "ng", "B")], "id int, surname string, place string")
    names = spark.createDataFrame([("ng", 0.8, 0.2)], "surname string, prior_u double, prior_v double")
    places = spark.createDataFrame([("A", 0.1, 0.3)], "place string, given_u double, given_v double")
    out = {r["id"]: r for r in B.posterior(df, names, places, (0.5, 0.5), ("u", "v"), place=("place",)).collect()}
    assert out[1]["pred_u"] == pytest.approx(0.08 / 0.14) and out[1]["surname_matched"] == 1
    assert out[2]["pred_u"] == pytest.approx(0.25) and out[2]["surname_matched"] == 0
    assert out[3]["pred_u"] is None


def test_equal_averages_are_ties_in_any_order(spark):
    rows = [(m, *p) for m in range(40) for p in ((0.1, 0.2, 0.7), (0.2, 0.7, 0.1), (0.7, 0.1, 0.2))]
    df = spark.createDataFrame(rows, "member_id int, a double, b double, c double").repartition(9)
    out = B.average_and_classify(df, columns=["a", "b", "c"], names=["x", "y", "z"])
    assert {(r["x"], r["y"], r["z"]) for r in out.collect()} == {(0, 0, 0)}
    assert out.columns == ["member_id", "a_avg", "b_avg", "c_avg", "x", "y", "z"]
