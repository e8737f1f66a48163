import datetime as dt

import pytest

from cohortry.operators.relational import check_agreement, derive_label, label_population
from cohortry.plans import donors as D

ON = dt.date(2016, 1, 1)
DONATION = "candidate_id int, trans_date date, amount double"


def donated(spark, days_and_amounts, who=1):
    return spark.createDataFrame([(who, ON + dt.timedelta(days=d), float(a)) for d, a in days_and_amounts], DONATION)


def features(spark, rows, **options):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "candidate_id int, target int")
    attributes = spark.createDataFrame([(1, 9.0), (2, 8.0)], "candidate_id int, NetWorth double")
    return {r["candidate_id"]: r for r in D.bucket_features(labels, donated(spark, rows), attributes, ON, **options).collect()}


def test_buckets_do_not_carry_forward(spark):
    out = features(spark, [(-10, 100)])[1]
    for b in D.KEPT_BUCKETS:
        assert (out[f"{b}_cum_sum"], out[f"{b}_cum_count"], out[f"{b}_cum_avg"]) == (0, 0, 0)


def test_cumulates_backwards_with_same_day_peers(spark):
    out = features(spark, [(-10, 100), (-400, 50), (-400, 30), (-1600, 7), (-5000, 3)])[1]
    assert (out["donation_p2yr_cum_sum"], out["donation_p2yr_cum_count"], out["donation_p2yr_cum_avg"]) == (180, 3, 60)
    assert (out["donation_p5yr_cum_sum"], out["donation_p5yr_cum_count"]) == (187, 4)
    assert (out["donation_historical_cum_sum"], out["donation_historical_cum_count"], out["donation_historical_cum_avg"]) == (190, 5, 38)


def test_no_donation_gives_null_attributes_unless_asked(spark):
    rows = [(-400, 5), (20, 1000)]  # the later one is after the date
    assert features(spark, rows)[2]["NetWorth"] is None
    assert features(spark, rows, attributes_for_all=True)[2]["NetWorth"] == 8.0
    assert features(spark, rows)[1]["donation_p2yr_cum_sum"] == 5


@pytest.mark.parametrize("days, k", [(-1, 1), (-360, 1), (-361, 2), (-720, 2), (-721, 3), (-1800, 5), (-1801, None), (0, None), (5, None)])
def test_lookback_edges(spark, days, k):
    out = D.lookback(donated(spark, [(days, 10)]), ON).first()
    assert [out[f"count_trans_date_prev360d{i}"] for i in range(1, 6)] == [int(i == k) for i in range(1, 6)]
    assert out["count_trans_date_prev5y"] == int(k is not None)
    assert out["amount_prev2y"] == (10 if k in (1, 2) else 0)


def test_label_rules(spark):
    d = donated(spark, [(0, 50000), (1, 15000), (2, 5000), (3, -900), (10, 50000)])
    out = derive_label(d, "candidate_id", "trans_date", "amount", ON, ON + dt.timedelta(days=10), 20000).collect()
    assert [(r["amount"], r["target"]) for r in out] == [(20000, 1)]
    labels = spark.createDataFrame([(1,), (2,)], "candidate_id int")
    both = label_population(labels, derive_label(d, "candidate_id", "trans_date", "amount", ON, ON + dt.timedelta(days=2), 20000), "candidate_id")
    assert {r["candidate_id"]: r["target"] for r in both.collect()} == {1: 0, 2: 0}


def test_agreement_counts_nulls_as_different(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (None, 0)], "a int, b int")
    assert tuple(check_agreement(df, "a", "b").first()) == (3, 2)


def test_property_features(spark):
    rows = [(1, 1.0, 0.8, 100.0, 1, 50.0), (2, 1.0, 0.81, 100.0, 1, 0.0), (3, None, 0.5, 1.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "candidate_id int, totalHouseholdDebt double, primaryPropertyLoanToValue double, primaryPropertyValue double, propertyCount int, NetWorth double")
    out = {r["candidate_id"]: r for r in D.property_features(df).collect()}
    assert set(out) == {1, 2}
    assert out[1]["primaryPropertyLoanToValue_ideal"] == 1 and out[2]["primaryPropertyLoanToValue_ideal"] == 0
    assert out[1]["primaryPropertyValueToNetWorth_ratio"] == 2 and out[2]["primaryPropertyValueToNetWorth_ratio"] is None
    assert out[1]["LoanAmount"] == pytest.approx(80)
