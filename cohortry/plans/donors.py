"""Donor features and training frames.

Donations: ``candidate_id, trans_date, amount``.  Labels: ``candidate_id`` and a 0/1 target.
Attributes: ``candidate_id`` and the columns of ``presets.PROPERTY_COLUMNS``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalar import cut, days_between, flag, random_benchmark, ratio
from cohortry.operators.relational import bucket_max, cum_avg, pivot_buckets
from cohortry.operators.windows import backward_cumulative
from cohortry.plans.presets import BUCKET_EDGES, BUCKET_LABELS, FIRST_YEAR, IDEAL_LOAN_TO_VALUE, KEPT_BUCKETS, PROPERTY_COLUMNS

ID = "candidate_id"


def bucketed_donations(donations: DataFrame, labels: DataFrame, on: dt.date, first_year: int = FIRST_YEAR) -> DataFrame:
    """Donations of labelled candidates up to ``on``, cumulated backwards, with their bucket.

    One row per candidate and day (see ``backward_cumulative``).
    """
    kept = donations.where((F.year("trans_date") >= first_year) & (F.col("trans_date") <= F.lit(on)))
    kept = kept.join(labels.select(ID), ID, "left_semi")
    back = backward_cumulative(kept, ID, "trans_date", "amount")
    days = days_between("trans_date", F.lit(on))
    return back.withColumn("time_bucket", cut(days, BUCKET_EDGES, BUCKET_LABELS))


def bucket_features(labels: DataFrame, donations: DataFrame, attributes: DataFrame, on: dt.date, target: str = "target", attributes_for_all: bool = False) -> DataFrame:
    """Cumulative count, sum and average per time bucket, beside the attributes.

    Buckets are not carried forward: one without a donation is 0.  A candidate with no
    donation up to ``on`` gets NULL features and, as the attributes hang on the donation
    side, NULL attributes; ``attributes_for_all`` joins them to every candidate instead.
    """
    per_bucket = bucket_max(bucketed_donations(donations, labels, on), [ID, "time_bucket"], ["cum_sum", "cum_count"])
    wide = pivot_buckets(per_bucket, ID, "time_bucket", KEPT_BUCKETS, ["cum_sum", "cum_count"])
    wide = wide.withColumns({f"{b}_cum_avg": cum_avg(F.col(f"{b}_cum_sum"), F.col(f"{b}_cum_count")) for b in KEPT_BUCKETS})
    base = labels.select(ID, target)
    if attributes_for_all:
        return base.join(wide, ID, "left").join(attributes, ID, "left")
    return base.join(wide.join(attributes, ID, "left"), ID, "left")


def lookback(donations: DataFrame, on: dt.date, width: int = 360, windows: int = 5) -> DataFrame:
    """Count and amount in each look-back window [-width*k, -width*(k-1)), in one aggregate.

    Also their sums over all windows (``prev5y``) and the two newest (``prev2y``).
    """
    d = donations.dropna(how="any")
    days = days_between("trans_date", F.lit(on))
    aggs = []
    for k in range(1, windows + 1):
        inside = (days >= -width * k) & (days < -width * (k - 1))
        aggs.append(F.count_if(inside).alias(f"count_trans_date_prev{width}d{k}"))
        aggs.append(F.sum(F.when(inside, F.col("amount")).otherwise(F.lit(0.0))).alias(f"amount_prev{width}d{k}"))
    out = d.groupBy(ID).agg(*aggs)

    def over(prefix: str, n: int):
        return reduce(lambda a, b: a + b, [F.col(f"{prefix}_prev{width}d{k}") for k in range(1, n + 1)])

    return out.withColumns({
        f"{prefix}_prev{n}y": over(prefix, n) for prefix in ("count_trans_date", "amount") for n in (windows, 2)
    })


def property_features(attributes: DataFrame, columns: Sequence[str] = PROPERTY_COLUMNS) -> DataFrame:
    """Rows without any NULL, with loan flag, loan amount and property to net worth."""
    out = attributes.dropna(how="any").select(ID, *columns)
    loan, value = F.col("primaryPropertyLoanToValue"), F.col("primaryPropertyValue")
    return out.withColumns({
        "primaryPropertyLoanToValue_ideal": flag(loan <= IDEAL_LOAN_TO_VALUE),
        "primaryPropertyValueDownpayment_fraction": F.lit(1.0) - loan,
        "primaryPropertyValueToNetWorth_ratio": ratio(value, "NetWorth"),
        "LoanAmount": loan * value,
    }).drop("totalHouseholdDebt", "primaryPropertyLoanToValue")


def scaled_amounts(df: DataFrame, names: Sequence[str], worth: str = "NetWorth") -> DataFrame:
    """``amountscaled_<window>`` = amount over net worth, NULL where that is zero."""
    return df.withColumns({f"amountscaled_{n}": ratio(f"amount_{n}", worth) for n in names})


def training_frame(attributes: DataFrame, donations: DataFrame, labels: DataFrame, on: dt.date, target: str = "ideal_donor", seed: int = 42) -> DataFrame:
    """Property and look-back features of candidates that have both, with their label."""
    features = property_features(attributes).join(lookback(donations, on), ID)
    features = scaled_amounts(random_benchmark(features, ID, seed), ["prev360d3", "prev360d5"])
    return features.join(labels.select(ID, target), ID, "left")
