"""Donor feature queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cohortry.catalog.book import Book, rounded, with_views
from cohortry.functions.scalar import cut, days_between
from cohortry.operators.relational import bucket_max, check_agreement, check_rows, derive_label, label_population, rule_precision_recall, segment_overlap
from cohortry.operators.windows import backward_cumulative
from cohortry.plans import donors as D
from cohortry.plans.presets import BUCKET_EDGES, BUCKET_LABELS
from cohortry.sources import views as V

BOOK = Book()
ON = dt.date(2000, 8, 1)
UNTIL = dt.date(2001, 7, 31)
CUT = 500_000

LABELS = """, labels_ AS (
  SELECT c_custkey AS candidate_id, coalesce(amount, 0) AS amount, coalesce(target, 0) AS target FROM customer LEFT JOIN (
    SELECT candidate_id, SUM(amount) AS amount, CASE WHEN SUM(amount) >= 500000 THEN 1 ELSE 0 END AS target FROM donations
    WHERE trans_date > DATE '2000-08-01' AND trans_date < DATE '2001-07-31' AND NOT (amount < 0) GROUP BY candidate_id) d ON c_custkey = candidate_id)"""

BUCKETS = LABELS + """, days AS (
  SELECT d.candidate_id, trans_date, COUNT(*) AS n, SUM(d.amount) AS amount FROM donations d
  WHERE d.candidate_id IN (SELECT candidate_id FROM labels_) AND trans_date <= DATE '2000-08-01' AND year(trans_date) >= 1950 GROUP BY d.candidate_id, trans_date),
back AS (
  SELECT *, CAST(SUM(n) OVER w AS BIGINT) AS cum_count, SUM(amount) OVER w AS cum_sum,
         CASE WHEN trans_date - DATE '2000-08-01' <= -1825 THEN 'donation_historical' WHEN trans_date - DATE '2000-08-01' <= -1460 THEN 'donation_p5yr'
              WHEN trans_date - DATE '2000-08-01' <= -1095 THEN 'donation_p4yr' WHEN trans_date - DATE '2000-08-01' <= -730 THEN 'donation_p3yr'
              WHEN trans_date - DATE '2000-08-01' <= -365 THEN 'donation_p2yr' WHEN trans_date - DATE '2000-08-01' <= 0 THEN 'donation_p1yr' END AS time_bucket
  FROM days WINDOW w AS (PARTITION BY candidate_id ORDER BY trans_date DESC)),
per_bucket AS (SELECT candidate_id, time_bucket, MAX(cum_sum) AS cum_sum, MAX(cum_count) AS cum_count FROM back GROUP BY candidate_id, time_bucket)"""


def _kept(b: str, v: str) -> str:
    return f"coalesce(MAX({v}) FILTER (WHERE time_bucket = '{b}'), 0)"


KEPT = ("donation_p2yr", "donation_p5yr", "donation_historical")
WIDE = BUCKETS + ", wide AS (SELECT candidate_id, " + ", ".join(
    f"{_kept(b, 'cum_sum')} AS {b}_cum_sum, {_kept(b, 'cum_count')} AS {b}_cum_count" for b in KEPT) + " FROM per_bucket GROUP BY candidate_id)"


def _labels(spark, folder):
    customers = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("candidate_id"))
    return label_population(customers, derive_label(V.donations(spark, folder), "candidate_id", "trans_date", "amount", ON, UNTIL, CUT), "candidate_id")


@BOOK.add("derive_label", with_views("donations") + LABELS + " SELECT candidate_id, round(amount, 2) AS amount, target FROM labels_")
def derive_labels(spark, folder):
    return rounded(_labels(spark, folder), 2)


@BOOK.add("label_agreement", with_views("donations") + LABELS + " SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE target <> (CASE WHEN amount >= 400000 THEN 1 ELSE 0 END)) AS n_different FROM labels_")
def label_agreement(spark, folder):
    return check_agreement(_labels(spark, folder).withColumn("other", (F.col("amount") >= 400_000).cast("int")), "target", "other")


@BOOK.add("rows_kept_by_join", with_views("donations", "attributes") + """
SELECT (SELECT COUNT(*) FROM donations) AS n_before, COUNT(*) AS n_after, COUNT(*) = (SELECT COUNT(*) FROM donations) AS rows_kept
FROM donations d LEFT JOIN attributes a ON d.candidate_id = a.candidate_id""")
def rows_kept(spark, folder):
    d = V.donations(spark, folder)
    return check_rows(d, d.join(V.attributes(spark, folder), "candidate_id", "left"))


@BOOK.add("cut_buckets", with_views("donations") + LABELS + """ SELECT candidate_id, trans_date, amount,
 CASE WHEN trans_date - DATE '2000-08-01' <= -1825 THEN 'donation_historical' WHEN trans_date - DATE '2000-08-01' <= -1460 THEN 'donation_p5yr'
      WHEN trans_date - DATE '2000-08-01' <= -1095 THEN 'donation_p4yr' WHEN trans_date - DATE '2000-08-01' <= -730 THEN 'donation_p3yr'
      WHEN trans_date - DATE '2000-08-01' <= -365 THEN 'donation_p2yr' WHEN trans_date - DATE '2000-08-01' <= 0 THEN 'donation_p1yr' END AS time_bucket FROM donations""")
def cut_buckets(spark, folder):
    return V.donations(spark, folder).withColumn("time_bucket", cut(days_between("trans_date", F.lit(ON)), BUCKET_EDGES, BUCKET_LABELS))


@BOOK.add("backward_cumulative", with_views("donations") + """, days AS (SELECT candidate_id, trans_date, COUNT(*) AS n, SUM(amount) AS amount FROM donations GROUP BY candidate_id, trans_date)
SELECT candidate_id, trans_date, n, round(amount, 2) AS amount, CAST(SUM(n) OVER w AS BIGINT) AS cum_count, round(SUM(amount) OVER w, 2) AS cum_sum
FROM days WINDOW w AS (PARTITION BY candidate_id ORDER BY trans_date DESC)""")
def backward(spark, folder):
    return rounded(backward_cumulative(V.donations(spark, folder), "candidate_id", "trans_date", "amount"), 2)


@BOOK.add("bucket_max", with_views("donations") + BUCKETS + " SELECT candidate_id, time_bucket, round(cum_sum, 2) AS cum_sum, cum_count FROM per_bucket")
def bucket_maxima(spark, folder):
    rows = D.bucketed_donations(V.donations(spark, folder), _labels(spark, folder), ON)
    return rounded(bucket_max(rows, ["candidate_id", "time_bucket"], ["cum_sum", "cum_count"]), 2)


@BOOK.add("pivot_buckets", with_views("donations") + WIDE + " SELECT candidate_id, " + ", ".join(f"round({b}_cum_sum, 2) AS {b}_cum_sum, {b}_cum_count" for b in KEPT) + " FROM wide")
def pivoted(spark, folder):
    rows = D.bucketed_donations(V.donations(spark, folder), _labels(spark, folder), ON)
    per = bucket_max(rows, ["candidate_id", "time_bucket"], ["cum_sum", "cum_count"])
    return rounded(D.pivot_buckets(per, "candidate_id", "time_bucket", KEPT, ["cum_sum", "cum_count"]), 2)


@BOOK.add("bucket_features", with_views("donations", "attributes") + WIDE + " SELECT l.candidate_id, l.target, " + ", ".join(
    f"round({b}_cum_sum, 2) AS {b}_cum_sum, {b}_cum_count, round(CASE WHEN w.candidate_id IS NULL THEN NULL WHEN {b}_cum_count = 0 THEN 0 ELSE {b}_cum_sum / {b}_cum_count END, 7) AS {b}_cum_avg" for b in KEPT) + """,
 totalHouseholdDebt, primaryPropertyLoanToValue, primaryPropertyValue, propertyCount, NetWorth, isClassADonor, isClassBDonor, isClassCDonor, isClassDDonor
FROM labels_ l LEFT JOIN wide w ON l.candidate_id = w.candidate_id LEFT JOIN attributes a ON a.candidate_id = w.candidate_id""")
def bucket_features(spark, folder):
    out = D.bucket_features(_labels(spark, folder), V.donations(spark, folder), V.attributes(spark, folder), ON)
    return rounded(out, 2, **{f"{b}_cum_avg": 7 for b in KEPT})


def _window(k: int) -> str:
    return f"trans_date - DATE '2000-08-01' >= {-360 * k} AND trans_date - DATE '2000-08-01' < {-360 * (k - 1)}"


LOOKBACK = ", back AS (SELECT candidate_id, " + ", ".join(
    f"COUNT(*) FILTER (WHERE {_window(k)}) AS count_trans_date_prev360d{k}, coalesce(SUM(amount) FILTER (WHERE {_window(k)}), 0) AS amount_prev360d{k}" for k in range(1, 6)
) + " FROM donations GROUP BY candidate_id)"


def _sum(prefix: str, n: int) -> str:
    return " + ".join(f"{prefix}_prev360d{k}" for k in range(1, n + 1))


@BOOK.add("lookback", with_views("donations") + LOOKBACK + " SELECT candidate_id, " + ", ".join(
    f"count_trans_date_prev360d{k}, round(amount_prev360d{k}, 2) AS amount_prev360d{k}" for k in range(1, 6)) + f""",
 {_sum('count_trans_date', 5)} AS count_trans_date_prev5y, {_sum('count_trans_date', 2)} AS count_trans_date_prev2y,
 round({_sum('amount', 5)}, 2) AS amount_prev5y, round({_sum('amount', 2)}, 2) AS amount_prev2y FROM back""")
def lookback(spark, folder):
    return rounded(D.lookback(V.donations(spark, folder), ON), 2)


PROPERTY = """, property AS (
 SELECT candidate_id, primaryPropertyValue, propertyCount, NetWorth, CASE WHEN primaryPropertyLoanToValue <= 0.8 THEN 1 ELSE 0 END AS primaryPropertyLoanToValue_ideal,
        1.0 - primaryPropertyLoanToValue AS primaryPropertyValueDownpayment_fraction, primaryPropertyValue / NetWorth AS primaryPropertyValueToNetWorth_ratio,
        primaryPropertyLoanToValue * primaryPropertyValue AS LoanAmount
 FROM attributes WHERE NetWorth IS NOT NULL)"""
PROPERTY_OUT = """candidate_id, primaryPropertyValue, propertyCount, NetWorth, primaryPropertyLoanToValue_ideal,
 round(primaryPropertyValueDownpayment_fraction, 6) AS primaryPropertyValueDownpayment_fraction,
 round(primaryPropertyValueToNetWorth_ratio, 6) AS primaryPropertyValueToNetWorth_ratio, round(LoanAmount, 6) AS LoanAmount"""


@BOOK.add("property_features", with_views("attributes") + PROPERTY + f" SELECT {PROPERTY_OUT} FROM property")
def property_features(spark, folder):
    return rounded(D.property_features(V.attributes(spark, folder)))


@BOOK.add("training_frame", with_views("donations", "attributes") + LABELS + LOOKBACK + PROPERTY + f"""
SELECT l.target, p.{PROPERTY_OUT}, count_trans_date_prev360d1, count_trans_date_prev360d2, round(amount_prev360d1, 4) AS amount_prev360d1, round(amount_prev360d3, 4) AS amount_prev360d3,
 {_sum('count_trans_date', 5)} AS count_trans_date_prev5y, round({_sum('amount', 5)}, 4) AS amount_prev5y,
 round(amount_prev360d3 / NetWorth, 4) AS amountscaled_prev360d3, round(amount_prev360d5 / NetWorth, 4) AS amountscaled_prev360d5
FROM property p JOIN back b ON p.candidate_id = b.candidate_id LEFT JOIN labels_ l ON l.candidate_id = p.candidate_id""".replace("p.candidate_id,", "p.candidate_id AS candidate_id,", 1))
def training_frame(spark, folder):
    """All columns but the hashed benchmark column, which DuckDB cannot reproduce."""
    f = D.training_frame(V.attributes(spark, folder), V.donations(spark, folder), _labels(spark, folder), ON, "target")
    keep = ["candidate_id", "target", "primaryPropertyValue", "propertyCount", "NetWorth", "primaryPropertyLoanToValue_ideal", "primaryPropertyValueDownpayment_fraction",
            "primaryPropertyValueToNetWorth_ratio", "LoanAmount", "count_trans_date_prev360d1", "count_trans_date_prev360d2", "amount_prev360d1", "amount_prev360d3",
            "count_trans_date_prev5y", "amount_prev5y", "amountscaled_prev360d3", "amountscaled_prev360d5"]
    four = dict.fromkeys(["amount_prev360d1", "amount_prev360d3", "amount_prev5y", "amountscaled_prev360d3", "amountscaled_prev360d5"], 4)
    return rounded(f.select(*keep), 6, **four)


@BOOK.add("rule_precision_recall", with_views("donations") + LABELS + LOOKBACK + f""", c AS (
 SELECT COUNT(*) FILTER (WHERE r AND target = 1) AS tp, COUNT(*) FILTER (WHERE r) AS selected, COUNT(*) FILTER (WHERE target = 1) AS positives, COUNT(*) AS n
 FROM (SELECT target, {_sum('count_trans_date', 5)} > 5 AS r FROM labels_ l JOIN back b ON l.candidate_id = b.candidate_id))
SELECT tp, selected, positives, round(CAST(tp AS DOUBLE) / selected, 6) AS precision, round(CAST(tp AS DOUBLE) / positives, 6) AS recall, round(CAST(positives AS DOUBLE) / n, 6) AS base_rate FROM c""")
def rule_quality(spark, folder):
    f = _labels(spark, folder).join(D.lookback(V.donations(spark, folder), ON), "candidate_id")
    return rounded(rule_precision_recall(f, F.col("count_trans_date_prev5y") > 5, "target"))


@BOOK.add("segment_overlap", with_views("donations", "attributes") + LABELS + """
SELECT COUNT(*) FILTER (WHERE isClassCDonor = 1 AND primaryPropertyValue > 25000) AS n,
       COUNT(*) FILTER (WHERE isClassCDonor = 1 AND primaryPropertyValue > 25000 AND target = 1) AS n_positive
FROM labels_ l JOIN attributes a ON l.candidate_id = a.candidate_id""")
def overlap(spark, folder):
    f = _labels(spark, folder).join(V.attributes(spark, folder), "candidate_id").withColumn("valuable", (F.col("primaryPropertyValue") > 25000).cast("int"))
    return segment_overlap(f, ["isClassCDonor", "valuable"], "target")


@BOOK.add("dropna_any", with_views("attributes") + " SELECT * FROM attributes WHERE NetWorth IS NOT NULL")
def dropna_any(spark, folder):
    return V.attributes(spark, folder).dropna(how="any")


@BOOK.add("fill_and_rename", with_views("attributes") + " SELECT candidate_id AS cand_id, coalesce(NetWorth, 0) AS NetWorth, propertyCount FROM attributes")
def fill_and_rename(spark, folder):
    return V.attributes(spark, folder).drop("no_such_column").withColumnsRenamed({"candidate_id": "cand_id"}).fillna(0, ["NetWorth"]).select("cand_id", "NetWorth", "propertyCount")
