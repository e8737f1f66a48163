"""Adherence queries: every stage of the possession ratio, and the ratio itself."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cohortry.catalog.book import Book, rounded, with_views
from cohortry.operators.relational import audit, count_distinct, duplicate_audit, unmatched
from cohortry.operators.windows import carry_forward as carry
from cohortry.operators.windows import next_event, running_sum
from cohortry.plans import adherence as A
from cohortry.sources import views as V

BOOK = Book()
END = dt.date(2001, 1, 1)
WINDOW = A.obs_window(END, 1096)
ALL = ("F", "O")


def _trees(spark, folder):
    return [V.crosswalk(spark, folder, (0,)), V.crosswalk(spark, folder, (1, 2))]


def _refills(spark, folder):
    return A.refills_of(A.eligible_claims(V.claims(spark, folder), WINDOW, statuses=ALL), _trees(spark, folder))


def _kept(spark, folder):
    return A.drop_thin_members(_refills(spark, folder))


def _timeline(spark, folder):
    return A.next_supply(A.with_dummies(_kept(spark, folder), END), END)


def _covered(spark, folder):
    return A.covered_timeline(_refills(spark, folder), END)


def _ratios(spark, folder):
    return A.dppr(V.claims(spark, folder), _trees(spark, folder), END, 1096, statuses=ALL)


# The stages as SQL, written the long way: self-joins, interval join, recursion, running maxima.
STAGES = {
    "eligible": """
        SELECT * FROM claims
        WHERE paid_amount >= 0 AND days_supply > 0 AND quantity > 0 AND service_date <= DATE '2000-12-31'
          AND service_date + CAST(trunc(days_supply - 1) AS INTEGER) >= DATE '1998-01-01'""",
    "refills": """
        SELECT member_id, class_id, service_date, MAX(days_supply) AS days_supply
        FROM eligible JOIN crosswalk USING (code) WHERE class_id = 0 GROUP BY member_id, class_id, service_date
        UNION
        SELECT member_id, class_id, service_date, MAX(days_supply) AS days_supply
        FROM eligible JOIN crosswalk USING (code) WHERE class_id IN (1, 2) GROUP BY member_id, class_id, service_date""",
    "thin": "SELECT member_id, class_id, COUNT(*) AS n_fills FROM refills GROUP BY member_id, class_id HAVING COUNT(*) < 4",
    "kept": "SELECT * FROM refills WHERE member_id NOT IN (SELECT member_id FROM thin)",
    "firsts": "SELECT member_id, class_id, MIN(service_date) AS first_date FROM kept GROUP BY member_id, class_id",
    "starts": """
        SELECT DISTINCT member_id, DENSE_RANK() OVER (PARTITION BY member_id ORDER BY first_date) AS period, first_date AS period_start
        FROM firsts""",
    "periods": """
        SELECT a.member_id, a.period, a.period_start, coalesce(b.period_start, DATE '2001-01-01') AS next_period_start
        FROM starts a LEFT JOIN starts b ON a.member_id = b.member_id AND a.period + 1 = b.period""",
    "dummies": """
        SELECT f.member_id, f.class_id, p.period_start AS service_date, CAST(0 AS DOUBLE) AS days_supply
        FROM firsts f JOIN starts p ON f.member_id = p.member_id AND f.first_date < p.period_start
        LEFT JOIN kept k ON k.member_id = f.member_id AND k.class_id = f.class_id AND k.service_date = p.period_start
        WHERE k.member_id IS NULL""",
    "ranked": """
        SELECT *, DENSE_RANK() OVER (PARTITION BY member_id, class_id ORDER BY service_date) AS supply_rank
        FROM (SELECT * FROM kept UNION SELECT * FROM dummies)""",
    "spaced": """
        SELECT a.*, coalesce(b.service_date, DATE '2001-01-01') AS next_date,
               CAST(coalesce(b.service_date, DATE '2001-01-01') - a.service_date AS INTEGER) AS time_to_next,
               (coalesce(b.service_date, DATE '2001-01-01') - a.service_date) - a.days_supply AS diff
        FROM ranked a LEFT JOIN ranked b
          ON a.member_id = b.member_id AND a.class_id = b.class_id AND a.supply_rank + 1 = b.supply_rank""",
    "placed": """
        SELECT s.*, p.period FROM spaced s LEFT JOIN periods p
          ON s.member_id = p.member_id AND s.service_date >= p.period_start AND s.service_date < p.next_period_start""",
    "carried": """
        SELECT member_id, class_id, supply_rank, greatest(-diff, 0) + 0 AS act_os, greatest(diff, 0) + 0 AS act_dnod
        FROM placed WHERE supply_rank = 1
        UNION ALL
        SELECT t.member_id, t.class_id, t.supply_rank, greatest(c.act_os - t.diff, 0) + 0, greatest(t.diff - c.act_os, 0) + 0
        FROM placed t JOIN carried c
          ON t.member_id = c.member_id AND t.class_id = c.class_id AND t.supply_rank = c.supply_rank + 1""",
    "actual": "SELECT p.*, c.act_os, c.act_dnod FROM placed p JOIN carried c USING (member_id, class_id, supply_rank)",
    "cumulated": """
        SELECT *, SUM(act_dnod) OVER w AS cum_act_dnod_period, CAST(SUM(time_to_next) OVER w AS BIGINT) AS cum_days_period
        FROM actual WINDOW w AS (PARTITION BY member_id, class_id, period ORDER BY service_date)""",
    "per_class": """
        SELECT member_id, period, class_id, MAX(cum_act_dnod_period) AS gap, MAX(cum_days_period) AS days, MIN(service_date) AS first_date
        FROM cumulated GROUP BY member_id, period, class_id""",
    "stats": """
        SELECT member_id, period, COUNT(DISTINCT class_id) AS n_classes, MAX(days) AS period_days, SUM(gap) AS gap_days, MIN(first_date) AS first_date
        FROM per_class GROUP BY member_id, period""",
    "ratios": """
        SELECT member_id, SUM(period_days - gap_days / n_classes) / (DATE '2001-01-01' - MIN(first_date)) * 100 AS dppr
        FROM stats GROUP BY member_id""",
}


def upto(stage: str, select: str = "SELECT * FROM {}") -> str:
    """SQL of all stages up to one, and a final select from it."""
    names = list(STAGES)
    ctes = ",\n".join(f"{n} AS ({STAGES[n]})" for n in names[: names.index(stage) + 1])
    return f"{with_views('claims', 'crosswalk')},\n{ctes}\n{select.format(stage)}"


@BOOK.add("obs_window", "SELECT DATE '2001-01-01' AS predicted_on, DATE '1998-01-01' AS history_from, DATE '2000-12-31' AS history_thru, COUNT(*) AS n_claims FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'")
def obs_window(spark, folder):
    inside = V.table(spark, folder, "lineitem").where(F.col("l_shipdate").cast("date").between(WINDOW.first, WINDOW.last))
    return inside.agg(F.count("*").alias("n_claims")).select(
        F.lit(WINDOW.predicted_on).alias("predicted_on"), F.lit(WINDOW.first).alias("history_from"), F.lit(WINDOW.last).alias("history_thru"), "n_claims")


@BOOK.add("eligible_claims", with_views("claims") + """
SELECT * FROM claims
WHERE (claim_status = 'F' OR claim_status IS NULL) AND paid_amount >= 0 AND days_supply > 0 AND quantity > 0 AND lob IN ('A', 'R')
  AND service_date <= DATE '2000-12-31' AND service_date + CAST(trunc(days_supply - 1) AS INTEGER) >= DATE '1998-01-01'""")
def eligible_claims(spark, folder):
    return A.eligible_claims(V.claims(spark, folder), WINDOW, lobs=("A", "R"), statuses=("F",))


@BOOK.add("interval_overlap", with_views("claims") + """
SELECT claim_id, line_id, service_date, days_supply, service_date <= DATE '1998-12-31' AND service_date + CAST(trunc(days_supply - 1) AS INTEGER) >= DATE '1998-01-01' AS touches
FROM claims""")
def interval_overlap(spark, folder):
    touches = A.overlaps("service_date", "days_supply", dt.date(1998, 1, 1), dt.date(1998, 12, 31))
    return V.claims(spark, folder).select("claim_id", "line_id", "service_date", "days_supply", touches.alias("touches"))


@BOOK.add("classify_claims", with_views("claims", "crosswalk") + " SELECT claim_id, line_id, code, class_id FROM claims JOIN crosswalk USING (code)")
def classify_claims(spark, folder):
    return A.classify(V.claims(spark, folder), V.crosswalk(spark, folder)).select("claim_id", "line_id", "code", "class_id")


@BOOK.add("dedupe_refills", upto("refills"))
def dedupe_refills(spark, folder):
    return _refills(spark, folder)


@BOOK.add("thin_groups", upto("thin"))
def thin_groups(spark, folder):
    return A.thin_groups(_refills(spark, folder))


@BOOK.add("drop_thin_members", upto("kept"))
def drop_thin_members(spark, folder):
    return _kept(spark, folder)


@BOOK.add("unmatched_parts", "SELECT p_partkey AS code FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 40)")
def unmatched_parts(spark, folder):
    used = V.table(spark, folder, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 40")
    return unmatched(V.table(spark, folder, "part").select(F.col("p_partkey").alias("code")), used.select(F.col("l_partkey").alias("code")), ["code"])


@BOOK.add("first_refill", upto("firsts"))
def first_refill(spark, folder):
    return A.first_refill(_kept(spark, folder))


@BOOK.add("periods", upto("periods"))
def periods(spark, folder):
    return A.periods(A.first_refill(_kept(spark, folder)), END)


@BOOK.add("dummy_refills", upto("dummies"))
def dummy_refills(spark, folder):
    return A.dummy_refills(_kept(spark, folder), END)


@BOOK.add("refills_with_dummies", upto("ranked"))
def refills_with_dummies(spark, folder):
    return A.with_dummies(_kept(spark, folder), END)


@BOOK.add("next_supply", upto("spaced"))
def next_supply(spark, folder):
    return _timeline(spark, folder)


@BOOK.add("assign_period", upto("placed"))
def assign_period(spark, folder):
    return A.assign_period(_timeline(spark, folder), A.periods(A.first_refill(_kept(spark, folder)), END))


@BOOK.add("gaps_and_surplus", upto("spaced", "SELECT member_id, class_id, service_date, greatest(diff, 0) AS days_not_on_drug, greatest(-diff, 0) AS over_supply FROM {}"))
def gaps_and_surplus(spark, folder):
    return A.gaps_and_surplus(_timeline(spark, folder)).select("member_id", "class_id", "service_date", "days_not_on_drug", "over_supply")


@BOOK.add("carry_forward", upto("carried"))
def carry_forward(spark, folder):
    return A.carry_forward(_timeline(spark, folder)).select("member_id", "class_id", "supply_rank", "act_os", "act_dnod")


@BOOK.add("carry_forward_chunked", upto("carried"))
def carry_forward_chunked(spark, folder):
    t = _timeline(spark, folder).withColumn("_x", -F.col("diff"))
    out = carry(t, A.KEY, "service_date", "_x", chunk=F.year("service_date"))
    return out.select("member_id", "class_id", "supply_rank", "act_os", "act_dnod")


@BOOK.add("cumulated_gaps", upto("cumulated", "SELECT member_id, class_id, period, service_date, cum_act_dnod_period, cum_days_period FROM {}"))
def cumulated_gaps(spark, folder):
    out = A.cumulate(A.covered_timeline(_refills(spark, folder), END))
    return out.select("member_id", "class_id", "period", "service_date", "cum_act_dnod_period", "cum_days_period")


@BOOK.add("covered_timeline", upto("actual", "SELECT member_id, class_id, service_date, days_supply, next_date, period, time_to_next, diff, act_os, act_dnod FROM {}"))
def covered_timeline(spark, folder):
    return A.covered_timeline(_refills(spark, folder), END)


@BOOK.add("period_stats", upto("stats", "SELECT member_id, period, n_classes, CAST(period_days AS BIGINT) AS period_days, gap_days FROM {}"))
def period_stats(spark, folder):
    return A.period_stats(A.covered_timeline(_refills(spark, folder), END)).drop("_first")


@BOOK.add("observation_span", upto("cumulated", "SELECT member_id, CAST(DATE '2001-01-01' - MIN(service_date) AS INTEGER) AS observation_days FROM {} GROUP BY member_id"))
def observation_span(spark, folder):
    return A.observation_span(A.with_dummies(_kept(spark, folder), END), END)


@BOOK.add("dppr", upto("ratios", "SELECT member_id, round(dppr, 6) AS dppr FROM {}"))
def dppr(spark, folder):
    return rounded(_ratios(spark, folder))


@BOOK.add("dppr_by_stages", upto("ratios", "SELECT member_id, round(dppr, 6) AS dppr FROM {}"))
def dppr_by_stages(spark, folder):
    return rounded(A.dppr_by_stages(_refills(spark, folder), END))


@BOOK.add("compliance", upto("ratios", "SELECT member_id, round(dppr, 6) AS dppr, CASE WHEN dppr >= 80 THEN 1 ELSE 0 END AS compliant FROM {}"))
def compliance(spark, folder):
    return rounded(A.compliance(_ratios(spark, folder)))


# --- comparison with other measures: two made-up measures per member stand for MPR and MPRm


def _others(spark, folder):
    o = V.donations(spark, folder).groupBy(F.col("candidate_id").alias("member_id")).agg(F.count("*").alias("n"), F.min("amount").alias("lo"))
    return o.select("member_id", (F.col("n") * 9.0).alias("mpr"), F.round(F.col("lo") / 1000, 3).alias("mprm"))


def _measures(spark, folder):
    return A.compare_measures(_ratios(spark, folder).withColumn("dppr", F.round("dppr", 6)), _others(spark, folder))


MEASURES = STAGES | {
    "others": "SELECT o_custkey AS member_id, COUNT(*) * CAST(9.0 AS DOUBLE) AS mpr, round(MIN(o_totalprice) / 1000, 3) AS mprm FROM orders GROUP BY o_custkey",
    "measures": """
        SELECT r.member_id, round(dppr, 6) AS dppr, mpr, mprm, mpr - round(dppr, 6) AS diff_mpr_dppr, mpr - mprm AS diff_mpr_mprm, mprm - round(dppr, 6) AS diff_mprm_dppr
        FROM ratios r JOIN others o ON r.member_id = o.member_id""",
    "tiles": """
        SELECT *, NTILE(100) OVER (ORDER BY dppr NULLS FIRST, member_id) AS percentile_dppr,
               NTILE(100) OVER (ORDER BY mpr NULLS FIRST, member_id) AS percentile_mpr,
               NTILE(100) OVER (ORDER BY mprm NULLS FIRST, member_id) AS percentile_mprm
        FROM measures""",
}


def measured(select: str) -> str:
    ctes = ",\n".join(f"{n} AS ({s})" for n, s in MEASURES.items())
    return f"{with_views('claims', 'crosswalk')},\n{ctes}\n{select}"


@BOOK.add("compare_measures", measured("SELECT member_id, dppr, mpr, mprm, round(diff_mpr_dppr, 6) AS diff_mpr_dppr, round(diff_mpr_mprm, 6) AS diff_mpr_mprm, round(diff_mprm_dppr, 6) AS diff_mprm_dppr FROM measures"))
def compare_measures(spark, folder):
    return rounded(_measures(spark, folder))


@BOOK.add("measure_percentiles", measured("SELECT member_id, percentile_dppr, percentile_mpr, percentile_mprm FROM tiles"))
def measure_percentiles(spark, folder):
    return A.with_percentiles(_measures(spark, folder)).select("member_id", "percentile_dppr", "percentile_mpr", "percentile_mprm")


@BOOK.add("measure_summary", measured(" UNION ALL ".join(f"SELECT '{m}' AS measure, MIN({m}) AS min, MAX({m}) AS max, round(AVG({m}), 5) AS avg FROM measures" for m in ("dppr", "mpr", "mprm"))))
def measure_summary(spark, folder):
    return rounded(A.measure_summary(_measures(spark, folder)), avg=5)


@BOOK.add("measure_quartiles", measured(" UNION ALL ".join(
    f"SELECT '{m}' AS measure, 'Q{q}' AS quartile, COUNT(*) AS n, MAX({m}) AS value FROM tiles WHERE percentile_{m} <= {25 * q}" for m in ("dppr", "mpr", "mprm") for q in (1, 2, 3))))
def measure_quartiles(spark, folder):
    return A.measure_quartiles(_measures(spark, folder))


@BOOK.add("agreement_at", measured(" UNION ALL ".join(f"""
SELECT '{m}' AS measure, CAST({c} AS DOUBLE) AS cut, COUNT(*) FILTER (WHERE dppr < {c}) AS n_below, COUNT(*) FILTER (WHERE dppr < {c} AND {m} >= {c}) AS missed,
       COUNT(*) FILTER (WHERE dppr >= {c}) AS n_above, COUNT(*) FILTER (WHERE dppr >= {c} AND {m} < {c}) AS overcalled, COUNT(*) FILTER (WHERE {m} >= {c}) AS n_compliant
FROM measures""" for m in ("mpr", "mprm") for c in (80, 50))))
def agreement_at(spark, folder):
    return A.agreement_at(_measures(spark, folder), "dppr", ["mpr", "mprm"])


_NEGATIVE = upto("spaced", """, negative AS (SELECT * FROM {} WHERE diff < 0),
limits AS (SELECT quantile_cont(diff, 0.25) - 0.5 * (quantile_cont(diff, 0.75) - quantile_cont(diff, 0.25)) AS lower FROM negative)
""")


@BOOK.add("gap_distribution", upto("spaced", "SELECT member_id, class_id, service_date, diff, NTILE(100) OVER (ORDER BY diff NULLS FIRST, member_id, class_id, service_date) AS percentile_diff FROM {}"))
def gap_distribution(spark, folder):
    return A.gap_distribution(_covered(spark, folder)).select("member_id", "class_id", "service_date", "diff", "percentile_diff")


@BOOK.add("outlier_members", _NEGATIVE + "SELECT DISTINCT member_id FROM negative, limits WHERE diff < lower AND next_date <> DATE '2001-01-01'")
def outlier_members(spark, folder):
    return A.outlier_members(_covered(spark, folder), END, k=0.5)


@BOOK.add("outlier_review", measured(""", negative AS (SELECT * FROM spaced WHERE diff < 0),
limits AS (SELECT quantile_cont(diff, 0.25) - 0.5 * (quantile_cont(diff, 0.75) - quantile_cont(diff, 0.25)) AS lower FROM negative)
SELECT n.member_id, class_id, service_date, next_date, days_supply, time_to_next, diff, dppr, mpr, mprm
FROM negative n JOIN measures m ON n.member_id = m.member_id, limits WHERE diff < lower AND next_date <> DATE '2001-01-01'"""))
def outlier_review(spark, folder):
    out = A.outlier_review(_covered(spark, folder), _measures(spark, folder), END, k=0.5)
    return out.select("member_id", "class_id", "service_date", "next_date", "days_supply", "time_to_next", "diff", "dppr", "mpr", "mprm")


@BOOK.add("review_claims", _NEGATIVE + """, chosen AS (SELECT DISTINCT member_id FROM negative, limits WHERE diff < lower AND next_date <> DATE '2001-01-01')
SELECT DISTINCT member_id, claim_id, line_id, class_id, code, service_date, days_supply
FROM eligible JOIN crosswalk USING (code) WHERE member_id IN (SELECT member_id FROM chosen) AND class_id = 0
UNION ALL
SELECT DISTINCT member_id, claim_id, line_id, class_id, code, service_date, days_supply
FROM eligible JOIN crosswalk USING (code) WHERE member_id IN (SELECT member_id FROM chosen) AND class_id IN (1, 2)""")
def review_claims(spark, folder):
    members = A.outlier_members(_covered(spark, folder), END, k=0.5)
    return A.review_claims(V.claims(spark, folder), _trees(spark, folder), members, WINDOW, statuses=ALL)


@BOOK.add("duplicate_audit", with_views("claims", "crosswalk") + " SELECT member_id, class_id, service_date, COUNT(*) AS n FROM claims JOIN crosswalk USING (code) GROUP BY member_id, class_id, service_date")
def duplicates(spark, folder):
    return duplicate_audit(A.classify(V.claims(spark, folder), V.crosswalk(spark, folder)), ["member_id", "class_id", "service_date"])


@BOOK.add("count_distinct_members", with_views("claims") + " SELECT lob, COUNT(DISTINCT member_id) AS n_member_id, COUNT(DISTINCT code) AS n_code FROM claims GROUP BY lob")
def count_distinct_members(spark, folder):
    return count_distinct(V.claims(spark, folder), ["member_id", "code"], ["lob"])


@BOOK.add("next_order", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, coalesce(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey), DATE '2002-01-01') AS next_day
FROM orders""")
def next_order(spark, folder):
    o = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    at = F.struct("day", "o_orderkey")
    o = next_event(o.withColumn("_at", at), ["o_custkey"], "_at", F.lit(None), "_next", chunk=F.year("day"))
    return o.select("o_orderkey", "o_custkey", "day", F.coalesce("_next.day", F.lit(dt.date(2002, 1, 1))).alias("next_day"))


@BOOK.add("running_sum", "SELECT o_orderkey, o_custkey, round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)), 2) AS total FROM orders")
def running_sum_orders(spark, folder):
    o = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    out = running_sum(o, ["o_custkey"], "day", {"total": "o_totalprice"}, chunk=F.year("day"))
    return rounded(out.select("o_orderkey", "o_custkey", "total"), 2)


@BOOK.add("claim_audit", with_views("claims") + """ SELECT 'no_status' AS rule, COUNT(*) FILTER (WHERE claim_status IS NULL) AS n FROM claims
UNION ALL SELECT 'unpaid', COUNT(*) FILTER (WHERE paid_amount < 2000) FROM claims UNION ALL SELECT 'bad_lob', COUNT(*) FILTER (WHERE lob NOT IN ('A', 'R')) FROM claims""")
def claim_audit(spark, folder):
    return audit(V.claims(spark, folder), {
        "no_status": F.col("claim_status").isNull(), "unpaid": F.col("paid_amount") < 2000, "bad_lob": ~F.col("lob").isin("A", "R")})
