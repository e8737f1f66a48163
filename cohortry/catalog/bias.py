"""Class-probability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog.book import Book, rounded, with_views
from cohortry.functions.scalar import county_of, tract_code
from cohortry.operators.relational import multi_rows
from cohortry.plans import bias as B
from cohortry.plans.presets import RACE_COLUMNS, RACE_NAMES
from cohortry.sources import views as V

BOOK = Book()

AVERAGES = """, averaged AS (
  SELECT member_id, """ + ", ".join(f"AVG({c}) AS {c}_avg" for c in RACE_COLUMNS) + """
  FROM (SELECT DISTINCT member_id, """ + ", ".join(RACE_COLUMNS) + """ FROM probabilities) GROUP BY member_id)"""


def _strict(c: str) -> str:
    return " AND ".join(f"round({c}_avg, 9) > round({o}_avg, 9)" for o in RACE_COLUMNS if o != c)


CLASSIFIED = AVERAGES + ", classified AS (SELECT member_id, " + ", ".join(f"round({c}_avg, 9) AS {c}_avg" for c in RACE_COLUMNS) + ", " + ", ".join(
    f"CASE WHEN {_strict(c)} THEN 1 ELSE 0 END AS {n}" for c, n in zip(RACE_COLUMNS, RACE_NAMES)) + " FROM averaged)"


@BOOK.add("average_by_member", with_views("probabilities") + AVERAGES + " SELECT member_id, " + ", ".join(f"round({c}_avg, 9) AS {c}_avg" for c in RACE_COLUMNS) + " FROM averaged")
def average_by_member(spark, folder):
    return rounded(B.average_by_member(V.probabilities(spark, folder)), 9)


@BOOK.add("average_and_classify", with_views("probabilities") + CLASSIFIED + " SELECT * FROM classified")
def average_and_classify(spark, folder):
    return rounded(B.average_and_classify(V.probabilities(spark, folder)), 9)


@BOOK.add("class_shares", with_views("probabilities") + CLASSIFIED + " SELECT COUNT(*) AS n, " + ", ".join(f"round(SUM({n}) * 100.0::DOUBLE / COUNT(*), 6) AS percent_{n}" for n in RACE_NAMES) + " FROM classified")
def class_shares(spark, folder):
    return rounded(B.class_shares(B.average_and_classify(V.probabilities(spark, folder))))


@BOOK.add("class_shares_in_population", with_views("probabilities") + CLASSIFIED + " SELECT COUNT(*) AS n, " + ", ".join(
    f"round(SUM({n}) * 100.0::DOUBLE / COUNT(*), 6) AS percent_{n}" for n in RACE_NAMES) + " FROM classified WHERE member_id IN (SELECT user_id FROM events WHERE value > 100)")
def class_shares_in_population(spark, folder):
    some = V.table(spark, folder, "events").where(F.col("value") > 100).select(F.col("user_id").alias("member_id"))
    return rounded(B.class_shares(B.average_and_classify(V.probabilities(spark, folder)), some))


@BOOK.add("threshold_classes", with_views("probabilities") + """ SELECT member_id, day, CASE WHEN pred_whi > 0.7 THEN 1 ELSE 0 END AS white, CASE WHEN pred_bla > 0.7 THEN 1 ELSE 0 END AS black,
 CASE WHEN pred_his > 0.7 THEN 1 ELSE 0 END AS hispanic, CASE WHEN pred_asi > 0.7 THEN 1 ELSE 0 END AS asian,
 CASE WHEN greatest(pred_whi, pred_bla, pred_his, pred_asi) > 0.7 THEN 0 ELSE 1 END AS other,
 CASE WHEN pred_whi > 0.7 THEN 'white' WHEN pred_bla > 0.7 THEN 'black' WHEN pred_his > 0.7 THEN 'hispanic' WHEN pred_asi > 0.7 THEN 'asian' ELSE 'other' END AS race FROM probabilities""")
def threshold_classes(spark, folder):
    return B.threshold_classes(V.probabilities(spark, folder)).select("member_id", "day", *RACE_NAMES, "race")


@BOOK.add("multi_rows", with_views("probabilities") + " SELECT member_id, COUNT(*) AS n FROM probabilities GROUP BY member_id HAVING COUNT(*) > 1")
def multiple(spark, folder):
    return multi_rows(V.probabilities(spark, folder), "member_id")


def _people(spark, folder):
    """Customers as members; two places for every fifth, some without place, age or state."""
    c = V.table(spark, folder, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    members = c.select(key.alias("member_id"))
    names = c.select(key.alias("member_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("surname"),
                     F.when(nation % 3 == 0, F.lit(None).cast("string")).when(nation == 7, "??").otherwise(F.concat(F.lit("S"), nation.cast("string"))).alias("state"))
    tract = (F.col("n") * 1000003 + F.lit(1001000000)).cast("string")
    one = c.select(key.alias("member_id"), F.explode(F.when(key % 5 == 0, F.array(nation, nation + 1)).otherwise(F.array(nation))).alias("n"))
    geography = one.select("member_id", F.when(F.col("n") == 24, "NA").when(F.col("n") % 2 == 0, F.concat(F.lit("0"), tract)).otherwise(F.concat(F.lit("1"), tract)).alias("tract"))
    demographics = c.select(key.alias("member_id"), F.when(key % 2 == 0, "M").otherwise("F").alias("gender"), F.when(key % 11 != 0, (key % 80).cast("string")).alias("age"))
    n = V.table(spark, folder, "nation").select(F.col("n_nationkey").alias("n"))
    tracts = n.select(F.concat(F.lit("T"), F.col("n").cast("string")).alias("state"),
                      F.when(F.col("n") % 2 == 0, tract).otherwise(F.concat(F.lit("1"), tract)).cast("double").alias("tract"))
    return members, names, geography, demographics, tracts


COMPONENTS = """, placed AS (
  SELECT c_custkey AS member_id, n, CASE WHEN n = 24 THEN 'NA' WHEN n % 2 = 0 THEN '0' || CAST(n * 1000003 + 1001000000 AS VARCHAR) ELSE '1' || CAST(n * 1000003 + 1001000000 AS VARCHAR) END AS tract
  FROM (SELECT c_custkey, c_nationkey AS n FROM customer UNION ALL SELECT c_custkey, c_nationkey + 1 FROM customer WHERE c_custkey % 5 = 0)),
tracts AS (SELECT 'T' || CAST(n_nationkey AS VARCHAR) AS st, CASE WHEN n_nationkey % 2 = 0 THEN '0' ELSE '1' END || CAST(n_nationkey * 1000003 + 1001000000 AS VARCHAR) AS tract FROM nation),
people AS (
  SELECT DISTINCT c_custkey AS member_id, c_name AS first_name, c_mktsegment AS surname, CAST(c_custkey % 80 AS INTEGER) AS age, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS sex,
         coalesce(CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey = 7 THEN '??' ELSE 'S' || CAST(c_nationkey AS VARCHAR) END, st) AS state, substr(p.tract, 3, 3) AS county
  FROM customer JOIN placed p ON c_custkey = member_id LEFT JOIN tracts t ON p.tract = t.tract
  WHERE p.tract <> 'NA' AND c_custkey % 11 <> 0),
components AS (SELECT * FROM people WHERE state <> '??' AND state <> 'VI')"""


def _dummy() -> str:
    return "WITH one AS (SELECT 1 AS x)"


@BOOK.add("member_components", _dummy() + COMPONENTS + " SELECT * FROM components")
def member_components(spark, folder):
    return B.components(*_people(spark, folder))


@BOOK.add("county_of_tract", "SELECT c_custkey AS member_id, CASE WHEN length(CAST(c_custkey * 7919 + 1001000000 AS VARCHAR)) = 10 THEN '0' ELSE '' END || CAST(c_custkey * 7919 + 1001000000 AS VARCHAR) AS tract, substr('0' || CAST(c_custkey * 7919 + 1001000000 AS VARCHAR), 3, 3) AS county FROM customer")
def county_of_tract(spark, folder):
    c = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("member_id"), tract_code(F.col("c_custkey") * 7919 + 1001000000).alias("tract"))
    return c.withColumn("county", county_of("tract"))


@BOOK.add("posterior", _dummy() + COMPONENTS + """,
priors AS (SELECT c_mktsegment AS surname, AVG(CASE WHEN c_acctbal < 2000 THEN 1.0::DOUBLE ELSE 0 END) AS prior_a, AVG(CASE WHEN c_acctbal >= 2000 AND c_acctbal < 6000 THEN 1.0::DOUBLE ELSE 0 END) AS prior_b,
                  AVG(CASE WHEN c_acctbal >= 6000 THEN 1.0::DOUBLE ELSE 0 END) AS prior_c FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_mktsegment),
places AS (SELECT state, county, (COUNT(*) % 7 + 1) / 10.0::DOUBLE AS given_a, (COUNT(*) % 5 + 1) / 10.0::DOUBLE AS given_b, (COUNT(*) % 3 + 1) / 10.0::DOUBLE AS given_c FROM components WHERE county <> '009' GROUP BY state, county),
weights AS (SELECT member_id, c.state, c.county, CASE WHEN p.surname IS NULL THEN 0 ELSE 1 END AS surname_matched,
                   coalesce(prior_a, 0.2) * given_a AS wa, coalesce(prior_b, 0.5) * given_b AS wb, coalesce(prior_c, 0.3) * given_c AS wc
            FROM components c LEFT JOIN priors p ON c.surname = p.surname LEFT JOIN places g ON c.state = g.state AND c.county = g.county)
SELECT member_id, state, county, surname_matched, round(wa / (wb + wc + wa), 6) AS pred_a, round(wb / (wb + wc + wa), 6) AS pred_b, round(wc / (wb + wc + wa), 6) AS pred_c FROM weights""")
def posterior(spark, folder):
    people = B.components(*_people(spark, folder))
    c = F.col("c_acctbal")
    priors = V.table(spark, folder, "customer").where("c_mktsegment <> 'MACHINERY'").groupBy(F.col("c_mktsegment").alias("surname")).agg(
        F.avg((c < 2000).cast("double")).alias("prior_a"), F.avg(((c >= 2000) & (c < 6000)).cast("double")).alias("prior_b"), F.avg((c >= 6000).cast("double")).alias("prior_c"))
    n = F.count("*")
    places = people.where("county <> '009'").groupBy("state", "county").agg(
        ((n % 7 + 1) / 10.0).alias("given_a"), ((n % 5 + 1) / 10.0).alias("given_b"), ((n % 3 + 1) / 10.0).alias("given_c"))
    out = B.posterior(people, priors, places, (0.2, 0.5, 0.3), ("a", "b", "c"), place=("state", "county"))
    return rounded(out.select("member_id", "state", "county", "surname_matched", "pred_a", "pred_b", "pred_c"))
