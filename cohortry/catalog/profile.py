"""Profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cohortry.catalog.book import Book, hash_sql, rounded, with_views
from cohortry.functions import scalar as S
from cohortry.operators import profile as P
from cohortry.operators import ranking as R
from cohortry.operators import relational as L
from cohortry.plans import players as G
from cohortry.plans.presets import ENGAGEMENT_LEVELS
from cohortry.sources import views as V

BOOK = Book()
ATTRIBUTES = ["totalHouseholdDebt", "primaryPropertyLoanToValue", "primaryPropertyValue", "propertyCount", "NetWorth"]
FLAGS = ["isClassADonor", "isClassBDonor", "isClassCDonor", "isClassDDonor"]
LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(pieces) -> str:
    return "\nUNION ALL ".join(pieces)


@BOOK.add("missing_report", with_views("attributes") + _union(
    f" SELECT '{c}' AS column, COUNT(*) - COUNT({c}) AS n_missing, round(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*), 6) AS ratio_missing FROM attributes" for c in ["candidate_id", *ATTRIBUTES, *FLAGS]))
def missing_report(spark, folder):
    return rounded(P.missing_report(V.attributes(spark, folder)))


@BOOK.add("missing_by_class", with_views("attributes") + " SELECT isClassADonor, COUNT(*) AS n, COUNT(*) FILTER (WHERE NetWorth IS NULL) AS n_missing, round(CAST(COUNT(*) FILTER (WHERE NetWorth IS NULL) AS DOUBLE) / COUNT(*), 6) AS ratio_missing FROM attributes GROUP BY isClassADonor")
def missing_by_class(spark, folder):
    return rounded(P.missing_by_class(V.attributes(spark, folder), "isClassADonor"))


@BOOK.add("class_balance", with_views("players") + " SELECT EngagementLevel, COUNT(*) AS n, round(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM players), 6) AS share FROM players GROUP BY EngagementLevel")
def class_balance(spark, folder):
    return rounded(L.class_balance(V.players(spark, folder), "EngagementLevel"))


@BOOK.add("value_counts", with_views("players") + _union(f" SELECT '{c}' AS column, {c} AS value, COUNT(*) AS n FROM players GROUP BY {c}" for c in ("GameGenre", "Location", "EngagementLevel")))
def value_counts(spark, folder):
    p = V.players(spark, folder)
    return L.value_counts(p, S.columns_of(p, "text"))


@BOOK.add("describe", "WITH x AS (SELECT * FROM lineitem)" + _union(
    f""" SELECT '{c}' AS column, COUNT({c}) AS count, round(AVG({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, MIN({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
 round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, MAX({c}) AS max FROM x""" for c in LINES))
def describe(spark, folder):
    return rounded(P.describe(V.table(spark, folder, "lineitem"), LINES), 4)


@BOOK.add("group_profile", "WITH x AS (SELECT * FROM lineitem)" + _union(
    f" SELECT l_returnflag, '{c}' AS column, MIN({c}) AS min, MAX({c}) AS max, round(median({c}), 4) AS median, round(SUM({c}), 2) AS total FROM x GROUP BY l_returnflag" for c in LINES[:2]))
def group_profile(spark, folder):
    return rounded(P.group_profile(V.table(spark, folder, "lineitem"), "l_returnflag", LINES[:2]), 4, total=2)


@BOOK.add("exact_quantiles", "SELECT l_returnflag, COUNT(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS q0, round(quantile_cont(l_extendedprice, 0.5), 4) AS q1, round(quantile_cont(l_extendedprice, 0.9), 4) AS q2 FROM lineitem GROUP BY l_returnflag")
def exact_quantiles(spark, folder):
    return rounded(R.exact_quantiles(V.table(spark, folder, "lineitem"), "l_extendedprice", (0.1, 0.5, 0.9), ["l_returnflag"]), 4)


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]


@BOOK.add("corr_matrix", "WITH c AS (SELECT " + ", ".join(f"corr({CORR[i]}, {CORR[j]}) AS c{i}_{j}" for i, j in combinations(range(4), 2)) + " FROM lineitem)" + _union(
    f" SELECT '{CORR[i]}' AS a, '{CORR[j]}' AS b, " + ("CAST(1 AS DOUBLE)" if i == j else f"round(c{min(i, j)}_{max(i, j)}, 6)") + " AS corr, "
    + ("CAST(1 AS DOUBLE)" if i == 1 else f"round(c{min(i, 1)}_{max(i, 1)}, 6)") + " AS target_corr FROM c" for i in range(4) for j in range(4)))
def corr_matrix(spark, folder):
    return rounded(P.corr_matrix(V.table(spark, folder, "lineitem"), CORR, "l_extendedprice"))


def _skew(c: str) -> str:
    m = f"(SELECT AVG(CAST({c} AS DOUBLE)) FROM players)"
    return f"round(AVG(pow({c} - {m}, 3)) / pow(AVG(pow({c} - {m}, 2)), 1.5), 4)"


PLAYER_NUMBERS = ["Age", "PlayTimeHours", "InGamePurchases", "SessionsPerWeek", "AvgSessionDurationMinutes", "PlayerLevel", "AchievementsUnlocked"]


@BOOK.add("skewness_report", with_views("players") + _union(f" SELECT '{c}' AS column, {_skew(c)} AS skewness FROM players" for c in PLAYER_NUMBERS))
def skewness_report(spark, folder):
    return rounded(P.skewness_report(V.players(spark, folder), PLAYER_NUMBERS), 4)


@BOOK.add("skewed_columns", with_views("players") + ", s AS (" + _union(f" SELECT '{c}' AS column, {_skew(c)} AS skewness FROM players" for c in PLAYER_NUMBERS) + ") SELECT * FROM s WHERE skewness > 0.02")
def skewed_columns(spark, folder):
    return rounded(P.skewness_report(V.players(spark, folder), PLAYER_NUMBERS, above=0.02), 4)


def _crosstab(c: str, scale: str) -> str:
    share = "CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY {c})".format(c=c)
    return f" SELECT '{c}' AS column_name, {c} AS row_value, EngagementLevel AS col_value, n, {scale.format(share)} AS share FROM (SELECT {c}, EngagementLevel, COUNT(*) AS n FROM players GROUP BY {c}, EngagementLevel)"


@BOOK.add("crosstab_share", with_views("players") + _union(_crosstab(c, "round({}, 6)") for c in ("GameGenre", "Location")))
def crosstab_share(spark, folder):
    return rounded(P.crosstab_share(V.players(spark, folder), ["GameGenre", "Location"], "EngagementLevel"))


@BOOK.add("crosstab_percent", with_views("players") + _union(_crosstab(c, "round(round({}, 3) * 100, 6)") for c in ("GameGenre", "Location")))
def crosstab_percent(spark, folder):
    return rounded(P.crosstab_share(V.players(spark, folder), ["GameGenre", "Location"], "EngagementLevel", digits=3))


@BOOK.add("box_stats", """WITH q AS (SELECT o_orderpriority, COUNT(*) AS n, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders GROUP BY o_orderpriority)
SELECT q.o_orderpriority, n, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, MIN(o_totalprice) FILTER (WHERE inside) AS whisker_low, MAX(o_totalprice) FILTER (WHERE inside) AS whisker_high, COUNT(*) FILTER (WHERE NOT inside) AS n_outliers
FROM (SELECT q.*, o_totalprice, o_totalprice BETWEEN q25 - 0.3 * (q75 - q25) AND q75 + 0.3 * (q75 - q25) AS inside FROM orders o JOIN q ON o.o_orderpriority = q.o_orderpriority) q
GROUP BY q.o_orderpriority, n, q25, q50, q75""")
def box_stats(spark, folder):
    return rounded(P.box_stats(V.table(spark, folder, "orders"), "o_totalprice", "o_orderpriority", whisker=0.3), 4)


@BOOK.add("histogram", """WITH b AS (SELECT o_orderstatus, CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice > 500000 THEN 21 ELSE CAST(least(floor(o_totalprice / 25000.0::DOUBLE) + 1, 20) AS BIGINT) END AS bin FROM orders)
SELECT o_orderstatus, bin, CASE WHEN bin > 0 THEN (bin - 1) * 25000.0::DOUBLE END AS bin_start, COUNT(*) AS n, round(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM b GROUP BY o_orderstatus, bin""")
def histogram(spark, folder):
    return rounded(P.histogram(V.table(spark, folder, "orders"), "o_totalprice", 20, ["o_orderstatus"], 0.0, 500000.0))


@BOOK.add("histogram_limits", """WITH b AS (SELECT o_orderstatus, CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice > 300000 THEN 11 ELSE CAST(least(floor((o_totalprice - 50000) / 25000.0::DOUBLE) + 1, 10) AS BIGINT) END AS bin FROM orders)
SELECT o_orderstatus, bin, CASE WHEN bin > 0 THEN 50000 + (bin - 1) * 25000.0::DOUBLE END AS bin_start, COUNT(*) AS n, round(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM b GROUP BY o_orderstatus, bin""")
def histogram_limits(spark, folder):
    """Limits within the data: what lies beyond them has bins of its own."""
    return rounded(P.histogram(V.table(spark, folder, "orders"), "o_totalprice", 10, ["o_orderstatus"], 50000.0, 300000.0))


@BOOK.add("density_by_class", """WITH s AS (SELECT o_orderstatus, COUNT(*) AS n, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, stddev_samp(o_totalprice) * pow(COUNT(*), -0.2) AS h FROM orders GROUP BY o_orderstatus),
c AS (SELECT o_orderstatus, least(floor((o_totalprice - low) / ((high - low) / 512)), 511) AS cell, COUNT(*) AS c FROM orders JOIN s USING (o_orderstatus) GROUP BY ALL),
g AS (SELECT o_orderstatus, CAST(point AS INTEGER) AS point, low - 3 * h + point * ((high - low + 6 * h) / 199) AS x FROM s, (SELECT unnest(range(0, 200)) AS point))
SELECT o_orderstatus, point, round(x, 3) AS x, round(sum(c * exp(-pow((x - (low + (cell + 0.5) * ((high - low) / 512))) / h, 2) / 2)) / (n * h * sqrt(2 * pi())) * 1e6, 6) AS density
FROM g JOIN s USING (o_orderstatus) JOIN c USING (o_orderstatus) GROUP BY o_orderstatus, point, x, n, h""")
def density_by_class(spark, folder):
    """Density of order values by status, per million of value."""
    out = P.density(V.table(spark, folder, "orders"), "o_totalprice", ["o_orderstatus"])
    return rounded(out.withColumn("density", F.col("density") * 1e6), 6, x=3)


@BOOK.add("histogram_auto", """WITH m AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders), b AS (SELECT lo, (hi - lo) / 10 AS w, CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10)) + 1, 10) AS BIGINT) AS bin FROM orders, m)
SELECT bin, round(MIN(lo) + (bin - 1) * MIN(w), 4) AS bin_start, COUNT(*) AS n, round(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM orders), 6) AS share FROM b GROUP BY bin""")
def histogram_auto(spark, folder):
    return rounded(P.histogram(V.table(spark, folder, "orders"), "o_totalprice", 10), 6, bin_start=4)


@BOOK.add("iqr_outliers", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q WHERE l_extendedprice > b + 0.4 * (b - a) AND l_quantity > 10""")
def iqr_outliers(spark, folder):
    out = P.iqr_outliers(V.table(spark, folder, "lineitem"), "l_extendedprice", 0.4, keep=F.col("l_quantity") > 10, side="high")
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice")


@BOOK.add("binary_columns", with_views("attributes") + _union(
    f" SELECT '{c}' AS column, coalesce(bool_and({c} IN (0, 1)), true) AS is_binary FROM attributes" for c in ["propertyCount", "NetWorth", *FLAGS]))
def binary_columns(spark, folder):
    return L.binary_report(V.attributes(spark, folder), ["propertyCount", "NetWorth", *FLAGS])


@BOOK.add("percentile_bucket", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, NTILE(100) OVER (ORDER BY l_quantity NULLS FIRST, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber) AS tile FROM lineitem")
def percentile_bucket(spark, folder):
    lines = V.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    lines = lines.withColumn("_key", F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 100 + F.col("l_linenumber"))
    return R.percentile_bucket(lines, "l_quantity", "_key", name="tile").drop("_key")


@BOOK.add("quartiles_by_ntile", "WITH t AS (SELECT o_totalprice, NTILE(100) OVER (ORDER BY o_totalprice, o_orderkey) AS tile FROM orders)" + _union(
    f" SELECT 'Q{q}' AS quartile, COUNT(*) AS n, MAX(o_totalprice) AS value FROM t WHERE tile <= {25 * q}" for q in (1, 2, 3)))
def quartiles_by_ntile(spark, folder):
    return R.quartiles_by_ntile(V.table(spark, folder, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey")


@BOOK.add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(spark, folder):
    return R.top_k(V.table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50)


@BOOK.add("top_k_large", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2000")
def top_k_large(spark, folder):
    return R.top_k(V.table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 2000)


@BOOK.add("top_abs", "SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal) DESC, c_acctbal) AS r FROM customer) WHERE r <= 5")
def top_abs(spark, folder):
    return R.top_abs(V.table(spark, folder, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_acctbal", 5, ["c_mktsegment"])


@BOOK.add("sample_n", f"SELECT * FROM customer ORDER BY {hash_sql('c_custkey')}, c_custkey LIMIT 200")
def sample_n(spark, folder):
    return R.sample_n(V.table(spark, folder, "customer"), 200, "c_custkey")


@BOOK.add("sample_n_size", "SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS n_keys FROM (SELECT o_orderkey FROM orders LIMIT 1000)")
def sample_n_size(spark, folder):
    s = R.sample_n(V.table(spark, folder, "orders"), 1000, "o_orderkey")
    return s.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_keys"))


@BOOK.add("log_columns", with_views("players") + " SELECT PlayerID, round(log10(PlayTimeHours + 1), 6) AS log_PlayTimeHours, round(log10(PlayerLevel + 1), 6) AS log_PlayerLevel FROM players")
def log_columns(spark, folder):
    out = S.log1p10(V.players(spark, folder), ["PlayTimeHours", "PlayerLevel", "Age"], exclude=["Age"])
    return rounded(out.select("PlayerID", "log_PlayTimeHours", "log_PlayerLevel"))


@BOOK.add("null_safe_ratio", with_views("players") + " SELECT PlayerID, round(PlayTimeHours / nullif(SessionsPerWeek, 0), 6) AS ratio FROM players")
def null_safe_ratio(spark, folder):
    return rounded(V.players(spark, folder).select("PlayerID", S.ratio("PlayTimeHours", "SessionsPerWeek").alias("ratio")))


@BOOK.add("ordinal_encode", with_views("players") + " SELECT PlayerID, CASE EngagementLevel WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS level, CASE GameGenre WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 END AS genre FROM players")
def ordinal_encode(spark, folder):
    return V.players(spark, folder).select("PlayerID", S.ordinal("EngagementLevel", ENGAGEMENT_LEVELS).alias("level"), S.ordinal("GameGenre", ["BUILDING", "MACHINERY"]).alias("genre"))


@BOOK.add("select_by_name", with_views("attributes") + " SELECT candidate_id, isClassADonor, isClassBDonor, isClassCDonor, isClassDDonor FROM attributes")
def select_by_name(spark, folder):
    return S.select_by_name(V.attributes(spark, folder), include=["Class", "Cause"], always=["candidate_id"])


@BOOK.add("select_without_name", with_views("attributes") + " SELECT candidate_id, totalHouseholdDebt, primaryPropertyLoanToValue, primaryPropertyValue, propertyCount, NetWorth FROM attributes")
def select_without_name(spark, folder):
    return S.select_by_name(V.attributes(spark, folder), exclude=["Class", "Cause"])


@BOOK.add("columns_by_kind", with_views("players") + " SELECT PlayerID, Age, PlayTimeHours, InGamePurchases, SessionsPerWeek, AvgSessionDurationMinutes, PlayerLevel, AchievementsUnlocked FROM players")
def columns_by_kind(spark, folder):
    p = V.players(spark, folder)
    return p.select(*S.columns_of(p, "number"))


@BOOK.add("threshold_flag", with_views("attributes") + " SELECT candidate_id, CASE WHEN NetWorth >= 5000 THEN 1 ELSE 0 END AS rich, 1.0 - primaryPropertyLoanToValue AS down FROM attributes")
def threshold_flag(spark, folder):
    return V.attributes(spark, folder).select("candidate_id", S.flag(F.col("NetWorth") >= 5000).alias("rich"), S.complement("primaryPropertyLoanToValue").alias("down"))


@BOOK.add("random_benchmark", "SELECT COUNT(*) AS n, true AS in_range, true AS spread FROM orders")
def random_benchmark(spark, folder):
    r = S.random_benchmark(V.table(spark, folder, "orders"), "o_orderkey")
    v = F.col("random_value")
    return r.agg(F.count("*").alias("n"), F.bool_and(v.between(0, 99)).alias("in_range"), F.avg(v).between(45, 54).alias("spread"))


@BOOK.add("random_benchmark_rows", f"SELECT o_orderkey, CAST({hash_sql('o_orderkey')} % 100 AS INTEGER) AS random_value FROM orders")
def random_benchmark_rows(spark, folder):
    return S.random_benchmark(V.table(spark, folder, "orders"), "o_orderkey").select("o_orderkey", "random_value")


@BOOK.add("text_casts", "SELECT doc_id, try_cast(source AS DOUBLE) AS source_number, try_cast(substr(CAST(n_chars AS VARCHAR), 1, 2) AS DOUBLE) AS head FROM documents")
def text_casts(spark, folder):
    d = V.table(spark, folder, "documents")
    return d.select("doc_id", S.number("source").alias("source_number"), S.number(F.substring(F.col("n_chars").cast("string"), 1, 2)).alias("head"))


@BOOK.add("round_percent", "SELECT c_custkey, round(round(c_acctbal / 10000, 3) * 100, 6) + 0 AS pct FROM customer")
def round_percent(spark, folder):
    return rounded(V.table(spark, folder, "customer").select("c_custkey", S.percent(F.col("c_acctbal") / 10000).alias("pct")))


@BOOK.add("union_distinct", "SELECT l_partkey AS code FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part")
def union_distinct(spark, folder):
    a = V.table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("code"))
    return L.union_distinct(a, V.table(spark, folder, "part").select(F.col("p_partkey").alias("code")))


@BOOK.add("union_all", "SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer")
def union_all(spark, folder):
    a = V.table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(V.table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")))


@BOOK.add("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def select_distinct(spark, folder):
    return V.table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@BOOK.add("stack_reports", "SELECT 'customer' AS report, COUNT(*) AS n, round(AVG(c_acctbal), 4) AS mean FROM customer UNION ALL SELECT 'supplier', COUNT(*), round(AVG(s_acctbal), 4) FROM supplier")
def stack_reports(spark, folder):
    def report(name, column):
        return V.table(spark, folder, name).agg(F.count("*").alias("n"), F.avg(column).alias("mean"))

    return rounded(L.stack_reports({"customer": report("customer", "c_acctbal"), "supplier": report("supplier", "s_acctbal")}), 4)


@BOOK.add("with_group_stats", "SELECT o_orderkey, o_custkey, COUNT(*) OVER w AS n, MAX(o_totalprice) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def with_group_stats(spark, folder):
    o = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return L.with_group_stats(o, ["o_custkey"], n=F.count("*"), top=F.max("o_totalprice")).drop("o_totalprice")


@BOOK.add("ordered_listing", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def ordered_listing(spark, folder):
    return V.table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice").orderBy("p_brand", F.desc("p_size"), "p_partkey")


@BOOK.add("player_features", with_views("players") + """ SELECT PlayerID, round(PlayTimeHours / nullif(SessionsPerWeek, 0), 6) AS Global_Duration, round(AchievementsUnlocked / nullif(PlayTimeHours, 0), 6) AS AchievementsUnlocked_hr,
 Age * InGamePurchases AS Purchasers_Age, round(CAST(PlayerLevel AS DOUBLE) / Age, 6) AS PlayerLevel_Age, round(PlayerLevel / nullif(PlayTimeHours, 0), 6) AS PlayerLevel_PlayTimeHours,
 CASE EngagementLevel WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS EngagementLevel FROM players""")
def player_features(spark, folder):
    out = G.prepare(V.players(spark, folder))
    return rounded(out.select("PlayerID", "Global_Duration", "AchievementsUnlocked_hr", "Purchasers_Age", "PlayerLevel_Age", "PlayerLevel_PlayTimeHours", "EngagementLevel"))
