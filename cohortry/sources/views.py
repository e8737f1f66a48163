"""The analyses' input tables as views over the test tables in a Parquet folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as drug claims of the ordering customer."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(
        F.col("o_custkey").alias("member_id"),
        F.col("l_partkey").alias("code"),
        F.col("l_shipdate").cast("date").alias("service_date"),
        (F.col("l_quantity") * 6).alias("days_supply"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("paid_amount"),
        F.col("l_linestatus").alias("claim_status"),
        F.col("l_returnflag").alias("lob"),
        F.col("l_orderkey").alias("claim_id"),
        F.col("l_linenumber").alias("line_id"),
    )


def crosswalk(spark: SparkSession, folder: str, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Parts as drug codes in three classes."""
    g = F.col("p_partkey") % 3
    return table(spark, folder, "part").select(g.alias("class_id"), F.col("p_partkey").alias("code")).where(F.col("class_id").isin(*classes))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations and suppliers as a three-level tree."""
    region = table(spark, folder, "region").select(
        (F.col("r_regionkey") + 1).cast("bigint").alias("node_id"), F.col("r_name").alias("node_name"),
        F.lit(0).cast("bigint").alias("parent_id"), F.lit(1).alias("level"), F.lit(0).alias("is_leaf"))
    nation = table(spark, folder, "nation").select(
        (F.col("n_nationkey") + 100).cast("bigint").alias("node_id"), F.col("n_name").alias("node_name"),
        (F.col("n_regionkey") + 1).cast("bigint").alias("parent_id"), F.lit(2).alias("level"), F.lit(0).alias("is_leaf"))
    supplier = table(spark, folder, "supplier").select(
        (F.col("s_suppkey") + 1000).cast("bigint").alias("node_id"), F.col("s_name").alias("node_name"),
        (F.col("s_nationkey") + 100).cast("bigint").alias("parent_id"), F.lit(3).alias("level"), F.lit(1).alias("is_leaf"))
    return region.unionByName(nation).unionByName(supplier)


def code_map(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as codes hung on the tree's leaves."""
    s = table(spark, folder, "supplier").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("lo"))
    n, lo = s.select("n").scalar(), s.select("lo").scalar()
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("code"),
        (F.col("p_partkey") % n + lo + 1000).alias("node_id"),
        (F.col("p_size") % 2).alias("common_use"),
        (F.col("p_size") % 3 == 0).cast("int").alias("default_use"),
    )


def donations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("candidate_id"), F.col("o_orderdate").cast("date").alias("trans_date"), F.col("o_totalprice").alias("amount"))


def attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as donors: balances as worth, market segments as classes.

    Balances below 100 stand for a missing net worth, so that NULLs occur.
    """
    c = F.col("c_acctbal")
    key = F.col("c_custkey")
    segments = {"isClassADonor": "AUTOMOBILE", "isClassBDonor": "BUILDING", "isClassCDonor": "FURNITURE", "isClassDDonor": "MACHINERY"}
    return table(spark, folder, "customer").select(
        key.alias("candidate_id"),
        (key % 7 * 1000).cast("double").alias("totalHouseholdDebt"),
        ((key % 13) / F.lit(10.0)).alias("primaryPropertyLoanToValue"),
        (F.lit(1000.0) * (key % 50 + 1)).alias("primaryPropertyValue"),
        (key % 4).cast("int").alias("propertyCount"),
        F.when(c >= 100, c).alias("NetWorth"),
        *[(F.col("c_mktsegment") == v).cast("int").alias(k) for k, v in segments.items()],
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.round(F.col("o_totalprice") / 500000, 3).alias("score"))


def multiclass(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with three class scores (rounded, so ties occur) and the status as label."""
    a = F.round(F.col("o_totalprice") / 500000, 2)
    b = F.round((F.col("o_custkey") % 100) / F.lit(100.0), 2)
    c = F.round((F.col("o_orderkey") % 37) / F.lit(37.0), 2)
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), label.alias("label"), F.array(a, b, c).alias("probability"))


def probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each of five event types per user and day, as class probabilities."""
    kinds = {"pred_whi": "view", "pred_bla": "click", "pred_his": "purchase", "pred_asi": "signup", "pred_oth": "error"}
    return (
        table(spark, folder, "events").groupBy(F.col("user_id").alias("member_id"), F.col("ts").cast("date").alias("day"))
        .agg(*[(F.count_if(F.col("event_type") == v) / F.count("*")).alias(k) for k, v in kinds.items()])
    )


def players(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as players, their orders as play."""
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("paid"), F.countDistinct(F.col("o_orderdate").cast("date")).alias("days"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    c = table(spark, folder, "customer")
    none = F.lit(0).cast("bigint")
    level = F.when(F.col("c_acctbal") < 2000, "Low").when(F.col("c_acctbal") < 6000, "Medium").otherwise("High")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(
        F.col("c_custkey").alias("PlayerID"),
        (F.col("c_custkey") % 35 + 15).cast("int").alias("Age"),
        F.round(F.coalesce("paid", F.lit(0.0)) / 100000, 7).alias("PlayTimeHours"),
        (F.col("c_nationkey") % 2).alias("InGamePurchases"),
        F.coalesce("days", none).cast("int").alias("SessionsPerWeek"),
        (F.col("c_custkey") % 60 + 1).cast("int").alias("AvgSessionDurationMinutes"),
        F.coalesce("n", none).cast("int").alias("PlayerLevel"),
        F.coalesce("done", none).cast("int").alias("AchievementsUnlocked"),
        F.col("c_mktsegment").alias("GameGenre"),
        F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")).alias("Location"),
        level.alias("EngagementLevel"),
    )


def cart_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as cart actions: an error event removes the item, any other adds it.

    Values below 1 stand for rejected prices.
    """
    return table(spark, folder, "events").select(
        F.col("event_id"), F.col("ts"), F.col("user_id").alias("cart"),
        F.regexp_extract("props", r"(\d+)", 1).alias("item"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"),
        F.when(F.col("value") < 1, -F.col("value")).otherwise(F.col("value")).alias("price"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("features"))
