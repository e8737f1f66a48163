"""Source and sink queries: each writes a test table, reads it back and reports it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog.book import Book, rounded, with_views
from cohortry.operators import curves as C
from cohortry.sources import io, views as V
from cohortry.streaming.carts import fresh_root

BOOK = Book()


@BOOK.add("csv_round_trip", with_views("scored") + " SELECT * FROM scored")
def csv_round_trip(spark, folder):
    path = fresh_root(spark, "csv")
    io.write_csv(V.scored(spark, folder), path)
    return io.read_csv(spark, path, "id bigint, label int, score double")


@BOOK.add("load_roles", with_views("donations", "attributes") + """ SELECT candidate_id, target, trans_date, amount, NetWorth FROM (
 SELECT candidate_id AS cid, CASE WHEN NetWorth > 5000 THEN 1 ELSE 0 END AS target, NetWorth FROM attributes) a JOIN donations ON cid = candidate_id""")
def load_roles(spark, folder):
    root = fresh_root(spark, "roles")
    a = V.attributes(spark, folder)
    io.write_csv(a.select(F.col("candidate_id").alias("cand_id"), F.coalesce(F.col("NetWorth") > 5000, F.lit(False)).cast("int").alias("ideal_donor")), f"{root}/label.csv")
    io.write_csv(V.donations(spark, folder).withColumnRenamed("candidate_id", "cand_id"), f"{root}/donation.csv")
    io.write_csv(a.select(F.col("candidate_id").alias("cand_id"), "NetWorth"), f"{root}/feature.csv")
    schemas = {"label": io.LABEL_SCHEMA, "donation": io.DONATION_SCHEMA, "feature": "cand_id bigint, NetWorth double"}
    labels, donations, features = io.load_roles(spark, [f"{root}/{r}.csv" for r in schemas], schemas)
    return labels.join(donations, "candidate_id").join(features, "candidate_id")


@BOOK.add("publish_table", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def publish_table(spark, folder):
    path = fresh_root(spark, "published")
    io.publish(V.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return io.load_table(spark, path)


@BOOK.add("metrics_round_trip", with_views("scored") + " SELECT COUNT(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp, COUNT(*) FILTER (WHERE score > 0.5) AS contacted FROM scored")
def metrics_round_trip(spark, folder):
    path = fresh_root(spark, "metrics")
    io.write_metrics(C.confusion(V.scored(spark, folder)), path)
    return io.read_metrics(spark, path).select("tp", "contacted")


@BOOK.add("params_round_trip", with_views("scored") + " SELECT MAX(score) AS threshold, COUNT(*) AS n FROM scored")
def params_round_trip(spark, folder):
    """A tuned threshold saved as a parameter and read back."""
    path = fresh_root(spark, "params")
    row = V.scored(spark, folder).agg(F.max("score").alias("threshold"), F.count("*").alias("n")).first()
    io.save_params(spark, row.asDict(), path)
    params = io.load_params(spark, path)
    return rounded(V.scored(spark, folder).agg(F.lit(params["threshold"]).alias("threshold"), F.lit(params["n"]).cast("bigint").alias("n")).select("threshold", "n"))
