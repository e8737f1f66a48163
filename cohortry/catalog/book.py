"""A small register: query name, callable, SQL; and the SQL text of the shared views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Book:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        """Register the decorated ``fn(spark, folder)`` under ``name``."""

        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql.strip()
            return fn

        return keep


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Round the double columns so that sums taken in another order compare equal.

    Adding 0.0 turns a negative zero into zero.
    """
    out = df
    for f in df.schema.fields:
        if f.dataType.simpleString() == "double":
            out = out.withColumn(f.name, F.round(F.col(f.name), own.get(f.name, digits)) + F.lit(0.0))
    return out


def hash_sql(key: str, seed: int = 42) -> str:
    """SQL of ``row_hash(key, seed=seed)``."""
    return f"CAST('0x' || substr(md5({key} || ':{seed}'), 1, 15) AS BIGINT)"


def with_views(*names: str) -> str:
    """``WITH RECURSIVE`` and the given view definitions."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)


VIEWS = {
    "claims": """
        SELECT o_custkey AS member_id, l_partkey AS code, CAST(l_shipdate AS DATE) AS service_date,
               l_quantity * 6 AS days_supply, l_quantity AS quantity, l_extendedprice AS paid_amount,
               l_linestatus AS claim_status, l_returnflag AS lob, l_orderkey AS claim_id, l_linenumber AS line_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "crosswalk": "SELECT p_partkey % 3 AS class_id, p_partkey AS code FROM part",
    "tree": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS node_id, r_name AS node_name, CAST(0 AS BIGINT) AS parent_id, 1 AS level, 0 AS is_leaf FROM region
        UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), n_name, CAST(n_regionkey + 1 AS BIGINT), 2, 0 FROM nation
        UNION ALL SELECT CAST(s_suppkey + 1000 AS BIGINT), s_name, CAST(s_nationkey + 100 AS BIGINT), 3, 1 FROM supplier""",
    "code_map": """
        SELECT p_partkey AS code, p_partkey % (SELECT COUNT(*) FROM supplier) + (SELECT MIN(s_suppkey) FROM supplier) + 1000 AS node_id,
               p_size % 2 AS common_use, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS default_use
        FROM part""",
    "donations": "SELECT o_custkey AS candidate_id, CAST(o_orderdate AS DATE) AS trans_date, o_totalprice AS amount FROM orders",
    "attributes": """
        SELECT c_custkey AS candidate_id, CAST(c_custkey % 7 * 1000 AS DOUBLE) AS totalHouseholdDebt,
               CAST(c_custkey % 13 AS DOUBLE) / 10.0 AS primaryPropertyLoanToValue,
               CAST(1000 * (c_custkey % 50 + 1) AS DOUBLE) AS primaryPropertyValue,
               CAST(c_custkey % 4 AS INTEGER) AS propertyCount,
               CASE WHEN c_acctbal >= 100 THEN c_acctbal END AS NetWorth,
               CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS isClassADonor,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS isClassBDonor,
               CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS isClassCDonor,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS isClassDDonor
        FROM customer""",
    "scored": """
        SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
               round(o_totalprice / 500000, 3) AS score
        FROM orders""",
    "multiclass": """
        SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
               [round(o_totalprice / 500000, 2), round((o_custkey % 100) / 100.0::DOUBLE, 2), round((o_orderkey % 37) / 37.0::DOUBLE, 2)] AS probability
        FROM orders""",
    "probabilities": """
        SELECT user_id AS member_id, CAST(ts AS DATE) AS day,
               CAST(COUNT(*) FILTER (WHERE event_type = 'view') AS DOUBLE) / COUNT(*) AS pred_whi,
               CAST(COUNT(*) FILTER (WHERE event_type = 'click') AS DOUBLE) / COUNT(*) AS pred_bla,
               CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / COUNT(*) AS pred_his,
               CAST(COUNT(*) FILTER (WHERE event_type = 'signup') AS DOUBLE) / COUNT(*) AS pred_asi,
               CAST(COUNT(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / COUNT(*) AS pred_oth
        FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "players": """
        SELECT c_custkey AS PlayerID, CAST(c_custkey % 35 + 15 AS INTEGER) AS Age,
               round(coalesce(paid, 0.0) / 100000, 7) AS PlayTimeHours, c_nationkey % 2 AS InGamePurchases,
               CAST(coalesce(days, 0) AS INTEGER) AS SessionsPerWeek,
               CAST(c_custkey % 60 + 1 AS INTEGER) AS AvgSessionDurationMinutes,
               CAST(coalesce(n, 0) AS INTEGER) AS PlayerLevel, CAST(coalesce(done, 0) AS INTEGER) AS AchievementsUnlocked,
               c_mktsegment AS GameGenre, 'R' || CAST(c_nationkey % 5 AS VARCHAR) AS Location,
               CASE WHEN c_acctbal < 2000 THEN 'Low' WHEN c_acctbal < 6000 THEN 'Medium' ELSE 'High' END AS EngagementLevel
        FROM customer LEFT JOIN (
            SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS paid, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS days,
                   COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done
            FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""",
    "cart_log": """
        SELECT event_id, ts, user_id AS cart, regexp_extract(props, '(\\d+)', 1) AS item,
               CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action,
               CASE WHEN value < 1 THEN -value ELSE value END AS price
        FROM events""",
    "vectors": "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings",
}
