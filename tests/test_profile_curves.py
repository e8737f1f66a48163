import random

import numpy as np
from pyspark.sql import functions as F

from cohortry.operators import profile as P
from cohortry.sources import io


def test_density_is_close_to_the_kernel_sum_over_all_values(spark):
    rng = random.Random(6)
    data = [("a", rng.gauss(0, 1)) for _ in range(400)] + [("b", rng.gauss(5, 2)) for _ in range(100)] + [(None, float(i % 5)) for i in range(50)]
    data += [("a", None), ("a", float("nan")), ("b", float("inf")), ("one", 3.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    for common in (False, True):
        rows = P.density(df, "v", ["k"], points=60, common=common).collect()
        assert {r["k"] for r in rows} == {"a", "b", None}
        for k in ("a", "b", None):
            x = np.array([v for c, v in data if c == k and v is not None and np.isfinite(v)])
            h = x.std(ddof=1) * len(x) ** -0.2
            own = sorted((r["point"], r["x"], r["density"]) for r in rows if r["k"] == k)
            grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 60)
            want = np.exp(-(((grid[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (h * np.sqrt(2 * np.pi) * (553 if common else len(x)))
            assert np.allclose([r[1] for r in own], grid) and np.allclose([r[2] for r in own], want, atol=2e-3)
    assert P.density(df.limit(0), "v", ["k"]).count() == 0 and P.density(df.where("k = 'a'"), "v").count() == 200


def test_histogram_counts_what_lies_beyond_its_limits(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 1.0, 9.9, 10.0, 10.1, float("nan"), None)], "v double")
    rows = {r["bin"]: (r["bin_start"], r["n"]) for r in P.histogram(df, "v", 2, (), 0.0, 10.0).collect()}
    assert rows == {0: (None, 1), 1: (0.0, 2), 2: (5.0, 2), 3: (10.0, 2)}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.sql(f"CREATE DATABASE buckets LOCATION '{tmp_path}/db'")
    try:
        left, right = (spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias(name)) for n, name in ((500, "a"), (700, "b")))
        io.publish(left, "buckets.l", bucket_by=(4, "k"))
        io.publish(right, "buckets.r", partition_by=(), bucket_by=(4, "k"))
        joined = io.load_table(spark, "buckets.l").join(io.load_table(spark, "buckets.r").hint("merge"), "k")
        assert joined.count() == 500
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        io.publish(right, "buckets.l", bucket_by=(4, "k"))  # replaces the table
        assert io.load_table(spark, "buckets.l").columns == ["k", "b"]
    finally:
        spark.sql("DROP DATABASE buckets CASCADE")
