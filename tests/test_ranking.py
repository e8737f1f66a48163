import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import profile as P
from cohortry.operators import ranking as R
from cohortry.operators.splits import allot, kfold_column, stratified_split


@pytest.fixture(scope="module")
def tied(spark):
    """600 rows; one value holds a third of them, some are NULL."""
    rng = random.Random(5)
    rows = [(i, None if i % 50 == 0 else (7.0 if i % 3 == 0 else float(rng.randint(0, 40))), "abc"[i % 3]) for i in range(600)]
    return spark.createDataFrame(rows, "id bigint, v double, g string").repartition(8), rows


def order_key(r):
    return (r[1] is not None, r[1] if r[1] is not None else 0, r[0])


def test_global_rank(tied):
    df, rows = tied
    got = R.global_rank(df, [F.col("v").asc_nulls_first(), "id"])
    assert got.total == 600
    assert {r["id"]: r["rank"] for r in got.rows.collect()} == {r[0]: i for i, r in enumerate(sorted(rows, key=order_key), 1)}


@pytest.mark.parametrize("tiles", [7, 100, 599, 700])
def test_tiles(tied, tiles):
    df, rows = tied
    base, extra = divmod(600, tiles)
    want, i = {}, 0
    ordered = sorted(rows, key=order_key)
    for t in range(1, tiles + 1):
        for r in ordered[i : i + base + (t <= extra)]:
            want[r[0]] = t
        i += base + (t <= extra)
    assert {r["id"]: r["t"] for r in R.percentile_bucket(df, "v", "id", tiles, "t").collect()} == want


def test_rank_within(tied):
    df, rows = tied
    got = {r["id"]: r["rank"] for r in R.rank_within(df, ["g"], ["v", "id"]).collect()}
    for g in "abc":
        for i, r in enumerate(sorted((r for r in rows if r[2] == g), key=order_key), 1):
            assert got[r[0]] == i


def test_running_totals_with_peeks_and_groups(spark, tied):
    df, rows = tied
    counts = df.where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    got = sorted((tuple(r) for r in R.running_totals(counts, ["v"], {"cum": "c"}, peeks=["c"]).select("v", "c", "cum", "next_c").collect()))
    run = 0
    for i, (v, c, cum, nxt) in enumerate(got):
        run += c
        assert cum == run and nxt == (got[i + 1][1] if i + 1 < len(got) else None)
    per = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    last = R.running_totals(per, ["v"], {"cum": "c"}, ["g"]).groupBy("g").agg(F.max("cum")).collect()
    assert {r[0]: r[1] for r in last} == {g: sum(r[2] == g and r[1] is not None for r in rows) for g in "abc"}


def test_exact_quantiles(tied):
    df, rows = tied
    got = R.exact_quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0), ["g"]).collect()
    for r in got:
        x = [v for _, v, g in rows if g == r["g"] and v is not None]
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(x, (0.0, 0.25, 0.5, 0.9, 1.0))))
    row = R.exact_quantiles(df, "v", (0.5,)).first()
    assert row["q0"] == np.quantile([r[1] for r in rows if r[1] is not None], 0.5)


def test_top_k_gives_exactly_k_in_order(tied):
    df, rows = tied
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for k in (0, 1, 250, len(rows) - 1, len(rows), len(rows) + 1):  # the last rows have no score
        assert [r["id"] for r in R.top_k(df, "v", "id", k).collect()] == want[:k]


@pytest.fixture(scope="module")
def repeated(spark):
    """Keys that repeat, are NULL, or sit in rows equal in every column."""
    rows = [(None, 5.0, "a"), (None, 5.0, "b"), (1, 5.0, "a"), (1, 5.0, "a"), (1, 5.0, "b"), (2, None, "a"), (2, None, "a"), (None, None, "c")]
    return spark.createDataFrame(rows, "k int, v double, t string").repartition(3), len(rows)


def test_top_k_and_sample_with_repeated_and_null_keys(repeated):
    df, n = repeated
    for k in range(n + 2):
        got = R.top_k(df, "v", "k", k).collect()
        assert len(got) == min(k, n)
        assert [(r["v"] is None, r["k"] is not None, r["k"] or 0) for r in got] == sorted((r["v"] is None, r["k"] is not None, r["k"] or 0) for r in df.collect())[:k]
        assert R.sample_n(df, k, "k").count() == min(k, n)
    assert R.top_k(df.where("k = 9"), "v", "k", 3).count() == 0


def test_sample_is_exact_and_repeatable(tied):
    df, _ = tied
    a = {r["id"] for r in R.sample_n(df, 100, "id").collect()}
    b = {r["id"] for r in R.sample_n(df.repartition(3), 100, "id").collect()}
    assert a == b and len(a) == 100


def test_split_has_exact_shares(tied):
    df, _ = tied
    df = df.withColumn("y", F.when(F.col("id") < 37, "rare").otherwise("common"))
    out = stratified_split(df, "y", "id", 0.3)
    got = {(r["y"], r["is_test"]): r["n"] for r in out.groupBy("y", "is_test").agg(F.count("*").alias("n")).collect()}
    quota = allot({"rare": 37, "common": 563}, 180)
    assert got["rare", True] == quota["rare"] and got["common", True] == quota["common"] and sum(got.values()) == 600
    again = stratified_split(df.repartition(5), "y", "id", 0.3)
    assert {r["id"] for r in out.where("is_test").collect()} == {r["id"] for r in again.where("is_test").collect()}


def test_split_edges(spark):
    df = spark.range(10).withColumn("y", F.lit(1))
    assert stratified_split(df, "y", "id", 0.0).where("is_test").count() == 0
    assert stratified_split(df, "y", "id", 1.0).where("is_test").count() == 10


def test_folds_are_balanced(tied):
    df, _ = tied
    out = kfold_column(df, "g", "id", 7).groupBy("g", "fold").agg(F.count("*").alias("n")).collect()
    assert len(out) == 21 and {r["n"] for r in out} == {28, 29}
    few = df.where("id < 3")
    assert few.count() == kfold_column(few, "g", "id", 5).where(F.col("fold").between(0, 4)).count()


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    got = {r["bin"]: r["n"] for r in P.histogram(df, "x", 5).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert [(r["bin"], r["n"]) for r in P.histogram(df, "x", 5).collect()] == [(1, 4)]


def test_corr_skips_null_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 5.0, 2.0), (4.0, None, 0.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in P.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1])
    assert got["b", "c"] == pytest.approx(1.0) and got["a", "a"] == 1.0


def test_top_abs_settles_ties_by_the_key(spark):
    rows = [("a", i, v) for i, v in enumerate([3.0, -3.0, 3.0, -1.0, None, 3.0])] + [("b", 9, 1.0)]
    df = spark.createDataFrame(rows, "g string, id int, v double").repartition(4)
    assert [r["id"] for r in R.top_abs(df, "v", 3, key="id").collect()] == [1, 0, 2]
    assert [r["id"] for r in R.top_abs(df, "v", 3, ["g"], key="id").collect()] == [1, 0, 2, 9]
