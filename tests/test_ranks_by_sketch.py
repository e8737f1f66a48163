import math
import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators import ranking as R


def ntile(rows, tiles):
    """Tile of each (value, key, id): NULLs first, NaN last, then the key."""
    order = sorted(rows, key=lambda r: (r[0] is not None, math.isnan(r[0]) if isinstance(r[0], float) else False, 0 if r[0] is None or r[0] != r[0] else r[0], r[1]))
    base, extra = divmod(len(order), tiles)
    sizes = [base + (t < extra) for t in range(tiles)]
    tile = [t + 1 for t, n in enumerate(sizes) for _ in range(n)]
    return {r[2]: t for r, t in zip(order, tile)}, order


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        a = rng.choice([None, float("nan"), float("inf"), -float("inf")]) if i % 40 == 0 else rng.gauss(0, 1)
        rows.append((i, a, float(rng.randrange(4)), None if i % 3 else rng.random()))
    return rows


@pytest.mark.parametrize("tiles", [1, 4, 100, 2000])
def test_tiles_of_several_columns(spark, data, tiles):
    df = spark.createDataFrame(data, "id long, a double, b double, c double").repartition(4)
    got = {r["id"]: r for r in R.tile_columns(df, {"a": "ta", "b": "tb", "c": "tc"}, "id", tiles).collect()}
    for at, name in ((1, "ta"), (2, "tb"), (3, "tc")):
        want, _ = ntile([(r[at], r[0], r[0]) for r in data], tiles)
        assert {i: r[name] for i, r in got.items()} == want


def test_brackets_that_are_too_narrow_are_widened(spark, data, monkeypatch):
    monkeypatch.setattr(R, "_SKETCH", 8)
    monkeypatch.setattr(R, "_MARGIN", 1e-6)
    df = spark.createDataFrame(data, "id long, a double, b double, c double").repartition(4)
    total, found = R.rows_at(df, ["a", "b"], "id", lambda n: [1, 200, 751, n])
    for at, name in ((1, "a"), (2, "b")):
        _, order = ntile([(r[at], r[0], r[0]) for r in data], 1)
        assert total == 1500 and {r: repr(tuple(p)) for r, p in found[name].items()} == {r: repr(order[r - 1][:2]) for r in (1, 200, 751, 1500)}
    assert sorted(r["id"] for r in R.top_k(df, "c", "id", 40).collect()) == sorted(r[0] for r in sorted((r for r in data if r[3] is not None), key=lambda r: -r[3])[:40])


def test_equal_pairs_on_both_sides_of_a_boundary(spark):
    df = spark.createDataFrame([(1, 1.0)] * 10, "k long, v double")
    assert R.rows_at(df, ["v"], "k", lambda n: [5])[1] == {"v": None}
    tiles = [r["t"] for r in R.tile_columns(df, {"v": "t"}, "k", 4).collect()]
    assert sorted(tiles) == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    quartiles = {r["quartile"]: (r["n"], r["value"]) for r in R.quartiles_by_ntile(df, "v", "k").collect()}
    assert quartiles == {"Q1": (10, 1.0), "Q2": (10, 1.0), "Q3": (10, 1.0)}


def test_empty_tables_and_other_types(spark):
    empty = spark.createDataFrame([], "k long, v double")
    assert R.tile_columns(empty, {"v": "t"}, "k").count() == 0
    assert [(r["n"], r["value"]) for r in R.quartiles_by_ntile(empty, "v", "k").collect()] == [(0, None)] * 3
    words = spark.createDataFrame([(i, w) for i, w in enumerate("badc")], "k long, v string")
    assert {r["v"]: r["t"] for r in R.tile_columns(words, {"v": "t"}, "k", 2).collect()} == {"a": 1, "b": 1, "c": 2, "d": 2}
    exact = spark.range(500).withColumn("v", (F.col("id") % 7).cast("decimal(38,2)"))
    want, _ = ntile([(i % 7, i, i) for i in range(500)], 9)
    assert {r["id"]: r["t"] for r in R.tile_columns(exact, {"v": "t"}, "id", 9).collect()} == want


def test_keys_of_ties_are_bracketed_too(spark, monkeypatch):
    """Three values and NULLs fill the table: few rows are sorted, and tiles equal NTILE's."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cohortry.operators import ranking as R

    draw = random.Random(4)
    n = 20_000
    keys = draw.sample(range(10 * n), n)
    rows = [(None if i % 7 == 0 else float(draw.choice([1, 2, 5])), k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "v double, k long").repartition(3)
    monkeypatch.setattr(R, "_TIES", 100, raising=False)
    sorted_rows, ordered = [], R._ordered

    def counted(frame, order):
        out = ordered(frame, order)
        sorted_rows.append(out.count())
        return out

    monkeypatch.setattr(R, "_ordered", counted)
    got = R.percentile_bucket(df, "v", "k", name="tile")
    want = df.withColumn("want", F.ntile(100).over(Window.orderBy(F.col("v").asc_nulls_first(), "k")).cast("bigint"))
    assert got.join(want, "k").where("tile <> want").count() == 0 and got.count() == n
    assert sum(sorted_rows) < n / 4


def test_tiles_with_infinity_nan_and_null_keys(spark):
    from pyspark.sql import functions as F

    from cohortry.operators import ranking as R

    values = [float("inf"), float("nan"), float("-inf"), None, -0.0, 0.0, 1.5]
    rows = [(values[i % 7], None if i == 3 else i) for i in range(70)]
    df = spark.createDataFrame(rows, "v double, k long")
    got = R.percentile_bucket(df, "v", "k", tiles=9, name="tile").select("k", "tile").collect()
    place = lambda r: (0, 0) if r[0] is None else (2, 0) if r[0] != r[0] else (1, r[0])
    order = sorted(rows, key=lambda r: (place(r), -1 if r[1] is None else r[1]))
    ends = R.last_ranks(70, 9)
    want = {r[1]: next(t for t, e in enumerate(ends, 1) if i <= e) for i, r in enumerate(order, 1)}
    assert {r["k"]: r["tile"] for r in got} == want
