import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import negatives

SCHEMA = "vec_id long, label int, x array<long>, score string"


def brute(rows, every, positives=5, negatives_=5):
    rows = [(i, v, c, x) for i, (v, c, x) in enumerate(rows) if c is not None and x is not None and None not in x]
    last = lambda v: (v is None, v or 0)
    out = []
    for i, a, cls, x in rows:
        if a is None or a % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), last(v), j, v, c) for j, v, c, y in rows if j != i))
        for s, _, _, pos, _ in [r for r in scored if r[4] == cls][:positives]:
            inside = [(v, -t) for t, _, _, v, c in scored if c != cls and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, pos, k, v, -s, t) for k, (v, t) in enumerate(inside[:negatives_], 1)]
    return sorted(out, key=repr)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **more).collect()), key=repr)


@pytest.mark.parametrize("high,width", [(3, 5), (200, 64), (3 << 40, 9)])
def test_equals_brute_force(spark, monkeypatch, high, width):
    """Ties, repeated rows, shorter and empty vectors, NULLs; products beyond 32 and 64 bits."""
    monkeypatch.setattr(negatives, "CANDIDATES", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = random.Random(high)
    near = 1 << 20 if high > 1 << 30 else 1
    base = [rng.randint(-high, high) // near * near for _ in range(width)]
    rows = [(i, rng.choice([0, 1, 2]), [b + rng.randint(-high // 2, high // 2) for b in base]) for i in range(150)]
    if high > 1 << 30:  # products stay within a long, sums of a hundred of them do not
        rows = [(i, c, [v // 4096 for v in x]) for i, c, x in rows]
    rows += [(7, 1, rows[3][2]), (500, 0, rows[3][2][:3]), (501, 1, []), (502, None, rows[0][2]), (503, 1, None), (504, 2, [None] * width)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_null_ids_and_empty_tables(spark):
    rows = [(0, 1, [4, 4]), (None, 1, [4, 3]), (5, 2, [4, 2]), (None, 2, [3, 3])]
    assert mined(spark, rows, 10) == [(0, None, 1, 5, 28, 24), (0, None, 2, None, 28, 24)]
    assert mined(spark, rows[1:], 10) == [] and mined(spark, [], 10) == []
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])], 10) == [(0, 1, 1, 2, 0, 0)]


def test_scores_beyond_a_long_end_at_its_range(spark):
    top = (1 << 63) - 1
    rows = [(0, 1, [top, top]), (1, 1, [top, top]), (2, 2, [top, top // 2])]
    assert mined(spark, rows, 10, share=(10, 100)) == [(0, 1, 1, 2, top, top)]


def test_planes_and_tables():
    rng = np.random.default_rng(1)
    a, c = rng.integers(-500, 500, (6, 19)), rng.integers(-512, 512, (40, 19))
    assert (negatives.scores(negatives.planes(c, 10), negatives.subset_sums(a, np.int64)) == c @ a.T).all()


def test_whole_numbers(spark):
    rows = [([0.5, -0.001, 1.0],), ([float("nan")],), ([float("inf")],), ([None, 1.0],), (None,), ([],)]
    df = spark.createDataFrame(rows, "e array<float>")
    assert [r[0] for r in df.select(negatives.whole_numbers("e")).collect()] == [[128, -1, 256], None, None, None, None, []]
