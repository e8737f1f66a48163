"""Descendants by steps of doubled length against a walk level by level."""

import random
from collections import Counter

import pytest

from cohortry.operators import hierarchy

COLUMNS = "node_id int, parent_id int, level int, node_name string"


def walk(rows, roots):
    out, front = Counter(), [r for r in rows if r[0] in roots]
    while front:
        front = [r for up in front for r in rows if None not in (r[1], r[2], up[0], up[2]) and r[1] == up[0] and r[2] == up[2] + 1]
        out.update(front)
    return out


def chain(depth):
    return [(i + 1, i, i + 1, f"n{i + 1}") for i in range(depth)]


def bushes(seed, repeated=False):
    rnd, rows = random.Random(seed), [(1, 0, 1, "a"), (2, 0, 1, "b")]
    for i in range(3, 60):
        up = rnd.choice(rows)
        rows.append((i, up[0], up[2] + 1 + (rnd.random() < 0.1), f"n{i}"))  # some skip a level: below nothing
    return rows + rows[4:9] if repeated else rows


@pytest.mark.parametrize(
    ("rows", "roots"),
    [
        (chain(21), [1]),
        (chain(21), [1, 4, 20]),
        (bushes(1), [1, 2]),
        (bushes(2, repeated=True), [1, 3, 5]),
        ([*chain(4), (9, None, 2, "no parent"), (8, 1, None, "no level"), (None, 1, 2, None)], [1]),
        (chain(3), [99]),
        (chain(3), []),
        ([], [1]),
    ],
)
def test_descendants_equal_a_walk(spark, rows, roots):
    got = hierarchy.descendants(spark.createDataFrame(rows, COLUMNS), roots)
    assert got.columns == ["node_id", "parent_id", "level", "node_name"]
    assert Counter(map(tuple, got.collect())) == walk(rows, roots)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    calls, real = [], hierarchy.materialize
    monkeypatch.setattr(hierarchy, "materialize", lambda df: calls.append(1) or real(df))
    assert hierarchy.descendants(spark.createDataFrame(chain(30), COLUMNS), [1]).count() == 29
    assert len(calls) == 2 * 5  # steps of 1, 2, 4, 8 and 16 levels
