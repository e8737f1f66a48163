import numpy as np
import pytest

from cohortry.operators import neighbours as N


def _points(spark, n=300, dim=3, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 20
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim))
    if copies:
        x[:copies] = x[0]
    label = rng.integers(0, 3, n)
    rows = [(int(i), int(label[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, label int, features array<double>"), x, label


def _brute(x, k, mask=None):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        if mask is not None:
            d[mask != mask[i]] = np.inf
        d[i] = np.inf
        order = np.lexsort((np.arange(len(x)), d))[:k]
        out[i] = [(int(j), round(float(d[j]), 9)) for j in order if np.isfinite(d[j])]
    return out


def _got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((r["pos"], r["neighbour"], round(r["distance"], 9)))
    return {i: [(n, d) for _, n, d in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize("copies", [0, 120])
def test_knn_in_many_blocks_is_exact(spark, copies):
    """Also where a large share of the points are copies of one."""
    df, x, _ = _points(spark, copies=copies)
    assert _got(N.knn(df, 4, block=16)) == _brute(x, 4)


def test_knn_within_groups(spark):
    df, x, label = _points(spark, n=150)
    assert _got(N.knn(df, 3, block=16, group="label")) == _brute(x, 3, label)


def test_blocks_are_pruned():
    shapes = [{"block": i, "n": 10, "centre": [100.0 * i, 0.0], "radius": 1.0, "grp": ""} for i in range(20)]
    import pandas as pd

    pairs = pd.concat(N._block_pairs(shapes, 3)([pd.DataFrame({"i": range(20)})]))
    assert len(pairs) == 20  # each block only meets itself


def test_tomek_links(spark):
    df, x, label = _points(spark, n=120)
    nearest = {i: v[0][0] for i, v in _brute(x, 1).items()}
    want = {(i, j) for i, j in nearest.items() if i < j and nearest[j] == i and label[i] != label[j]}
    assert {(r["a"], r["b"]) for r in N.tomek_links(df, block=16).collect()} == want
    kept = {r["id"] for r in N.drop_tomek_links(df, block=16).collect()}
    assert kept == set(range(120)) - {i for pair in want for i in pair}


def test_smote_points_lie_between_neighbours(spark):
    df, x, label = _points(spark, n=90)
    targets = {c: 60 for c in range(3)}
    out = N.smote(df, targets, k=3, block=16).collect()
    assert {c: sum(r["label"] == c for r in out) for c in range(3)} == {c: max(60, int((label == c).sum())) for c in range(3)}
    assert len({r["id"] for r in out}) == len(out)
    near = _brute(x, 3, label)
    for r in out:
        if not r["synthetic"]:
            continue
        p = np.array(r["features"])
        on_line = False
        for i in np.flatnonzero(label == r["label"]):
            for j, _ in near[int(i)]:
                a, b = x[i], x[j]
                t = np.dot(p - a, b - a) / np.dot(b - a, b - a)
                on_line |= bool(-1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * (b - a), p, atol=1e-8))
        assert on_line


def test_smote_is_repeatable(spark):
    df, _, _ = _points(spark, n=60)
    a, b = (sorted((r["id"], tuple(r["features"])) for r in N.smote(df, {0: 40}, block=16).collect()) for _ in range(2))
    assert a == b


def test_knn_with_repeated_and_null_ids_and_an_offset(spark):
    """An id that occurs twice is never its own neighbour; far from the origin and among copies results stay exact."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 5)), 2) + 1e5
    x[40:60] = x[40]
    ids = [int(i) for i in range(90)]
    ids[1], ids[2], ids[80] = 0, None, None
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in zip(ids, x)], "id bigint, features array<double>")
    want = {}
    for i, p in zip(ids, x):
        d = [(float(np.sqrt(((p - q) ** 2).sum())), -1 if j is None else j) for j, q in zip(ids, x) if q is not p and (i is None or i != j)]
        want.setdefault(i, []).extend(d)
    got = {}
    for r in N.knn(df, 3, block=16).collect():
        got.setdefault(r["id"], []).append(round(r["distance"], 6))
    own = {i: [round(v, 6) for v, _ in sorted(d)[:3]] for i, d in want.items() if i is not None and i != 0}
    assert {i: sorted(v) for i, v in got.items() if i is not None and i != 0} == own
    assert None in got and len(got[0]) == 3
    assert not [r for r in N.knn(df, 3, block=16).where("id = neighbour").collect()]


def test_a_block_travels_once_a_strip(spark, monkeypatch):
    """Few groups of many blocks each: what is shuffled does not grow with the square of the number of blocks."""
    df, x, _ = _points(spark, n=600)
    seen = []
    compare = N._top_k
    monkeypatch.setattr(N, "_top_k", lambda shapes, k: seen.append(len(shapes)) or compare(shapes, k))
    plan = N.knn(df, 2, block=4)
    assert seen == [150]
    assert _got(plan) == _brute(x, 2)


def test_few_distances_are_computed_exactly(monkeypatch):
    """A product gives the rough distances; the old form held all differences of two blocks."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    ids, none = np.arange(600), np.zeros(600, bool)
    best = N._Nearest(x, ids, none, 4)
    merged = []
    merge = N._Nearest._merge
    monkeypatch.setattr(N._Nearest, "_merge", lambda self, row, *rest: merged.append(len(row)) or merge(self, row, *rest))
    for i in range(0, 600, 100):
        best.show(x[i : i + 100], ids[i : i + 100], none[i : i + 100])
    got = best.found()
    assert sum(merged) < 600 * 600 / 20
    assert {i: list(g["neighbour"]) for i, g in got.groupby("id")} == {i: [j for j, _ in v] for i, v in _brute(x, 4).items()}
