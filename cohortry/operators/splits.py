"""Train/test splits and folds with exact class shares, fixed by a seeded hash.

Each class is ordered by the hash of the row key.  Only keys are sorted; the few order
positions where a split changes come back to the driver, and the split itself is then a
plain comparison of (hash, key) with those values.  The wide rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalar import row_hash
from cohortry.operators.ranking import global_rank


def split_xy(df: DataFrame, drop: Sequence[str], target: str) -> tuple[list[str], DataFrame]:
    """Feature names, and one row with the number of rows, features and classes."""
    features = [c for c in df.columns if c not in set(drop) | {target}]
    meta = df.agg(F.count("*").alias("n_rows"), F.countDistinct(target).alias("n_classes"))
    return features, meta.withColumn("n_features", F.lit(len(features)))


def _class_counts(df: DataFrame, label: str) -> dict:
    rows = df.groupBy(label).agg(F.count("*").alias("_n")).collect()
    return dict(sorted(((r[0], r["_n"]) for r in rows), key=lambda kv: (kv[0] is not None, kv[0])))


def _cut_points(df: DataFrame, label: str, key: str, seed: int, counts: dict, cuts: dict) -> dict:
    """(hash, key) found at the wanted positions of each class."""
    start, wanted = 0, {}
    for cls, n in counts.items():
        for c in cuts[cls]:
            if 0 < c < n:
                wanted[start + c] = cls
        start += n
    slim = df.select(F.col(label).alias("_y"), row_hash(key, seed=seed).alias("_h"), F.col(key).alias("_k"))
    ranked = global_rank(slim, ["_y", "_h", "_k"], "_rank").rows
    points: dict = {cls: [] for cls in counts}
    if wanted:
        for r in ranked.where(F.col("_rank").isin(list(wanted))).orderBy("_rank").collect():
            points[wanted[r["_rank"]]].append((r["_h"], r["_k"]))
    return points


def _beyond(key: str, seed: int, point: tuple) -> Column:
    h = row_hash(key, seed=seed)
    return (h > point[0]) | ((h == point[0]) & (F.col(key) > F.lit(point[1])))


def _same(label: str, cls) -> Column:
    return F.col(label).eqNullSafe(F.lit(cls))


def allot(counts: dict, total: int) -> dict:
    """Rows per class that add up to ``total``, in proportion; largest remainders get the rest."""
    n = sum(counts.values())
    exact = {c: Fraction(k * total, n) for c, k in counts.items()}
    out = {c: int(x) for c, x in exact.items()}
    for c in sorted(counts, key=lambda c: (-(exact[c] - out[c]), str(c)))[: total - sum(out.values())]:
        out[c] += 1
    return out


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.3, seed: int = 42, name: str = "is_test") -> DataFrame:
    """Mark ceil(share * n) rows as test, in proportion to the classes (runs actions)."""
    counts = _class_counts(df, label)
    n = sum(counts.values())
    quota = allot(counts, -int(-Fraction(str(test_share)) * n // 1))
    points = _cut_points(df, label, key, seed, counts, {c: [q] for c, q in quota.items()})
    mark = F.lit(False)
    for cls, k in counts.items():
        if points[cls]:
            inside = ~_beyond(key, seed, points[cls][0])
        else:
            inside = F.lit(quota[cls] >= k)
        mark = F.when(_same(label, cls), inside).otherwise(mark)
    return df.withColumn(name, mark)


def kfold_column(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold number 0..k-1; each class is spread over the folds evenly (runs actions)."""
    counts = _class_counts(df, label)
    points = _cut_points(df, label, key, seed, counts, {c: [n * i // k for i in range(1, k)] for c, n in counts.items()})
    fold = F.lit(0)
    for cls, n in counts.items():
        at = sum((_beyond(key, seed, p).cast("int") for p in points[cls]), F.lit(0))
        # positions that fell on 0 rows were not looked up: those folds stay empty for this class
        skipped = sum(1 for i in range(1, k) if n * i // k == 0)
        fold = F.when(_same(label, cls), at + skipped).otherwise(fold)
    return df.withColumn(name, fold.cast("int"))
