"""Permutation importance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalar import row_hash
from cohortry.operators.curves import multiclass_metrics
from cohortry.operators.ranking import global_rank


def _shifts(n: int, repeats: int, seed: int) -> list[int]:
    """Per repeat how far in the cycle of ``n`` rows a row's donor is."""
    return [int(hashlib.md5(f"{seed}:{r}".encode()).hexdigest()[:15], 16) % (n - 1) + 1 if n > 1 else 0 for r in range(repeats)]


def _shuffled(df: DataFrame, key: str, columns: Sequence[str], seed: int, repeats: int = 1) -> DataFrame:
    """Every row beside another row's values, for each ``repeat``.

    The rows are ranked once by a seeded hash; a repeat turns this cycle by its own distance, which
    maps ranks to ranks one to one, so no repeat sorts again.  A single row is its own donor.
    """
    ranked = global_rank(df, [row_hash(key, seed=seed), key], "_rank")
    turns = F.array(*[F.lit(s).cast("long") for s in _shifts(ranked.total, repeats, seed)])
    rows = ranked.rows.select("*", F.posexplode(turns).alias("repeat", "_turn"))
    rows = rows.withColumn("_donor", (F.col("_rank") - 1 + F.col("_turn")) % F.lit(max(ranked.total, 1)) + 1).drop("_rank", "_turn")
    donor = ranked.rows.select(F.col("_rank").alias("_donor"), *[F.col(c).alias(f"_d_{c}") for c in columns])
    return rows.join(donor, "_donor").drop("_donor")


def permutation_importance(predict: Callable[[DataFrame], DataFrame], df: DataFrame, key: str, label: str, columns: Sequence[str], repeats: int = 10, metric: str = "f1", seed: int = 42) -> DataFrame:
    """Mean and deviation of the weighted score lost when a column is shuffled.

    ``predict`` adds a ``prediction`` column and is called twice: on the rows, and on all repeats of all
    columns together, in which the columns of a repeat share one order.  Output: (feature, importance,
    std), least important first.
    """
    base = df.select(key, F.col(label).alias("label"), *columns)
    plain = predict(base).select(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("int").alias("repeat"), F.col("label"), "prediction")
    rows = _shuffled(base, key, columns, seed, repeats).withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    swapped = rows.select(
        key, "label", "feature", "repeat",
        *[F.when(F.col("feature") == c, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
    )
    trials = plain.unionByName(predict(swapped).select("feature", "repeat", "label", "prediction"))
    scores = multiclass_metrics(trials, ["feature", "repeat"]).select("feature", "repeat", F.col(metric).alias("_score"))
    whole = scores.where(F.col("feature").isNull()).select("_score").scalar()
    lost = scores.where(F.col("feature").isNotNull()).withColumn("_lost", whole - F.col("_score"))
    return lost.groupBy("feature").agg(F.avg("_lost").alias("importance"), F.stddev_pop("_lost").alias("std")).orderBy("importance", "feature")
