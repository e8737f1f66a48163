"""Boosted trees as tables, scores after every round, and a cross-validated number of rounds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.operators.ranking import running_totals
from cohortry.session import materialize, shared_folder


def tree_table(model) -> DataFrame:
    """Nodes of all trees: (tree, weight, node, prediction, rows, weighted_rows, gain, left, right, feature, threshold, categories).

    ``feature`` is -1 in a leaf.  Rows go left if their value is at most ``threshold``, or among
    ``categories`` where the split has some.  Read from the saved form of the model, which is written
    to the shared folder.
    """
    spark = _session()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "tree int, weight double")
    node, split = "nodeData", "nodeData.split"
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col(f"{node}.id").alias("node"), F.col(f"{node}.prediction").alias("prediction"),
        F.col(f"{node}.rawCount").alias("rows"), F.get(f"{node}.impurityStats", F.lit(0)).alias("weighted_rows"), F.col(f"{node}.gain").alias("gain"), F.col(f"{node}.leftChild").alias("left"), F.col(f"{node}.rightChild").alias("right"),
        F.col(f"{split}.featureIndex").alias("feature"),
        F.when((F.col(f"{split}.featureIndex") >= 0) & (F.col(f"{split}.numCategories") < 0), F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(F.col(f"{split}.numCategories") >= 0, F.col(f"{split}.leftCategoriesOrThreshold")).alias("categories"),
    )
    return rows.join(weights, "tree").select("tree", "weight", *rows.columns[1:])


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def split_importance(model, names: Sequence[str]) -> DataFrame:
    """Per feature (feature, gain, splits, mean_gain, cover), least used first.

    ``gain`` is its share of all gain, weighted by the rows of the node; ``mean_gain`` and ``cover`` are
    the mean gain of its splits and the mean number of training rows that reach them.  All are 0 for a
    feature that is never split on.
    """
    own = F.sum(F.col("gain") * F.col("weighted_rows"))
    used = tree_table(model).where("feature >= 0").groupBy("feature").agg(own.alias("_own"), F.count("*").alias("splits"), F.avg("gain").alias("mean_gain"), F.avg("rows").alias("cover"))
    every = used.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    whole = F.sum("_own").over(Window.partitionBy())  # one row a feature
    out = every.join(used.withColumn("gain", F.try_divide("_own", whole)), "feature", "left").drop("feature")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gain", "mean_gain", "cover")]
    out = out.select(F.col("name").alias("feature"), zero[0], F.coalesce("splits", F.lit(0)).cast("int").alias("splits"), *zero[1:])
    return out.orderBy("splits", "gain", "feature")


def _steps(model) -> list[tuple]:
    """Per tree (weight, feature, threshold, categories, left, right, prediction) as arrays by node.

    Bounded by the model: rounds times two to the depth.
    """
    found: dict[int, list] = {}
    for r in tree_table(model).collect():
        found.setdefault(r["tree"], []).append(r)
    out = []
    for t in sorted(found):
        rows = sorted(found[t], key=lambda r: r["node"])
        columns = [np.array([r[c] for r in rows]) for c in ("feature", "left", "right", "prediction")]
        threshold = np.array([np.nan if r["threshold"] is None else r["threshold"] for r in rows])
        out.append((rows[0]["weight"], *columns, threshold, [r["categories"] for r in rows]))
    return out


def _leaf_values(x: np.ndarray, tree: tuple) -> np.ndarray:
    _, feature, left, right, prediction, threshold, categories = tree
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return prediction[at]
        node = at[inner]
        value = x[inner, feature[node]]
        go_left = value <= threshold[node]
        for n in np.unique(node):
            if categories[n] is not None:
                here = node == n
                go_left[here] = np.isin(value[here], categories[n])
        at[inner] = np.where(go_left, left[node], right[node])


def staged_margins(model, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """``keep`` and ``margins``: the booster's margin after each round, from one pass over the rows."""
    trees = _steps(model)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in keep) + ", margins array<double>"
    names = [*keep, "margins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(len(keep)).to_pylist(), np.float64).reshape(b.num_rows, -1)
            sums = np.cumsum([t[0] * _leaf_values(x, t) for t in trees], axis=0).T
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(list(sums), pa.list_(pa.float64()))], names)

    return df.select(*keep, vector_to_array(features).alias("_x")).mapInArrow(run, schema)


def round_scores(staged: DataFrame, metric: str = "average_precision", groups: Sequence[str] = ()) -> DataFrame:
    """(groups, round, score) from rows (groups, label, margins); rounds count from 1.

    ``average_precision`` is larger, ``log_loss`` smaller for a better round.
    """
    long = staged.select(*groups, F.col("label").cast("double").alias("label"), F.posexplode("margins").alias("round", "margin"))
    long = long.withColumn("round", F.col("round") + 1)
    keys = [*groups, "round"]
    if metric == "log_loss":
        signed = (2 * F.col("label") - 1) * F.col("margin")
        # log(1 + e^-2m) without overflow for large negative m
        loss = F.greatest(-2 * signed, F.lit(0.0)) + F.log1p(F.exp(-2 * F.abs(signed)))
        return long.groupBy(*keys).agg(F.avg(loss).alias("score"))
    if metric != "average_precision":
        raise ValueError(f"unknown metric {metric}")
    counts = long.groupBy(*keys, (-F.col("margin")).alias("_order")).agg(F.sum(F.col("label").cast("long")).alias("_pos"), F.count("*").alias("_n"))
    run = running_totals(counts, ["_order"], {"_tp": "_pos", "_all": "_n"}, keys)
    area = F.sum(F.col("_pos") * F.col("_tp") / F.col("_all"))
    return run.groupBy(*keys).agg(F.try_divide(area, F.sum("_pos")).alias("score"))


@dataclass(frozen=True)
class Rounds:
    """The number of rounds found, its score, the scores by round, and the model refitted with it."""

    rounds: int
    score: float
    scores: DataFrame
    model: PipelineModel


def stopping_round(scores: Sequence[tuple[int, float]], patience: int, larger: bool) -> int:
    """The best round before ``patience`` rounds without a better one; the first of equal ones."""
    best_round, best = 0, None
    for n, score in sorted(scores):
        if best is None or (score > best if larger else score < best):
            best_round, best = n, score
        elif n - best_round >= patience:
            break
    return best_round


def cv_rounds(booster, train: DataFrame, folds: int, fold: str = "fold", transform: Pipeline | None = None, metric: str = "average_precision", patience: int = 10) -> Rounds:
    """Cross-validate the number of rounds and refit on all rows with the one found.

    In each fold the booster is fitted once, with its full number of rounds, on the other folds; the
    rows of the fold are scored after every round.  Scores are averaged over the folds by round, and
    the first round that ``patience`` further ones do not improve on is taken.  A transform is fitted
    within each fold.  ``fold`` holds 0..folds-1; rows with another value are only fitted on.
    """
    stages, label = transform.getStages() if transform else [], booster.getLabelCol()
    staged = None
    for i in range(folds):
        model = Pipeline(stages=[*stages, booster]).fit(train.where(F.col(fold) != i))
        held = train.where(F.col(fold) == i)
        held = PipelineModel(model.stages[:-1]).transform(held) if stages else held
        held = held.withColumns({"label": F.col(label).cast("double"), "fold": F.lit(i)})
        part = staged_margins(model.stages[-1], held, ["fold", "label"], booster.getFeaturesCol())
        staged = part if staged is None else staged.unionByName(part)
    by_fold = materialize(round_scores(staged, metric, ["fold"]))
    means = by_fold.groupBy("round").agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("std"))
    listed = means.orderBy("round").collect()  # one row a round
    larger = metric != "log_loss"
    found = stopping_round([(r["round"], r["score"]) for r in listed], patience, larger)
    scores = means.withColumn("best", F.col("round") == found)
    final = booster.copy({booster.maxIter: found})
    return Rounds(found, {r["round"]: r["score"] for r in listed}[found], scores, Pipeline(stages=[*stages, final]).fit(train))


@dataclass(frozen=True)
class Tuned:
    """The best parameters with their number of rounds, all trials, and the model refitted on all rows."""

    params: dict
    rounds: int
    score: float
    trials: DataFrame
    model: PipelineModel


def tuned_booster(booster, train: DataFrame, maps: Sequence[dict], folds: int, fold: str = "fold", transform: Pipeline | None = None, metric: str = "average_precision", patience: int = 10) -> Tuned:
    """For each parameter map cross-validate the number of rounds; refit the best map with its number.

    ``booster`` holds the largest number of rounds.  Trials: (trial, params, rounds, score, best); the
    first of equal scores is best.  Maps come from ``draw_params`` or ``grid_params``.
    """
    if not maps:
        raise ValueError("no parameters to try")
    found = [cv_rounds(booster.copy(m), train, folds, fold, transform, metric, patience) for m in maps]
    scores = [f.score for f in found]
    best = scores.index((min if metric == "log_loss" else max)(scores))
    named = [{p.name: v for p, v in m.items()} for m in maps]
    rows = [(i, json.dumps(m, sort_keys=True), f.rounds, float(f.score), i == best) for i, (m, f) in enumerate(zip(named, found))]
    trials = train.sparkSession.createDataFrame(rows, "trial int, params string, rounds int, score double, best boolean")
    return Tuned(named[best], found[best].rounds, scores[best], trials, found[best].model)
