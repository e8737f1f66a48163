"""Feature transforms, models and searches on Spark ML."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalar import columns_of
from cohortry.operators.boosting import split_importance
from cohortry.operators.curves import auc_ovr, curve_areas, multiclass_metrics
from cohortry.operators.estimators import BoosterOfClasses
from cohortry.operators.ranking import top_abs
from cohortry.operators.relational import binary_columns
from cohortry.session import materialize


# --- column transforms ------------------------------------------------------------------


@dataclass(frozen=True)
class FeaturePlan:
    """Which columns get which transform."""

    numbers: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    logs: list[str] = field(default_factory=list)


def plan_features(df: DataFrame, drop: Sequence[str], logs: Sequence[str] = ()) -> FeaturePlan:
    """Sort the columns by type and, for numbers, by whether they are 0/1 (one action)."""
    numbers = columns_of(df, "number", drop)
    flags = [c for c in binary_columns(df, numbers) if c not in logs]
    return FeaturePlan([c for c in numbers if c not in flags and c not in logs], columns_of(df, "text", drop), flags, list(logs))


def feature_pipeline(plan: FeaturePlan, n_rows: int, number_fill: float = 0.0, text_fill: str = "-9999", log_fill: float = 0.0) -> Pipeline:
    """Impute, scale, one-hot and log-scale into one vector column ``features``.

    Numbers and logs are centred and scaled by the population deviation; Spark's scaler uses
    the sample deviation, so the result is stretched by sqrt(n / (n - 1)) for ``n_rows``
    training rows.  A category not seen in training becomes all zeros.
    """
    text = text_fill.replace("'", "''")
    pieces = [f"coalesce(cast(`{c}` as double), {number_fill}D) as `num__{c}`" for c in plan.numbers]
    pieces += [f"log10(coalesce(cast(`{c}` as double), {log_fill}D) + 1) as `log__{c}`" for c in plan.logs]
    pieces += [f"coalesce(`{c}`, '{text}') as `cat__{c}`" for c in plan.texts]
    pieces += [f"coalesce(cast(`{c}` as double), 0D) as `bin__{c}`" for c in plan.flags]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(pieces)} FROM __THIS__")]
    parts = []
    scaled = [f"num__{c}" for c in plan.numbers] + [f"log__{c}" for c in plan.logs]
    if scaled:
        stretch = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
        stages += [
            VectorAssembler(inputCols=scaled, outputCol="_to_scale"),
            StandardScaler(inputCol="_to_scale", outputCol="_sample_scaled", withMean=True, withStd=True),
            ElementwiseProduct(inputCol="_sample_scaled", outputCol="_scaled", scalingVec=Vectors.dense([stretch] * len(scaled))),
        ]
        parts.append("_scaled")
    if plan.texts:
        stages += [
            StringIndexer(inputCols=[f"cat__{c}" for c in plan.texts], outputCols=[f"idx__{c}" for c in plan.texts], handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"idx__{c}" for c in plan.texts], outputCols=[f"hot__{c}" for c in plan.texts], dropLast=True),
        ]
        parts += [f"hot__{c}" for c in plan.texts]
    parts += [f"bin__{c}" for c in plan.flags]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the entries of ``features``, in order."""
    scaled: list[str] = []
    labels: dict[str, list[str]] = {}
    for stage in model.stages:
        if isinstance(stage, VectorAssembler) and stage.getOutputCol() == "_to_scale":
            scaled = stage.getInputCols()
        elif hasattr(stage, "labelsArray"):
            labels = dict(zip(stage.getOutputCols(), stage.labelsArray))
    final = [s for s in model.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "features"][0]
    names: list[str] = []
    for part in final.getInputCols():
        if part == "_scaled":
            names += scaled
        elif part.startswith("hot__"):
            names += [f"{part}_{value}" for value in labels[part.replace("hot__", "idx__")]]
        else:
            names.append(part)
    return names


# --- models -------------------------------------------------------------------------------


def class_weights(df: DataFrame, label: str, positive_weight: float, name: str = "weight") -> DataFrame:
    """Weight of the positive class; negatives weigh 1."""
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0)))


def gbt(label: str = "label", rounds: int = 100, depth: int = 3, rate: float = 0.1, sample: float = 1.0, min_leaf: int = 1, features: str = "all", weight: str | None = None, validation: str | None = None, seed: int = 42, output: str = "") -> GBTClassifier:
    """An unfitted binary booster.  With ``validation`` (a boolean column) it stops early."""
    options = {"weightCol": weight} if weight else {}
    if validation:
        options |= {"validationIndicatorCol": validation, "validationTol": 0.0}
    booster = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=sample,
        minInstancesPerNode=min_leaf, featureSubsetStrategy=features, seed=seed, predictionCol=f"prediction{output}", **options,
    )
    return booster.setProbabilityCol(f"probability{output}").setRawPredictionCol(f"rawPrediction{output}")


def fit_gbt(train: DataFrame, transform: Pipeline | None = None, **options) -> PipelineModel:
    """Transform and booster as one fitted pipeline."""
    return Pipeline(stages=[*(transform.getStages() if transform else []), gbt(**options)]).fit(train)


def rounds_used(model: PipelineModel) -> int:
    """Boosting rounds kept after early stopping."""
    return model.stages[-1].getNumTrees


def fit_gbt_multiclass(train: DataFrame, classes: int, label: str = "label", transform: Pipeline | None = None, rounds: int = 100, depth: int = 3, rate: float = 0.1, sample: float = 1.0, min_leaf: int = 1, features: str = "all", seed: int = 42) -> PipelineModel:
    """Transform and a booster of several classes as one fitted pipeline."""
    booster = BoosterOfClasses(classes=classes, labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=sample, minInstancesPerNode=min_leaf, featureSubsetStrategy=features, seed=seed)
    return Pipeline(stages=[*(transform.getStages() if transform else []), booster]).fit(train)


def logistic(n_rows: int, c: float = 1.0, penalty: str = "l2", l1_ratio: float = 0.5, label: str = "label", rounds: int = 200) -> LogisticRegression:
    """Multinomial regression; ``c`` is the inverse strength, so the penalty is 1 / (c n)."""
    mix = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio}[penalty]
    return LogisticRegression(labelCol=label, featuresCol="features", family="multinomial", regParam=1.0 / (c * n_rows), elasticNetParam=mix, standardization=False, maxIter=rounds)


def fit_lr(train: DataFrame, transform: Pipeline | None = None, **options) -> PipelineModel:
    return Pipeline(stages=[*(transform.getStages() if transform else []), logistic(n_rows=train.count(), **options)]).fit(train)


def fit_gbt_regressor(train: DataFrame, transform: Pipeline | None = None, label: str = "label", rounds: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    reg = GBTRegressor(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    return Pipeline(stages=[*(transform.getStages() if transform else []), reg]).fit(train)


def regression_errors(predicted: DataFrame, label: str = "label") -> DataFrame:
    """One row: rows, mean squared error, root of it, mean absolute error, R squared."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col("prediction")
    return predicted.agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
    )


def scored(model: PipelineModel, df: DataFrame, key: str, label: str) -> DataFrame:
    """Scored population of a binary model: (id, label, score)."""
    return model.transform(df).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))


def scored_multiclass(model, df: DataFrame, key: str, label: str) -> DataFrame:
    """Multi-class scores: (id, label, prediction, probability, probability_max)."""
    out = model.transform(df).withColumn("probability", vector_to_array("probability"))
    return out.select(
        F.col(key).alias("id"), F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), "probability", F.array_max("probability").alias("probability_max"),
    )


def evaluate_sets(model, sets: Mapping[str, DataFrame], key: str, label: str, classes: int) -> DataFrame:
    """(set, n, precision, recall, f1, auroc) of a fitted pipeline on several tables, such as train and test.

    Precision, recall and F1 are averaged over the classes by their support; the AUC is one against the
    rest, for two classes that of class 1.  A row a set; sets without rows have none.
    """
    out = None
    for name, rows in sets.items():
        scores = materialize(scored_multiclass(model, rows, key, label))
        area = auc_ovr(scores, classes).withColumnRenamed("auc_ovr", "auroc")
        row = multiclass_metrics(scores).crossJoin(area).crossJoin(scores.agg(F.count("*").alias("n"))).where("n > 0")  # one row each
        row = row.select(F.lit(name).alias("set"), "n", "precision", "recall", "f1", "auroc")
        out = row if out is None else out.unionByName(row)
    return out


# --- search ---------------------------------------------------------------------------------


class AveragePrecision(Evaluator):
    """Average precision on probabilities, for use in a search."""

    def __init__(self, label: str = "label"):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.col(self.label).alias("label"), vector_to_array("probability")[1].alias("score"))
        return curve_areas(rows).first()["average_precision"] or 0.0

    def isLargerBetter(self) -> bool:
        return True

    def copy(self, extra=None):
        return AveragePrecision(self.label)


def evaluator(metric: str, label: str = "label") -> Evaluator:
    """``average_precision``, ``f1`` (weighted), ``mse`` (smaller is better)."""
    if metric == "average_precision":
        return AveragePrecision(label)
    if metric == "f1":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="weightedFMeasure")
    return RegressionEvaluator(labelCol=label, metricName=metric)


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def draw(self, rng: random.Random):
        if self.log:
            x = math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        else:
            x = rng.uniform(self.low, self.high)
        return round(x) if self.whole else x


def _scattered(i: int, n: int, seed: int) -> int:
    """Number i of a fixed shuffle of 0..n-1: Feistel rounds over the least even number of bits, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = i >> half, i & mask
        for step in range(4):
            digest = hashlib.blake2b(f"{seed}:{step}:{right}".encode(), digest_size=16).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        i = left << half | right
        if i < n:
            return i


def _unranked(lists: list[tuple[Param, list]], i: int) -> dict:
    """Number i of all combinations of the lists; the last list changes fastest."""
    out = {}
    for p, values in reversed(lists):
        i, at = divmod(i, len(values))
        out[p] = values[at]
    return {p: out[p] for p, _ in lists}


def grid_params(space: dict[Param, Sequence]) -> list[dict]:
    """Every combination of the lists, the last one changing fastest; values that repeat count once."""
    lists = [(p, list(dict.fromkeys(values))) for p, values in space.items()]
    return [_unranked(lists, i) for i in range(math.prod(len(v) for _, v in lists))]


def draw_params(space: dict[Param, Sequence | Uniform], n: int, seed: int = 42) -> list[dict]:
    """n parameter maps drawn from lists or ranges.

    Combinations of the lists come in a seeded shuffle of all of them, without looking at any twice,
    so a space of lists alone gives n different maps, or all if it has fewer; with ranges the
    combinations start over after the last.
    """
    rng = random.Random(seed)
    lists = [(p, list(dict.fromkeys(v))) for p, v in space.items() if not isinstance(v, Uniform)]
    total = math.prod(len(v) for _, v in lists)
    ranges = {p: u for p, u in space.items() if isinstance(u, Uniform)}
    maps = []
    for i in range(n if ranges else min(n, total)):
        fixed = _unranked(lists, _scattered(i % total, total, seed))
        maps.append({p: ranges[p].draw(rng) if p in ranges else fixed[p] for p in space})
    return maps


@dataclass(frozen=True)
class Search:
    model: PipelineModel
    params: dict
    score: float
    trials: DataFrame


def search(estimator: Estimator, train: DataFrame, maps: list[dict], folds: int, fold: str = "fold", metric: str = "f1", label: str = "label", parallelism: int = 4, seed: int = 42) -> Search:
    """Cross-validate parameter maps on a given fold column and refit the best; the first of equal ones."""
    ev = evaluator(metric, label)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, numFolds=folds, foldCol=fold, parallelism=parallelism, seed=seed)
    fitted = cv.fit(train)
    scores = list(fitted.avgMetrics)
    pick = max if ev.isLargerBetter() else min
    best = scores.index(pick(scores))
    named = [{p.name: v for p, v in m.items()} for m in maps]
    rows = [(i, json.dumps(m, sort_keys=True), float(s), i == best) for i, (m, s) in enumerate(zip(named, scores))]
    trials = train.sparkSession.createDataFrame(rows, "trial int, params string, score double, best boolean")
    return Search(fitted.bestModel, named[best], scores[best], trials)


def random_search(estimator: Estimator, train: DataFrame, space: dict, n: int, folds: int, fold: str = "fold", metric: str = "f1", label: str = "label", parallelism: int = 4, seed: int = 42) -> Search:
    """Search over n drawn parameter maps."""
    return search(estimator, train, draw_params(space, n, seed), folds, fold, metric, label, parallelism, seed)


def grid_search(estimator: Estimator, train: DataFrame, space: dict[Param, Sequence], folds: int, fold: str = "fold", metric: str = "f1", label: str = "label", parallelism: int = 4, seed: int = 42) -> Search:
    """Search over every combination."""
    return search(estimator, train, grid_params(space), folds, fold, metric, label, parallelism, seed)


def nested_cv(estimator: Estimator, df: DataFrame, space: dict, n: int, outer: int, inner: int, outer_fold: str = "outer_fold", inner_fold: str = "fold", metric: str = "f1", label: str = "label", seed: int = 42) -> DataFrame:
    """Search on all but one outer fold, score on that one: (outer_fold, params, score)."""
    ev = evaluator(metric, label)
    rows = []
    for i in range(outer):
        found = random_search(estimator, df.where(F.col(outer_fold) != i), space, n, inner, inner_fold, metric, label, seed=seed)
        score = ev.evaluate(found.model.transform(df.where(F.col(outer_fold) == i)))
        rows.append((i, json.dumps(found.params, sort_keys=True), float(score)))
    return df.sparkSession.createDataFrame(rows, "outer_fold int, params string, score double")


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the outer scores."""
    return scores.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


# --- what a model uses ---------------------------------------------------------------------


def coefficients(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Rows (class, feature, coefficient).  A two-class model has one row set, for class 1."""
    lr = model.stages[-1]
    matrix = lr.coefficientMatrix.toArray()
    if matrix.shape[0] == 2:  # multinomial form of two classes: the log-odds of class 1
        rows = [(1, n, float(v)) for n, v in zip(names, matrix[1] - matrix[0])]
    elif matrix.shape[0] == 1:
        rows = [(1, n, float(v)) for n, v in zip(names, matrix[0])]
    else:
        rows = [(k, n, float(v)) for k, line in enumerate(matrix) for n, v in zip(names, line)]
    return _session().createDataFrame(rows, "class int, feature string, coefficient double")


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def top_coefficients(model: PipelineModel, names: Sequence[str], n: int = 15) -> DataFrame:
    """Per class the n coefficients largest in absolute value, from lowest to highest."""
    return top_abs(coefficients(model, names), "coefficient", n, ["class"])


def feature_importance(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """(feature, gain, splits, mean_gain, cover) from the trees of a fitted booster, least used first."""
    return split_importance(model.stages[-1], names)
