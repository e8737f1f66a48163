"""Estimators that Spark ML lacks: a booster for several classes, resampling of training rows, and a
logistic regression whose penalty follows the rows it is fitted on.  All can be searched and saved.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import neighbours


def _param(name: str, doc: str, converter) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=converter)


# --- several classes -------------------------------------------------------------------------


class _BoosterParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasMaxIter, HasSeed):
    classes = _param("classes", "number of classes; labels are 0..classes-1", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = _param("stepSize", "learning rate", TypeConverters.toFloat)
    subsamplingRate = _param("subsamplingRate", "share of the rows a tree is fitted on", TypeConverters.toFloat)
    minInstancesPerNode = _param("minInstancesPerNode", "least rows of a leaf", TypeConverters.toInt)
    featureSubsetStrategy = _param("featureSubsetStrategy", "features tried at a split", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", maxIter=100, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, minInstancesPerNode=1, featureSubsetStrategy="all", seed=42, classes=3)


class BoosterOfClasses(Estimator, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):
    """One binary booster per class against the rest, since Spark's booster is binary.

    A label outside 0..classes-1 counts as another class to all of them.
    """

    @keyword_only
    def __init__(self, *, classes=3, labelCol="label", featuresCol="features", maxIter=100, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, minInstancesPerNode=1, featureSubsetStrategy="all", seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoosterOfClassesModel:
        from cohortry.operators.modelling import gbt

        get, label = self.getOrDefault, self.getLabelCol()
        data = dataset.select(F.col(self.getFeaturesCol()).alias("features"), F.col(label).alias("_y"))
        models = []
        for k in range(get(self.classes)):
            one = gbt(
                label="_is", rounds=self.getMaxIter(), depth=get(self.maxDepth), rate=get(self.stepSize), sample=get(self.subsamplingRate),
                min_leaf=get(self.minInstancesPerNode), features=get(self.featureSubsetStrategy), seed=self.getSeed(), output=f"_{k}",
            )
            models.append(one.fit(data.withColumn("_is", F.coalesce(F.col("_y") == k, F.lit(False)).cast("double"))))
        return self._copyValues(BoosterOfClassesModel(models))


class BoosterOfClassesModel(Model, _BoosterParams, MLReadable, MLWritable):
    """Adds ``probability`` (a vector that adds up to 1) and ``prediction`` (its first largest entry)."""

    def __init__(self, models: list[GBTClassificationModel] | None = None):
        super().__init__()
        self.models = models or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = [f"_own_{k}" for k in range(len(self.models))]
        out = dataset
        for name, model in zip(own, self.models):
            step = model.copy({model.featuresCol: self.getFeaturesCol(), model.predictionCol: "", model.rawPredictionCol: "", model.probabilityCol: name})
            out = step.transform(out)
        single = [vector_to_array(F.col(c))[1] for c in own]
        total = sum(single[1:], single[0])
        p = F.array(*[x / total for x in single])
        out = out.withColumn("_p", p).drop(*own)
        top = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.withColumns({self.getProbabilityCol(): array_to_vector("_p"), self.getPredictionCol(): top}).drop("_p")

    def copy(self, extra=None) -> BoosterOfClassesModel:
        that = super().copy(extra)
        that.models = list(self.models)
        return that

    def write(self) -> MLWriter:
        return _BoosterWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoosterReader(cls)


class _BoosterWriter(MLWriter):
    def __init__(self, model: BoosterOfClassesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"models": len(self.model.models)})
        for k, model in enumerate(self.model.models):
            model.write().session(self.sparkSession).save(f"{path}/models/{k}")


class _BoosterReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoosterOfClassesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls([GBTClassificationModel.load(f"{path}/models/{k}") for k in range(metadata["models"])])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


# --- resampling of training rows -------------------------------------------------------------


class Resampler(Estimator, HasFeaturesCol, HasLabelCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Adds synthetic rows to classes until they have their target counts, then drops Tomek links.

    A stage of a ``TrainingPipeline``: it changes the rows that the stages after it are fitted on, and
    no others.  ``targets`` maps a label to its number of rows as JSON text, so that a search can try
    several; a class that has as many already stays as it is.  Classes with fewer than two rows cannot
    be enlarged (ValueError).  Columns other than label and features end here.
    """

    targets = _param("targets", "rows per label as JSON", TypeConverters.toString)
    neighbours = _param("neighbours", "neighbours a synthetic row may lie towards", TypeConverters.toInt)
    tomek = _param("tomek", "whether to drop Tomek links afterwards", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, targets="{}", neighbours=5, tomek=True, labelCol="label", featuresCol="features", seed=42):
        super().__init__()
        self._setDefault(targets="{}", neighbours=5, tomek=True, labelCol="label", featuresCol="features", seed=42)
        self._set(**self._input_kwargs)

    @staticmethod
    def counts(targets: dict) -> str:
        """A value for ``targets``."""
        return json.dumps({str(k): int(n) for k, n in targets.items()}, sort_keys=True)

    def resample(self, dataset: DataFrame) -> DataFrame:
        """(features, label, synthetic) of the rows to fit on."""
        get, label = self.getOrDefault, self.getLabelCol()
        # equal rows get numbers of their own; the rows are stored below before they are read twice
        rows = dataset.select(F.monotonically_increasing_id().alias("id"), F.col(label).cast("double").alias("label"), vector_to_array(self.getFeaturesCol()).alias("features"))
        rows = neighbours.materialize(rows)
        targets = {float(k): n for k, n in json.loads(get(self.targets)).items()}
        out = neighbours.smote(rows, targets, "label", get(self.neighbours), self.getSeed())
        if get(self.tomek):
            out = neighbours.drop_tomek_links(neighbours.materialize(out), "label")
        return out.select(array_to_vector("features").alias(self.getFeaturesCol()), F.col("label").alias(label), "synthetic")

    def _fit(self, dataset: DataFrame):
        raise TypeError("a Resampler is fitted as a stage of a TrainingPipeline")


class TrainingPipeline(Pipeline):
    """A pipeline whose ``Resampler`` stages act on the rows of ``fit`` alone.

    The fitted model has no trace of them, so rows to be scored, as those a search validates on, pass
    unchanged.  Parameters of a resampler are searched like those of any stage.
    """

    def _run(self, dataset: DataFrame, last: bool) -> tuple[DataFrame, list]:
        fitted, stages = [], self.getStages()
        for i, stage in enumerate(stages):
            if isinstance(stage, Resampler):
                dataset = stage.resample(dataset)
                continue
            if i == len(stages) - 1 and not last:
                break
            model = stage.fit(dataset) if isinstance(stage, Estimator) else stage
            fitted.append(model)
            if i < len(stages) - 1:
                dataset = model.transform(dataset)
        return dataset, fitted

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return PipelineModel(self._run(dataset, True)[1])

    def training_rows(self, dataset: DataFrame) -> DataFrame:
        """The rows that the last stage is fitted on."""
        return self._run(dataset, False)[0]


def fold_counts(pipeline: TrainingPipeline, df: DataFrame, folds: Iterable[int], fold: str = "fold", label: str = "label") -> DataFrame:
    """(fold, part, label, n, n_synthetic): the rows each fold fits and validates on."""
    out = None
    for i in folds:
        train, fitted = pipeline._run(df.where(F.col(fold) != i), False)
        train = neighbours.materialize(train)
        model = PipelineModel([*fitted, pipeline.getStages()[-1].fit(train)])
        held = model.transform(df.where(F.col(fold) == i)).withColumn("synthetic", F.lit(False))
        for part, rows in (("train", train), ("validation", held)):
            n = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"), F.count_if("synthetic").alias("n_synthetic"))
            n = n.select(F.lit(i).alias("fold"), F.lit(part).alias("part"), "label", "n", "n_synthetic")
            out = n if out is None else out.unionByName(n)
    return out


# --- logistic regression by inverse strength -------------------------------------------------


class PenalisedLogistic(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable):
    """Multinomial regression by inverse strength, penalty and mix, as a grid names them.

    The penalty of a row is 1 / (inverseStrength * n) for the n rows it is fitted on, also where those
    were resampled.  ``l1Ratio`` counts for the penalty ``elasticnet`` only.  Fits Spark's model.
    """

    inverseStrength = _param("inverseStrength", "inverse of the penalty's strength", TypeConverters.toFloat)
    penalty = _param("penalty", "l1, l2 or elasticnet", TypeConverters.toString)
    l1Ratio = _param("l1Ratio", "share of l1 in elasticnet", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inverseStrength=1.0, penalty="l2", l1Ratio=0.5, maxIter=200, labelCol="label", featuresCol="features"):
        super().__init__()
        self._setDefault(inverseStrength=1.0, penalty="l2", l1Ratio=0.5, maxIter=200, labelCol="label", featuresCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        get = self.getOrDefault
        mix = {"l1": 1.0, "l2": 0.0, "elasticnet": get(self.l1Ratio)}[get(self.penalty)]
        return LogisticRegression(
            labelCol=self.getLabelCol(), featuresCol=self.getFeaturesCol(), family="multinomial", regParam=1.0 / (get(self.inverseStrength) * max(dataset.count(), 1)),
            elasticNetParam=mix, standardization=False, maxIter=self.getMaxIter(),
        ).fit(dataset)
