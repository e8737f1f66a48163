"""Quality of scored populations: ROC, precision-recall, gains, confusion, multi-class.

Binary input: columns ``id``, ``label`` (0/1) and ``score``.  Multi-class input: ``id``,
``label`` (0..K-1) and ``probability`` (array of K doubles).

All curves rest on one frame: rows are first reduced to distinct scores (partial aggregates
absorb ties), then cumulated in global order without a single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.ranking import global_rank, running_totals


def cumulative_counts(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, highest first: positives, negatives, and their running totals (runs actions)."""
    counts = df.groupBy(*groups, F.col("score").alias("threshold")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    return running_totals(counts, [F.col("threshold").desc()], {"tp": "pos", "fp": "neg"}, groups, peeks=() if groups else ("pos", "neg"))


def _totals(curve: DataFrame) -> tuple[int, int]:
    row = curve.agg(F.max("tp").alias("p"), F.max("fp").alias("n")).first()
    return row["p"], row["n"]


def roc_curve(df: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """Threshold, counts and rates.  Collinear inner points are dropped unless told otherwise."""
    c = cumulative_counts(df)
    p, n = _totals(c)
    if drop_intermediate:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        c = c.where(first | F.col("next_pos").isNull() | bend)
    return c.select(
        "threshold", "tp", "fp",
        F.try_divide(F.col("tp").cast("double"), F.lit(p)).alias("tpr"),
        F.try_divide(F.col("fp").cast("double"), F.lit(n)).alias("fpr"),
    )


def best_gmean(curve: DataFrame) -> DataFrame:
    """ROC point with the largest sqrt(tpr * (1 - fpr)); on ties the highest threshold."""
    g = F.sqrt(F.col("tpr") * (1 - F.col("fpr")))
    return curve.withColumn("gmean", g).orderBy(F.desc("gmean"), F.desc("threshold")).limit(1)


def pr_curve(df: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score."""
    c = cumulative_counts(df)
    p, _ = _totals(c)
    return c.select(
        "threshold", "tp", "fp",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.lit(p)).alias("recall"),
    )


def best_fscore(curve: DataFrame) -> DataFrame:
    """PR point with the largest F-score (0 where undefined); on ties the lowest threshold."""
    f = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return curve.withColumn("fscore", f).orderBy(F.desc("fscore"), F.asc("threshold")).limit(1)


def _auc_terms() -> Column:
    # trapezoid between consecutive thresholds; twice the area in units of pos x neg
    return F.sum(F.col("neg").cast("double") * (2 * F.col("tp") - F.col("pos")))


def curve_areas(df: DataFrame) -> DataFrame:
    """One row: AUC, trapezoid PR area, average precision, no-skill rate."""
    c = cumulative_counts(df)
    tp, fp, pos, neg = (F.col(x).cast("double") for x in ("tp", "fp", "pos", "neg"))
    precision = tp / (tp + fp)
    before = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), F.lit(1.0))
    return (
        c.agg(
            F.max("tp").alias("p"), F.max("fp").alias("n"), _auc_terms().alias("_auc"),
            F.sum(pos * (precision + before) / 2).alias("_pr"), F.sum(pos * precision).alias("_ap"),
        )
        .select(
            F.col("p").alias("positives"), F.col("n").alias("negatives"),
            F.try_divide(F.col("_auc"), 2.0 * F.col("p") * F.col("n")).alias("roc_auc"),
            F.try_divide(F.col("_pr"), F.col("p").cast("double")).alias("pr_auc"),
            F.try_divide(F.col("_ap"), F.col("p").cast("double")).alias("average_precision"),
            (F.col("p") / (F.col("p") + F.col("n"))).alias("no_skill"),
        )
    )


def average_precision(df: DataFrame) -> DataFrame:
    """Sum over thresholds of recall gained times precision (step rule, not a trapezoid)."""
    return curve_areas(df).select("average_precision")


def gains_lift(df: DataFrame, steps: int = 20) -> DataFrame:
    """True-positive rate and lift among the top i/steps of the population, i = 1..steps.

    The cut-off is ceil(i * n / steps) in whole numbers; ties go to the smaller id.
    """
    ranked = global_rank(df.select("id", "label", "score"), [F.col("score").desc_nulls_last(), F.col("id").asc()])
    n = ranked.total
    ks = [-(-i * n // steps) for i in range(1, steps + 1)]
    wide = ranked.rows.agg(
        F.count_if(F.col("label") == 1).alias("positives"),
        *[F.count_if((F.col("label") == 1) & (F.col("rank") <= k)).alias(f"tp{i}") for i, k in enumerate(ks, 1)],
    )
    pieces = ", ".join(f"{i}, {k}L, tp{i}" for i, k in enumerate(ks, 1))
    out = wide.select("positives", F.expr(f"stack({steps}, {pieces}) as (step, k, tp)"))
    fraction = F.col("step") / F.lit(steps)
    tpr = F.try_divide(F.col("tp").cast("double"), F.col("positives"))
    return out.select(fraction.alias("fraction"), "k", "tp", tpr.alias("tpr"), (tpr / fraction).alias("lift"))


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of counts and rates; a score exactly at the threshold is predicted 0."""
    y, s = F.col("label") == 1, F.coalesce(F.col("score") > threshold, F.lit(False))
    c = df.agg(
        F.count_if(~y & ~s).alias("tn"), F.count_if(~y & s).alias("fp"),
        F.count_if(y & ~s).alias("fn"), F.count_if(y & s).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    chance = (tp + fn) / (tn + fp + fn + tp)
    sensitivity = F.try_divide(tp, tp + fn)
    return c.select(
        "tn", "fp", "fn", "tp",
        F.try_divide(tp, tp + fp).alias("precision"), sensitivity.alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"), chance.alias("chance"),
        F.try_divide(sensitivity, chance).alias("lift"),
        (F.col("tp") + F.col("fp")).alias("contacted"), F.col("tp").alias("found"),
        F.floor((tp + fp) * chance).alias("found_by_chance"),
    )


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Rows (label, prediction, n) of a hard multi-class prediction."""
    return df.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per class: support, precision, recall, F1; undefined values are 0."""
    cells = df.groupBy(*groups, "label", "prediction").agg(F.count("*").alias("_n"))
    sides = F.array(
        F.struct(F.col("label").cast("int").alias("class"), F.col("_n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
        F.struct(F.col("prediction").cast("int").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("_n").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("hit")),
    )
    per = (
        cells.select(*groups, F.explode(sides).alias("_s")).groupBy(*groups, "_s.class")
        .agg(F.sum("_s.actual").alias("support"), F.sum("_s.predicted").alias("predicted"), F.sum("_s.hit").alias("hit"))
    )
    def zero(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    return per.select(
        *groups, "class", "support",
        zero(F.col("hit"), F.col("predicted")).alias("precision"),
        zero(F.col("hit"), F.col("support")).alias("recall"),
        zero(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def multiclass_metrics(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 averaged over classes by their support."""
    def weighted(c):
        return (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)

    return class_metrics(df, groups).groupBy(*groups).agg(weighted("precision"), weighted("recall"), weighted("f1"))


def auc_by_group(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """AUC of each group's (score, label) rows, all groups in one pass."""
    c = cumulative_counts(df, groups)
    return c.groupBy(*groups).agg(F.max("tp").alias("p"), F.max("fp").alias("n"), _auc_terms().alias("_auc")).select(
        *groups, "p", "n", F.try_divide(F.col("_auc"), 2.0 * F.col("p") * F.col("n")).alias("auc")
    )


def auc_ovr(df: DataFrame, classes: int) -> DataFrame:
    """One-vs-rest AUC averaged by class prevalence."""
    sides = F.array(*[
        F.struct(F.lit(k).alias("class"), (F.col("label") == k).cast("int").alias("label"), F.col("probability")[k].alias("score")) for k in range(classes)
    ])
    per = auc_by_group(df.select(F.explode(sides).alias("_s")).select("_s.*"), ["class"])
    return per.agg((F.sum(F.col("auc") * F.col("p")) / F.sum("p")).alias("auc_ovr"))


def auc_ovo(df: DataFrame, classes: int) -> DataFrame:
    """One-vs-one AUC: both directions of each class pair, averaged by the pair's prevalence."""
    sides = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("positive"), (F.col("label") == k).cast("int").alias("label"), F.col("probability")[k].alias("score"))
        for a, b in combinations(range(classes), 2) for k in (a, b)
    ])
    long = df.select(F.col("label").alias("_y"), F.explode(sides).alias("_s"))
    long = long.where((F.col("_y") == F.col("_s.a")) | (F.col("_y") == F.col("_s.b"))).select("_s.*")
    per = auc_by_group(long, ["a", "b", "positive"])
    pairs = per.groupBy("a", "b").agg(F.avg("auc").alias("auc"), F.max(F.col("p") + F.col("n")).alias("rows"))
    return pairs.agg((F.sum(F.col("auc") * F.col("rows")) / F.sum("rows")).alias("auc_ovo"))


def propensity_by_segment(df: DataFrame, segments: DataFrame, names: Sequence[str], bins: int = 20) -> DataFrame:
    """Score histogram on [0, 1] per label for all rows and for each segment flag.

    ``segments`` has one row per id with 0/1 flags.
    """
    joined = df.select("id", "label", "score").join(segments.select("id", *names), "id", "left")
    tags = F.concat(
        F.array(F.lit("all")),
        F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names])),
    )
    bucket = F.least(F.floor(F.col("score") * bins) + 1, F.lit(bins)).cast("bigint")
    cells = (
        joined.where(F.col("score").isNotNull())
        .select(F.explode(tags).alias("segment"), "label", bucket.alias("bin"))
        .groupBy("segment", "label", "bin").agg(F.count("*").alias("n"))
    )
    totals = cells.groupBy("segment", "label").agg(F.sum("n").alias("_all"))
    return cells.join(totals, ["segment", "label"]).select("segment", "label", "bin", "n", (F.col("n") / F.col("_all")).alias("share"))
