"""Model-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog.book import Book, rounded, with_views
from cohortry.functions.scalar import hard_prediction
from cohortry.operators import curves as C
from cohortry.sources import views as V

BOOK = Book()

CURVE = with_views("scored") + """, counts AS (SELECT score AS threshold, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY score),
run AS (SELECT *, CAST(SUM(pos) OVER w AS BIGINT) AS tp, CAST(SUM(neg) OVER w AS BIGINT) AS fp, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS r FROM counts WINDOW w AS (ORDER BY threshold DESC)),
tot AS (SELECT CAST(SUM(pos) AS DOUBLE) AS p, CAST(SUM(neg) AS DOUBLE) AS n FROM counts),
roc AS (SELECT threshold, tp, fp, tp / p AS tpr, fp / n AS fpr FROM run, tot WHERE r = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg),
pr AS (SELECT threshold, tp, fp, CAST(tp AS DOUBLE) / (tp + fp) AS precision, tp / p AS recall FROM run, tot)
"""


@BOOK.add("cumulative_counts", CURVE + "SELECT threshold, pos, neg, tp, fp FROM run")
def cumulative_counts(spark, folder):
    return C.cumulative_counts(V.scored(spark, folder)).select("threshold", "pos", "neg", "tp", "fp")


@BOOK.add("roc_curve", CURVE + "SELECT threshold, tp, fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM roc")
def roc_curve(spark, folder):
    return rounded(C.roc_curve(V.scored(spark, folder)), 9)


@BOOK.add("best_gmean", CURVE + "SELECT threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(sqrt(tpr * (1 - fpr)), 6) AS gmean FROM roc ORDER BY sqrt(tpr * (1 - fpr)) DESC, threshold DESC LIMIT 1")
def best_gmean(spark, folder):
    return rounded(C.best_gmean(C.roc_curve(V.scored(spark, folder))))


@BOOK.add("pr_curve", CURVE + "SELECT threshold, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr")
def pr_curve(spark, folder):
    return rounded(C.pr_curve(V.scored(spark, folder)), 9)


@BOOK.add("best_fscore", CURVE + """SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS fscore
FROM (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f FROM pr) ORDER BY f DESC, threshold LIMIT 1""")
def best_fscore(spark, folder):
    return rounded(C.best_fscore(C.pr_curve(V.scored(spark, folder))))


@BOOK.add("curve_areas", CURVE + """, l AS (SELECT tp, fp, p, n, lag(tp, 1, 0) OVER w AS tp0, lag(fp, 1, 0) OVER w AS fp0 FROM run, tot WINDOW w AS (ORDER BY threshold DESC))
SELECT CAST(MAX(p) AS BIGINT) AS positives, CAST(MAX(n) AS BIGINT) AS negatives, round(SUM((fp - fp0) / n * (tp + tp0) / p / 2), 6) AS roc_auc,
 round(SUM((tp - tp0) / p * (CAST(tp AS DOUBLE) / (tp + fp) + CASE WHEN tp0 + fp0 = 0 THEN 1 ELSE CAST(tp0 AS DOUBLE) / (tp0 + fp0) END) / 2), 6) AS pr_auc,
 round(SUM((tp - tp0) / p * CAST(tp AS DOUBLE) / (tp + fp)), 6) AS average_precision, round(MAX(p / (p + n)), 6) AS no_skill FROM l""")
def curve_areas(spark, folder):
    return rounded(C.curve_areas(V.scored(spark, folder)))


@BOOK.add("average_precision", CURVE + ", l AS (SELECT tp, fp, p, lag(tp, 1, 0) OVER (ORDER BY threshold DESC) AS tp0 FROM run, tot) SELECT round(SUM((tp - tp0) / p * CAST(tp AS DOUBLE) / (tp + fp)), 6) AS average_precision FROM l")
def average_precision(spark, folder):
    return rounded(C.average_precision(V.scored(spark, folder)))


@BOOK.add("gains_lift", with_views("scored") + """, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored),
cuts AS (SELECT i, CAST(ceil(CAST(i * n AS DOUBLE) / 20) AS BIGINT) AS k, p FROM (SELECT unnest(range(1, 21)) AS i), (SELECT COUNT(*) AS n, SUM(label) AS p FROM scored))
SELECT i / 20.0::DOUBLE AS fraction, k, COUNT(*) FILTER (WHERE label = 1 AND rank <= k) AS tp, round(CAST(COUNT(*) FILTER (WHERE label = 1 AND rank <= k) AS DOUBLE) / MAX(p), 6) AS tpr,
       round(CAST(COUNT(*) FILTER (WHERE label = 1 AND rank <= k) AS DOUBLE) / MAX(p) / (i / 20.0::DOUBLE), 6) AS lift
FROM r, cuts GROUP BY i, k""")
def gains_lift(spark, folder):
    return rounded(C.gains_lift(V.scored(spark, folder)))


@BOOK.add("confusion", with_views("scored") + """, c AS (SELECT COUNT(*) FILTER (WHERE label = 0 AND score <= 0.5) AS tn, COUNT(*) FILTER (WHERE label = 0 AND score > 0.5) AS fp,
 COUNT(*) FILTER (WHERE label = 1 AND score <= 0.5) AS fn, COUNT(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp, CAST(COUNT(*) AS DOUBLE) AS n FROM scored)
SELECT tn, fp, fn, tp, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS sensitivity, round(tn / CAST(tn + fp AS DOUBLE), 6) AS specificity,
 round((tp + fn) / n, 6) AS chance, round(tp / CAST(tp + fn AS DOUBLE) / ((tp + fn) / n), 6) AS lift, tp + fp AS contacted, tp AS found, CAST(floor((tp + fp) * ((tp + fn) / n)) AS BIGINT) AS found_by_chance FROM c""")
def confusion(spark, folder):
    return rounded(C.confusion(V.scored(spark, folder)))


HARD = with_views("multiclass") + ", hard AS (SELECT id, label, CAST(list_position(probability, list_max(probability)) - 1 AS INTEGER) AS prediction, list_max(probability) AS probability_max FROM multiclass)"


def _hard(spark, folder):
    index, top = hard_prediction("probability")
    return V.multiclass(spark, folder).select("id", "label", index.alias("prediction"), top.alias("probability_max"))


@BOOK.add("hard_prediction", HARD + " SELECT * FROM hard")
def hard(spark, folder):
    return _hard(spark, folder)


@BOOK.add("confusion_matrix", HARD + " SELECT label, prediction, COUNT(*) AS n FROM hard GROUP BY label, prediction")
def confusion_matrix(spark, folder):
    return C.confusion_matrix(_hard(spark, folder))


PER_CLASS = HARD + """, k AS (SELECT unnest([0, 1, 2]) AS class), m AS (
 SELECT class, COUNT(*) FILTER (WHERE label = class) AS support, COUNT(*) FILTER (WHERE prediction = class) AS predicted, COUNT(*) FILTER (WHERE label = class AND prediction = class) AS hit FROM hard, k GROUP BY class),
per AS (SELECT class, support, coalesce(hit / nullif(CAST(predicted AS DOUBLE), 0), 0) AS precision, coalesce(hit / nullif(CAST(support AS DOUBLE), 0), 0) AS recall, coalesce(2 * hit / nullif(CAST(predicted + support AS DOUBLE), 0), 0) AS f1 FROM m)
"""


@BOOK.add("class_metrics", PER_CLASS + "SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per")
def class_metrics(spark, folder):
    return rounded(C.class_metrics(_hard(spark, folder)))


@BOOK.add("multiclass_metrics", PER_CLASS + "SELECT round(SUM(precision * support) / SUM(support), 6) AS precision, round(SUM(recall * support) / SUM(support), 6) AS recall, round(SUM(f1 * support) / SUM(support), 6) AS f1 FROM per")
def multiclass_metrics(spark, folder):
    return rounded(C.multiclass_metrics(_hard(spark, folder)))


# AUC as the chance that a positive outranks a negative, ties counted half (rank-sum form).
def _auc(source: str, keys: str) -> str:
    return f"""ranks AS (SELECT {keys}, y, (SUM(c) OVER (PARTITION BY {keys} ORDER BY s) - (c - 1) / 2.0::DOUBLE) AS mid, c, pos FROM (
   SELECT {keys}, s, MAX(y) AS y, COUNT(*) AS c, SUM(y) AS pos FROM {source} GROUP BY {keys}, s)),
aucs AS (SELECT {keys}, CAST(SUM(pos) AS DOUBLE) AS p, CAST(SUM(c) - SUM(pos) AS DOUBLE) AS n, (SUM(pos * mid) - SUM(pos) * (SUM(pos) + 1) / 2.0::DOUBLE) / (CAST(SUM(pos) AS DOUBLE) * (SUM(c) - SUM(pos))) AS auc FROM ranks GROUP BY {keys})
"""


@BOOK.add("auc_ovr", with_views("multiclass") + """, k AS (SELECT unnest([0, 1, 2]) AS class), long AS (SELECT class, probability[class + 1] AS s, CASE WHEN label = class THEN 1 ELSE 0 END AS y FROM multiclass, k),
""" + _auc("long", "class") + "SELECT round(SUM(auc * p) / SUM(p), 6) AS auc_ovr FROM aucs")
def auc_ovr(spark, folder):
    return rounded(C.auc_ovr(V.multiclass(spark, folder), 3))


@BOOK.add("auc_ovo", with_views("multiclass") + """, k AS (SELECT * FROM (VALUES (0, 1, 0), (0, 1, 1), (0, 2, 0), (0, 2, 2), (1, 2, 1), (1, 2, 2)) AS v(a, b, pos_class)),
long AS (SELECT a, b, pos_class, probability[pos_class + 1] AS s, CASE WHEN label = pos_class THEN 1 ELSE 0 END AS y FROM multiclass, k WHERE label = a OR label = b),
""" + _auc("long", "a, b, pos_class") + "SELECT round(SUM(auc * (p + n)) / SUM(p + n), 6) AS auc_ovo FROM aucs")
def auc_ovo(spark, folder):
    return rounded(C.auc_ovo(V.multiclass(spark, folder), 3))


@BOOK.add("propensity_by_segment", with_views("scored") + """, seg AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS even FROM orders),
tagged AS (SELECT 'all' AS segment, label, score FROM scored UNION ALL SELECT 'urgent', label, score FROM scored JOIN seg USING (id) WHERE urgent = 1 UNION ALL SELECT 'even', label, score FROM scored JOIN seg USING (id) WHERE even = 1),
c AS (SELECT segment, label, CAST(least(floor(score * 20) + 1, 20) AS BIGINT) AS bin, COUNT(*) AS n FROM tagged GROUP BY ALL)
SELECT segment, label, bin, n, round(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY segment, label), 6) AS share FROM c""")
def propensity_by_segment(spark, folder):
    seg = V.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), (F.col("o_custkey") % 2 == 0).cast("int").alias("even"))
    return rounded(C.propensity_by_segment(V.scored(spark, folder), seg, ["urgent", "even"]))
