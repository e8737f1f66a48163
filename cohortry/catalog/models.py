"""Split, resampling and model queries.  Fitted models are checked by row counts and shares."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortry.catalog.book import Book, hash_sql, rounded, with_views
from cohortry.catalog.donors import ON, _labels
from cohortry.operators import boosting as B
from cohortry.operators import curves as C
from cohortry.operators import estimators as E
from cohortry.operators import modelling as M
from cohortry.operators import neighbours as N
from cohortry.operators.importance import permutation_importance
from cohortry.operators.splits import kfold_column, split_xy, stratified_split
from cohortry.plans import donors as D
from cohortry.plans import players as G
from cohortry.session import materialize
from cohortry.sources import io, views as V
from cohortry.streaming.carts import fresh_root

BOOK = Book()


@BOOK.add("split_xy", with_views("players") + " SELECT COUNT(*) AS n_rows, COUNT(DISTINCT EngagementLevel) AS n_classes, 9 AS n_features FROM players")
def split_meta(spark, folder):
    return split_xy(V.players(spark, folder), ["PlayerID"], "EngagementLevel")[1]


@BOOK.add("stratified_split", """WITH c AS (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus), t AS (SELECT CAST(ceil(0.3 * SUM(n)) AS BIGINT) AS total, SUM(n) AS n FROM c),
q AS (SELECT o_orderstatus, c.n, CAST(floor(c.n * total / CAST(t.n AS DOUBLE)) AS BIGINT) AS base, total, row_number() OVER (ORDER BY c.n * total / CAST(t.n AS DOUBLE) - floor(c.n * total / CAST(t.n AS DOUBLE)) DESC, o_orderstatus) AS r FROM c, t),
z AS (SELECT o_orderstatus, n, base + CASE WHEN r <= total - (SELECT SUM(base) FROM q) THEN 1 ELSE 0 END AS test FROM q)
SELECT o_orderstatus, true AS is_test, CAST(test AS BIGINT) AS n FROM z UNION ALL SELECT o_orderstatus, false, CAST(n - test AS BIGINT) FROM z""")
def stratified(spark, folder):
    """Exact class shares; the rows themselves are in ``stratified_split_rows``."""
    out = stratified_split(V.table(spark, folder, "orders"), "o_orderstatus", "o_orderkey", 0.3)
    return out.groupBy("o_orderstatus", "is_test").agg(F.count("*").alias("n"))


@BOOK.add("kfold_column", """WITH c AS (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus), f AS (SELECT unnest(range(0, 5)) AS fold)
SELECT o_orderstatus, CAST(fold AS INTEGER) AS fold, CAST(n * (fold + 1) // 5 - n * fold // 5 AS BIGINT) AS n FROM c, f""")
def kfold(spark, folder):
    out = kfold_column(V.table(spark, folder, "orders"), "o_orderstatus", "o_orderkey", 5)
    return out.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


@BOOK.add("stratified_split_rows", f"""WITH c AS (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus), t AS (SELECT CAST(ceil(0.3 * SUM(n)) AS BIGINT) AS total, SUM(n) AS n FROM c),
q AS (SELECT o_orderstatus, c.n * total // t.n AS base, total, row_number() OVER (ORDER BY c.n * total % t.n DESC, o_orderstatus) AS r FROM c, t),
z AS (SELECT o_orderstatus, base + CASE WHEN r <= total - (SELECT SUM(base) FROM q) THEN 1 ELSE 0 END AS test FROM q)
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey')}, o_orderkey) <= test AS is_test FROM orders JOIN z USING (o_orderstatus)""")
def stratified_rows(spark, folder):
    return stratified_split(V.table(spark, folder, "orders"), "o_orderstatus", "o_orderkey", 0.3).select("o_orderkey", "is_test")


@BOOK.add("kfold_rows", f"""WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, CAST(len(list_filter(range(1, 5), lambda i: r > n * i // 5)) AS INTEGER) AS fold FROM r""")
def kfold_rows(spark, folder):
    return kfold_column(V.table(spark, folder, "orders"), "o_orderstatus", "o_orderkey", 5).select("o_orderkey", "fold")


@BOOK.add("knn", with_views("vectors") + """, d AS (SELECT a.id, b.id AS neighbour, list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s FROM vectors a JOIN vectors b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, neighbour) AS pos FROM d)
SELECT id, neighbour, round(sqrt(s), 6) AS distance, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 5""")
def nearest(spark, folder):
    return rounded(N.knn(V.vectors(spark, folder), 5))


@BOOK.add("tomek_links", with_views("vectors") + """, d AS (SELECT a.id, a.label, b.id AS other, b.label AS other_label, list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s FROM vectors a JOIN vectors b ON a.id <> b.id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, other) AS r FROM d) WHERE r = 1)
SELECT x.id AS a, x.other AS b, round(sqrt(x.s), 6) AS distance FROM n x JOIN n y ON x.other = y.id AND y.other = x.id WHERE x.id < x.other AND x.label <> x.other_label""")
def tomek(spark, folder):
    return rounded(N.tomek_links(V.vectors(spark, folder)))


@BOOK.add("smote", "SELECT label, COUNT(*) AS n, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM embeddings GROUP BY label)) - COUNT(*) AS n_synthetic FROM embeddings GROUP BY label")
def smote(spark, folder):
    """Per class: rows before, and synthetic rows that bring it to the largest class."""
    v = V.vectors(spark, folder)
    counts = {r["label"]: r["n"] for r in v.groupBy("label").agg(F.count("*").alias("n")).collect()}
    out = N.smote(v, dict.fromkeys(counts, max(counts.values())))
    return out.groupBy("label").agg(F.count_if(~F.col("synthetic")).alias("n"), F.count_if("synthetic").alias("n_synthetic"))


@BOOK.add("smote_tomek")
def smote_tomek(spark, folder):
    v = V.vectors(spark, folder)
    n = v.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    labels = [r[0] for r in v.select("label").distinct().collect()]
    return N.smote_tomek(v, dict.fromkeys(labels, n)).groupBy("label").agg(F.count("*").alias("n"), F.count_if("synthetic").alias("n_synthetic"))


PLAN = M.FeaturePlan(numbers=["Age", "PlayTimeHours"], texts=["GameGenre"], flags=["InGamePurchases"], logs=["PlayerLevel"])


def _std(expr: str) -> str:
    return f"round(({expr} - (SELECT AVG({expr}) FROM p)) / (SELECT stddev_pop({expr}) FROM p), 6) + 0"


@BOOK.add("column_transform", with_views("players") + f""", p AS (SELECT PlayerID, CAST(Age AS DOUBLE) AS Age, PlayTimeHours, GameGenre, InGamePurchases, log10(PlayerLevel + 1) AS lg FROM players)
SELECT PlayerID, {_std('Age')} AS f0, {_std('PlayTimeHours')} AS f1, {_std('lg')} AS f2, CASE WHEN GameGenre = 'AUTOMOBILE' THEN 1.0::DOUBLE ELSE 0 END AS f3,
 CASE WHEN GameGenre = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END AS f4, CAST(InGamePurchases AS DOUBLE) AS f8 FROM p""")
def column_transform(spark, folder):
    """Scaled numbers, scaled log, two of the one-hot entries, and the flag."""
    p = V.players(spark, folder)
    v = vector_to_array("features")
    out = M.feature_pipeline(PLAN, p.count()).fit(p).transform(p)
    return rounded(out.select("PlayerID", *[v[i].alias(f"f{i}") for i in (0, 1, 2, 3, 4, 8)]))


@BOOK.add("feature_names", with_views("players") + """, n AS (SELECT unnest(['num__Age', 'num__PlayTimeHours', 'log__PlayerLevel']) AS feature UNION ALL SELECT DISTINCT 'hot__GameGenre_' || GameGenre FROM players UNION ALL SELECT 'bin__InGamePurchases')
SELECT feature FROM n""")
def names(spark, folder):
    p = V.players(spark, folder)
    return spark.createDataFrame([(n,) for n in M.feature_names(M.feature_pipeline(PLAN, p.count()).fit(p))], "feature string")


def _donor_rows(spark, folder):
    f = D.training_frame(V.attributes(spark, folder), V.donations(spark, folder), _labels(spark, folder), ON, "target")
    f = f.withColumnRenamed("target", "label").where(F.col("label").isNotNull())
    f = f.withColumn("label", F.col("label").cast("double"))
    # read by every pass of the fits below
    return materialize(stratified_split(f, "label", "candidate_id", 0.3))


def _donor_transform(rows):
    return M.feature_pipeline(M.plan_features(rows, ["candidate_id", "label"]), rows.count())


def _donor_fit(spark, folder):
    rows = _donor_rows(spark, folder)
    train = M.class_weights(rows.where("NOT is_test"), "label", 5.0)
    return rows, M.fit_gbt(train, _donor_transform(train.drop("weight", "is_test")), rounds=5, depth=3, weight="weight")


def _player_rows(spark, folder):
    p = G.player_features(V.players(spark, folder)).withColumnRenamed("EngagementLevel", "label").withColumn("label", F.col("label").cast("double"))
    return materialize(stratified_split(p, "label", "PlayerID", 0.25))


TEST_SHARE = "SELECT CAST(ceil(0.3 * COUNT(*)) AS BIGINT) AS n, true AS in_range FROM customer WHERE c_acctbal >= 100 AND c_custkey IN (SELECT o_custkey FROM orders)"


@BOOK.add("gbt_scored", TEST_SHARE)
def gbt_scored(spark, folder):
    """Held-out rows scored by a weighted booster: their number, and scores within [0, 1]."""
    rows, model = _donor_fit(spark, folder)
    s = M.scored(model, rows.where("is_test"), "candidate_id", "label")
    return s.agg(F.count("*").alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"))


@BOOK.add("gbt_quality")
def gbt_quality(spark, folder):
    rows, model = _donor_fit(spark, folder)
    return C.curve_areas(M.scored(model, rows.where("is_test"), "candidate_id", "label"))


@BOOK.add("gbt_early_stopping")
def gbt_early_stopping(spark, folder):
    rows = _donor_rows(spark, folder)
    model = M.fit_gbt(rows, _donor_transform(rows.drop("is_test")), rounds=12, depth=2, validation="is_test")
    return rows.agg(F.count("*").alias("n")).select("n", F.lit(M.rounds_used(model)).alias("rounds"))


@BOOK.add("gbt_importance")
def gbt_importance(spark, folder):
    _, model = _donor_fit(spark, folder)
    return M.feature_importance(model, M.feature_names(model))


@BOOK.add("gbt_regression")
def gbt_regression(spark, folder):
    rows = _donor_rows(spark, folder)
    rows = rows.drop("label").withColumnRenamed("amount_prev360d2", "label")
    train = rows.where("NOT is_test").drop("is_test")
    model = M.fit_gbt_regressor(train, M.feature_pipeline(M.plan_features(train, ["candidate_id", "label"]), train.count()), rounds=4)
    return M.regression_errors(model.transform(rows.where("is_test")))


def _player_transform(train):
    return M.feature_pipeline(M.plan_features(train.drop("is_test"), ["PlayerID", "label"], logs=["PlayTimeHours"]), train.count())


@BOOK.add("gbt_multiclass")
def gbt_multiclass(spark, folder):
    rows = _player_rows(spark, folder)
    train = rows.where("NOT is_test")
    model = M.fit_gbt_multiclass(train, 3, transform=_player_transform(train), rounds=3, depth=2)
    return C.multiclass_metrics(M.scored_multiclass(model, rows.where("is_test"), "PlayerID", "label"))


def _player_lr(spark, folder, penalty="elasticnet"):
    rows = _player_rows(spark, folder)
    train = rows.where("NOT is_test")
    return rows, M.fit_lr(train, _player_transform(train), c=1.0, penalty=penalty, rounds=20)


@BOOK.add("lr_scored")
def lr_scored(spark, folder):
    rows, model = _player_lr(spark, folder)
    return M.scored_multiclass(model, rows.where("is_test"), "PlayerID", "label")


@BOOK.add("lr_coefficients")
def lr_coefficients(spark, folder):
    _, model = _player_lr(spark, folder)
    return M.top_coefficients(model, M.feature_names(model), 5)


@BOOK.add("random_search")
def random_search(spark, folder):
    rows = _player_rows(spark, folder).where("NOT is_test")
    rows = materialize(kfold_column(rows, "label", "PlayerID", 3))
    stages = _player_transform(rows.drop("fold")).getStages()
    lr = M.logistic(rows.count(), rounds=10)
    space = {lr.regParam: M.Uniform(1e-4, 1e-1, log=True), lr.elasticNetParam: [0.0, 0.5, 1.0]}
    return M.random_search(M.Pipeline(stages=[*stages, lr]), rows, space, 3, 3).trials


@BOOK.add("nested_cv")
def nested_cv(spark, folder):
    rows = _donor_rows(spark, folder).drop("is_test")
    rows = kfold_column(kfold_column(rows, "label", "candidate_id", 2, seed=1, name="outer_fold"), "label", "candidate_id", 2, seed=2)
    rows = materialize(rows)
    stages = _donor_transform(rows.drop("fold", "outer_fold")).getStages()
    booster = M.gbt(rounds=3, depth=2)
    space = {booster.maxDepth: M.Uniform(1, 3, whole=True), booster.stepSize: [0.1, 0.3]}
    return M.nested_cv(M.Pipeline(stages=[*stages, booster]), rows, space, 2, 2, 2, metric="average_precision")


@BOOK.add("permutation_importance")
def importance(spark, folder):
    rows, model = _player_lr(spark, folder)
    columns = ["Age", "PlayTimeHours", "InGamePurchases", "PlayerLevel", "GameGenre", "Location"]
    train = rows.where("NOT is_test").select("PlayerID", "label", *columns)
    model = M.fit_lr(train, M.feature_pipeline(M.plan_features(train, ["PlayerID", "label"]), train.count()), rounds=10)
    return permutation_importance(model.transform, rows.where("is_test"), "PlayerID", "label", columns, repeats=3)


RULE = "CASE WHEN {0} >= 150000 OR {1} = '1-URGENT' THEN 1 ELSE 0 END"


@BOOK.add("rule_importance", f"""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice AS price, o_orderpriority AS priority FROM orders),
k AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('id')}, id) AS rank, count(*) OVER () AS n FROM o),
s AS (SELECT r, CAST('0x' || substr(md5('42:' || r), 1, 15) AS BIGINT) AS h FROM (SELECT unnest(range(0, 4)) AS r)),
j AS (SELECT k.label, r, k.price, k.priority, d.price AS other_price, d.priority AS other_priority FROM k, s, k d WHERE d.rank = (k.rank - 1 + h % (k.n - 1) + 1) % k.n + 1),
t AS (SELECT 'price' AS feature, r, label, {RULE.format('other_price', 'priority')} AS p FROM j UNION ALL SELECT 'priority', r, label, {RULE.format('price', 'other_priority')} FROM j
    UNION ALL SELECT '', -1, label, {RULE.format('price', 'priority')} FROM o),
f AS (SELECT feature, r, c, sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS support, 2.0::DOUBLE * sum(CASE WHEN label = c AND p = c THEN 1 ELSE 0 END) / sum(CASE WHEN label = c THEN 1 ELSE 0 END + CASE WHEN p = c THEN 1 ELSE 0 END) AS f1 FROM t, (SELECT unnest([0, 1]) AS c) GROUP BY feature, r, c),
w AS (SELECT feature, r, sum(f1 * support) / sum(support) AS f1 FROM f GROUP BY feature, r),
l AS (SELECT feature, (SELECT f1 FROM w WHERE feature = '') - f1 AS lost FROM w WHERE feature <> '')
SELECT feature, round(avg(lost), 7) + 0 AS importance, round(stddev_pop(lost), 7) + 0 AS std FROM l GROUP BY feature""")
def rule_importance(spark, folder):
    """Permutation importance where the model is a fixed rule."""
    o = V.table(spark, folder, "orders")
    o = o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    rule = lambda df: df.withColumn("prediction", F.expr(RULE.format("price", "priority")))
    return rounded(permutation_importance(rule, o, "o_orderkey", "label", ["price", "priority"], repeats=4), 7)


@BOOK.add("artifact_round_trip", "SELECT CAST(ceil(0.25 * COUNT(*)) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_different FROM customer")
def artifact_round_trip(spark, folder):
    """Held-out rows scored by a model and by its saved and loaded copy."""
    rows, model = _player_lr(spark, folder, "l2")
    path = fresh_root(spark, "artifact")
    io.save_artifact(model, rows.where("is_test"), path)
    loaded, held_out = io.load_artifact(spark, path)
    after = M.scored_multiclass(loaded, held_out, "PlayerID", "label").select("id", F.col("probability").alias("again"))
    before = M.scored_multiclass(model, rows.where("is_test"), "PlayerID", "label")
    return before.join(after, "id").agg(F.count("*").alias("n"), F.count_if(F.col("probability") != F.col("again")).alias("n_different"))


@BOOK.add("lr_probabilities", "SELECT CAST(ceil(0.25 * COUNT(*)) AS BIGINT) AS n, true AS add_up, true AS top_is_predicted FROM customer")
def lr_probabilities(spark, folder):
    """Every held-out row is scored once, with probabilities that add up to 1."""
    rows, model = _player_lr(spark, folder)
    s = M.scored_multiclass(model, rows.where("is_test"), "PlayerID", "label")
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    return s.agg(
        F.countDistinct("id").alias("n"), F.bool_and(F.abs(total - 1) < 1e-9).alias("add_up"),
        F.bool_and(F.col("probability")[F.col("prediction")] == F.col("probability_max")).alias("top_is_predicted"),
    )


@BOOK.add("gbt_multiclass_one_round", with_views("players") + """, p AS (SELECT PlayerID, InGamePurchases AS x, CASE EngagementLevel WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS y FROM players),
m AS (SELECT x, k, 1 / (1 + exp(-2 * avg(CASE WHEN y = k THEN 1.0::DOUBLE ELSE -1 END))) AS own FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY x, k),
s AS (SELECT x, max(own) FILTER (k = 0) / sum(own) AS p0, max(own) FILTER (k = 1) / sum(own) AS p1, max(own) FILTER (k = 2) / sum(own) AS p2 FROM m GROUP BY x)
SELECT PlayerID, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction FROM p JOIN s USING (x)""")
def gbt_multiclass_one_round(spark, folder):
    """One round of depth 1 on one 0/1 column, saved and loaded: a class's margin is the mean of its +1 and -1 by that column."""
    p = G.player_features(V.players(spark, folder)).withColumn("label", F.col("EngagementLevel").cast("double"))
    flag = VectorAssembler(inputCols=["InGamePurchases"], outputCol="features")
    model = M.fit_gbt_multiclass(p, 3, transform=M.Pipeline(stages=[flag]), rounds=1, depth=1)
    path = fresh_root(spark, "booster")
    io.save_artifact(model, p, path)
    loaded, held_out = io.load_artifact(spark, path)
    out = M.scored_multiclass(loaded, held_out, "PlayerID", "label")
    return rounded(out.select(F.col("id").alias("PlayerID"), *[F.col("probability")[k].alias(f"p{k}") for k in range(3)], "prediction"))


STEP, ROUNDS = 0.3, 6


@BOOK.add("cv_rounds", f"""WITH RECURSIVE o AS (SELECT CASE WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1 END AS y, o_orderkey % 3 AS fold FROM orders),
f AS (SELECT unnest([0, 1, 2]) AS held),
s AS (SELECT held, x, 1 AS round, avg(y) AS m, avg(CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM o, f WHERE fold <> held GROUP BY held, x
    UNION ALL SELECT held, x, round + 1, m + {STEP} * (share * 4 / (1 + exp(2 * m)) - (1 - share) * 4 / (1 + exp(-2 * m))), share FROM s WHERE round < {ROUNDS}),
l AS (SELECT held, round, avg(ln(1 + exp(-2 * y * m))) AS loss FROM o JOIN s ON fold = held AND o.x = s.x GROUP BY held, round),
a AS (SELECT round, avg(loss) AS score FROM l GROUP BY round)
SELECT CAST(round AS INTEGER) AS round, round(score, 7) AS score, round = (SELECT arg_min(round, (score, round)) FROM a) AS best FROM a""")
def cv_rounds(spark, folder):
    """Held-out loss after each round of a booster on one 0/1 column, whose margins follow a recursion."""
    rows = V.table(spark, folder, "orders").select(
        (F.col("o_totalprice") >= 150000).cast("double").alias("x"), (F.col("o_orderstatus") == "F").cast("double").alias("label"), (F.col("o_orderkey") % 3).alias("fold"),
    )
    rows = materialize(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    found = B.cv_rounds(M.gbt(rounds=ROUNDS, depth=1, rate=STEP), rows, 3, metric="log_loss", patience=ROUNDS)
    return rounded(found.scores.select("round", "score", "best"), 7)


@BOOK.add("resampled_folds", """WITH t AS (SELECT COUNT(*) // 5 AS target FROM embeddings), f AS (SELECT unnest([0, 1, 2]) AS fold),
n AS (SELECT f.fold, vec_id % 3 = f.fold AS held, label, COUNT(*) AS n FROM embeddings, f GROUP BY ALL),
a AS (SELECT fold, held, label, n, CASE WHEN held OR label > 1 THEN 0 ELSE greatest(target - n, 0) END AS more FROM n, t)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN held THEN 'validation' ELSE 'train' END AS part, label, n + more AS n, more AS n_synthetic FROM a""")
def resampled_folds(spark, folder):
    """Rows by class that each fold of a search is fitted on, after resampling, and validated on."""
    v = V.vectors(spark, folder)
    rows = materialize(v.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), (F.col("id") % 3).alias("fold")))
    target = rows.count() // 5
    resampler = E.Resampler(targets=E.Resampler.counts({0: target, 1: target}), tomek=False)
    return E.fold_counts(E.TrainingPipeline(stages=[resampler, E.PenalisedLogistic(maxIter=1)]), rows, range(3))


@BOOK.add("tree_splits", """SELECT 'x' AS feature, 1::DOUBLE AS gain, 1 AS splits, round(var_pop(y) - sum((y - m) * (y - m)) / COUNT(*), 6) AS mean_gain, COUNT(*)::DOUBLE AS cover FROM (
SELECT y, avg(y) OVER (PARTITION BY x) AS m FROM (SELECT o_totalprice >= 150000 AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1 END AS y FROM orders))
UNION ALL SELECT 'constant', 0, 0, 0, 0""")
def tree_splits(spark, folder):
    """Splits, mean gain and mean rows of a single tree's one split, read from the saved nodes: the gain is the drop in variance."""
    rows = V.table(spark, folder, "orders").select((F.col("o_totalprice") >= 150000).cast("double").alias("x"), F.lit(1.0).alias("constant"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    model = M.fit_gbt(rows, M.Pipeline(stages=[VectorAssembler(inputCols=["x", "constant"], outputCol="features")]), rounds=1, depth=1)
    return rounded(M.feature_importance(model, ["x", "constant"]))


# the model and its scores of the closed form above, for even keys (train) and odd ones (test)
@BOOK.add("evaluate_sets", with_views("players") + """, p AS (SELECT PlayerID, InGamePurchases AS x, CASE EngagementLevel WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS y, CASE WHEN PlayerID % 2 = 0 THEN 'train' ELSE 'test' END AS s FROM players),
m AS (SELECT x, k, 1 / (1 + exp(-2 * avg(CASE WHEN y = k THEN 1.0::DOUBLE ELSE -1 END))) AS own FROM p, (SELECT unnest([0, 1, 2]) AS k) WHERE s = 'train' GROUP BY x, k),
q AS (SELECT x, k, round(own / sum(own) OVER (PARTITION BY x), 12) AS own FROM m),
t AS (SELECT x, arg_max(k, (own, -k)) AS guess FROM q GROUP BY x),
c AS (SELECT s, k, count(*) FILTER (y = k) AS support, count(*) FILTER (guess = k) AS guessed, count(*) FILTER (y = k AND guess = k) AS hit FROM p JOIN t USING (x), (SELECT unnest([0, 1, 2]) AS k) GROUP BY s, k),
f AS (SELECT s, sum(support) AS n, sum(support * CASE WHEN guessed > 0 THEN hit / guessed::DOUBLE ELSE 0 END) / sum(support) AS precision, sum(support * (hit / support::DOUBLE)) / sum(support) AS recall,
    sum(support * (2.0::DOUBLE * hit / (support + guessed))) / sum(support) AS f1 FROM c GROUP BY s),
a AS (SELECT a.s, a.k, sum(CASE WHEN a.own > b.own THEN 1.0::DOUBLE WHEN a.own = b.own THEN 0.5 ELSE 0 END * a.w * b.w) / (sum(a.w * b.w)) AS auc, max(a.w_all) AS w
    FROM (SELECT s, k, own, count(*) AS w, sum(count(*)) OVER (PARTITION BY s, k) AS w_all FROM p JOIN q USING (x) WHERE y = k GROUP BY s, k, own) a
    JOIN (SELECT s, k, own, count(*) AS w FROM p JOIN q USING (x) WHERE y <> k GROUP BY s, k, own) b ON a.s = b.s AND a.k = b.k GROUP BY a.s, a.k)
SELECT f.s AS set, CAST(n AS BIGINT) AS n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round((SELECT sum(auc * w) / sum(w) FROM a WHERE a.s = f.s), 6) AS auroc FROM f""")
def evaluate_sets(spark, folder):
    """Train and test metrics of a fitted model as one table, through the metrics sink and back."""
    p = G.player_features(V.players(spark, folder)).withColumn("label", F.col("EngagementLevel").cast("double"))
    flag = VectorAssembler(inputCols=["InGamePurchases"], outputCol="features")
    sets = {"train": p.where("PlayerID % 2 = 0"), "test": p.where("PlayerID % 2 = 1")}
    model = M.fit_gbt_multiclass(sets["train"], 3, transform=M.Pipeline(stages=[flag]), rounds=1, depth=1)
    path = fresh_root(spark, "metrics")
    io.write_metrics(rounded(M.evaluate_sets(model, sets, "PlayerID", "label", 3)), path)
    return io.read_metrics(spark, path).select("set", "n", "precision", "recall", "f1", "auroc")
