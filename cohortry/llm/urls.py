"""Rules on URLs, and gradient-boosted trees on how a URL looks where no rule fits.

Column expressions and Spark ML only.  The trees learn from URLs that carry a label; labels may come
from a table or, as in ``judged``, from the rules themselves: what they allow and block shows what
allowed and blocked URLs look like.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored

#: Bound of the labelled URLs that the trees are fitted on: the first by a hash of the URL.
MOST_LABELLED = 8_000
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "host_parts", "digit_ratio", "entropy", "params", "has_fragment",
    "suffix_urls", "suffix_blocked",
]


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path, both empty for a NULL or one without ``://``.

    Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.
    Path: from there up to ``?``, ``#`` or the end.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def rule_of(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """A struct of the longest fitting rule and its verdict, NULL if none fits.

    A rule (host, path, verdict) fits its host and all subdomains if the path starts with its own.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    n = F.char_length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    bits = F.aggregate(F.filter(counts, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """Length, depth, digit ratio, entropy and parameter counts of a URL that has host and path; and its suffix, the last part of the host."""
    u = F.coalesce(F.col(url), F.lit(""))
    count = lambda text, c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    n = F.char_length(u)
    return pages.withColumns({
        "url_length": n, "host_length": F.char_length("host"), "path_length": F.char_length("path"),
        "depth": count(F.col("path"), "/"), "host_parts": count(F.col("host"), "."),
        "digit_ratio": F.when(n > 0, (n - F.char_length(F.translate(u, string.digits, ""))) / n).otherwise(F.lit(0.0)),
        "entropy": _entropy(u),
        "params": F.when(F.locate("?", u) > 0, count(u, "&") + 1).otherwise(F.lit(0)),
        "has_fragment": (F.locate("#", u) > 0).cast("int"),
        "suffix": F.regexp_extract("host", "[^.]*$", 0),
    })


def suffix_statistics(pages: DataFrame, label: str) -> DataFrame:
    """Per suffix the logarithm of its URLs and the smoothed share of blocked ones among the labelled, over all rows."""
    blocked, labelled = F.sum(F.col(label)), F.count(label)
    return pages.groupBy("suffix").agg(F.log1p(F.count("*")).alias("suffix_urls"), ((F.coalesce(blocked, F.lit(0)) + 1) / (labelled + 2)).alias("suffix_blocked"))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep").transform(rows)


def fit(rows: DataFrame, label: str, url: str = "url", most: int = MOST_LABELLED, seed: int = 7) -> GBTClassificationModel | None:
    """Trees on at most ``most`` different labelled URLs; None if only one label occurs."""
    sample = rows.where(F.col(label).isNotNull()).groupBy(url).agg(F.max(label).cast("double").alias("_label"), *[F.max(c).alias(c) for c in FEATURES])
    sample = stored(sample.orderBy(F.xxhash64(url), url).limit(most).select("_label", *FEATURES), "labelled-urls")
    if sample.select("_label").distinct().count() < 2:
        return None
    trees = GBTClassifier(labelCol="_label", featuresCol="_features", maxIter=10, maxDepth=4, stepSize=0.3, seed=seed)
    return trees.fit(_vectors(sample))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (the trees' probability of being blocked).

    The verdict is that of the longest fitting rule, else the trees'.  URLs that a rule judges are
    the labelled ones.  Without both labels there are no trees: the score is NULL and what no rule
    blocks is allowed.  NULL URLs are judged as empty ones.  Columns of ``pages`` that have the name
    of a result are replaced; repeated rows get the same verdict.
    """
    narrow = lexical(with_parts(pages.drop("score", "suffix", *FEATURES), url), url)
    found = rule_of(rules, F.col("host"), F.col("path"))
    narrow = narrow.withColumns({"rule": found["rule"], "verdict": found["verdict"]}).withColumn("_blocked", F.when(F.col("rule").isNotNull(), (F.col("verdict") == "block").cast("int")))
    rows = narrow.join(suffix_statistics(narrow, "_blocked"), "suffix")
    model = fit(rows, "_blocked", url)
    if model is None:
        out = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction").transform(_vectors(rows))
        out = scored.withColumn("score", vector_to_array("_probability")[1]).drop("_probability", "_raw", "_prediction", "_features")
    own = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("verdict", own)).drop("_blocked", "suffix", *FEATURES)
