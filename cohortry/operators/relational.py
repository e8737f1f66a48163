"""Joins, aggregates and set operations that the analyses share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def having_count(df: DataFrame, keys: Sequence[str], fewer_than: int | None = None, more_than: int | None = None, name: str = "n") -> DataFrame:
    """Groups whose row count is below or above a bound."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(name))
    if fewer_than is not None:
        counts = counts.where(F.col(name) < fewer_than)
    if more_than is not None:
        counts = counts.where(F.col(name) > more_than)
    return counts


def multi_rows(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Keys that occur in more than one row."""
    return having_count(df, [key], more_than=1, name=name)


def duplicate_audit(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Row count of every key combination."""
    return having_count(df, keys, name=name)


def count_distinct(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Exact distinct counts, one column ``n_<column>`` each.

    Every (group, value) pair is aggregated before the per-group count, so a group's values
    are spread over tasks.
    """
    return df.groupBy(*groups).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with no partner."""
    return left.join(right.select(*on), list(on), "left_anti")


def in_population(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the population; members listed twice do not repeat rows."""
    return df.join(members.select(key), key, "left_semi")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def stack_reports(reports: dict[str, DataFrame], tag: str = "report") -> DataFrame:
    """Small result tables of one shape under each other, each with its name."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in reports.items()]
    return reduce(DataFrame.unionByName, tagged)


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Attach aggregates of the key's group to every row.

    Aggregate and join rather than a window: the aggregate combines before its shuffle, and
    the join may be broadcast or split where one key is frequent.
    """
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(table, list(keys))


def binary_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose values are all 0, 1 or NULL (one aggregate, an action)."""
    if not columns:
        return []
    row = df.agg(*[F.bool_and(F.col(c).isin(0, 1)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not False]


def binary_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same test as rows (column, is_binary), as one lazy aggregate."""
    wide = df.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "is_binary")


def share(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows and, per flag, the percentage of rows that carry it."""
    return df.agg(
        F.count("*").alias("n"),
        *[(F.sum(f) * F.lit(100.0) / F.count("*")).alias(f"percent_{f}") for f in flags],
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.select(label, "n", (F.col("n") / total).alias("share"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several text columns as rows (column, value, n), in one aggregate."""
    pieces = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pieces).alias("_p")).groupBy("_p.column", "_p.value").agg(F.count("*").alias("n"))


def bucket_max(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def pivot_buckets(df: DataFrame, key: str, bucket: str, labels: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key, one column ``<label>_<value>`` per bucket, 0 where there is none.

    The labels are given, so an empty bucket still makes its column.
    """
    out = df.groupBy(key).pivot(bucket, list(labels)).agg(*[F.max(v).alias(v) for v in values])
    if len(values) == 1:
        out = out.withColumnsRenamed({lab: f"{lab}_{values[0]}" for lab in labels})
    return out.fillna(0)


def cum_avg(total: Column, count: Column) -> Column:
    """Sum over count, 0 where it is undefined."""
    return F.coalesce(F.try_divide(total, count.cast("double")), F.lit(0.0))


def derive_label(events: DataFrame, key: str, date: str, amount: str, after, before, cutoff: float, name: str = "target") -> DataFrame:
    """1 where the amounts strictly between two dates add up to the cut-off.

    Negative amounts are left out; a NULL amount is kept and adds nothing.  The sum is
    rounded at 6 digits, so that the order of addition cannot move it across the cut-off.
    """
    kept = events.where(
        (F.col(date) > F.lit(after)) & (F.col(date) < F.lit(before)) & F.coalesce(F.col(amount) >= 0, F.lit(True))
    )
    return kept.groupBy(key).agg(F.round(F.sum(amount), 6).alias("amount")).withColumn(name, F.coalesce(F.col("amount") >= cutoff, F.lit(False)).cast("int"))


def label_population(labels: DataFrame, derived: DataFrame, key: str, name: str = "target") -> DataFrame:
    """Left join of derived labels; no record means 0."""
    return labels.join(derived, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0))).withColumn(
        "amount", F.coalesce(F.col("amount"), F.lit(0.0))
    )


def check_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows, and rows where two columns differ (NULL counts as a difference)."""
    return df.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(a) == F.col(b), F.lit(False))).alias("n_different"))


def check_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after a step."""
    return before.agg(F.count("*").alias("n_before")).withColumn(
        "n_after", after.agg(F.count("*")).scalar()
    ).withColumn("rows_kept", F.col("n_before") == F.col("n_after"))


def audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each named rule, counted in one pass: (rule, n)."""
    wide = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n")


def rule_precision_recall(df: DataFrame, rule: Column, label: str) -> DataFrame:
    """Precision and recall of the rows a rule selects."""
    positive = F.col(label) == 1
    counts = df.agg(
        F.count_if(rule & positive).alias("tp"),
        F.count_if(rule).alias("selected"),
        F.count_if(positive).alias("positives"),
        F.count("*").alias("n"),
    )
    return counts.select(
        "tp", "selected", "positives",
        F.try_divide(F.col("tp").cast("double"), F.col("selected")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("positives")).alias("recall"),
        F.try_divide(F.col("positives").cast("double"), F.col("n")).alias("base_rate"),
    )


def segment_overlap(df: DataFrame, segments: Sequence[str], label: str) -> DataFrame:
    """Rows that carry every segment flag, and how many of them are positive."""
    both = reduce(lambda a, b: a & b, [F.col(s) == 1 for s in segments])
    return df.agg(F.count_if(both).alias("n"), F.count_if(both & (F.col(label) == 1)).alias("n_positive"))
