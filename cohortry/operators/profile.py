"""Data profiles.  Each report is one aggregate pass over the table, whatever its width."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import columns_of
from cohortry.operators.ranking import exact_quantiles


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as rows (keep..., column, value)."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keep), list(columns), "column", "value")


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column: (column, n_missing, ratio_missing)."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot(["_n"], columns, "column", "n_missing").select(
        "column", "n_missing", F.try_divide(F.col("n_missing").cast("double"), F.col("_n")).alias("ratio_missing")
    )


def missing_by_class(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with any NULL, per class."""
    columns = [c for c in (columns or df.columns) if c != label]
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    out = df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(any_null).alias("n_missing"))
    return out.withColumn("ratio_missing", F.col("n_missing") / F.col("n"))


def describe(df: DataFrame, columns: Sequence[str] | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column.

    Runs actions for the quartiles (see ``exact_quantiles``).
    """
    columns = list(columns or columns_of(df, "number"))
    long = _long(df, columns, groups)
    keys = [*groups, "column"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = exact_quantiles(long, "value", (0.25, 0.5, 0.75), keys).withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    return moments.join(q.drop("n"), keys, "left").select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def group_profile(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum, exact median and sum per class and column (runs actions)."""
    long = _long(df, columns, [label])
    keys = [label, "column"]
    base = long.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("total"))
    median = exact_quantiles(long, "value", (0.5,), keys).withColumnRenamed("q0", "median")
    return base.join(median.drop("n"), keys, "left").select(*keys, "min", "max", "median", "total")


def corr_matrix(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Pearson correlation of all column pairs as rows (a, b, corr), in one aggregate.

    A pair skips the rows where either side is NULL.  With ``target`` each row also holds the
    correlation of ``a`` with the target, and the rows come with the largest first.
    """
    columns = list(columns)
    pairs = list(combinations(range(len(columns)), 2))
    wide = df.agg(*[F.corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"),
                 (F.lit(1.0) if i == j else F.col(f"c{min(i, j)}_{max(i, j)}")).alias("corr"))
        for i in range(len(columns)) for j in range(len(columns))
    ]
    out = wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    if target is None:
        return out
    with_target = out.where(F.col("b") == target).select("a", F.col("corr").alias("target_corr"))
    return out.join(F.broadcast(with_target), "a").orderBy(F.desc("target_corr"), "a", "b")


def skewness_report(df: DataFrame, columns: Sequence[str] | None = None, above: float | None = None, digits: int = 4) -> DataFrame:
    """Population skewness per column, largest first; NULLs are skipped."""
    columns = list(columns or columns_of(df, "number"))
    wide = df.agg(*[F.round(F.skewness(F.col(c).cast("double")), digits).alias(c) for c in columns])
    out = wide.unpivot([], columns, "column", "skewness")
    if above is not None:
        out = out.where(F.col("skewness") > above)
    return out.orderBy(F.desc("skewness"), "column")


def crosstab_share(df: DataFrame, rows: Sequence[str], column: str, digits: int | None = None) -> DataFrame:
    """Share of each ``column`` value among the rows of each value of each row column.

    Several row columns are stacked: (column_name, row_value, col_value, n, share).  With
    ``digits`` the share is a percentage, rounded before it is scaled.
    """
    pieces = F.array(*[F.struct(F.lit(r).alias("column_name"), F.col(r).cast("string").alias("row_value")) for r in rows])
    cells = (
        df.where(F.col(column).isNotNull())
        .select(F.explode(pieces).alias("_p"), F.col(column).cast("string").alias("col_value"))
        .where(F.col("_p.row_value").isNotNull())
        .groupBy("_p.column_name", "_p.row_value", "col_value")
        .agg(F.count("*").alias("n"))
    )
    totals = cells.groupBy("column_name", "row_value").agg(F.sum("n").alias("_all"))
    share = F.col("n") / F.col("_all")
    if digits is not None:
        share = F.round(share, digits) * 100
    return cells.join(totals, ["column_name", "row_value"]).select("column_name", "row_value", "col_value", "n", share.alias("share"))


def box_stats(df: DataFrame, column: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers per class: quartiles, whisker ends within 1.5 ranges, outliers.

    Runs actions for the quartiles.
    """
    q = exact_quantiles(df, column, (0.25, 0.5, 0.75), [by]).withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    spread = F.col("q75") - F.col("q25")
    q = q.withColumns({"_lo": F.col("q25") - whisker * spread, "_hi": F.col("q75") + whisker * spread})
    x = F.col(column).cast("double")
    inside = x.between(F.col("_lo"), F.col("_hi"))
    return (
        df.select(by, column).where(F.col(column).isNotNull()).join(q, by)
        .groupBy(by, "n", "q25", "q50", "q75")
        .agg(F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))
    )


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = (), low: float | None = None, high: float | None = None, log10: bool = False) -> DataFrame:
    """Equal-width histogram with the share within each class.

    Limits that are not given are the column's minimum and maximum (an action).  The last
    bin is closed on the right.  Values below given limits count in bin 0, whose start is NULL, and
    values above them, as NaN, in bin ``bins`` + 1, so that shares are of all values.
    """
    x = F.col(column).cast("double")
    if log10:
        x = F.log10(x)
    data = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull())
    if low is None or high is None:
        row = data.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
        low = row["lo"] if low is None else low
        high = row["hi"] if high is None else high
    if low is None or high is None or high <= low:
        bins, low, high = 1, low or 0.0, (high if high is not None and low is not None and high > low else (low or 0.0) + 1.0)
    width = (high - low) / bins
    inside = F.least(F.floor((F.col("_x") - F.lit(low)) / F.lit(width)) + 1, F.lit(bins))
    bucket = F.when(F.col("_x") < low, 0).when(F.col("_x") > high, bins + 1).otherwise(inside).cast("bigint")
    counts = data.withColumn("bin", bucket).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
        counts = counts.join(totals, list(by))
    else:
        counts = counts.withColumn("_all", counts.agg(F.sum("n")).scalar())
    return counts.select(
        *by, "bin", F.when(F.col("bin") > 0, F.lit(low) + (F.col("bin") - 1) * width).alias("bin_start"), "n", (F.col("n") / F.col("_all")).alias("share")
    )


def density(df: DataFrame, column: str, by: Sequence[str] = (), points: int = 200, cells: int = 512, common: bool = False, cut: float = 3.0, log10: bool = False) -> DataFrame:
    """Gaussian kernel density of each class on a grid of its own: (by, point, x, density).

    The bandwidth is the sample deviation times n^(-1/5); the grid runs from ``cut`` bandwidths below
    the minimum to as many above the maximum.  Values are first counted in ``cells`` cells between
    minimum and maximum and stand at the middle of theirs, so the kernels are summed over at most
    cells x points rows a class, whatever its size.  With ``common`` the densities of all classes add
    up to one, each to its share of the rows; otherwise each to one.  With ``log10`` the logarithms are
    taken.  NULL, NaN and infinite values are left out; a class without two different values has no
    rows.
    """
    x = F.col(column).cast("double")
    x = F.log10(x) if log10 else x
    data = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf")))
    shape = data.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.stddev_samp("_x").alias("_sd"))
    shape = shape.withColumn("_all", F.sum("_n").over(Window.partitionBy())).where("_high > _low")
    shape = shape.withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    # the shapes are one row a class
    match = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    placed = data.alias("d").join(shape.alias("s"), reduce(lambda a, b: a & b, match, F.lit(True))).select("s.*", "_x")
    width = (F.col("_high") - F.col("_low")) / cells
    cell = F.least(F.floor((F.col("_x") - F.col("_low")) / width), F.lit(cells - 1))
    counts = placed.groupBy(*shape.columns, cell.alias("_cell")).agg(F.count("*").alias("_c"))
    start, end = F.col("_low") - cut * F.col("_h"), F.col("_high") + cut * F.col("_h")
    grid = counts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", start + F.col("point") * ((end - start) / (points - 1)))
    z = (F.col("x") - (F.col("_low") + (F.col("_cell") + 0.5) * width)) / F.col("_h")
    kernel = F.sum(F.col("_c") * F.exp(-z * z / 2)) / (F.col("_h") * math.sqrt(2 * math.pi) * (F.col("_all") if common else F.col("_n")))
    return grid.groupBy(*by, "point", "x", "_h", "_n", "_all").agg(kernel.alias("density")).select(*by, "point", "x", "density")


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Quartiles and the outlier limits Q1 - k·IQR and Q3 + k·IQR (runs actions)."""
    q = exact_quantiles(df, column, (0.25, 0.75)).withColumnsRenamed({"q0": "q25", "q1": "q75"})
    spread = F.col("q75") - F.col("q25")
    return q.withColumns({"lower": F.col("q25") - k * spread, "upper": F.col("q75") + k * spread})


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5, keep=None, side: str = "both") -> DataFrame:
    """Rows beyond the limits; ``keep`` is a condition rows must also meet (runs actions).

    The limits come back to the driver as two numbers and enter the filter as literals, so
    the filter can be pushed into the scan.
    """
    limits = iqr_bounds(df, column, k).first()
    low, high = F.col(column) < limits["lower"], F.col(column) > limits["upper"]
    out = df.where({"both": low | high, "low": low, "high": high}[side])
    return out if keep is None else out.where(keep)
