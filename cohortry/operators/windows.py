"""Ordered per-key operators.

Plain windows hold one key in one task.  Where a key's rows are not bounded by the data
model, pass ``chunk`` (a column that cuts the order into consecutive pieces, such as the
month of the date): the window then runs per (key, chunk), and one short row per chunk
carries the state across chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import as_column


def dense_number(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Dense rank by ``order`` within the keys."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint"))


def next_event(df: DataFrame, keys: Sequence[str], order: str, default: Column | str, name: str = "next_event", chunk: Column | None = None) -> DataFrame:
    """The following row's ``order`` value within the keys, else ``default``."""
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumn(name, F.coalesce(F.lead(order).over(w), as_column(default)))
    df = df.withColumn("_chunk", chunk)
    firsts = df.groupBy(*keys, "_chunk").agg(F.min(order).alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_chunk")
    firsts = firsts.withColumn("_after", F.lead("_first").over(over)).drop("_first")
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        df.join(firsts, [*keys, "_chunk"])
        .withColumn(name, F.coalesce(F.lead(order).over(w), F.col("_after"), as_column(default)))
        .drop("_chunk", "_after")
    )


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, chunk: Column | None = None) -> DataFrame:
    """``value`` of the preceding row within the keys (NULL on the first)."""
    if chunk is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    df = df.withColumn("_chunk", chunk)
    lasts = df.groupBy(*keys, "_chunk").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_chunk")
    lasts = lasts.withColumn("_carried", F.lag("_last").over(over)).drop("_last")
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        df.join(lasts, [*keys, "_chunk"])
        .withColumn(name, F.when(F.row_number().over(w) == 1, F.col("_carried")).otherwise(F.lag(value).over(w)))
        .drop("_chunk", "_carried")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], chunk: Column | None = None, descending: bool = False) -> DataFrame:
    """Running sums within the keys; rows with equal ``order`` share one total.

    ``values`` maps output names to input columns.
    """
    direction = F.col(order).desc() if descending else F.col(order).asc()
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(direction)
        return df.withColumns({o: F.sum(c).over(w) for o, c in values.items()})
    df = df.withColumn("_chunk", chunk)
    names = [f"_s{i}" for i in range(len(values))]
    sums = df.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(n) for n, c in zip(names, values.values())])
    chunk_order = F.col("_chunk").desc() if descending else F.col("_chunk").asc()
    before = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({n: F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names})
    w = Window.partitionBy(*keys, "_chunk").orderBy(direction)
    return (
        df.join(sums, [*keys, "_chunk"])
        .withColumns({o: F.col(n) + F.sum(c).over(w) for (o, c), n in zip(values.items(), names)})
        .drop("_chunk", *names)
    )


def backward_cumulative(df: DataFrame, key: str, date: str, amount: str) -> DataFrame:
    """Count and amount from the newest date back to each date, one row per (key, date).

    Rows of one day are peers and share a total, so they are added up first: a key then has
    at most one row per calendar day, however many rows it came with.
    """
    daily = df.groupBy(key, date).agg(
        F.count(F.col(date)).alias("n"), F.sum(amount).alias("amount")
    )
    return running_sum(daily, [key], date, {"cum_count": "n", "cum_sum": "amount"}, descending=True)


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, x: str, surplus: str = "act_os", deficit: str = "act_dnod", chunk: Column | None = None) -> DataFrame:
    """Surplus carried to the next row and floored at zero, and the deficit left over.

    The recursion ``surplus = max(previous surplus + x, 0)`` has the closed form
    ``S - M`` with ``S`` the running sum and ``M = min(0, running minimum of S)``; the deficit
    is the drop of ``M``.  No recursion and no self-join is needed.
    """
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn("_s", F.sum(x).over(upto))
        df = df.withColumn("_m", F.least(F.min("_s").over(upto), F.lit(0)))
        df = df.withColumn("_m0", F.coalesce(F.lag("_m").over(w), F.lit(0)))
        return df.withColumns({surplus: F.col("_s") - F.col("_m"), deficit: F.col("_m0") - F.col("_m")}).drop("_s", "_m", "_m0")

    df = df.withColumn("_chunk", chunk)
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_s", F.sum(x).over(upto))
    chunks = df.groupBy(*keys, "_chunk").agg(F.sum(x).alias("_sum"), F.min("_s").alias("_low"))
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_base", F.coalesce(F.sum("_sum").over(prior), F.lit(0)))
    chunks = chunks.withColumn("_floor", F.coalesce(F.least(F.min(F.col("_base") + F.col("_low")).over(prior), F.lit(0)), F.lit(0)))
    df = df.join(chunks.select(*keys, "_chunk", "_base", "_floor"), [*keys, "_chunk"])
    df = df.withColumn("_s", F.col("_base") + F.col("_s"))
    df = df.withColumn("_m", F.least(F.min("_s").over(upto), F.col("_floor")))
    df = df.withColumn("_m0", F.coalesce(F.lag("_m").over(in_chunk), F.col("_floor")))
    return df.withColumns({surplus: F.col("_s") - F.col("_m"), deficit: F.col("_m0") - F.col("_m")}).drop(
        "_chunk", "_s", "_m", "_m0", "_base", "_floor"
    )
