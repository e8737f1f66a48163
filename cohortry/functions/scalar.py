"""Row-wise expressions.  All are built-in column expressions; none is a Python UDF."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers ---------------------------------------------------------------------


def number(c: ColumnLike) -> Column:
    """Text to double; text that is not a number gives NULL."""
    return as_column(c).try_cast("double")


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """Quotient that is NULL where the denominator is zero or NULL."""
    return F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))


def pos_part(c: ColumnLike) -> Column:
    return F.greatest(as_column(c), F.lit(0))


def neg_part(c: ColumnLike) -> Column:
    return F.greatest(-as_column(c), F.lit(0))


def complement(c: ColumnLike) -> Column:
    return F.lit(1.0) - as_column(c)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def rounded(c: ColumnLike, digits: int = 6) -> Column:
    return F.round(as_column(c).cast("double"), digits)


def percent(c: ColumnLike, digits: int = 1) -> Column:
    """A fraction as a rounded percentage: round first at ``digits + 2``, then scale."""
    return F.round(as_column(c), digits + 2) * 100


def log1p10(df: DataFrame, columns: Sequence[str], exclude: Iterable[str] = ()) -> DataFrame:
    """Add ``log_<name>`` = log10(x + 1) for each column not excluded; NULL for x <= -1."""
    skip = set(exclude)
    return df.withColumns(
        {f"log_{c}": F.log10(F.col(c) + 1) for c in columns if c not in skip}
    )


# --- categories ------------------------------------------------------------------


def recode(c: ColumnLike, mapping: dict) -> Column:
    """Value lookup; values outside the mapping give NULL."""
    source = as_column(c)
    out = None
    for key, value in mapping.items():
        out = F.when(source == key, F.lit(value)) if out is None else out.when(source == key, F.lit(value))
    return out if out is not None else F.lit(None)


def ordinal(c: ColumnLike, values: Sequence) -> Column:
    """Position in an ordered list, NULL when absent from it."""
    return recode(c, {v: i for i, v in enumerate(values)})


def cut(c: ColumnLike, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: ``labels[i]`` for edges[i-1] < x <= edges[i].

    The first bin has no lower edge, so ``edges`` and ``labels`` have equal length; values
    above the last edge and NULL give NULL.
    """
    if len(edges) != len(labels):
        raise ValueError("one upper edge per label is needed")
    x = as_column(c)
    out = None
    for edge, label in zip(edges, labels):
        out = F.when(x <= edge, label) if out is None else out.when(x <= edge, label)
    return out


def argmax_onehot(columns: Sequence[str], names: Sequence[str]) -> list[Column]:
    """One flag per column: 1 only where it is strictly greater than every other one."""
    out = []
    for column, name in zip(columns, names):
        others = [F.col(o) for o in columns if o != column]
        rival = F.greatest(*others) if len(others) > 1 else others[0]
        # greatest() skips NULL, a comparison with NULL must fail: require all present.
        present = reduce(lambda a, b: a & b, [o.isNotNull() for o in others])
        out.append(flag((F.col(column) > rival) & present).alias(name))
    return out


def threshold_flags(columns: Sequence[str], names: Sequence[str], t: float = 0.7) -> list[Column]:
    """One flag per class for probability > t (strict); NULL gives 0."""
    return [flag(F.col(c) > t).alias(n) for c, n in zip(columns, names)]


def threshold_label(columns: Sequence[str], names: Sequence[str], t: float = 0.7, other: str = "other") -> Column:
    """Name of the class above t; ``other`` if none is.  Later classes win, as a rewrite would."""
    out = F.lit(other)
    for column, name in zip(columns, names):
        out = F.when(F.col(column) > t, F.lit(name)).otherwise(out)
    return out


def hard_prediction(probabilities: ColumnLike) -> tuple[Column, Column]:
    """Index of the first largest entry of a probability array, and that entry."""
    p = as_column(probabilities)
    top = F.array_max(p)
    return (F.array_position(p, top) - 1).cast("int"), top


# --- codes -----------------------------------------------------------------------


def tract_code(c: ColumnLike) -> Column:
    """Whole-number text of a tract code, with the leading zero put back at 10 digits."""
    text = as_column(c).cast("double").cast("bigint").cast("string")
    return F.when(F.length(text) == 10, F.concat(F.lit("0"), text)).otherwise(text)


def county_of(c: ColumnLike) -> Column:
    """Digits 3 to 5 of a tract code."""
    return F.substring(as_column(c), 3, 3)


# --- dates -----------------------------------------------------------------------


def add_days(start: ColumnLike, days: ColumnLike) -> Column:
    """Date plus days; a fractional number of days is truncated."""
    return F.date_add(as_column(start), as_column(days).cast("int"))


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    return F.datediff(as_column(later), as_column(earlier))


def overlaps(start: ColumnLike, days: ColumnLike, first: dt.date, last: dt.date) -> Column:
    """Does [start, start + days - 1] touch [first, last]?"""
    return (as_column(start) <= F.lit(last)) & (add_days(start, number(days) - 1) >= F.lit(first))


# --- seeded hashing in place of a random generator ----------------------------------


def row_hash(*columns: ColumnLike, seed: int = 0) -> Column:
    """A whole number in [0, 2^60): the first 15 hex digits of the MD5 of ``column:...:seed``.

    Any engine with MD5 gives the same, so splits and samples can be checked row by row.
    """
    text = F.concat_ws(":", *[as_column(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def unit_hash(*columns: ColumnLike, seed: int = 0) -> Column:
    """Uniform double in [0, 1), fixed by the columns and the seed."""
    return F.shiftright(row_hash(*columns, seed=seed), 7).cast("double") / F.lit(float(1 << 53))


def random_benchmark(df: DataFrame, key: str, seed: int = 42, name: str = "random_value") -> DataFrame:
    """A whole number in [0, 100) per row that carries no signal."""
    return df.withColumn(name, F.pmod(row_hash(key, seed=seed), F.lit(100)).cast("int"))


# --- column choice from the schema ---------------------------------------------------

_KINDS = {
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "text": (T.StringType,),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def columns_of(df: DataFrame, kind: str, exclude: Iterable[str] = ()) -> list[str]:
    """Column names by kind: ``number``, ``text`` or ``date``."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _KINDS[kind]) and f.name not in skip]


def select_by_name(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), always: Sequence[str] = ()) -> DataFrame:
    """Columns whose name holds one of ``include`` (all if empty) and none of ``exclude``."""
    keep = [
        c
        for c in df.columns
        if c in always
        or ((not include or any(p in c for p in include)) and not any(p in c for p in exclude))
    ]
    return df.select(*keep)
