"""Global order statistics with no single-task stage.

A window without partition keys would run in one task.  Here the rows are range-partitioned
and sorted once, numbered inside their partition, and written out; the per-partition totals
(one small row each) then shift the numbers into a global order.  Ties are split by listing
a unique column last in the order, so one frequent value cannot fill a single partition.

Functions in this module run actions: the range sort is stored before it is read twice,
since a second run of the sampling could draw other partition bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.scalar import row_hash
from cohortry.session import materialize

_IDX = "_idx"
_PART = "_part"
_POS_MASK = (1 << 33) - 1


@dataclass(frozen=True)
class Ranked:
    """Rows with their global 1-based rank, and the number of rows."""

    rows: DataFrame
    total: int


def _ordered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    # monotonically_increasing_id holds the partition in its upper bits and the row's
    # position within the sorted partition in its lower 33 bits.
    return materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_IDX, F.monotonically_increasing_id())
    )


def _part() -> Column:
    return F.shiftright(F.col(_IDX), 33)


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> Ranked:
    """Number all rows 1..n in the given order.  The order should end in a unique column."""
    rows = _ordered(df, order)
    sizes = rows.groupBy(_part().alias(_PART)).agg(F.count("*").alias("_n")).collect()
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r[_PART]):  # one row per partition
        starts.append((r[_PART], total))
        total += r["_n"]
    offsets = df.sparkSession.createDataFrame(starts, f"{_PART} long, _start long")
    ranked = (
        rows.withColumn(_PART, _part())
        .join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("_start") + F.col(_IDX).bitwiseAND(F.lit(_POS_MASK)) + 1)
        .drop(_PART, _IDX, "_start")
    )
    return Ranked(ranked, total)


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Row number inside each group.  A group may span many partitions.

    One global order over (groups, order); the group's first rank is then taken off.
    """
    ranked = global_rank(df, [*groups, *order], "_rank").rows
    first = materialize(ranked.groupBy(*groups).agg((F.min("_rank") - 1).alias("_before")))
    return (
        ranked.join(first, list(groups))
        .withColumn(name, F.col("_rank") - F.col("_before"))
        .drop("_rank", "_before")
    )


def running_totals(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str], groups: Sequence[str] = (), peeks: Sequence[str] = ()) -> DataFrame:
    """Inclusive running totals of whole-number columns over a global order.

    ``sums`` maps output names to input columns.  With ``groups`` the totals restart in each
    group; a group may span many partitions.  For each column in ``peeks`` the value of the
    next row in the order is added as ``next_<column>`` (not with ``groups``).
    """
    rows = _ordered(df, [*groups, *order])
    return _cumulate(rows, sums, groups, peeks)


def _cumulate(rows: DataFrame, sums: dict[str, str], groups: Sequence[str] = (), peeks: Sequence[str] = ()) -> DataFrame:
    names = [f"_t{i}" for i in range(len(sums))]
    # Groups are contiguous: at most (partitions + groups) rows here, one row per partition below.
    per_group = rows.groupBy(_part().alias(_PART), *groups).agg(
        *[F.sum(c).alias(n) for n, c in zip(names, sums.values())], F.min(_IDX).alias("_from"),
        *([F.min_by(F.struct(*peeks), _IDX).alias("_head")] if peeks else []),
    )
    tag = F.struct(*groups) if groups else F.lit(0)
    totals = per_group.groupBy(_PART).agg(
        F.min_by(tag, "_from").alias("_first"), F.max_by(tag, "_from").alias("_last"), F.count("*").alias("_groups"),
        *[F.max_by(n, "_from").alias(n) for n in names], *([F.min_by("_head", "_from").alias("_head")] if peeks else []),
    ).collect()
    totals.sort(key=lambda r: r[_PART])
    table, carry, last = [], [0] * len(names), None
    for i, r in enumerate(totals):
        # what the group at the start of this partition already had in earlier ones
        carry = carry if last is not None and last == r["_first"] else [0] * len(names)
        after = totals[i + 1]["_head"] if peeks and i + 1 < len(totals) else None
        table.append((r[_PART], *carry, *[None if after is None else after[p] for p in peeks], *(r["_first"] if groups else ())))
        carry = [a + r[n] if r["_groups"] == 1 else r[n] for a, n in zip(carry, names)]
        last = r["_last"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"{_PART} long" + "".join(f", {n} long" for n in names)
    schema += "".join(f", _after_{p} {types[p]}" for p in peeks) + "".join(f", _first_{i} {types[g]}" for i, g in enumerate(groups))
    offsets = rows.sparkSession.createDataFrame(table, schema)

    in_part = Window.partitionBy(_PART, *groups).orderBy(_IDX)
    upto = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leading = F.lit(True)
    for i, g in enumerate(groups):
        leading = leading & F.col(g).eqNullSafe(F.col(f"_first_{i}"))
    out = rows.withColumn(_PART, _part()).join(F.broadcast(offsets), _PART)
    out = out.withColumns(
        {o: F.sum(c).over(upto) + F.when(leading, F.col(n)).otherwise(F.lit(0)) for (o, c), n in zip(sums.items(), names)}
        | {f"next_{p}": F.coalesce(F.lead(p).over(in_part), F.col(f"_after_{p}")) for p in peeks}
    )
    return out.drop(_PART, _IDX, *names, *[f"_after_{p}" for p in peeks], *[f"_first_{i}" for i in range(len(groups))])


def tile_of(rank: Column, total: int, tiles: int) -> Column:
    """Tile number as NTILE gives it: the first ``total % tiles`` tiles hold one more row."""
    base, extra = divmod(total, tiles)
    if base == 0:
        return rank.cast("bigint")
    large = extra * (base + 1)
    small = F.expr("bigint(0)") + extra + 1 + F.floor((rank - 1 - large) / base)
    return F.when(rank <= large, F.floor((rank - 1) / (base + 1)) + 1).otherwise(small).cast("bigint")


#: Size of a quantile sketch, and a share of the rows that exceeds its error in rank.
_SKETCH, _MARGIN = 65535, 0.0003


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _sketched(value: Column) -> Column:
    # sketches pass over NaN, which is larger than every number here
    return F.nanvl(value.cast("double"), F.lit(float("inf")))


def last_ranks(total: int, tiles: int) -> list[int]:
    """The rank of the last row of each tile, as NTILE deals them."""
    base, extra = divmod(total, tiles)
    return [t * base + min(t, extra) for t in range(1, tiles + 1)]


def _placed(df: DataFrame, column: Column, edges: Sequence[float], name: str) -> DataFrame:
    """How many of the edges (rising, none of them NaN) are less than the column; NULL for a NULL."""
    splits = [float(np.nextafter(e, np.inf)) for e in edges if e < float("inf")]
    if not splits:
        return df.withColumn(name, F.when(column.isNotNull(), 0))
    splits = [float("-inf"), *splits, float("inf")]
    if splits[1] == float("-inf") or splits[-2] == float("inf"):
        return df.withColumn(name, F.when(column.isNotNull(), F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < column))))
    look_up = Bucketizer(splits=splits, inputCol=f"{name}_in", outputCol=name, handleInvalid="keep")
    out = look_up.transform(df.withColumn(f"{name}_in", F.coalesce(column, F.lit(0.0))))
    return out.withColumn(name, F.when(column.isNotNull(), F.col(name).cast("int"))).drop(f"{name}_in")


#: Groups of equal values with more rows are narrowed by a sketch of their keys before any is sorted.
_TIES = 100_000


def _sorted_at(rows: DataFrame, groups: Sequence[str], wanted: list[tuple], schema: str) -> list[tuple[int, int, object]]:
    """(g, at, key) of the rows at rank ``_r`` by key in the groups; ``wanted`` holds the groups, ``_r``, g and at."""
    spark = rows.sparkSession
    want = F.broadcast(spark.createDataFrame(wanted, schema + ", _r long, _g int, _at long"))
    ranked = rank_within(rows, groups, [F.col("key").asc_nulls_first()], "_r")
    return [(r["_g"], r["_at"], r["key"]) for r in ranked.join(want, [*groups, "_r"]).select("_g", "_at", "key").collect()]


def _keys_at(rows: DataFrame, wanted: dict[int, set[int]], sizes: dict[int, int]) -> dict[tuple[int, int], object]:
    """The key at each wanted rank of each group ``g`` of rows (g, key), by key, NULLs first.

    Of large groups a sketch of the keys brackets those at the ranks, as in ``rows_at``; where a
    bracket proves too narrow the group is sorted.
    """
    spark, out = rows.sparkSession, []
    large = [g for g in wanted if sizes[g] > _TIES] if _numeric(rows.schema["key"].dataType) else []
    direct = [g for g in wanted if g not in large]
    if large:
        value = _sketched(F.col("key"))
        mine = rows.where(F.col("g").isin(large))
        sums = materialize(mine.groupBy("g").agg(F.count("key").alias("f"), F.kll_sketch_agg_double(value, F.lit(_SKETCH)).alias("s")))
        known, ends = {r["g"]: r["f"] for r in sums.select("g", "f").collect()}, {}
        for g in large:
            at = [(r - (sizes[g] - known[g])) / known[g] for r in sorted(wanted[g]) if r > sizes[g] - known[g]]
            ends[g] = [min(1.0, max(0.0, x + d)) for x in at for d in (-_MARGIN, _MARGIN)]
        # ranks must be literals: one column a group, all in one job
        asked = [F.max(F.when(F.col("g") == g, F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(x) for x in ends[g]])))).alias(f"q{g}") for g in large if ends[g]]
        row = sums.agg(F.count("*"), *asked).first().asDict()
        table = []
        for g in large:
            some = row.get(f"q{g}") or []
            spans: list[list[float]] = []
            for low, high in sorted(zip(some[::2], some[1::2])):
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(high, spans[-1][1])
                else:
                    spans.append([low, high])
            table.append((g, [x for x, _ in spans], [x for _, x in spans]))
        spans_of = F.broadcast(spark.createDataFrame(table, "g int, lows array<double>, highs array<double>"))
        place = F.size(F.filter("highs", lambda h: h < value))
        inside = F.coalesce(F.get("lows", place) <= value, F.lit(False))
        coded = mine.join(spans_of, "g").select("g", F.when(F.col("key").isNull(), -1).otherwise(2 * place + inside.cast("int")).alias("code"), "key")
        counts = {(r["g"], r["code"]): r["n"] for r in coded.groupBy("g", "code").agg(F.count("*").alias("n")).collect()}
        picks = []
        for g in large:
            below, found = 0, []
            for code in sorted(c for h, c in counts if h == g):
                found += [(g, code, at - below, g, at) for at in sorted(wanted[g]) if below < at <= below + counts[g, code]]
                below += counts[g, code]
            if any(code >= 0 and code % 2 == 0 for _, code, *_ in found):
                direct.append(g)
            else:
                picks += found
        if picks:
            chosen = coded.join(F.broadcast(spark.createDataFrame(sorted({(g, c) for g, c, *_ in picks}), "g int, code int")), ["g", "code"])
            out += _sorted_at(chosen, ["g", "code"], picks, "g int, code int")
    if direct:
        out += _sorted_at(rows.where(F.col("g").isin(direct)), ["g"], [(g, at, g, at) for g in direct for at in wanted[g]], "g int")
    return {(g, at): key for g, at, key in out}


def rows_at(df: DataFrame, columns: Sequence[str], key: str, ranks: Callable[[int], Sequence[int]]) -> tuple[int, dict[str, dict[int, tuple] | None]]:
    """The number of rows n, and per column the (value, key) at each rank of ``ranks(n)``, in order of
    value (NULLs first), then key.

    Exact, without sorting the table: quantile sketches of all columns, from one pass, bracket the
    values at those ranks; a second pass counts the rows between the brackets and, by value, those
    inside, which gives the value at each rank; among many rows equal to it, the keys are bracketed in
    the same way (two passes more), and only those inside are sorted.  A bracket that proves too narrow is widened.  A
    column is None if equal pairs of value and key lie on both sides of a rank.  All columns must be
    of one numeric type.  The table is read twice or more: store it if it is costly.  Runs actions.
    """
    spark = df.sparkSession
    sums = df.agg(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("f", F.count), ("s", lambda x: F.kll_sketch_agg_double(_sketched(x), F.lit(_SKETCH))))])
    sums = materialize(sums)
    head = sums.drop(*[f"s{i}" for i in range(len(columns))]).first()
    total = head["n"]
    wanted = sorted({r for r in ranks(total) if 1 <= r <= total})
    if not wanted:
        return total, {c: {} for c in columns}
    kind = df.schema[columns[0]].dataType.simpleString()
    margin, out, left = _MARGIN, {}, list(range(len(columns)))
    while left:
        spans = {}
        for i in left:
            some = head[f"f{i}"]
            at = [(r - (total - some)) / some for r in wanted if r > total - some]
            if at:
                quantile = lambda x, i=i: F.kll_sketch_get_quantile_double(f"s{i}", F.lit(x))
                row = sums.select(*[quantile(min(1.0, max(0.0, x + d))) for x in at for d in (-margin, margin)]).first()
                pairs = sorted(zip(row[::2], row[1::2]))
                if margin >= 1:
                    pairs = [(float("-inf"), float("inf"))]
                spans[i] = []
                for low, high in pairs:
                    if spans[i] and low <= spans[i][-1][1]:
                        spans[i][-1] = (spans[i][-1][0], max(high, spans[i][-1][1]))
                    else:
                        spans[i].append((low, high))
            else:
                spans[i] = []
        parts, placed = [], df.select(*[F.col(columns[i]).alias(f"v{i}") for i in left])
        for i in left:
            value, place = _sketched(F.col(f"v{i}")), F.col(f"p{i}")
            placed = _placed(placed, value, [x[1] for x in spans[i]], f"p{i}")
            lows = F.array(*[F.lit(x[0]).cast("double") for x in spans[i]])
            inside = F.coalesce(F.get(lows, place) <= value, F.lit(False))
            code = F.when(F.col(f"v{i}").isNull(), -1).otherwise(2 * place + inside.cast("int"))
            parts.append(F.struct(F.lit(i).alias("c"), code.alias("code"), F.col(f"v{i}").cast(kind).alias("value")))
        long = placed.select(F.explode(F.array(*parts)).alias("_x")).select("_x.*")
        within = F.when(F.pmod("code", F.lit(2)) == 1, F.col("value"))  # NULLs have code -1
        values = materialize(long.groupBy("c", "code", within.alias("value")).agg(F.count("*").alias("n")))
        counts = {(r["c"], r["code"]): r["n"] for r in values.groupBy("c", "code").agg(F.sum("n").alias("n")).collect()}
        picks, failed = [], []
        for i in left:
            below, mine = 0, []
            for code in sorted(k for c, k in counts if c == i):
                mine += [(i, code, r - below, r) for r in wanted if below < r <= below + counts[i, code]]
                below += counts[i, code]
            if any(code >= 0 and code % 2 == 0 for _, code, _, _ in mine):
                failed.append(i)
            else:
                picks += mine
        if picks:
            codes = {(c, code) for c, code, _, _ in picks}
            some = values.join(F.broadcast(spark.createDataFrame(list(codes), "c int, code int")), ["c", "code"])
            run = running_totals(some, [F.col("value").asc_nulls_first()], {"_upto": "n"}, ["c", "code"])
            # the row after as well: it must differ
            near = spark.createDataFrame([(c, code, at + d, r + d / 2) for c, code, at, r in picks for d in (0, 1)], "c2 int, code2 int, _r long, rank double")
            here = (F.col("c") == F.col("c2")) & (F.col("code") == F.col("code2")) & (F.col("_r") <= F.col("_upto")) & (F.col("_r") > F.col("_upto") - F.col("n"))
            hits = run.join(F.broadcast(near), here).select("c", "rank", "value", "n", (F.col("_r") - F.col("_upto") + F.col("n")).alias("at")).collect()
            group: dict[tuple, int] = {}
            wanted_keys, sizes = {}, {}
            for h in hits:
                g = group.setdefault((h["c"], str(h["value"])), len(group))
                wanted_keys.setdefault(g, set()).add(h["at"])
                sizes[g] = h["n"]
            alike = {g: v for h in hits for v, g in [((h["c"], h["value"]), group[h["c"], str(h["value"])])]}
            table = spark.createDataFrame([(c, g, v) for g, (c, v) in alike.items()], f"c2 int, g int, value2 {kind}")
            equal = (F.col("c") == F.col("c2")) & F.col("value").eqNullSafe(F.col("value2"))
            plain = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(columns[i]).cast(kind).alias("value")) for i in left])).alias("_x")
            ties = df.select(F.col(key).alias("key"), plain).select("key", "_x.*")
            keys = _keys_at(ties.join(F.broadcast(table), equal).select("g", "key"), wanted_keys, sizes)
            rows = {(h["c"], h["rank"]): (h["value"], keys[group[h["c"], str(h["value"])], h["at"]]) for h in hits}
            for i in left:
                mine = [(r, rows[i, float(r)], rows.get((i, r + 0.5))) for c, _, _, r in picks if c == i]
                if mine:
                    same = any(after is not None and after == pair for _, pair, after in mine)
                    out[columns[i]] = None if same else {r: pair for r, pair, _ in mine}
        left, margin = failed, margin * 8
    return total, out


def _tiled(df: DataFrame, column: str, key: str, edges: list[tuple], kinds: dict[str, T.DataType], name: str) -> DataFrame:
    """1 + the number of edges (value, key; rising, NULLs first) before each row."""
    value, known = F.col(column), [e for e in edges if e[0] is not None]
    by_double = isinstance(kinds[column], (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType))
    if not by_double or not all(np.isfinite(float(v)) for v, _ in known):
        pair = F.struct(value.alias("v"), F.col(key).alias("k"))
        lits = [F.struct(F.lit(v).cast(kinds[column]).alias("v"), F.lit(k).cast(kinds[key]).alias("k")) for v, k in edges]
        # structs compare field by field, NULLs first
        before = F.size(F.filter(F.array(*lits), lambda e: e < F.col("_pair"))) if lits else F.lit(0)
        return df.withColumn("_pair", pair).withColumn(name, (before + 1).cast("bigint")).drop("_pair")
    keys: dict[float, list] = {}
    for v, k in known:
        keys.setdefault(float(v), []).append(k)
    values, kind = sorted(keys), kinds[key].simpleString()
    counts = np.cumsum([len(edges) - len(known), *[len(keys[v]) for v in values]]).tolist()
    listed = lambda ks: F.array(*[F.lit(k).cast(kinds[key]) for k in ks]).cast(f"array<{kind}>")
    own = F.get(F.array(*[listed(keys[v]) for v in values], F.array().cast(f"array<{kind}>")), F.col("_place"))
    same = F.get(F.array(*[F.lit(v) for v in values], F.lit(None).cast("double")), F.col("_place")) == value.cast("double")
    own = F.when(value.isNull(), listed([k for v, k in edges if v is None])).when(same, own)
    # of the edges with the row's own value those count that have a smaller key
    less = F.size(F.filter("_own", lambda e: F.when(e.isNull(), F.col(key).isNotNull()).otherwise(F.coalesce(e < F.col(key), F.lit(False)))))
    before = F.coalesce(F.get(F.array(*[F.lit(n) for n in counts]), F.col("_place")), F.lit(0)) + F.when(F.col("_own").isNull(), 0).otherwise(less)
    out = _placed(df, _sketched(value), values, "_place").withColumn("_own", own)
    return out.withColumn(name, (before + 1).cast("bigint")).drop("_place", "_own")


def tile_columns(df: DataFrame, columns: dict[str, str], key: str, tiles: int = 100) -> DataFrame:
    """NTILE over the whole table for each column (``columns`` maps it to the new name), NULLs first, ties split by ``key``.

    Numeric columns of one type share two passes over the table, and no row is shuffled but those
    near a boundary (see ``rows_at``); every row is then compared with the boundaries.  Columns of
    other types, and those where a boundary falls between equal pairs of value and key, are sorted.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    edges: dict[str, list | None] = {}
    for kind in {kinds[c].simpleString() for c in columns if _numeric(kinds[c])}:
        same = [c for c in columns if kinds[c].simpleString() == kind]
        total, found = rows_at(df, same, key, lambda n: last_ranks(n, tiles)[:-1])
        edges |= {c: None if found[c] is None else [found[c][r] for r in sorted(found[c]) if r < total] for c in same}
    out = df
    for c, name in columns.items():
        if edges.get(c) is None:
            ranked = global_rank(out, [F.col(c).asc_nulls_first(), F.col(key)], "_rank")
            out = ranked.rows.withColumn(name, tile_of(F.col("_rank"), ranked.total, tiles)).drop("_rank")
            continue
        out = _tiled(out, c, key, edges[c], kinds, name)
    return out


def percentile_bucket(df: DataFrame, column: str, key: str, tiles: int = 100, name: str | None = None) -> DataFrame:
    """NTILE over the whole table, NULLs first, ties split by ``key``."""
    return tile_columns(df, {column: name or f"percentile_{column}"}, key, tiles)


def quartiles_by_ntile(df: DataFrame, column: str, key: str) -> DataFrame:
    """Largest value among the first 25, 50 and 75 of 100 tiles, with the rows in them."""
    return quartiles_of(df, [column], key).drop("measure")


def quartiles_of(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``quartiles_by_ntile`` of numeric columns of one type, in two passes: (measure, quartile, n, value)."""
    three = (25, 50, 75)
    total, found = rows_at(df, columns, key, lambda n: [last_ranks(n, 100)[p - 1] for p in three])
    at = [last_ranks(total, 100)[p - 1] for p in three]
    rows = []
    for c in columns:
        # equal pairs on both sides of a rank leave the value there as it is
        pairs = found[c] if found[c] is not None else rows_at(df.select(c, F.monotonically_increasing_id().alias("_id")), [c], "_id", lambda _: at)[1][c]
        rows += [(c, f"Q{i}", r, pairs[r][0] if r else None) for i, r in enumerate(at, 1)]
    kind = df.schema[columns[0]].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"measure string, quartile string, n bigint, value {kind}")


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per group, without holding a group in one task.

    Values are counted first (partial aggregates absorb repeated values), then placed by
    their running count.  Output: groups, ``n``, and ``q0``, ``q1``, ... in the given order.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("_c"))
    rows = _ordered(counts, [*groups, column])
    run = _cumulate(rows, {"_cum": "_c"}, groups)
    if groups:
        n = materialize(rows.groupBy(*groups).agg(F.sum("_c").alias("n")))
        run = run.join(n, list(groups))
    else:
        run = run.withColumn("n", rows.agg(F.sum("_c")).scalar())
    first, last = F.col("_cum") - F.col("_c"), F.col("_cum") - 1
    picks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for end, where in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= where) & (where <= last), F.col(column).cast("double"))).alias(f"_{end}{i}"))
    out = run.groupBy(*groups, "n").agg(*picks)
    values = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("n") - 1)
        values.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))).alias(f"q{i}"))
    return out.select(*groups, "n", *values)


def _narrowed(df: DataFrame, score: Column, descending: bool, k: int) -> DataFrame | None:
    """Rows up to a bound that a quantile sketch puts beyond row k; None if there is none to find.

    One pass.  That k rows lie within the bound is likely, not certain: the caller counts them.
    """
    if not _numeric(df.select(score.alias("_s")).schema[0].dataType):
        return None
    value = _sketched(score)
    sums = materialize(df.agg(F.count(score).alias("n"), F.kll_sketch_agg_double(value, F.lit(_SKETCH)).alias("s")))
    n = sums.select("n").first()["n"]
    if n <= k:
        return None
    at = max(0.0, 1 - k / n - _MARGIN) if descending else min(1.0, k / n + _MARGIN)
    bound = sums.select(F.kll_sketch_get_quantile_double("s", F.lit(at))).first()[0]
    return df.where(value >= bound) if descending else df.where(score.isNull() | (value <= bound))


def _pair_at(df: DataFrame, score: Column, descending: bool, key: str, k: int) -> Row | None:
    """(_s, _k, _n, _upto) of the (score, key) that holds row k; None if there are fewer rows."""
    counts = df.groupBy(score.alias("_s"), F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    order = [F.col("_s").desc_nulls_last() if descending else F.col("_s").asc_nulls_first(), F.col("_k").asc_nulls_first()]
    run = running_totals(counts, order, {"_upto": "_n"}).where(F.col("_upto") >= k)
    return run.agg(F.min_by(F.struct("_s", "_k", "_n", "_upto"), "_upto").alias("last")).first()["last"]


def _first_k(df: DataFrame, score: Column, descending: bool, key: str, k: int) -> DataFrame:
    """Exactly ``min(k, n)`` rows that come first by score, then by key (an action).

    A sketch of the scores bounds the rows to look at, and only the counts of their (score, key) are
    ordered.  The pair that holds row k becomes a literal: rows before it belong, and of the rows equal
    to it as many as are missing.  NULL scores come last when descending and first when not; NULL keys
    come first.
    """
    if k <= 0:
        return df.limit(0)
    narrowed = _narrowed(df, score, descending, k)
    for rows in [df] if narrowed is None else [narrowed, df]:
        last = _pair_at(rows, score, descending, key, k)
        if last is not None:
            break
    if last is None:
        return df
    same_score, same_key = score.eqNullSafe(F.lit(last["_s"])), F.col(key).eqNullSafe(F.lit(last["_k"]))
    if descending:
        earlier = score.isNotNull() if last["_s"] is None else score > F.lit(last["_s"])
    else:
        earlier = F.lit(False) if last["_s"] is None else score.isNull() | (score < F.lit(last["_s"]))
    lower = F.lit(False) if last["_k"] is None else F.col(key).isNull() | (F.col(key) < F.lit(last["_k"]))
    before = F.coalesce(earlier, F.lit(False)) | (same_score & F.coalesce(lower, F.lit(False)))
    missing = k - (last["_upto"] - last["_n"])
    if missing == last["_n"]:
        return df.where(before | (same_score & same_key))
    tied = df.where(same_score & same_key).withColumn("_tie", F.monotonically_increasing_id())
    ranked = global_rank(tied, [F.xxhash64(*df.columns), F.col("_tie")], "_rank").rows
    return df.where(before).unionByName(ranked.where(F.col("_rank") <= missing).select(*df.columns))


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows with the largest score, listed in order; on ties the smaller key comes first.

    All rows if there are fewer; NULL scores come last.  Repeated keys count as rows of their own.
    The table is filtered, so no task receives the k rows, and rows outside them are not shuffled.
    """
    chosen = _first_k(df, F.col(score), True, key, k)
    return chosen.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc_nulls_first())


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (all rows if fewer), chosen by a seeded hash of the row key."""
    return _first_k(df, row_hash(key, seed=seed), False, key, n)


def top_abs(df: DataFrame, column: str, n: int, groups: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """Per group the n rows largest in absolute value, listed from lowest to highest value.

    Of equal absolute values the negative one comes first, then the smaller ``key``; without a key it
    is open which of several equal rows stay.  The ``rank <= n`` filter is applied before the shuffle
    as well, so each task sends at most n rows per group.
    """
    ties = [F.col(key).asc_nulls_first()] if key else []
    by = [F.abs(column).desc(), F.col(column), *ties]
    if not groups:
        return df.orderBy(*by).limit(n).orderBy(column, *ties)
    w = Window.partitionBy(*groups).orderBy(*by)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r").orderBy(*groups, column, *ties)
