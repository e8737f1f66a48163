"""Daily polypharmacy possession ratio (DPPR) and the review queries around it.

Claims: ``member_id, code, service_date, days_supply, quantity, paid_amount, claim_status,
lob``.  Crosswalk: ``class_id, code``.  Refills: ``member_id, class_id, service_date,
days_supply`` with one row per member, class and date.

``dppr`` is the fused form.  The stage functions give each intermediate table on its own.

Size of a member: after ``dedupe_refills`` a member has at most (classes x days) rows,
whatever the number of claims, so the per-member windows are bounded by the calendar and
the crosswalk.  The de-duplication combines before its shuffle and shuffles on (member,
class, date); a member with a third of all claims is therefore reduced where the claims lie.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scalar import days_between, flag, neg_part, number, overlaps, pos_part
from cohortry.operators.profile import iqr_outliers
from cohortry.operators.ranking import global_rank, quartiles_of, tile_columns, tile_of
from cohortry.operators.relational import having_count, in_population, union_distinct
from cohortry.operators.windows import carry_forward as carry
from cohortry.operators.windows import dense_number, next_event, running_sum
from cohortry.plans.presets import COMPLIANT_AT, MIN_FILLS, PAID_STATUS
from cohortry.session import materialize

KEY = ["member_id", "class_id"]


@dataclass(frozen=True)
class ObservationWindow:
    predicted_on: dt.date
    first: dt.date
    last: dt.date


def obs_window(predicted_on: dt.date, days: int) -> ObservationWindow:
    """The ``days`` days that end the day before the prediction date."""
    last = predicted_on - dt.timedelta(days=1)
    return ObservationWindow(predicted_on, last + dt.timedelta(days=1 - days), last)


# --- refills -----------------------------------------------------------------------


def eligible_claims(claims: DataFrame, window: ObservationWindow | None = None, lobs: Sequence[str] | None = None, statuses: Sequence[str] = PAID_STATUS) -> DataFrame:
    """Paid claims with supply and quantity whose supply days touch the window.

    A missing status counts as paid; ``lobs=None`` takes every line of business.
    """
    keep = (F.col("claim_status").isin(*statuses) | F.col("claim_status").isNull()) & (F.col("paid_amount") >= 0)
    keep = keep & (number("days_supply") > 0) & (number("quantity") > 0)
    if lobs is not None:
        keep = keep & F.col("lob").isin(*lobs)
    if window is not None:
        keep = keep & overlaps("service_date", "days_supply", window.first, window.last)
    return claims.where(keep)


def classify(claims: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Claims with the therapy class of their code."""
    return claims.join(crosswalk, "code")


def dedupe_refills(classified: DataFrame) -> DataFrame:
    """Largest supply per member, class and date."""
    return classified.groupBy(*KEY, "service_date").agg(F.max(number("days_supply")).alias("days_supply"))


def _tagged(crosswalks: Sequence[DataFrame]) -> DataFrame:
    """All trees under each other, numbered."""
    return reduce(DataFrame.unionByName, [x.select("class_id", "code", F.lit(i).alias("_tree")) for i, x in enumerate(crosswalks)])


def refills_of(claims: DataFrame, crosswalks: Sequence[DataFrame]) -> DataFrame:
    """Refills of one or several therapy trees, duplicates removed.

    The trees are tagged and joined in one pass over the claims.  A class should be in one
    tree only: a class in two trees keeps one row per differing supply.
    """
    if len(crosswalks) == 1:
        return dedupe_refills(classify(claims, crosswalks[0].select("class_id", "code")))
    best = [F.max(F.when(F.col("_tree") == i, number("days_supply"))).alias(f"_b{i}") for i in range(len(crosswalks))]
    per_day = classify(claims, _tagged(crosswalks)).groupBy(*KEY, "service_date").agg(*best)
    values = F.array_distinct(F.array_compact(F.array(*[F.col(f"_b{i}") for i in range(len(crosswalks))])))
    return per_day.select(*KEY, "service_date", F.explode(values).alias("days_supply"))


def thin_groups(refills: DataFrame, min_fills: int = MIN_FILLS) -> DataFrame:
    """(member, class) groups with fewer refills than ``min_fills``."""
    return having_count(refills, KEY, fewer_than=min_fills, name="n_fills")


def drop_thin_members(refills: DataFrame, min_fills: int = MIN_FILLS) -> DataFrame:
    """Refills of members without any thin group: one thin group removes the whole member."""
    return refills.join(thin_groups(refills, min_fills).select("member_id").distinct(), "member_id", "left_anti")


# --- periods -----------------------------------------------------------------------


def first_refill(refills: DataFrame) -> DataFrame:
    return refills.groupBy(*KEY).agg(F.min("service_date").alias("first_date"))


def periods(first: DataFrame, end: dt.date) -> DataFrame:
    """A period starts at every distinct first-refill date of the member, and ends at the next."""
    numbered = dense_number(first, ["member_id"], "first_date", "period").select("member_id", "period", F.col("first_date").alias("period_start")).distinct()
    return next_event(numbered, ["member_id"], "period_start", F.lit(end), "next_period_start")


def dummy_refills(refills: DataFrame, end: dt.date) -> DataFrame:
    """A refill of zero supply for each class at each later period start without a refill."""
    first = first_refill(refills)
    starts = periods(first, end).select("member_id", "period_start")
    wanted = (
        first.join(starts, "member_id").where(F.col("first_date") < F.col("period_start"))
        .select(*KEY, F.col("period_start").alias("service_date"), F.lit(0.0).alias("days_supply"))
    )
    return wanted.join(refills.select(*KEY, "service_date"), [*KEY, "service_date"], "left_anti")


def with_dummies(refills: DataFrame, end: dt.date) -> DataFrame:
    """Refills and dummy refills, numbered by date within (member, class)."""
    both = union_distinct(refills, dummy_refills(refills, end))
    return dense_number(both, KEY, "service_date", "supply_rank")


def next_supply(timeline: DataFrame, end: dt.date) -> DataFrame:
    """Date of the next refill (or the end), days until it, and days not covered by supply."""
    out = next_event(timeline, KEY, "service_date", F.lit(end), "next_date")
    out = out.withColumn("time_to_next", days_between("next_date", "service_date"))
    return out.withColumn("diff", F.col("time_to_next") - F.col("days_supply"))


def assign_period(timeline: DataFrame, period_table: DataFrame) -> DataFrame:
    """Period that holds each refill date (range join within the member)."""
    p = period_table.select(F.col("member_id").alias("_m"), "period", "period_start", "next_period_start")
    hit = (F.col("member_id") == F.col("_m")) & (F.col("service_date") >= F.col("period_start")) & (F.col("service_date") < F.col("next_period_start"))
    return timeline.join(p, hit, "left").drop("_m", "period_start", "next_period_start")


def gaps_and_surplus(timeline: DataFrame) -> DataFrame:
    """Uncovered days and over-supply of each refill by itself."""
    return timeline.withColumns({"days_not_on_drug": pos_part("diff"), "over_supply": neg_part("diff")})


def carry_forward(timeline: DataFrame) -> DataFrame:
    """Over-supply carried to the next refill of the class, and the gap that remains."""
    return carry(timeline.withColumn("_x", -F.col("diff")), KEY, "service_date", "_x").drop("_x")


def cumulate(timeline: DataFrame) -> DataFrame:
    """Running gap and running days within (member, class, period)."""
    return running_sum(timeline, [*KEY, "period"], "service_date", {"cum_act_dnod_period": "act_dnod", "cum_days_period": "time_to_next"})


# --- the ratio ---------------------------------------------------------------------


def observation_span(timeline: DataFrame, end: dt.date) -> DataFrame:
    """Days from a member's first refill to the end.

    Supply bought before the window counts, so the span can exceed the window.
    """
    return timeline.groupBy("member_id").agg(F.min("service_date").alias("_first")).select(
        "member_id", days_between(F.lit(end), "_first").alias("observation_days")
    )


def period_stats(timeline: DataFrame) -> DataFrame:
    """Per member and period: classes, days, and summed gaps.

    Running totals of non-negative values end at their sum, so plain sums are taken.
    """
    per_class = timeline.groupBy("member_id", "period", "class_id").agg(
        F.sum("act_dnod").alias("_gap"), F.sum("time_to_next").alias("_days"), F.min("service_date").alias("_first")
    )
    return per_class.groupBy("member_id", "period").agg(
        F.count("class_id").alias("n_classes"), F.max("_days").alias("period_days"), F.sum("_gap").alias("gap_days"), F.min("_first").alias("_first")
    )


def ratio_of(stats: DataFrame, end: dt.date) -> DataFrame:
    covered = F.col("period_days") - F.col("gap_days") / F.col("n_classes")
    out = stats.withColumn("_covered", covered).groupBy("member_id").agg(F.sum("_covered").alias("_covered"), F.min("_first").alias("_first"))
    return out.select("member_id", (F.col("_covered") / days_between(F.lit(end), "_first") * 100).alias("dppr"))


def covered_timeline(refills: DataFrame, end: dt.date, min_fills: int = MIN_FILLS) -> DataFrame:
    """All stages from refills to remaining gaps with a single shuffle, on the member.

    A dummy refill is a period start that falls strictly between two refills of a class, so
    every refill row makes its own dummies: the row is cut at those starts.  This needs no
    self-join, no union and no anti-join, and all windows share the member partitioning.
    """
    by_class = Window.partitionBy(*KEY)
    by_member = Window.partitionBy("member_id")
    stop = F.coalesce(F.col("_next"), F.lit(end))
    # member_id alone is the shuffle key: every window and aggregate below contains it
    r = refills.repartition("member_id").withColumns({
        "_next": F.lead("service_date").over(by_class.orderBy("service_date")),
        "_first": F.min("service_date").over(by_class),
        "_fills": F.count("*").over(by_class),
    })
    r = r.withColumns({"_starts": F.collect_set("_first").over(by_member), "_least": F.min("_fills").over(by_member)})
    r = r.where(F.col("_least") >= min_fills)
    cuts = F.array_sort(F.filter("_starts", lambda s: (s > F.col("service_date")) & (s < stop)))
    pieces = F.concat(F.array("service_date"), cuts)
    r = r.select(*KEY, "days_supply", "_starts", stop.alias("_stop"), pieces.alias("_pieces"))
    r = r.select(*KEY, "days_supply", "_starts", "_stop", "_pieces", F.posexplode("_pieces").alias("_i", "service_date"))
    r = r.select(
        *KEY, "service_date",
        F.when(F.col("_i") == 0, F.col("days_supply")).otherwise(F.lit(0.0)).alias("days_supply"),
        F.coalesce(F.get("_pieces", F.col("_i") + 1), F.col("_stop")).alias("next_date"),
        F.size(F.filter("_starts", lambda s: s <= F.col("service_date"))).cast("bigint").alias("period"),
    )
    r = r.withColumn("time_to_next", days_between("next_date", "service_date"))
    r = r.withColumn("diff", F.col("time_to_next") - F.col("days_supply"))
    return carry_forward(r)


def dppr(claims: DataFrame, crosswalks: Sequence[DataFrame], predicted_on: dt.date, days: int = 365, lobs: Sequence[str] | None = None, statuses: Sequence[str] = PAID_STATUS, min_fills: int = MIN_FILLS) -> DataFrame:
    """Adherence in percent per member: (member_id, dppr).

    Two shuffles: the de-duplication on (member, class, date), then the member.
    """
    window = obs_window(predicted_on, days)
    refills = refills_of(eligible_claims(claims, window, lobs, statuses), crosswalks)
    timeline = covered_timeline(refills, predicted_on, min_fills)
    return ratio_of(period_stats(timeline), predicted_on)


def dppr_by_stages(refills: DataFrame, end: dt.date, min_fills: int = MIN_FILLS) -> DataFrame:
    """The same ratio through every intermediate table."""
    kept = drop_thin_members(refills, min_fills)
    timeline = next_supply(with_dummies(kept, end), end)
    timeline = assign_period(timeline, periods(first_refill(kept), end))
    return ratio_of(period_stats(carry_forward(timeline)), end)


def compliance(ratios: DataFrame, at: float = COMPLIANT_AT) -> DataFrame:
    """1 from the cut on; compared at 9 digits, below which only the order of addition shows."""
    return ratios.withColumn("compliant", flag(F.round("dppr", 9) >= at))


# --- comparison with other measures -------------------------------------------------


def compare_measures(ratios: DataFrame, others: DataFrame) -> DataFrame:
    """Members of both tables with the differences between the measures."""
    return ratios.join(others, "member_id").withColumns({
        "diff_mpr_dppr": F.col("mpr") - F.col("dppr"),
        "diff_mpr_mprm": F.col("mpr") - F.col("mprm"),
        "diff_mprm_dppr": F.col("mprm") - F.col("dppr"),
    })


def with_percentiles(measures: DataFrame, columns: Sequence[str] = ("dppr", "mpr", "mprm"), key: str = "member_id") -> DataFrame:
    """Percentile bucket (1-100) of each measure over all members."""
    # read for the sketches, the counts and the result
    return tile_columns(materialize(measures), {c: f"percentile_{c}" for c in columns}, key)


def measure_summary(measures: DataFrame, columns: Sequence[str] = ("dppr", "mpr", "mprm")) -> DataFrame:
    """Minimum, maximum and mean of each measure: (measure, min, max, avg)."""
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    pieces = ", ".join(f"'{c}', min_{c}, max_{c}, avg_{c}" for c in columns)
    return measures.agg(*aggs).select(F.expr(f"stack({len(columns)}, {pieces}) as (measure, min, max, avg)"))


def measure_quartiles(measures: DataFrame, columns: Sequence[str] = ("dppr", "mpr", "mprm"), key: str = "member_id") -> DataFrame:
    return quartiles_of(materialize(measures.select(key, *columns)), columns, key)


def agreement_at(measures: DataFrame, reference: str, others: Sequence[str], cuts: Sequence[float] = (80, 50)) -> DataFrame:
    """Members each measure puts below or above a cut where the reference measure disagrees.

    All cuts and measures in one pass: (measure, cut, n_below, missed, n_above, overcalled,
    n_compliant).
    """
    a = F.col(reference)
    aggs, pieces = [], []
    for i, m in enumerate(others):
        for j, c in enumerate(cuts):
            b = F.col(m)
            names = [f"{x}{i}_{j}" for x in ("lo", "fn", "hi", "fp", "ok")]
            conditions = [a < c, (a < c) & (b >= c), a >= c, (a >= c) & (b < c), b >= c]
            aggs += [F.count_if(cond).alias(n) for cond, n in zip(conditions, names)]
            pieces.append(f"'{m}', {float(c)}D, " + ", ".join(names))
    return measures.agg(*aggs).select(
        F.expr(f"stack({len(pieces)}, {', '.join(pieces)}) as (measure, cut, n_below, missed, n_above, overcalled, n_compliant)")
    )


# --- outlier review ------------------------------------------------------------------


def gap_distribution(timeline: DataFrame) -> DataFrame:
    """Refills with the percentile bucket of their gap (ties by member, class, date)."""
    ranked = global_rank(timeline, [F.col("diff").asc_nulls_first(), *KEY, "service_date"], "_rank")
    return ranked.rows.withColumn("percentile_diff", tile_of(F.col("_rank"), ranked.total, 100)).drop("_rank")


def not_at_end(end: dt.date) -> Column:
    """The next supply date is a refill, not the end of the window."""
    return F.col("next_date") != F.lit(end)


def outlier_members(distribution: DataFrame, end: dt.date, k: float = 1.5) -> DataFrame:
    """Members with an over-supply beyond the lower limit that does not touch the end."""
    negative = distribution.where(F.col("diff") < 0)
    return iqr_outliers(negative, "diff", k, keep=not_at_end(end), side="low").select("member_id").distinct()


def outlier_review(distribution: DataFrame, measures: DataFrame, end: dt.date, k: float = 1.5) -> DataFrame:
    """Outlying refills with the member's adherence measures."""
    negative = distribution.where(F.col("diff") < 0)
    rows = iqr_outliers(negative, "diff", k, keep=not_at_end(end), side="low")
    return rows.join(measures, "member_id")


def review_claims(claims: DataFrame, crosswalks: Sequence[DataFrame], members: DataFrame, window: ObservationWindow, lobs: Sequence[str] | None = None, statuses: Sequence[str] = PAID_STATUS, detail: Sequence[str] = ("claim_id", "line_id")) -> DataFrame:
    """The claim lines of given members, distinct per therapy tree, trees under each other."""
    chosen = in_population(eligible_claims(claims, window, lobs, statuses), members, "member_id")
    return (
        classify(chosen, _tagged(crosswalks))
        .select("_tree", "member_id", *detail, "class_id", "code", "service_date", number("days_supply").alias("days_supply"))
        .distinct().drop("_tree")
    )
