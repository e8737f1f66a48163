"""Literal cases of the possession ratio, and the fused form against the stages and a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators.windows import carry_forward, next_event, previous_value, running_sum
from cohortry.plans import adherence as A

END = dt.date(2001, 1, 1)
WINDOW = A.obs_window(END, 365)
CLAIM = "member_id bigint, code bigint, service_date date, days_supply string, quantity string, paid_amount double, claim_status string, lob string"
REFILL = "member_id bigint, class_id bigint, service_date date, days_supply double"


def day(text):
    return dt.date.fromisoformat(text)


def claim(date, supply="30", status=None, quantity="1", paid=1.0, lob="US"):
    return (1, 1, day(date), supply, quantity, paid, status, lob)


def test_window_is_inclusive_of_both_ends():
    assert (WINDOW.first, WINDOW.last) == (day("2000-01-02"), day("2000-12-31"))


@pytest.mark.parametrize("row, kept", [
    (claim("1999-12-03", "30"), False),  # ends the day before the window
    (claim("1999-12-04", "30"), True),  # ends on its first day
    (claim("2000-12-31"), True),
    (claim("2001-01-01"), False),
    (claim("2000-05-01", status="1"), True),
    (claim("2000-05-01", status="2"), False),
    (claim("2000-05-01", supply="0"), False),
    (claim("2000-05-01", supply="-1"), False),
    (claim("1999-12-03", supply="30.5"), False),  # the added days are truncated
    (claim("1999-12-03", supply="31.5"), True),
    (claim("2000-05-01", supply="x"), False),
    (claim("2000-05-01", quantity="0"), False),
    (claim("2000-05-01", paid=-0.01), False),
    (claim("2000-05-01", lob="ZZ"), False),
    (claim("2000-05-01", lob=None), False),
])
def test_eligibility(spark, row, kept):
    df = spark.createDataFrame([row], CLAIM)
    assert A.eligible_claims(df, WINDOW, lobs=("US", "BH")).count() == int(kept)


def refills(spark, rows):
    return spark.createDataFrame([(m, g, day(d), float(s)) for m, g, d, s in rows], REFILL)


def monthly(member, group, n, start="2000-02-01", supply=30, step=30):
    first = day(start)
    return [(member, group, str(first + dt.timedelta(days=step * i)), supply) for i in range(n)]


def test_one_thin_group_removes_the_member(spark):
    r = refills(spark, monthly(1, 1, 4) + monthly(1, 2, 3) + monthly(2, 1, 4))
    assert {x[0] for x in A.drop_thin_members(r).select("member_id").collect()} == {2}
    assert {x[0] for x in A.ratio_of(A.period_stats(A.covered_timeline(r, END)), END).select("member_id").collect()} == {2}


def test_duplicates_keep_the_largest_supply_and_trees_are_united(spark):
    claims = spark.createDataFrame([(1, c, day("2000-03-01"), s, "1", 1.0, None, "US") for c, s in ((1, "30"), (1, "90"), (2, "60"))], CLAIM)
    one = spark.createDataFrame([(7, 1)], "class_id bigint, code bigint")
    two = spark.createDataFrame([(7, 2), (8, 2)], "class_id bigint, code bigint")
    got = {(r["class_id"], r["days_supply"]) for r in A.refills_of(claims, [one, two]).collect()}
    assert got == {(7, 90.0), (7, 60.0), (8, 60.0)}  # class 7 sits in both trees: both supplies stay
    assert A.refills_of(claims, [one]).collect()[0]["days_supply"] == 90.0


def test_no_dummy_where_a_refill_exists(spark):
    r = refills(spark, monthly(1, 1, 4) + monthly(1, 2, 4, start="2000-03-02"))  # group 1 refills on 2000-03-02 too
    assert A.dummy_refills(r, END).count() == 0
    r = refills(spark, monthly(1, 1, 4) + monthly(1, 2, 4, start="2000-03-05"))
    assert [(x["class_id"], str(x["service_date"])) for x in A.dummy_refills(r, END).collect()] == [(1, "2000-03-05")]


def test_carry_forward_literal(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((10, -4, -9, 2))], "k int, i int, x double")
    for chunk in (None, F.floor(F.col("i") / 2)):
        rows = carry_forward(df, ["k"], "i", "x", chunk=chunk).orderBy("i").collect()
        assert [r["act_os"] for r in rows] == [10, 6, 0, 2]
        assert [r["act_dnod"] for r in rows] == [0, 0, 3, 0]


def test_carry_forward_equals_the_recursion(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        surplus = 0
        for i in range(rng.randint(1, 30)):
            x = rng.randint(-20, 20)
            rows.append((k, i, float(x)))
            want[k, i] = (max(surplus + x, 0), max(-(surplus + x), 0))
            surplus = max(surplus + x, 0)
    df = spark.createDataFrame(rows, "k int, i int, x double")
    for chunk in (None, F.floor(F.col("i") / 7)):
        got = {(r["k"], r["i"]): (r["act_os"], r["act_dnod"]) for r in carry_forward(df, ["k"], "i", "x", chunk=chunk).collect()}
        assert got == want


def test_chunked_windows_equal_plain_ones(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i % 3, rng.randint(0, 60), i, float(rng.randint(1, 9))) for i in range(300)], "k int, d int, id int, v double")
    chunk = F.floor(F.col("d") / 10)

    def rows(x):
        return sorted(tuple(r) for r in x.select("id", "out").collect())

    for desc in (False, True):
        assert rows(running_sum(df, ["k"], "d", {"out": "v"}, descending=desc)) == rows(running_sum(df, ["k"], "d", {"out": "v"}, chunk=chunk, descending=desc))
    unique = df.dropDuplicates(["k", "d"])
    assert rows(next_event(unique, ["k"], "d", F.lit(99), "out")) == rows(next_event(unique, ["k"], "d", F.lit(99), "out", chunk=chunk))
    assert rows(previous_value(df, ["k"], ["d", "id"], "v", "out")) == rows(previous_value(df, ["k"], ["d", "id"], "v", "out", chunk=chunk))


def plain_ratio(rows, end):
    """The ratio of one member, day by day bookkeeping in plain Python."""
    groups = {}
    for _, g, d, s in rows:
        groups.setdefault(g, {})[day(d)] = s
    starts = sorted({min(v) for v in groups.values()})
    gap, days = {}, {}
    for g, fills in groups.items():
        cuts = sorted(set(fills) | {s for s in starts if s > min(fills)})
        surplus = 0
        for i, d in enumerate(cuts):
            nxt = cuts[i + 1] if i + 1 < len(cuts) else end
            x = surplus + fills.get(d, 0) - (nxt - d).days
            surplus = max(x, 0)
            p = sum(s <= d for s in starts)
            gap[p, g] = gap.get((p, g), 0) + max(-x, 0)
            days[p, g] = days.get((p, g), 0) + (nxt - d).days
    total = 0
    for p in {p for p, _ in days}:
        gs = [g for q, g in days if q == p]
        total += max(days[p, g] for g in gs) - sum(gap[p, g] for g in gs) / len(gs)
    return 100 * total / (end - starts[0]).days


def test_ratio_against_plain_python(spark):
    rng = random.Random(7)
    rows = []
    for m in range(60):
        for g in range(rng.randint(1, 4)):
            for d in rng.sample(range(380), rng.randint(4, 12)):
                rows.append((m, g, str(day("1999-12-20") + dt.timedelta(days=d)), rng.choice((7, 28, 30, 90))))
    rows = [r for r in rows if day(r[2]) < END]
    counts = {}
    for m, g, *_ in rows:
        counts[m, g] = counts.get((m, g), 0) + 1
    thin = {m for (m, _), n in counts.items() if n < 4}
    r = refills(spark, rows)
    want = {m: round(plain_ratio([x for x in rows if x[0] == m], END), 9) for m in {x[0] for x in rows} - thin}
    for got in (A.ratio_of(A.period_stats(A.covered_timeline(r, END)), END), A.dppr_by_stages(r, END)):
        assert {x["member_id"]: round(x["dppr"], 9) for x in got.collect()} == want


def test_supply_before_the_window_lengthens_the_span(spark):
    r = refills(spark, monthly(1, 1, 5, start="1999-12-10", supply=60, step=60))
    assert A.observation_span(r, END).first()["observation_days"] == 388


def test_hot_member_is_reduced_before_the_shuffle(spark):
    """A third of all claims on one member collapse to one refill per class and day."""
    base = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("member_id"), F.lit(1).cast("bigint").alias("code"),
        F.date_add(F.lit(day("2000-01-05")), (F.col("id") % 5).cast("int")).alias("service_date"), F.lit("30").alias("days_supply"),
        F.lit("1").alias("quantity"), F.lit(1.0).alias("paid_amount"), F.lit(None).cast("string").alias("claim_status"), F.lit("US").alias("lob"))
    x = spark.createDataFrame([(1, 1)], "class_id bigint, code bigint")
    out = A.refills_of(A.eligible_claims(base, WINDOW), [x])
    assert out.where("member_id = 1").count() == 5


def test_agreement_counts(spark):
    m = spark.createDataFrame([(1, 79.9, 80.0), (2, 80.0, 79.0), (3, 90.0, 95.0), (4, 40.0, 55.0)], "member_id int, dppr double, mpr double")
    rows = {r["cut"]: r for r in A.agreement_at(m, "dppr", ["mpr"]).collect()}
    assert (rows[80.0]["n_below"], rows[80.0]["missed"], rows[80.0]["n_above"], rows[80.0]["overcalled"]) == (2, 1, 2, 1)
    assert (rows[50.0]["n_below"], rows[50.0]["missed"]) == (1, 1)
