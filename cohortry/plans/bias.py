"""Class-probability features of members for bias audits.

Nothing here infers a class by itself: probabilities come from tables the caller supplies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.scalar import argmax_onehot, county_of, recode, threshold_flags, threshold_label, tract_code
from cohortry.operators.relational import in_population, share
from cohortry.plans.presets import BAD_STATES, RACE_COLUMNS, RACE_NAMES


def components(members: DataFrame, names: DataFrame, geography: DataFrame, demographics: DataFrame, tracts: DataFrame) -> DataFrame:
    """Distinct (member, name, age, sex, state, county) rows of members with a usable place.

    ``members``: member_id.  ``names``: member_id, first_name, surname, state.
    ``geography``: member_id, tract.  ``demographics``: member_id, gender, age.
    ``tracts``: state, tract (numeric).
    """
    # the result is distinct, so every side may drop its repeats before the joins
    places = geography.where(F.col("tract").isNotNull() & (F.col("tract") != "NA")).select("member_id", "tract").distinct()
    people = demographics.where(F.col("gender").isNotNull() & F.col("age").isNotNull()).select("member_id", "gender", "age").distinct()
    states = tracts.select(tract_code("tract").alias("tract"), F.col("state").alias("tract_state")).distinct()
    known = names.select("member_id", "first_name", "surname", "state").distinct()
    # place, gender and age are required, so those joins are inner; names stay optional
    out = (
        members.select("member_id").distinct().join(places, "member_id").join(people, "member_id")
        .join(known, "member_id", "left")
        .join(states, "tract", "left")
        .select(
            "member_id", "first_name", "surname",
            F.col("age").cast("int").alias("age"),
            recode("gender", {"M": 0, "F": 1}).alias("sex"),
            F.coalesce("state", "tract_state").alias("state"),
            county_of("tract").alias("county"),
        )
        .distinct()
    )
    return out.where(~F.col("state").isin(*BAD_STATES))


def posterior(df: DataFrame, surname_table: DataFrame, place_table: DataFrame, default_prior: Sequence[float], classes: Sequence[str], surname: str = "surname", place: Sequence[str] = ("state", "county", "age", "sex")) -> DataFrame:
    """p(class | surname, place) in proportion to p(class | surname) x p(place | class).

    ``surname_table``: surname and one ``prior_<class>`` per class.  ``place_table``: the
    place columns and one ``given_<class>`` per class.  Unmatched surnames take the default
    prior and are flagged; an unmatched place gives NULL.  (Imai and Khanna, 2016.)
    """
    out = df.join(surname_table, surname, "left").join(place_table, list(place), "left")
    out = out.withColumn("surname_matched", F.col(f"prior_{classes[0]}").isNotNull().cast("int"))
    out = out.withColumns({
        f"_w_{c}": F.coalesce(F.col(f"prior_{c}"), F.lit(float(p))) * F.col(f"given_{c}") for c, p in zip(classes, default_prior)
    })
    total = sum((F.col(f"_w_{c}") for c in classes[1:]), F.col(f"_w_{classes[0]}"))
    out = out.withColumns({f"pred_{c}": F.try_divide(F.col(f"_w_{c}"), total) for c in classes})
    return out.drop(*[f"_w_{c}" for c in classes], *[f"prior_{c}" for c in classes], *[f"given_{c}" for c in classes])


def threshold_classes(predicted: DataFrame, columns: Sequence[str] = RACE_COLUMNS[:4], names: Sequence[str] = RACE_NAMES[:4], t: float = 0.7) -> DataFrame:
    """One flag per class with probability above t, ``other`` if none, and the class name."""
    out = predicted.select("*", *threshold_flags(columns, names, t))
    none = sum((F.col(n) for n in names[1:]), F.col(names[0])) == 0
    return out.withColumns({"other": none.cast("int"), "race": threshold_label(columns, names, t)})


def average_by_member(predicted: DataFrame, key: str = "member_id", columns: Sequence[str] = RACE_COLUMNS) -> DataFrame:
    """Mean of the distinct probability rows of each member."""
    distinct = predicted.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).distinct()
    return distinct.groupBy(key).agg(*[F.avg(c).alias(f"{c}_avg") for c in columns])


def average_and_classify(predicted: DataFrame, key: str = "member_id", columns: Sequence[str] = RACE_COLUMNS, names: Sequence[str] = RACE_NAMES) -> DataFrame:
    """Averaged probabilities with a flag on the strictly largest one; ties leave all 0.

    Averages are compared at 12 digits: equal ones may differ in their last bits by the order
    in which rows were added.
    """
    averaged = average_by_member(predicted, key, columns)
    compared = [f"_{c}" for c in columns]
    averaged = averaged.withColumns({t: F.round(f"{c}_avg", 12) for t, c in zip(compared, columns)})
    return averaged.select("*", *argmax_onehot(compared, names)).drop(*compared)


def class_shares(classified: DataFrame, population: DataFrame | None = None, key: str = "member_id", names: Sequence[str] = RACE_NAMES) -> DataFrame:
    """Percentage of members per class, of all or of a sub-population."""
    rows = classified if population is None else in_population(classified, population, key)
    return share(rows, names)
