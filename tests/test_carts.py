import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortry.streaming import carts as K

LOG = "event_id bigint, ts timestamp_ntz, cart bigint, item string, action string, price double"


def log(spark, steps, cart=1):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t + dt.timedelta(minutes=20 * i), cart, item, action, price) for i, (action, item, price) in enumerate(steps)], LOG)


def test_adds(spark):
    t = K.cart_totals(K.cart_state(log(spark, [("add", "Apple", 1.5), ("add", "Banana", 2.0)]))).first()
    assert (t["total_count"], t["total_price"]) == (2, 3.5)


def test_remove_takes_the_item_out(spark):
    df = log(spark, [("add", "Apple", 1.5), ("add", "Banana", 2.0), ("remove", "Apple", None)])
    assert [(r["item"], r["price"]) for r in K.cart_state(df).collect()] == [("Banana", 2.0)]
    assert [r["price"] for r in K.removed_prices(df).collect()] == [1.5]
    assert K.failed_removes(df).count() == 0


@pytest.mark.parametrize("price", [-1.5, 0.0, None])
def test_bad_price_is_rejected(spark, price):
    df = log(spark, [("add", "Apple", 2.0), ("add", "Apple", price)])
    assert K.rejected_adds(df).count() == 1
    assert K.cart_state(df).first()["price"] == 2.0


def test_last_price_wins_and_missing_removals_are_errors(spark):
    df = log(spark, [("remove", "A", None), ("add", "A", 1.0), ("add", "A", 4.0), ("remove", "A", None), ("remove", "A", None), ("add", "A", 3.0)])
    assert K.cart_state(df).first()["price"] == 3.0
    assert sorted(r["event_id"] for r in K.failed_removes(df).collect()) == [0, 4]


def plain(steps):
    """Items and errors of (position, action, item, price) applied in order by a dictionary."""
    cart, errors = {}, {}
    for i, (action, item, price) in steps:
        if action == "add" and price is not None and price > 0:
            cart[item] = price
        elif action == "add":
            errors[i] = "rejected"
        elif item not in cart:
            errors[i] = "missing"
        else:
            del cart[item]
    return cart, errors


def random_steps(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(("add", "add", "remove")), rng.choice("abcdef"), rng.choice((None, -1.0, 1.0, 2.5, 4.0))) for _ in range(n)]


def feed(spark, df, tmp_path, batches, lateness):
    """Each batch of event_ids is a file that the stream reads in a run of its own."""
    source = str(tmp_path / "log")
    for ids in batches:
        df.where(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(source)
        stream = K.run_cart_stream(spark.readStream.schema(df.schema).parquet(source), str(tmp_path / "out"), lateness)
    return stream


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_stream_in_any_order_within_the_lateness_equals_batch_and_a_dictionary(spark, tmp_path, kind):
    steps = random_steps(11)
    df = log(spark, steps).withColumn("ts", F.col("ts").cast(kind))
    cart, errors = plain(enumerate(steps))
    assert {r["item"]: r["price"] for r in K.cart_state(df).collect()} == cart
    # events are 20 minutes apart: one delayed by up to 40 of them stays within 14 hours
    rng = random.Random(12)
    arrival = sorted(range(300), key=lambda i: i + rng.randrange(41))
    stream = feed(spark, df, tmp_path, [arrival[lo : lo + 75] for lo in range(0, 300, 75)], "14 hours")
    assert {r["item"]: r["price"] for r in K.stream_state(spark, stream).collect()} == cart
    assert {r["event_id"]: r["reason"] for r in K.stream_errors(spark, stream).collect()} == errors
    assert K.late_events(spark, stream).count() == 0
    # most errors were noted by the stream itself, not found among the events that still wait
    assert spark.read.parquet(stream.noted).where("reason = 'missing'").count() > 0.5 * sum(r == "missing" for r in errors.values())


def test_events_beyond_the_lateness_are_late_and_change_nothing(spark, tmp_path):
    steps = random_steps(21, 120)
    held = [3, 10, 30]  # come after everything else
    df = log(spark, steps)
    batches = [[i for i in range(60) if i not in held], list(range(60, 120)), held]
    stream = feed(spark, df, tmp_path, batches, "10 minutes")
    cart, errors = plain([(i, s) for i, s in enumerate(steps) if i not in held])
    assert sorted(r["event_id"] for r in K.late_events(spark, stream).collect()) == held
    assert {r["item"]: r["price"] for r in K.stream_state(spark, stream).collect()} == cart
    assert {r["event_id"]: r["reason"] for r in K.stream_errors(spark, stream).collect()} == errors


def test_a_removal_that_overtakes_its_add_is_no_error(spark, tmp_path):
    df = log(spark, [("add", "a", 1.0), ("add", "b", 2.0), ("remove", "b", None), ("add", "c", 3.0)])
    stream = feed(spark, df, tmp_path, [[0, 2], [1], [3]], "2 hours")
    assert {r["item"]: r["price"] for r in K.stream_state(spark, stream).collect()} == {"a": 1.0, "c": 3.0}
    assert K.stream_errors(spark, stream).count() == 0 and K.late_events(spark, stream).count() == 0


def test_state_is_kept_per_bucket_and_many_items_and_chunks_share_one(spark, tmp_path):
    rng = random.Random(31)
    t = dt.datetime(2024, 1, 1)
    rows = [
        (i, t + dt.timedelta(minutes=i // 3), rng.choice((1, 2, 3)), rng.choice("abcdefghijkl"), rng.choice(("add", "add", "remove")), rng.choice((None, -1.0, 1.0, 2.5)))
        for i in range(4_000)
    ]
    df = spark.createDataFrame(rows, LOG)
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    for ids in (F.col("event_id") < 3_000, F.col("event_id") >= 3_000):
        df.where(ids).coalesce(1).write.mode("append").parquet(source)
        stream = K.run_cart_stream(spark.readStream.schema(df.schema).parquet(source), out, "5 hours", buckets=2)
    held = [spark.read.format("statestore").option("path", stream.progress).option("stateVarName", v).load() for v in ("last", "waiting")]
    assert [h.select("key.*").distinct().count() for h in held] == [2, 2]
    assert len(spark.read.parquet(stream.noted).where("reason = 'missing'").take(1)) == 1
    key = lambda r: (str(r["cart"]), str(r["item"]), r["price"])
    assert sorted(map(key, K.stream_state(spark, stream).collect())) == sorted(map(key, K.cart_state(df).collect()))
    errors = K.rejected_adds(df).select("event_id").union(K.failed_removes(df).select("event_id"))
    assert sorted(r["event_id"] for r in K.stream_errors(spark, stream).collect()) == sorted(r["event_id"] for r in errors.collect())
