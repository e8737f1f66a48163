"""Cart state from an event log, in batch and as a stream.

Log: ``event_id, ts, cart, item, action ('add' or 'remove'), price``.  An add sets the
item's price (the last one wins); a price of zero or less is rejected; a removal of an item
that is not in the cart is an error and changes nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cohortry.operators.windows import previous_value
from cohortry.session import shared_folder

KEY = ["cart", "item"]
ORDER = ["ts", "event_id"]


def rejected_adds(log: DataFrame) -> DataFrame:
    """Adds whose price is missing or not positive."""
    return log.where((F.col("action") == "add") & ~F.coalesce(F.col("price") > 0, F.lit(False)))


def valid_events(log: DataFrame) -> DataFrame:
    return log.where((F.col("action") == "remove") | ((F.col("action") == "add") & (F.col("price") > 0)))


def last_event(log: DataFrame) -> DataFrame:
    """The last valid event of each item; partial aggregates absorb long histories."""
    at = F.struct(*ORDER)
    return valid_events(log).groupBy(*KEY).agg(F.max_by(F.struct("action", "price", *ORDER), at).alias("_e")).select(*KEY, "_e.*")


def apply_adds(log: DataFrame) -> DataFrame:
    """Price of every item ever added, removals ignored."""
    return last_event(log.where(F.col("action") == "add")).select(*KEY, "price")


def cart_state(log: DataFrame) -> DataFrame:
    """Items in each cart at the end of the log: (cart, item, price)."""
    return last_event(log).where(F.col("action") == "add").select(*KEY, "price")


def failed_removes(log: DataFrame, chunk: str = "minute") -> DataFrame:
    """Removals of an item that was not in the cart.

    The item is there if and only if its previous valid event is an add.  The look-back runs
    per (item, minute), so one busy item is spread over tasks.
    """
    events = previous_value(valid_events(log), KEY, ORDER, "action", "_before", chunk=F.date_trunc(chunk, "ts"))
    gone = (F.col("action") == "remove") & ~F.coalesce(F.col("_before") == "add", F.lit(False))
    return events.where(gone).drop("_before")


def removed_prices(log: DataFrame, chunk: str = "minute") -> DataFrame:
    """Removals that took an item out, with the price it had."""
    events = valid_events(log).withColumn("_was", F.struct("action", "price"))
    events = previous_value(events, KEY, ORDER, "_was", "_before", chunk=F.date_trunc(chunk, "ts"))
    hit = (F.col("action") == "remove") & (F.col("_before.action") == "add")
    return events.where(hit).select("event_id", "ts", *KEY, F.col("_before.price").alias("price"))


def cart_totals(state: DataFrame) -> DataFrame:
    """Total price and item count per cart.  The items are the state's own rows."""
    return state.groupBy("cart").agg(F.sum("price").alias("total_price"), F.count("item").alias("total_count"))


@dataclass(frozen=True)
class CartStream:
    """Where a stream keeps its progress with the state, and where it writes errors and late events."""

    root: str

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"

    @property
    def noted(self) -> str:
        return f"{self.root}/noted"


#: Items are dealt to so many buckets by a hash; a stream keeps the number it began with.  State is
#: read and written once a bucket and batch, not once an item.
BUCKETS = 1 << 12
#: Waiting events in one value of the state.
CHUNK = 1_000


class _CartItems(StatefulProcessor):
    """The items of one bucket: the adds that put them into their carts, and the events that wait until no earlier one can come.

    A timer fires when the watermark has passed the first waiting event; those it has passed are
    applied in time order.  A bucket has one timer at a time.
    """

    def __init__(self, event: str):
        self.event = event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"events array<struct<{self.event}>>")
        self.last = handle.getValueState("last", f"events array<struct<{self.event}>>")

    @staticmethod
    def _note(event_id, ts, cart, item, reason: str) -> Row:
        return Row(event_id=event_id, ts=ts, cart=cart, item=item, reason=reason)

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh, first = [], None
        for _, cart, item, at, event_id, ts, action, price in rows:
            if passed > 0 and at <= passed:
                yield self._note(event_id, ts, cart, item, "late")
            elif action == "remove" or (price is not None and price > 0):
                fresh.append((at, event_id, ts, cart, item, action, price))
                first = at if first is None else min(first, at)
                if len(fresh) == CHUNK:
                    self.waiting.appendValue((fresh,))
                    fresh = []
            else:
                yield self._note(event_id, ts, cart, item, "rejected")
        if fresh:
            self.waiting.appendValue((fresh,))
        if first is not None:
            wake, set_before = -(-first // 1000), list(self.handle.listTimers())
            if not set_before or wake < min(set_before):
                for other in set_before:
                    self.handle.deleteTimer(other)
                self.handle.registerTimer(wake)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = [tuple(e) for (chunk,) in self.waiting.get() for e in chunk]
        events.sort(key=lambda e: (e[0], e[1] is not None, e[1]))
        due = bisect_right(events, passed, key=lambda e: e[0])
        if not due:
            return
        held = self.last.get() if self.last.exists() else ([],)
        here = {(e[3], e[4]): tuple(e) for e in held[0]}
        for e in events[:due]:
            _, event_id, ts, cart, item, action, _ = e
            if action == "add":
                here[cart, item] = e
            elif here.pop((cart, item), None) is None and action == "remove":
                yield self._note(event_id, ts, cart, item, "missing")
        if here:
            self.last.update((list(here.values()),))
        else:
            self.last.clear()
        if due < len(events):
            self.waiting.put([(events[lo : lo + CHUNK],) for lo in range(due, len(events), CHUNK)])
            self.handle.registerTimer(-(-events[due][0] // 1000))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State variables and timers need this store; a query keeps the setting it starts with."""
    name, value = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def note_errors(events: DataFrame, lateness: str, buckets: int = BUCKETS) -> DataFrame:
    """Streaming log rows to (event_id, ts, cart, item, reason): rejected adds, removals of missing items, late events.

    State is kept per bucket of carts and items, so a busy cart is spread over tasks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    # the copy of the time carries no watermark: Spark would drop late rows, and they are to be noted
    rows = events.withColumn("at", at).withColumn("_seen", F.timestamp_micros("at")).withWatermark("_seen", lateness)
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select(bucket, *KEY, "at", "event_id", "ts", "action", F.col("price").cast("double").alias("price"))
    event = f"at: bigint, event_id: {kinds['event_id']}, ts: {kinds['ts']}, cart: {kinds['cart']}, item: {kinds['item']}, action: string, price: double"
    out = f"event_id {kinds['event_id']}, ts {kinds['ts']}, cart {kinds['cart']}, item {kinds['item']}, reason string"
    return rows.groupBy("bucket").transformWithState(_CartItems(event), out, "Append", "EventTime")


def run_cart_stream(events: DataFrame, root: str, lateness: str = "1 hour", buckets: int = BUCKETS) -> CartStream:
    """Run a stream of log rows to the end of what is there.

    State and errors equal those of the batch form for events in any order, as long as each is newer
    than the newest event of earlier batches less ``lateness``.  Older ones are noted as late and
    change nothing.  Progress, state and output lie under ``root``, which every executor must reach;
    a batch that is repeated replaces what it wrote.  ``buckets`` must stay as in the stream's first run.
    """
    stream = CartStream(root)
    with _rocksdb(events.sparkSession):
        query = (
            note_errors(events, lateness, buckets).writeStream.format("parquet").option("path", stream.noted)
            .option("checkpointLocation", stream.progress).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return stream


def _variable(spark: SparkSession, stream: CartStream, name: str) -> DataFrame:
    """A state variable as log rows, read from the store as of the last batch."""
    rows = spark.read.format("statestore").option("path", stream.progress).option("stateVarName", name).load()
    value = "list_element" if "list_element" in rows.columns else "value"
    return rows.select(F.explode(f"{value}.events").alias("_e")).select("_e.*").drop("at")


def _open_log(spark: SparkSession, stream: CartStream) -> DataFrame:
    """The add that put each item into its cart, and the events that still wait (``waits``)."""
    done, waiting = (_variable(spark, stream, v).withColumn("waits", F.lit(v == "waiting")) for v in ("last", "waiting"))
    return done.unionByName(waiting)


def stream_state(spark: SparkSession, stream: CartStream) -> DataFrame:
    """Items in each cart after all events read so far."""
    return cart_state(_open_log(spark, stream))


def stream_errors(spark: SparkSession, stream: CartStream) -> DataFrame:
    """Errors noted, and those of the events that still wait: (event_id, ts, cart, item, reason)."""
    columns = ["event_id", "ts", *KEY, "reason"]
    waiting = failed_removes(_open_log(spark, stream)).where("waits").withColumn("reason", F.lit("missing"))
    return spark.read.parquet(stream.noted).where("reason <> 'late'").select(*columns).unionByName(waiting.select(*columns))


def late_events(spark: SparkSession, stream: CartStream) -> DataFrame:
    """Events that came too late to be applied: (event_id, ts, cart, item)."""
    return spark.read.parquet(stream.noted).where("reason = 'late'").drop("reason")


def fresh_root(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
