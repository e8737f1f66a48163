"""Cart queries, batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog.book import Book, rounded, with_views
from cohortry.sources import views as V
from cohortry.streaming import carts as K

BOOK = Book()

VALID = with_views("cart_log") + """, valid AS (SELECT *, lag(action) OVER w AS was, lag(price) OVER w AS old FROM cart_log WHERE action = 'remove' OR price > 0 WINDOW w AS (PARTITION BY cart, item ORDER BY ts, event_id)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cart, item ORDER BY ts DESC, event_id DESC) AS r FROM valid) WHERE r = 1),
state AS (SELECT cart, item, price FROM latest WHERE action = 'add')
"""
TOTALS = "SELECT cart, round(SUM(price), 2) AS total_price, COUNT(*) AS total_count FROM state GROUP BY cart"
ERRORS = """SELECT event_id, cart, item, 'rejected' AS reason FROM cart_log WHERE action = 'add' AND price <= 0
UNION ALL SELECT event_id, cart, item, 'missing' FROM valid WHERE action = 'remove' AND (was IS NULL OR was = 'remove')"""


@BOOK.add("cart_adds", with_views("cart_log") + " SELECT cart, item, arg_max(price, (ts, event_id)) AS price FROM cart_log WHERE action = 'add' AND price > 0 GROUP BY cart, item")
def cart_adds(spark, folder):
    return K.apply_adds(V.cart_log(spark, folder))


@BOOK.add("cart_rejected_adds", with_views("cart_log") + " SELECT event_id, cart, item, price FROM cart_log WHERE action = 'add' AND price <= 0")
def cart_rejected(spark, folder):
    return K.rejected_adds(V.cart_log(spark, folder)).select("event_id", "cart", "item", "price")


@BOOK.add("cart_failed_removes", VALID + "SELECT event_id, cart, item FROM valid WHERE action = 'remove' AND (was IS NULL OR was = 'remove')")
def cart_failed(spark, folder):
    return K.failed_removes(V.cart_log(spark, folder)).select("event_id", "cart", "item")


@BOOK.add("cart_removed_prices", VALID + "SELECT event_id, cart, item, old AS price FROM valid WHERE action = 'remove' AND was = 'add'")
def cart_removed(spark, folder):
    return K.removed_prices(V.cart_log(spark, folder)).select("event_id", "cart", "item", "price")


@BOOK.add("cart_state", VALID + "SELECT * FROM state")
def cart_state(spark, folder):
    return K.cart_state(V.cart_log(spark, folder))


@BOOK.add("cart_totals", VALID + TOTALS)
def cart_totals(spark, folder):
    return rounded(K.cart_totals(K.cart_state(V.cart_log(spark, folder))), 2)


def _streamed(spark, folder):
    """The events arrive up to two days late, in three pieces by arrival; the stream catches up after each."""
    root = K.fresh_root(spark, "carts")
    log = V.cart_log(spark, folder)
    delay = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(2 * 86400)))
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    passed = F.unix_micros((F.col("ts") + delay).cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))
    third = F.floor(3 * passed / ((last - first).total_seconds() * 1e6 + 1))
    source = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).parquet
    for piece in range(3):
        log.where(F.least(third, F.lit(2)) == piece).write.parquet(f"{root}/log/piece={piece}")
        stream = K.run_cart_stream(source(f"{root}/log"), f"{root}/out", "2 days")
    return stream


@BOOK.add("cart_totals_stream", VALID + TOTALS)
def cart_totals_stream(spark, folder):
    return rounded(K.cart_totals(K.stream_state(spark, _streamed(spark, folder))), 2)


@BOOK.add("cart_errors_stream", VALID + ERRORS)
def cart_errors_stream(spark, folder):
    return K.stream_errors(spark, _streamed(spark, folder)).select("event_id", "cart", "item", "reason")
