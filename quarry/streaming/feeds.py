"""Stateful feed operators on Structured Streaming, with their batch forms."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions import scalars


def feeds_of(ticks: DataFrame, size: int = 20, order: str = "seq", lanes: int = 8) -> DataFrame:
    """Every ``size`` ticks in order form one feed: adds ``feed`` and ``place``; the last may be short.

    With several lanes (a hash of the symbol) each lane counts for itself, so that no task sees
    all ticks.
    """
    lane = F.pmod(F.xxhash64("symbol"), F.lit(lanes))
    n = F.row_number().over(Window.partitionBy("lane").orderBy(order)) - 1
    return ticks.withColumn("lane", lane).withColumn("n", n).withColumn("feed", F.floor(F.col("n") / size)).withColumn("place", F.col("n") % size).drop("n")


def stream_feeds(ticks: DataFrame, size: int = 20, lanes: int = 8) -> DataFrame:
    """The streaming form: ``lane, feed, symbols`` as soon as a lane holds ``size`` ticks; the rest waits in state."""
    out = "lane long, feed long, symbols array<string>"
    keep = "feed long, waiting array<string>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed, waiting = state.get if state.exists else (0, [])
        waiting = list(waiting)
        for f in frames:
            waiting += f.sort_values("seq")["symbol"].tolist()
        rows = []
        while len(waiting) >= size:
            rows.append((key[0], feed, waiting[:size]))
            feed, waiting = feed + 1, waiting[size:]
        state.update((feed, waiting))
        yield pd.DataFrame(rows, columns=["lane", "feed", "symbols"])

    keyed = ticks.withColumn("lane", F.pmod(F.xxhash64("symbol"), F.lit(lanes)))
    return keyed.groupBy("lane").applyInPandasWithState(step, out, keep, "append", GroupStateTimeout.NoTimeout)


def fill_feeds(triggered: DataFrame, ambient: DataFrame, size: int = 20) -> DataFrame:
    """Feeds of ``size``: triggered entries first, the rest from the ambient ones, ``(feed, seq, symbol)`` each."""
    both = triggered.withColumn("rank", F.lit(0)).unionByName(ambient.withColumn("rank", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("feed").orderBy("rank", "seq"))
    return both.withColumn("place", n).where(F.col("place") <= size)


def book_triggers(orders: DataFrame, quotes: DataFrame) -> DataFrame:
    """Orders with the first quote at or after their arrival that puts them in the money: ``at`` (null: still waiting).

    ``orders(order_id, symbol, kind, limit, ts)``, ``quotes(symbol, price, ts)``. Buys and stops fire at
    price <= limit, sells at price >= limit. Each symbol's events run once in time order through a
    book of two heaps, so no pairs are made and a task holds the open orders of one symbol. Orders
    and quotes of one time: orders come first. Null limits and prices never fire.
    """
    kind = F.when(F.col("kind") == "sell", 1).otherwise(0)
    events = orders.select("symbol", F.col("ts").cast("double").alias("t"), F.lit(0).alias("quote"), kind.alias("sell"), F.col("limit").cast("double").alias("x"), "order_id", F.lit(None).cast(quotes.schema["ts"].dataType).alias("at"))
    events = events.unionByName(quotes.select("symbol", F.col("ts").cast("double").alias("t"), F.lit(1).alias("quote"), F.lit(0).alias("sell"), F.col("price").cast("double").alias("x"), F.lit(None).cast(orders.schema["order_id"].dataType).alias("order_id"), F.col("ts").alias("at")))
    fired = events.where("symbol is not null and t is not null and x is not null").repartition("symbol").sortWithinPartitions("symbol", "t", "quote")
    hit = fired.mapInArrow(_run_book, f"order_id {orders.schema['order_id'].dataType.simpleString()}, at {quotes.schema['ts'].dataType.simpleString()}")
    return orders.join(hit, "order_id", "left")


def _run_book(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol, books = None, ([], [])
    for b in batches:
        ids, at = [], []
        rows = zip(*(b.column(c).to_pylist() for c in ("symbol", "quote", "sell", "x", "order_id", "at")))
        for s, quote, sell, x, order, when in rows:
            if s != symbol:
                symbol, books = s, ([], [])
            if not quote:
                # buys wait with the highest limit on top, sells with the lowest
                heapq.heappush(books[sell], (x if sell else -x, order))
                continue
            for side in (0, 1):
                while books[side] and books[side][0][0] <= (x if side else -x):
                    ids.append(heapq.heappop(books[side])[1])
                    at.append(when)
        if ids:
            yield pa.record_batch([pa.array(ids, b.schema.field("order_id").type), pa.array(at, b.schema.field("at").type)], names=["order_id", "at"])


def due_results(trades: DataFrame, mean_delay: float, cap: float, seed: int = 1) -> DataFrame:
    """Adds ``due``: ``ts`` plus a negative-exponential delay (a hash of the id is its draw), capped."""
    u = (F.pmod(F.xxhash64("t_id", F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return trades.withColumn("due", F.col("ts") + F.least(-F.log(u) * mean_delay, F.lit(cap)))


def stream_timers(trades: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """Trades ``t_id, event_time, due_time``, each emitted once event time has passed its ``due_time``.

    State holds a trade until its event-time timer fires.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (due,) = state.get
            state.remove()
            yield pd.DataFrame({"t_id": [key[0]], "due_ms": [due]})
            return
        due = max(int(f["due_ms"].max()) for f in frames)
        state.update((due,))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    src = trades.withWatermark("event_time", watermark).select("t_id", "event_time", (F.unix_millis(F.col("due_time"))).alias("due_ms"))
    return src.groupBy("t_id").applyInPandasWithState(step, "t_id long, due_ms long", "due long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_requests(feed: DataFrame, requests: DataFrame) -> DataFrame:
    """Stream-static join: requests that each tick ``(symbol, price)`` sets off."""
    j = feed.join(requests, feed["symbol"] == requests["tr_s_symb"])
    return j.where(scalars.triggered(F.col("tr_tt_id"), F.col("tr_bid_price"), F.col("price"))).select("tr_t_id", "symbol", "price")


def event_windows(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and type, late events within ``late`` included."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
