"""Incremental forms on Structured Streaming: deduplicated appends, last writes, windows, and keyed state by ticker."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_DAY_MS = 86_400_000
_EPOCH = dt.date(1970, 1, 1)


def first_writes(stream: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """A stream with the first row of each key only; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def window_counts(stream: DataFrame, at: str, key: str, width: str, delay: str) -> DataFrame:
    """Counts by key and time window; late rows count until the watermark passes the window."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", key, "n")


def last_writes(stream: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The last row, by `at`, of each key (update mode: a key comes again when it changes)."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("x")).select(*keys, "x.*")


#: Keys of the state store: tickers are dealt to so many buckets. It cannot change between runs from one checkpoint.
BUCKETS = 1024
#: Days of a bucket that lie further apart than this do not wait for each other.
GAP = 31


def _pack(frame: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class _InOrder(StatefulProcessor):
    """Days of the tickers of a bucket, each ticker's taken in the order of their date however they arrive.

    A row of state costs far more than the work on a day, so the days that a batch brings to a bucket wait as one row of a
    list until a timer, at the last of them, fires: then the watermark has passed them and nothing earlier can come. Where
    a batch leaves out more than GAP days, those before have a timer of their own: a single far day, of any ticker of the
    bucket, would hold them back until the watermark had passed it too. What has been seen so far is one row a ticker in
    another list. Both live in the state store, so a query that starts again from its checkpoint goes on where it was.
    """

    fields: Sequence[str]  # boolean columns of a day
    state: str  # schema of what is known of a ticker
    start: tuple

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "days binary")
        self.now = handle.getListState("now", f"ticker string, {self.state}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat([r[["ticker", "day", *self.fields]] for r in rows])
        self.waiting.appendValue((_pack(days),))
        at = np.unique(days["day"])
        for last in [*at[:-1][np.diff(at) > GAP], at[-1]]:  # mostly one timer a batch
            self.handle.registerTimer(int(last) * _DAY_MS)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // _DAY_MS
        waiting = [_unpack(x[0]) for x in self.waiting.get()]
        if not waiting:
            return
        days = pd.concat(waiting)
        ready, left = days[days["day"] <= passed], days[days["day"] > passed]
        if ready.empty:
            return
        ready = ready.drop_duplicates(["ticker", "day"], keep="last").sort_values(["ticker", "day"])
        known, out = {ticker: tuple(now) for ticker, *now in self.now.get()}, []
        for ticker, day, *flags in zip(*(ready[c].tolist() for c in ready), strict=True):
            known[ticker], events = self.step(known.get(ticker, self.start), _EPOCH + dt.timedelta(day), *flags)
            out += [{"ticker": ticker, **event} for event in events]
        if left.empty:
            self.waiting.clear()
        else:
            self.waiting.put([(_pack(left),)])
        self.now.put([(ticker, *now) for ticker, now in known.items()])
        if out:
            yield pd.DataFrame(out)

    def step(self, now: tuple, day: dt.date, *flags: bool) -> tuple[tuple, list[dict]]:
        raise NotImplementedError


class Sessions(_InOrder):
    """State of a ticker: sessions so far, entry day of the open one, last day of the run of holds."""

    fields, state, start = ("hold", "signal"), "n int, entry date, last date", (0, None, None)
    schema = "ticker string, event string, session_id int, entry_date date, exit_date date, last_hold date"

    def step(self, now: tuple, day: dt.date, hold: bool, signal: bool) -> tuple[tuple, list[dict]]:
        n, entry, last = now
        if not hold:
            closed = [] if entry is None else [{"event": "close", "session_id": n, "entry_date": entry, "exit_date": day, "last_hold": last}]
            return (n, None, None), closed
        if entry is None and signal:
            return (n + 1, day, day), [{"event": "open", "session_id": n + 1, "entry_date": day, "exit_date": None, "last_hold": day}]
        return (n, entry, day), []


class Membership(_InOrder):
    """State of a ticker: is it a member, was it ever, fails in a row."""

    fields, state, start = ("passes",), "active boolean, seen boolean, fails int", (False, False, 0)
    schema = "ticker string, effective_date date, is_active boolean"

    def __init__(self, grace: int) -> None:
        self.grace = grace

    def step(self, now: tuple, day: dt.date, passes: bool) -> tuple[tuple, list[dict]]:
        active, seen, fails = now
        if passes:
            return (True, True, 0), [] if active else [{"effective_date": day, "is_active": True}]
        if active and fails + 1 >= self.grace:
            return (False, seen, fails + 1), [{"effective_date": day, "is_active": False}]
        return (active, seen, fails + 1), []


def _by_ticker(days: DataFrame, processor: _InOrder, delay: str) -> DataFrame:
    timed = days.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", delay)
    flags = [F.coalesce(f, F.lit(False)).alias(f) for f in processor.fields]
    bucket = F.pmod(F.xxhash64("ticker"), F.lit(BUCKETS)).cast("int")
    dealt = timed.select(bucket.alias("bucket"), "ticker", F.unix_date("date").alias("day"), *flags, "ts")
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, processor.schema, "Append", "EventTime")


def session_events(days: DataFrame, delay: str) -> DataFrame:
    """Trade sessions as they open and close: stream (ticker, date, hold, signal) in any order within `delay`.

    One "open" row at the first signal of a run of holds, one "close" row at the first day after the run; together
    they are the rows of trade_sessions() over all days that the watermark has passed. Of repeated days the last one
    counts; days that come later than delay are dropped. Needs the RocksDB state store (see use_rocksdb()).
    """
    return _by_ticker(days, Sessions(), delay)


def membership_events(days: DataFrame, grace: int, delay: str) -> DataFrame:
    """The membership log as it grows: stream (ticker, date, passes) in any order within `delay`; entry at a pass, exit at
    the grace-th fail in a row. Order, repeats and late days as for session_events()."""
    return _by_ticker(days, Membership(grace), delay)


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers is kept by this state store alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replay(days: DataFrame, make: Callable[[DataFrame], DataFrame], cuts: Sequence[str], folder: str) -> DataFrame:
    """What make(stream) appends while a table of days (with ticker and date) comes in batches cut at the given dates,
    with a last batch of a far day that moves the watermark over all of them. The batches, the checkpoint and the
    output are in the folder, which driver and executors share. A batch has as many files as a shuffle has partitions."""
    spark = days.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = days if lo is None else days.where(F.col("date") >= F.lit(lo).cast("date"))
        part = part if hi is None else part.where(F.col("date") < F.lit(hi).cast("date"))
        part.coalesce(files).write.mode("append").parquet(f"{folder}/in")
    end = days.agg(F.max("date").alias("date")).select(*[F.date_add("date", 3650).alias(c) if c == "date" else F.lit(None).cast(k).alias(c) for c, k in days.dtypes])
    end.write.mode("append").parquet(f"{folder}/in")
    out = make(spark.readStream.schema(days.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"))
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
