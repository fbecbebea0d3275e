"""Keyed streams over shuffled batches against the batch operators, with a restart from the checkpoint."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from barsmith.operators import sessions
from barsmith.streaming import incremental as inc

START, DAYS, TICKERS, BATCH = dt.date(2022, 1, 3), 90, 12, 15
SCHEMA = "ticker string, date date, hold boolean, signal boolean"


def all_days(seed):
    rng = random.Random(seed)
    out = []
    for k in range(TICKERS):
        hold = False
        for n in range(DAYS):
            hold = hold ^ (rng.random() < 0.2)
            if rng.random() < 0.85:
                out.append((f"T{k}", START + dt.timedelta(n), hold, rng.random() < 0.3))
    return out


def batches(rows, seed):
    """Files of about BATCH days in order, every row up to 6 days away from its place; the last one moves the watermark."""
    rng = random.Random(seed)
    out = {}
    for r in rows:
        out.setdefault(max(0, (r[1] - START).days + rng.randint(-6, 6)) // BATCH, []).append(r)
    files = [out[k] for k in sorted(out)]
    for f in files:
        rng.shuffle(f)
    return [*files, [("END", START + dt.timedelta(3000), False, False)]]


def run(spark, make, folder, files, before):
    """The stream over the first files, then, started again from its checkpoint, over the others."""
    os.makedirs(f"{folder}/in")
    result = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    for part in (files[:before], files[before:]):
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        result.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    inc.use_rocksdb(spark)
    yield spark
    spark.conf.unset(key)


def test_sessions_of_shuffled_batches(rocks, tmp_path):
    rows = all_days(1)
    got = run(rocks, lambda s: inc.session_events(s, "20 days"), f"{tmp_path}", batches(rows, 2), 3).collect()
    days = rocks.createDataFrame(rows, SCHEMA)
    want = sessions.trade_sessions(days, F.col("hold"), F.col("signal")).collect()
    assert sorted((r.ticker, r.session_id, r.entry_date) for r in got if r.event == "open") == sorted((r.ticker, r.session_id, r.entry_date) for r in want)
    closed = lambda x: sorted((r.ticker, r.session_id, r.entry_date, r.exit_date, r.last_hold) for r in x)
    assert closed(r for r in got if r.event == "close") == closed(r for r in want if r.exit_date)
    assert sum(r.exit_date is None for r in want) > 0 and len(want) > 40


def test_membership_of_shuffled_batches(rocks, tmp_path):
    rows = all_days(5)
    got = run(rocks, lambda s: inc.membership_events(s.withColumnRenamed("hold", "passes"), 3, "20 days"), f"{tmp_path}", batches(rows, 6), 4)
    want = sessions.membership_log(rocks.createDataFrame(rows, SCHEMA), F.col("hold"), 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_last_writes(spark, tmp_path):
    schema = "k string, at int, v string"
    for rows in ([("a", 1, "x"), ("b", 5, "y")], [("a", 3, "z"), ("b", 2, "late")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    inc.last_writes(stream, ["k"], "at").writeStream.format("memory").queryName("last_rows").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("last_rows").collect())) == [("a", 3, "z"), ("b", 5, "y")]


def test_a_bucket_keeps_the_days_of_a_batch_as_one_row_of_state():
    import pandas as pd

    class List(list):
        get, put, appendValue = lambda self: list(self), lambda self, rows: self.__setitem__(slice(None), rows), list.append

    class Handle:
        def __init__(self):
            self.lists, self.timers = {}, []

        def getListState(self, name, schema):
            return self.lists.setdefault(name, List())

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 5 * 86_400_000

    handle, bucket = Handle(), inc.Membership(2)
    bucket.init(handle)
    days = [(f"T{k}", day, k % 2 == day % 2) for k in range(50) for day in (4, 3, 9)]
    list(bucket.handleInputRows((1,), iter([pd.DataFrame(days, columns=["ticker", "day", "passes"])]), None))
    assert len(handle.lists["waiting"]) == 1 and handle.timers == [9 * 86_400_000]
    got = pd.concat(bucket.handleExpiredTimer((1,), Times(), None))
    assert len(got) == 50 and got["is_active"].all() and len(handle.lists["waiting"]) == 1 and len(handle.lists["now"]) == 50


def taken(bucket, days, passed):
    """What a bucket gives, in a row for each timer that fires, when a batch has brought it days and the watermark is at passed."""
    import pandas as pd

    class List(list):
        get, put, clear, appendValue = lambda self: list(self), lambda self, rows: self.__setitem__(slice(None), rows), list.clear, list.append

    class Handle:
        def __init__(self):
            self.lists, self.timers = {}, set()

        def getListState(self, name, schema):
            return self.lists.setdefault(name, List())

        def registerTimer(self, at):
            self.timers.add(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return passed * 86_400_000

    handle = Handle()
    bucket.init(handle)
    list(bucket.handleInputRows((1,), iter([pd.DataFrame(days, columns=["ticker", "day", *bucket.fields])]), None))
    fired = [at for at in handle.timers if at <= passed * 86_400_000]
    got = [list(bucket.handleExpiredTimer((1,), Times(), None)) for _ in fired]
    return [[tuple(r) for frame in frames for r in frame.itertuples(index=False)] for frames in got], len(handle.lists["waiting"])


def day(n):
    return dt.date(1970, 1, 1) + dt.timedelta(n)


def test_a_far_day_does_not_hold_back_the_members_of_its_bucket():
    """All days of a replay, with the far one that ends it, may come in one batch."""
    got, waiting = taken(inc.Membership(2), [("A", 3, True), ("B", 10, True), ("A", 8, False), ("A", 9, False), (None, 3660, False)], 3630)
    assert len(got) == 1 and waiting == 1
    assert sorted(got[0]) == [("A", day(3), True), ("A", day(9), False), ("B", day(10), True)]


def test_a_far_day_does_not_hold_back_the_sessions_of_its_bucket():
    days = [("A", 3, True, True), ("A", 5, True, False), ("A", 7, False, False), ("B", 90, True, True), ("B", 91, False, True), (None, 3741, False, False)]
    got, waiting = taken(inc.Sessions(), days, 3711)
    assert sorted(len(rows) for rows in got) == [0, 4] and waiting == 1  # the first timer takes all days that have passed
    closed = [(t, n, lo, hi, last) for t, event, n, lo, hi, last in got[0] if event == "close"]
    assert closed == [("A", 1, day(3), day(7), day(5)), ("B", 1, day(90), day(91), day(90))]
