"""Sign-in locks: the batch form and the stream against a plain state machine."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivener.operators import ladder as L
from scrivener.streaming import windows

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


class Guard:
    """One dictionary of accounts, as a sign-in page keeps it."""

    def __init__(self):
        self.wrong, self.locks, self.until, self.seen = {}, {}, {}, {}

    def forget(self, a):
        for d in (self.wrong, self.locks, self.until, self.seen):
            d.pop(a, None)

    def attempt(self, name, now, right):
        a = (name or "").strip().lower()
        if not a:
            return "right" if right else "wrong", 5, 0
        for x in [x for x in self.seen if now - self.seen[x] > 3_600_000_000 and now >= self.until.get(x, 0)]:
            self.forget(x)
        if now < self.until.get(a, 0):
            return "refused", 0, int((self.until[a] - now) / 1e6) + 1
        if right:
            self.forget(a)
            return "right", 5, 0
        self.seen[a] = now
        self.wrong[a] = self.wrong.get(a, 0) + 1
        if self.wrong[a] < 5:
            return "wrong", 5 - self.wrong[a], 0
        wait = (60, 300, 600)[min(self.locks.get(a, 0), 2)]
        self.locks[a], self.wrong[a], self.until[a] = self.locks.get(a, 0) + 1, 0, now + wait * 1_000_000
        return "locked", 0, wait


def attempts_of(seed, n=1500):
    """Bursts, long pauses, attempts at one moment and on the edge of a lock."""
    rng, now, out = random.Random(seed), 0, []
    for i in range(n):
        now += rng.choice([0, 1, 1_000_000, 7_000_000, 60_000_000, 300_000_000, 600_000_000, 3_600_000_000, 3_600_000_001] if rng.random() < 0.3 else [500_000, 3_000_000])
        out.append((rng.choice(["ann", "ANN ", "bob", "cy", "ann"]), i, T0 + dt.timedelta(microseconds=now), rng.random() < 0.04))
    return out


def expected(rows):
    guard, out = Guard(), {}
    for name, i, at, right in sorted(rows, key=lambda r: (r[2], r[1])):
        out[i] = guard.attempt(name, round((at - T0) / dt.timedelta(microseconds=1)), right)
    return out


SCHEMA = "name string, i long, at timestamp, right boolean"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_ladder_against_a_state_machine(spark, seed):
    rows = attempts_of(seed)
    got = L.lock_ladder(spark.createDataFrame(rows, SCHEMA).repartition(3), "name", "i", "at", F.col("right"))
    want = expected(rows)
    assert {r["attempt"]: (r["outcome"], r["attempts_left"], r["lock_seconds"]) for r in got.collect()} == want
    assert {"right", "wrong", "locked", "refused"} == {v[0] for v in want.values()} and {60, 300, 600} <= {v[2] for v in want.values() if v[0] == "locked"}


def test_attempts_without_account_or_time(spark):
    rows = [(None, 1, T0, False), (" ", 2, T0, True), ("ann", 3, None, False), ("ann", 4, T0, None)] + [(None, 10 + i, T0, False) for i in range(9)]
    got = {r["attempt"]: r for r in L.lock_ladder(spark.createDataFrame(rows, SCHEMA), "name", "i", "at", F.col("right")).collect()}
    assert len(got) == 13 and all(got[k]["attempts_left"] == 5 and got[k]["lock_seconds"] == 0 for k in got if k != 4)
    assert got[2]["outcome"] == "right" and got[4]["outcome"] == "wrong" and got[4]["attempts_left"] == 4
    assert L.lock_ladder(spark.createDataFrame([], SCHEMA), "name", "i", "at", F.col("right")).count() == 0


def test_stream_agrees_across_batches_and_a_restart(spark, tmp_path):
    """Three deliveries with rows out of order within the delay; the query is stopped and started again between them."""
    windows.with_rocksdb(spark)
    rows = attempts_of(4, 240)
    parts = [rows[:90], rows[90:170], rows[170:] + [(None, None, T0 + dt.timedelta(days=900), None)]]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in parts:
        spark.createDataFrame(part[::-1], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = L.lock_ladder_stream(spark.readStream.schema(SCHEMA).parquet(folder), "name", "i", "at", F.col("right"), late="1 minute")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["attempt"]: (r["outcome"], r["attempts_left"], r["lock_seconds"]) for r in spark.read.parquet(out).collect()}
    want = expected(rows)
    assert got == want and spark.read.parquet(out).count() == len(rows)
    batch = L.lock_ladder(spark.createDataFrame(rows, SCHEMA), "name", "i", "at", F.col("right"))
    assert {tuple(r) for r in batch.collect()} == {tuple(r) for r in spark.read.parquet(out).select(*batch.columns).collect()}


class _Map(dict):
    """A map state in memory that counts the calls which Spark answers one by one."""

    calls = 0

    def exists(self):
        return bool(self)

    def getValue(self, key):
        _Map.calls += 1
        return self[key]

    def updateValue(self, key, value):
        _Map.calls += 1
        self[key] = value

    def removeKey(self, key):
        del self[key]


class _Value(list):
    def exists(self):
        return bool(self)

    def get(self):
        return tuple(self)

    def update(self, value):
        self[:] = value


class _Handle:
    def __init__(self):
        self.value, self.map, self.timers = _Value(), _Map(), []

    def getValueState(self, *_):
        return self.value

    def getMapState(self, *_):
        return self.map

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class _Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_waiting_attempts_are_kept_by_the_hour_not_by_the_row():
    """20,000 attempts over two days of one account, in any order: some 50 values of state, and the outcomes of the plain rule."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(1, 48 * 3600) * L.SECOND, rng.random() < 0.1) for i in range(20_000)]
    frame = pd.DataFrame(rows, columns=["attempt", "us", "right"])
    handle, processor = _Handle(), L.LadderProcessor(L.Ladder())
    processor.init(handle)
    _Map.calls = 0
    assert list(processor.handleInputRows(("a",), iter([frame[:9_000], frame[9_000:]]), _Watermark(0))) == []
    assert _Map.calls <= 60 and len(handle.timers) == 1
    got = [t for ms in (30 * 3600_000, 60 * 3600_000) for df in processor.handleExpiredTimer(("a",), _Watermark(ms), None) for t in df.itertuples()]
    state, said = None, []
    for at, attempt, right in sorted((at, i, r) for i, at, r in rows):
        state, *rest = L.Ladder().attempt(state, at, right)
        said.append((attempt, *rest))
    assert [(t.attempt, t.outcome, t.attempts_left, t.lock_seconds) for t in got] == said and not handle.map
