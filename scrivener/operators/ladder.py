"""Sign-in attempts against a ladder of locks: the rule, a batch form and a stream with keyed state and timers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SECOND = 1_000_000
#: A waiting attempt as packed into state; those of an hour make one value, so state is read and written by the hour, not by the row.
WAITING = np.dtype([("at", "<i8"), ("attempt", "<i8"), ("right", "?")])
SLICE = 3600 * SECOND
#: Judged attempts given on at a time.
OUT_ROWS = 10_000
OUTCOME = "attempt long, at timestamp, outcome string, attempts_left int, lock_seconds long"


class State(NamedTuple):
    """Wrong attempts since the last lock, locks so far, and in microseconds the end of the last lock and the last wrong attempt."""

    wrong: int
    locks: int
    until: int
    seen: int


@dataclass(frozen=True)
class Ladder:
    """Every ``per_lock`` wrong attempts in a row close an account, each time for the next of ``seconds`` (the last stays).

    Defaults are fixed values. Attempts on a closed account are refused and change nothing. A right one forgets
    everything, and so does a pause of more than ``forget`` seconds since the last wrong one.
    """

    per_lock: int = 5
    seconds: tuple[int, ...] = (60, 300, 600)
    forget: int = 3600

    def forgotten(self, s: State, now: int) -> bool:
        return now - s.seen > self.forget * SECOND and now >= s.until

    def attempt(self, s: State | None, now: int, right: bool) -> tuple[State | None, str, int, int]:
        """(state after, outcome, attempts left, seconds locked) of one attempt; outcomes: right, wrong, locked, refused."""
        if s is not None and self.forgotten(s, now):
            s = None
        if s is not None and now < s.until:
            return s, "refused", 0, (s.until - now) // SECOND + 1
        if right:
            return None, "right", self.per_lock, 0
        wrong, locks, until = (s.wrong + 1, s.locks, s.until) if s else (1, 0, 0)
        if wrong < self.per_lock:
            return State(wrong, locks, until, now), "wrong", self.per_lock - wrong, 0
        wait = self.seconds[min(locks, len(self.seconds) - 1)]
        return State(0, locks + 1, now + wait * SECOND, now), "locked", 0, wait


def _attempts(df: DataFrame, key: str, order: str, at: str, right: Column) -> DataFrame:
    account = F.nullif(F.lower(F.trim(F.col(key).cast("string"))), F.lit(""))
    return df.select(account.alias("account"), F.col(order).cast("long").alias("attempt"), F.col(at).cast("timestamp").alias("at"), right.alias("right"))


def lock_ladder(df: DataFrame, key: str, order: str, at: str, right: Column, ladder: Ladder = Ladder()) -> DataFrame:
    """``account, attempt, at, outcome, attempts_left, lock_seconds`` of each attempt, by time, then ``order``.

    Accounts are compared without case and outer blanks; attempts without an account or
    time are never counted against any. A pause longer than the ladder remembers starts an
    account anew, so its attempts are dealt out by account and pause; a task holds one
    account's state and streams its sorted rows.
    """
    rows = _attempts(df, key, order, at, right)
    w = Window.partitionBy("account").orderBy("at", "attempt")
    pause = (F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > max(ladder.forget, *ladder.seconds) * SECOND).cast("int")
    dealt = rows.where("account is not null and at is not null").withColumn("_island", F.sum(F.coalesce(pause, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = dealt.withColumn("_us", F.unix_micros("at")).repartition("account", "_island").sortWithinPartitions("account", "_island", "at", "attempt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, group = None, None
        for batch in batches:
            out = []
            for account, island, now, right_ in zip(batch["account"], batch["_island"], batch["_us"], batch["right"]):
                if group != (account, island):
                    state, group = None, (account, island)
                state, *rest = ladder.attempt(state, int(now), bool(right_))
                out.append(rest)
            yield batch[["account", "attempt", "at"]].assign(**dict(zip(("outcome", "attempts_left", "lock_seconds"), zip(*out))))

    judged = dealt.mapInPandas(run, f"account string, {OUTCOME}")
    free = rows.where("account is null or at is null").select("account", "attempt", "at", F.when(F.col("right"), "right").otherwise("wrong").alias("outcome"), F.lit(ladder.per_lock).alias("attempts_left"), F.lit(0).cast("long").alias("lock_seconds"))
    return judged.union(free)


class LadderProcessor(StatefulProcessor):
    """The ladder over a stream: a value state an account, rows that wait for the watermark by the hour, one timer.

    Rows of a micro-batch come in any order, so they wait until the watermark has passed
    them and are then judged by time. The timer stands at the first waiting row, or where
    nothing waits at the moment the account is forgotten; then its state is removed.
    """

    def __init__(self, ladder: Ladder):
        self.ladder = ladder

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "wrong int, locks int, until long, seen long")
        self.waiting = handle.getMapState("waiting", "slice long", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        if not key[0]:  # rows without an account pass the watermark on and are judged by nobody
            return
        come = [np.rec.fromarrays([batch[c].to_numpy() for c in ("us", "attempt", "right")], dtype=WAITING) for batch in rows]
        yield from self._judged(key, timerValues, np.concatenate(come) if come else np.empty(0, WAITING))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._judged(key, timerValues, np.empty(0, WAITING))

    def close(self) -> None:
        pass

    def _judged(self, key, timerValues, come):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        slices = sorted(k[0] for k in self.waiting.keys()) if self.waiting.exists() else []
        held = lambda at: np.frombuffer(bytes(self.waiting.getValue((at,))[0]), WAITING)
        due, emptied = [come[come["at"] <= passed]], set()
        for at in slices:
            if at * SLICE <= passed:
                rows = held(at)
                due.append(rows[rows["at"] <= passed])
                if len(rest := rows[rows["at"] > passed]):
                    self.waiting.updateValue((at,), (rest.tobytes(),))
                else:
                    self.waiting.removeKey((at,))
                    emptied.add(at)
        late = np.sort(come[come["at"] > passed], order="at")
        kept = {at for at in slices if at not in emptied}
        for rows in np.split(late, np.flatnonzero(np.diff(late["at"] // SLICE)) + 1) if len(late) else ():
            at = int(rows["at"][0] // SLICE)
            self.waiting.updateValue((at,), ((held(at).tobytes() if at in kept else b"") + rows.tobytes(),))
            kept.add(at)
        state = State(*map(int, self.state.get())) if self.state.exists() else None
        ready = np.sort(np.concatenate(due), order=["at", "attempt", "right"])
        for start in range(0, len(ready), OUT_ROWS):
            part, said = ready[start : start + OUT_ROWS], []
            for at, right in zip(part["at"].tolist(), part["right"].tolist()):
                state, *rest = self.ladder.attempt(state, at, right)
                said.append(rest)
            outcome, left, seconds = zip(*said)
            yield pd.DataFrame({"account": key[0], "attempt": part["attempt"], "at": pd.to_datetime(part["at"], unit="us", utc=True), "outcome": outcome, "attempts_left": left, "lock_seconds": seconds})
        if state is not None and not kept and self.ladder.forgotten(state, passed):
            state = None
        self.state.update(tuple(state)) if state is not None else self.state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if kept or state is not None:
            first = int(held(min(kept))["at"].min()) if kept else max(state.seen + self.ladder.forget * SECOND, state.until)
            self.handle.registerTimer(max(first, passed) // 1000 + 1)


def lock_ladder_stream(stream: DataFrame, key: str, order: str, at: str, right: Column, *, late: str = "10 minutes", ladder: Ladder = Ladder()) -> DataFrame:
    """:func:`lock_ladder` over a stream, each attempt given once the watermark has passed it; those without account or time are left out.

    Needs the RocksDB state store. The state is exactly once: a restart from the checkpoint goes on where
    the last committed batch ended.
    """
    rows = _attempts(stream, key, order, at, right).withWatermark("at", late)
    return rows.withColumns({"us": F.unix_micros("at"), "account": F.coalesce("account", F.lit("")), "attempt": F.coalesce("attempt", F.lit(0)), "right": F.coalesce("right", F.lit(False))}).groupBy("account").transformWithStateInPandas(LadderProcessor(ladder), f"account string, {OUTCOME}", "Append", "EventTime")
