"""Decisions on a stream that depend on the key's past: bursts of a user, retries of a stage.

State is kept by key in RocksDB beside the query's checkpoint; timers in event time forget what no
longer counts, or say that a retry is due. A micro-batch hands over the rows of a key, which are
taken in order of time; a query that starts again goes on from its checkpoint. Keys have few rows each, so
these come and go as rows, in batches over many keys: a table for each key costs more than its rows do.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lectern.functions.moments import backoff
from lectern.operators.jobs import ATTEMPTS

WINDOW_S = 60.0
#: Seconds before the first retry, and at most.
BASE_S, MOST_S = 30.0, 3600.0
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; it also keeps state out of the JVM's heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _rows(arrived: Iterator[Row], *order: str) -> list[Row]:
    """The rows in order, nulls last."""
    return sorted(arrived, key=lambda r: [(r[c] is None, r[c]) for c in order])


class _Burst(StatefulProcessor):
    """The times of a key's last allowed events: no more than are allowed in a window."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "at double")

    def handleInputRows(self, key, rows, timerValues):
        recent = deque(t[0] for t in self.times.get())
        held = bool(recent)
        for r in _rows(rows, "at", "event_id"):
            while recent and r.at - recent[0] >= WINDOW_S:
                recent.popleft()
            allowed = len(recent) < self.most
            if allowed:
                recent.append(r.at)
            yield Row(key=key[0], event_id=r.event_id, allowed=allowed)
        if recent:
            self.times.put([(t,) for t in recent])
            # A key without times has no timer.
            for old in list(self.handle.listTimers()) if held else ():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((recent[-1] + WINDOW_S) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.times.clear()  # the last allowed event is over a minute old
        return iter(())

    def close(self) -> None:
        pass


def burst(events: DataFrame, per_minute: int, key: str = "user_id", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """``operators.events.burst`` on a stream: (key, event_id, allowed), at most so many allowed events in any 60 seconds.

    The same where no row comes after a later one in an earlier micro-batch; rows later than ``late`` are
    dropped. State is at most ``per_minute`` numbers a key, and goes a minute after the last of them.
    """
    use_rocks(events.sparkSession)
    of = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(ts).cast("double").alias("at"), "event_id").withWatermark("ts", late)
    got = rows.groupBy("key").transformWithState(_Burst(per_minute), f"key {of[key]}, event_id {of['event_id']}, allowed boolean", "Append", "EventTime")
    return got.select(F.col("key").alias(key), "event_id", "allowed")


class _Retry(StatefulProcessor):
    """A job's failures since it last succeeded or was given up, and the time of its next attempt."""

    def __init__(self, attempts: dict[str, int], base: float):
        self.attempts, self.base = attempts, base

    def init(self, handle) -> None:
        self.handle, self.failures = handle, handle.getValueState("failures", "n int")

    def _forget(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)

    def handleInputRows(self, key, rows, timerValues):
        held = self.failures.get()
        n, due = (held[0] if held else 0), None
        for r in _rows(rows, "at", "event_id"):
            if not isinstance(r.error, str):
                n, due, state = 0, None, "done"
            else:
                n += 1
                wait = min(max(self.base * 2 ** (n - 1), r.at_least or 0.0), MOST_S)
                state, due = ("failed", None) if n >= self.attempts.get(key[1], 3) else ("queued", r.at + wait)
            yield Row(doc_id=key[0], stage=key[1], event_id=r.event_id, state=state, attempts=n, next_attempt_at=due)
            n = 0 if state == "failed" else n
        # A job without failures has neither state nor timer.
        if held:
            self._forget()
        if n:
            self.failures.update((n,))
            if due is not None:
                self.handle.registerTimer(int(due * 1000))
        elif held:
            self.failures.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The attempt is due: the job is handed out again."""
        n = self.failures.get()[0]
        yield Row(doc_id=key[0], stage=key[1], event_id=None, state="due", attempts=n, next_attempt_at=expiredTimerInfo.getExpiryTimeInMs() / 1000)

    def close(self) -> None:
        pass


_RETRY = "doc_id {doc}, stage string, event_id {event}, state string, attempts int, next_attempt_at double"


def retries(outcomes: DataFrame, base: float = BASE_S, late: str = "1 minute") -> DataFrame:
    """What follows each outcome (doc_id, stage, ts, event_id, error, at_least) of a stream of attempts: done, queued with its next time, or failed when attempts are used up.

    A null error is success. Rows of state "due" come when a job's time has come by the stream's clock
    and nothing was heard of it since. State is one number a job that is not done.
    """
    use_rocks(outcomes.sparkSession)
    of = {f.name: f.dataType.simpleString() for f in outcomes.schema}
    rows = outcomes.select("doc_id", "stage", "ts", F.col("ts").cast("double").alias("at"), "event_id", "error", "at_least").withWatermark("ts", late)
    return rows.groupBy("doc_id", "stage").transformWithState(_Retry(ATTEMPTS, base), _RETRY.format(doc=of["doc_id"], event=of["event_id"]), "Append", "EventTime")


def retries_of(outcomes: DataFrame, base: float = BASE_S) -> DataFrame:
    """The same of a table, by windows: failures are counted from the last success, and from the start again after as many as a stage has attempts."""
    by = Window.partitionBy("doc_id", "stage").orderBy("ts", "event_id")
    most = F.coalesce(F.create_map(*(F.lit(x) for kv in ATTEMPTS.items() for x in kv))[F.col("stage")], F.lit(3))
    failed = F.col("error").isNotNull()
    rows = outcomes.withColumn("run", F.sum(F.when(failed, 0).otherwise(1)).over(by))
    nth = F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy("doc_id", "stage", "run").orderBy("ts", "event_id"))
    rows = rows.withColumn("attempts", F.when(failed, (nth - 1) % most + 1).otherwise(0).cast("int"))
    out = failed & (F.col("attempts") == most)
    wait = F.least(backoff(F.col("attempts") - 1, base, F.coalesce("at_least", F.lit(0.0))), F.lit(MOST_S))
    state = F.when(~failed, "done").when(out, "failed").otherwise("queued")
    return rows.select("doc_id", "stage", "event_id", state.alias("state"), "attempts", F.when(failed & ~out, F.col("ts").cast("double") + wait).alias("next_attempt_at"))
