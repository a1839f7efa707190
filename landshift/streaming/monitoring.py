"""Stateful monitoring: token buckets by key, latest run states, an append-only audit log."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Burst and refill a second of the general and of the run budget; seconds until an idle key is forgotten.
GENERAL, RUNS, IDLE_S = (120.0, 2.0), (12.0, 0.2), 600.0
DECISIONS = "key string, seq long, ts double, is_run boolean, allowed boolean, retry_after long"


class Bucket:
    def __init__(self, capacity: float, rate: float, tokens: float | None = None, at: float | None = None):
        self.capacity, self.rate = capacity, rate
        self.tokens, self.at = capacity if tokens is None else tokens, at

    def take(self, now: float) -> int | None:
        """None if a token was there, else the seconds until one is."""
        if self.at is not None:
            self.tokens = min(self.capacity, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = now
        if self.tokens >= 1:
            self.tokens -= 1
            return None
        return math.ceil((1 - self.tokens) / self.rate) if self.rate > 0 else 60


def fold(events: pd.DataFrame, general: Bucket, runs: Bucket) -> pd.DataFrame:
    """Decisions on one key's events in order; the general token is spent even when the run budget then refuses."""
    out = []
    for seq, ts, is_run in events.sort_values(["ts", "seq"])[["seq", "ts", "is_run"]].itertuples(index=False):
        if general.at is not None and ts - general.at >= IDLE_S:  # forgotten meanwhile
            general.tokens, runs.tokens = general.capacity, runs.capacity
        wait = general.take(ts)
        if wait is None and is_run:
            wait = runs.take(ts)
        out.append((seq, ts, bool(is_run), wait is None, wait))
    return pd.DataFrame(out, columns=["seq", "ts", "is_run", "allowed", "retry_after"])


def rate_limited(events: DataFrame) -> DataFrame:
    """Batch twin: events of key, seq, ts (seconds) and is_run with their decisions; a key's events stream past its two buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, general, runs = (), Bucket(*GENERAL), Bucket(*RUNS)
        for pdf in batches:
            for key, part in pdf.groupby("key", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                if last != (key,):  # else the key goes on from the batch before
                    last, general, runs = (key,), Bucket(*GENERAL), Bucket(*RUNS)
                done = fold(part, general, runs)
                done.insert(0, "key", key)
                yield done.astype({"retry_after": "Int64"})

    ordered = events.select("key", "seq", "ts", "is_run").repartition("key").sortWithinPartitions("key", F.asc_nulls_last("ts"), F.asc_nulls_last("seq"))
    return ordered.mapInPandas(run, DECISIONS)


def rate_limited_stream(events: DataFrame) -> DataFrame:
    """The same over a stream; a key's state is four numbers and ends after IDLE_S without events."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        g, gt, r, rt = state.get if state.exists else (None,) * 4
        general, runs = Bucket(*GENERAL, g, gt), Bucket(*RUNS, r, rt)
        rows = pd.concat(list(batches))
        done = fold(rows, general, runs)
        state.update((general.tokens, general.at, runs.tokens, runs.at))
        state.setTimeoutDuration(int(IDLE_S * 1000))
        done.insert(0, "key", key[0])
        yield done.astype({"retry_after": "Int64"})

    return events.groupBy("key").applyInPandasWithState(one, DECISIONS, "g double, gt double, r double, rt double", "append", GroupStateTimeout.ProcessingTimeTimeout)


class OrderedBuckets(StatefulProcessor):
    """Two buckets a key; events wait until the watermark has passed them, so late ones take their turn by time.

    One timer a key stands at its earliest waiting event, or, where none waits, where the key has
    been idle for IDLE_S and its state ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getValueState("buckets", "g double, gt double, r double, rt double")
        self.waiting = handle.getListState("waiting", "seq long, ts double, is_run boolean")

    def alarm(self, at: float) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(math.ceil(at * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get())
        for pdf in rows:
            held += [(int(a), float(b), bool(c)) for a, b, c in pdf[["seq", "ts", "is_run"]].itertuples(index=False)]
        self.waiting.put(held)
        # A timer in the past of the watermark would fire at once: late rows are answered in this batch's timers.
        self.alarm(max(min(x[1] for x in held), timerValues.getCurrentWatermarkInMs() / 1000))
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "ts": pd.Series([], dtype=float), "is_run": pd.Series([], dtype=bool), "allowed": pd.Series([], dtype=bool), "retry_after": pd.Series([], dtype="Int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000
        held = list(self.waiting.get())
        due, later = [x for x in held if x[1] <= until], [x for x in held if x[1] > until]
        old = self.buckets.get() if self.buckets.exists() else (None,) * 4
        general, runs = Bucket(*GENERAL, *old[:2]), Bucket(*RUNS, *old[2:])
        if due:
            done = fold(pd.DataFrame(due, columns=["seq", "ts", "is_run"]), general, runs)
            self.buckets.update((general.tokens, general.at, runs.tokens, runs.at))
            done.insert(0, "key", key[0])
            yield done.astype({"retry_after": "Int64"})
        if later:
            self.waiting.put(later)
            self.alarm(min(x[1] for x in later))
        else:
            self.waiting.clear()
            if general.at is not None and general.at + IDLE_S > until:
                self.alarm(general.at + IDLE_S)
            else:
                self.buckets.clear()

    def close(self) -> None:
        pass


def rate_limited_in_order(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """The decisions of ``rate_limited`` over a stream whose events come out of order by no more than ``delay``.

    Needs the RocksDB state store (``stream_settings``).
    """
    timed = events.withColumn("at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(OrderedBuckets(), DECISIONS, "append", "eventTime")


def stream_settings(spark) -> None:
    """Keyed state with timers needs a store that can hold it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CompletionEdges(StatefulProcessor):
    """The last status of each run; a poll that finds it completed for the first time since it was not is passed on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values(["ts", "seq"])
        before = [self.last.get()[0] if self.last.exists() else "", *polls["status"].tolist()[:-1]]
        edge = [s == "completed" and b != "completed" for s, b in zip(polls["status"], before, strict=True)]
        self.last.update((polls["status"].iloc[-1],))
        yield polls.loc[edge, ["seq", "ts"]].assign(run_id=key[0])[["run_id", "seq", "ts"]]

    def close(self) -> None:
        pass


def completion_stream(polls: DataFrame) -> DataFrame:
    """Polls (run_id, seq, ts, status) at which a run is seen completed and was not at the poll before: when its findings are to be read again."""
    return polls.groupBy("run_id").transformWithStateInPandas(CompletionEdges(), "run_id string, seq long, ts double", "append", "none")


def watch(polls: DataFrame, then: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds"):
    """Runs ``then`` on the completion edges of each round of polls, a round ``every`` five seconds."""
    return completion_stream(polls).writeStream.foreachBatch(then).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def audit_rows(events: DataFrame) -> DataFrame:
    """One row of the audit log for each request; the user is never known."""
    return events.select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("user_name"), F.col("event_type").alias("action"), "ts")


def audit_to(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream's audit rows to a Parquet folder."""
    return audit_rows(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
