"""Run the event operators on streams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from leadloom.operators import events as E
from leadloom.operators.crawl import CRAWL_TTL_SECONDS
from leadloom.session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int = 100
               ) -> DataFrame:
    """Stream over parquet files of one table; the schema is that of the files present.

    What ``pattern`` names may be files or folders of files. It stands in braces, a glob even for a
    plain name: a stream takes a path without one for a folder.
    """
    path = f"{folder.rstrip('/')}/{{{pattern}}}"
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


class _Seen(StatefulProcessor):
    """Per key the time of the last row let through; forgotten when its time to live is over."""

    def __init__(self, ttl_ms: int) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        last = self._last.get()[0] if self._last.exists() else None
        passed = []
        for at in sorted(t for b in rows for t in b["ms"].tolist()):
            if last is None or at > last + self._ttl:
                last = at
                passed.append((*key, at))
        if passed:
            self._last.update((last,))
            self._handle.registerTimer(last + self._ttl + 1)
        yield pd.DataFrame(passed, columns=["key", "ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a later row may have renewed the key since this timer was set
        if self._last.exists() and \
                self._last.get()[0] + self._ttl < expiredTimerInfo.getExpiryTimeInMs():
            self._last.clear()
        yield pd.DataFrame(columns=["key", "ms"])

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, key: str = "url", at: str = "timestamp",
               ttl_seconds: int = CRAWL_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Rows (key, at) whose key was not let through within the time to live before.

    The watermark is this engine's addition: state that it has passed is dropped. Needs the
    RocksDB state store.
    """
    slim = events.select(F.col(key).alias("key"), F.col(at).alias("at"),
                         F.unix_millis(at).alias("ms")).withWatermark("at", lateness)
    return slim.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Seen(ttl_seconds * 1000), outputStructType="key string, ms long",
        outputMode="Append", timeMode="EventTime",
    ).select(F.col("key").alias(key), F.timestamp_millis("ms").alias(at))


@contextmanager
def rocksdb(spark: SparkSession):
    """State store for jobs with their own state, the session's setting put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def start(stream: DataFrame, path: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write every micro-batch to its own folder; a retried batch replaces its folder."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    return (stream.writeStream.foreachBatch(save).outputMode(mode)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there and return the written rows with their ``batch``."""
    path = fresh_path(spark, name)
    start(stream, path, mode).awaitTermination()
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")


def latest_rows(written: DataFrame, *keys: str) -> DataFrame:
    """Newest version of each key's row from an update-mode output."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(
        *keys, "r.*")


def last_batch(written: DataFrame) -> DataFrame:
    """Rows of the newest batch from a complete-mode output."""
    newest = written.agg(F.max("batch").alias("b")).scalar()
    return written.filter(F.col("batch") == newest).drop("batch")


def alert_hot_leads(events: DataFrame, path: str) -> StreamingQuery:
    return start(E.hot_leads(events), path)


# -- event time ------------------------------------------------------------------------

#: How long an event may be behind the newest one and still count.
LATENESS = "1 hour"


def marked_late(spark: SparkSession, events: DataFrame, name: str, window: str = "1 day",
                lateness: str = LATENESS) -> DataFrame:
    """The stream's rows as written, with ``late``: their window had gone when they came.

    ``funnel_windows`` leaves out just these rows, so the two together hold every event once. A
    window that the watermark has passed is given out at the end of a batch, and rows that come
    after that are late: the watermark in force for batch n is that of the batches up to n - 2.
    The newest time of each batch is written, so a batch that is retried marks the same rows.
    """
    path = fresh_path(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.agg(F.max("timestamp").alias("newest")).write.mode("overwrite").parquet(
                f"{path}/newest/batch={batch_id}")
            late = F.lit(False)
            if batch_id >= 2:
                seen = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/newest")
                passed = seen.filter(F.col("batch") <= batch_id - 2).agg(
                    F.date_trunc("millisecond", F.max("newest")) - F.expr(f"interval {lateness}")).scalar()
                late = F.coalesce(F.window("timestamp", window)["end"] <= passed, F.lit(False))
            batch.withColumn("late", late).write.mode("overwrite").parquet(
                f"{path}/out/batch={batch_id}")
        finally:
            batch.unpersist()

    events.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")


def funnel_windows(events: DataFrame, window: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Events per session and window, once the watermark has passed the window (append mode).

    A window's counts leave the state when they are given out.
    """
    return E.funnel(events.withWatermark("timestamp", lateness), F.window("timestamp", window))


class _Status(StatefulProcessor):
    """Per bucket of sessions: the last status event of each kind of a session, and its newest time.
    A session is dropped when it was quiet for longer than its time to live.

    Buckets, because a call and its state cost the same for one session as for hundreds.
    """

    def __init__(self, ttl_ms: int) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "sessions string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        sessions, touched = self._sessions(), set()
        for frame in rows:
            for session, *event in zip(*[frame[c].tolist() for c in ["session_id", *_STATUS_EVENTS]]):
                us, kind, payload = event = [None if pd.isna(x) else x for x in event]
                us = event[0] = None if us is None else int(us)
                newest, last = sessions.get(session, (-1, {}))
                held = last.get(kind)
                if held is None or _place(held) <= _place(event):
                    last[kind] = event
                sessions[session] = (newest if us is None else max(newest, us), last)
                touched.add(session)
        self._keep(sessions)
        yield _status_rows({s: sessions[s] for s in touched}, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        fired = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(timerValues.getCurrentWatermarkInMs() - 1, fired)
        sessions = self._sessions()
        gone = {s: x for s, x in sessions.items() if self._ends(x[0]) <= passed}
        # the timer that fired is deleted after this call; the one for the rest is another
        self._keep({s: x for s, x in sessions.items() if s not in gone}, fired)
        yield _status_rows(gone, True)

    def close(self) -> None:
        pass

    def _ends(self, newest: int) -> int:
        return newest // 1000 + self._ttl + 1

    def _sessions(self) -> dict:
        held = json.loads(self._held.get()[0]) if self._held.exists() else []
        return {s: (newest, {e[1]: e for e in events}) for s, newest, events in held}

    def _keep(self, sessions: dict, fired: int | None = None) -> None:
        """Store the sessions, and one timer for the first of them to end."""
        for timer in list(self._handle.listTimers()):
            if timer != fired:
                self._handle.deleteTimer(timer)
        if not sessions:
            self._held.clear()
            return
        self._held.update((json.dumps(
            [[s, newest, list(last.values())] for s, (newest, last) in sessions.items()]),))
        self._handle.registerTimer(self._ends(min(newest for newest, _ in sessions.values())))


def _place(event: list) -> tuple:
    """Order of a session's events of one kind; those without a time or payload come last."""
    us, _, payload = event
    return us is None, us or 0, payload is None, payload or ""


def _status_rows(sessions: dict, expired: bool) -> pd.DataFrame:
    return pd.DataFrame(
        [(s, *e, expired) for s, (_, last) in sessions.items() for e in last.values()],
        columns=["session_id", *_STATUS_EVENTS, "expired"], dtype=object)


_STATUS_EVENTS = ["us", "event_type", "payload"]


def session_states(events: DataFrame, ttl_seconds: int = 7 * 86_400,
                   lateness: str = LATENESS, buckets: int = 256) -> DataFrame:
    """The events that decide a session's status: at most one of each kind per session.

    With each batch the sessions that it touched come out whole, so the newest batch of a session
    stands for it: ``status_of`` what was written is its status. A session that was quiet for
    ``ttl_seconds`` (the watermark tells) comes out a last time with ``expired`` and leaves the
    state. Events that the watermark has passed do not count. State is kept by bucket of sessions, and
    ``buckets`` is not to change under a checkpoint. Needs the RocksDB state store.
    """
    slim = E.of_types(events, E.STATUS_EVENTS).select(
        "session_id", "timestamp", F.unix_micros("timestamp").alias("us"), "event_type",
        "payload", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket")
    ).withWatermark("timestamp", lateness)
    return slim.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Status(ttl_seconds * 1000),
        outputStructType="session_id string, us long, event_type string, payload string, "
                         "expired boolean",
        outputMode="Update", timeMode="EventTime")


def status_of(written: DataFrame) -> DataFrame:
    """Status rows of the states that ``session_states`` gave out (with their ``batch``)."""
    newest = W.partitionBy("session_id")
    last = written.withColumn("_last", F.max("batch").over(newest)).filter("batch = _last")
    events = last.withColumn("timestamp", F.timestamp_micros("us"))
    expired = last.groupBy("session_id").agg(F.bool_or("expired").alias("expired"))
    return E.session_status(events).join(expired, "session_id")


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows held in state after each micro-batch of a query."""
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in map(
        lambda p: json.loads(p.json), query.recentProgress)]
