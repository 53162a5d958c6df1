"""Keyed state of live feeds, with timers and expiry.

The operators here keep what they know of a key in Spark's state store (RocksDB, checkpointed with the query)
and touch only the keys of a batch and those whose time has come: the work of a batch does not grow with the
number of keys ever seen. Times are whole microseconds inside the state, so no time zone comes in.

Rows that are older than the watermark when they arrive are dropped by the engine and counted (``late_rows``);
every other row counts, in whatever order and batch it comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: For streams that are joined: one store a partition instead of four, and a batch writes its changes, not the store's files.
JOINED = {"spark.sql.streaming.join.stateFormatVersion": "3", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
MS = 1000
#: Buckets of keys whose waiting windows are kept together.
BUCKETS = 1024
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def start(writer, spark: SparkSession, settings: dict[str, str] | None = None) -> StreamingQuery:
    """Starts a query with the RocksDB state store; a query keeps the settings it was started with."""
    settings = {PROVIDER: ROCKSDB} | (settings or {})
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def append_to(stream: DataFrame, path: str, settings: dict[str, str] | None = None) -> StreamingQuery:
    """All input there is, its results appended below ``path``/out."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    query = start(writer.trigger(availableNow=True), stream.sparkSession, settings)
    query.awaitTermination()
    return query


def state_of(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """A state variable after the last finished batch of the query run by ``append_to``."""
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{path}/checkpoint")


def late_rows(query: StreamingQuery) -> int:
    """Rows that arrived behind the watermark, as far as the query's recent progress reaches."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows held in state after each recent batch."""
    return [sum(int(s["numRowsTotal"]) for s in p["stateOperators"]) for p in query.recentProgress]


def _micros(ts: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-1))


class _Timed(StatefulProcessor):
    """A processor whose keys have one timer at most."""

    def init(self, handle) -> None:
        self.handle = handle

    def set_timer(self, at_ms: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


# --- snapshot with expiry ------------------------------------------------------

class _Snapshot(_Timed):
    """``closed`` is the place of the newest final row; families hold rows after it that are younger than the time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.closed = handle.getValueState("closed", "at long, tie long")
        self.families = handle.getMapState("families", "family string", "at long, tie long, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        best, closed, live = {}, tuple(self.closed.get()) if self.closed.exists() else None, self._live()
        was_closed, known = closed, bool(live)
        for r in rows:
            at = (r.at, r.tie)
            if r.final:
                closed = at if closed is None else max(closed, at)
            elif r.family not in best or at > best[r.family][0]:
                best[r.family] = (at, r.payload)
        if closed != was_closed:
            self.closed.update(closed)
        for family, (at, payload) in best.items():
            if family not in live or at > live[family]:
                self.families.updateValue((family,), (*at, payload))
                live[family] = at
        for family in [f for f, at in live.items() if closed is not None and at <= closed]:
            self.families.removeKey((family,))
            del live[family]
        self._arm(live, closed)
        if known and not live:
            yield Row(key=key[0], reason="final", at=closed[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, live, closed = timerValues.getCurrentWatermarkInMs(), self._live(), tuple(self.closed.get()) if self.closed.exists() else None
        if closed is not None and closed[0] // MS < due:
            self.closed.clear()
            closed = None
        last, known = max(live.values(), default=None), bool(live)
        for family in [f for f, at in live.items() if at[0] // MS + self.ttl_ms <= due]:
            self.families.removeKey((family,))
            del live[family]
        self._arm(live, closed)
        if known and not live:
            yield Row(key=key[0], reason="expired", at=last[0])

    def _live(self) -> dict:
        return {k[0]: (v[0], v[1]) for k, v in self.families.iterator()} if self.families.exists() else {}

    def _arm(self, live: dict, closed: tuple | None) -> None:
        times = [at // MS + self.ttl_ms for at, _ in live.values()] + ([closed[0] // MS + 1] if closed is not None else [])
        self.set_timer(min(times) if times else None)


def expiring_snapshot(stream: DataFrame, key: str, ts: str, tie: str, families: dict[str, list[str]], family: Column, final: Column,
                      ttl_hours: float = 12, delay: str = "1 hour") -> DataFrame:
    """Keeps the newest values of every column family of a key; returns the keys that went, with the reason.

    A final row takes all that its key had before it, at once; a family goes when the watermark is ``ttl_hours``
    past its newest row; a key without families is gone. The final row's place is remembered until no older row
    can come any more, so one that arrives after it but was sent before does not bring the key back. Rows
    without a key only move the watermark.
    """
    payload = F.coalesce(*[F.when(family == name, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})) for name, cols in families.items()], F.lit("{}"))
    rows = stream.withWatermark(ts, delay).select(
        F.col(key).alias("key"), ts, _micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"), family.alias("family"),
        F.coalesce(final, F.lit(False)).alias("final"), payload.alias("payload"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithState(_Snapshot(int(ttl_hours * 3600 * MS)), f"key {kind}, reason string, at long", "Append", "EventTime")


def snapshot_table(spark: SparkSession, path: str, key: str, families: dict[str, list[str]], schema: str) -> DataFrame:
    """One row per live key: every family's columns and when the family was updated."""
    held = state_of(spark, path, "families").select(F.col("key.key").alias(key), F.col("user_map_key.family").alias("family"), F.col("user_map_value.*"))
    row = F.from_json("payload", schema)
    aggs = []
    for name, cols in families.items():
        mine = F.col("family") == name
        aggs += [F.max(F.when(mine, row[c])).alias(c) for c in cols] + [F.max(F.when(mine, F.timestamp_micros("at"))).alias(f"{name}_updated_at")]
    return held.groupBy(key).agg(*aggs)


# --- silence -------------------------------------------------------------------

class _Stale(_Timed):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long, live boolean, alerted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        newest = max((r.at, r.live) for r in rows)
        if self.last.exists() and newest <= self.last.get()[:2]:
            return
        self.last.update((*newest, False))
        self.set_timer(newest[0] // MS + self.wait_ms if newest[1] else None)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, live, _ = self.last.get()
        self.last.update((at, live, True))
        yield Row(key=key[0], last_at=at, due_ms=expiredTimerInfo.getExpiryTimeInMs())


def stale_alerts(stream: DataFrame, key: str, ts: str, live: Column, seconds: float = 120, delay: str | None = None) -> DataFrame:
    """One alert (key, last_at, due_ms) for every live key that has had no row for ``seconds``, once until its next row.

    Each key has its own timer, so a key is found although it, or the whole source, sends nothing, and no batch
    looks at keys whose time has not come. Without ``delay`` the clock is the machine's; with it the clock is
    the watermark, so that a replay of old rows gives the alerts of then. A key that is not live has no timer.
    """
    rows = stream.withWatermark(ts, delay) if delay is not None else stream
    rows = rows.select(F.col(key).alias("key"), ts, _micros(ts).alias("at"), F.coalesce(live, F.lit(False)).alias("live"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithState(_Stale(int(seconds * MS)), f"key {kind}, last_at long, due_ms long", "Append",
                                                  "EventTime" if delay is not None else "ProcessingTime")


def open_alerts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys that are silent now, and their newest row's time."""
    return state_of(spark, path, "last").where("value.alerted").select(F.col("key.key").alias(key), F.timestamp_micros("value.at").alias("last_change_at"))


# --- bounded de-duplication ----------------------------------------------------

def drop_repeats_within(stream: DataFrame, key: str, cols: list[str], ts: str, delay: str) -> DataFrame:
    """One row of those alike in ``key`` and ``cols``, if they lie within ``delay`` of event time.

    What has been seen is forgotten ``delay`` behind the newest row, so the state holds the rows of that span
    and no more. A row older than that when it arrives is dropped, repeat or not, and counted as late.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key, *cols])


# --- running poll metrics ------------------------------------------------------

class TrailingRun:
    """The failed polls after the last successful one, as partial results that can be merged in any order.

    ``ok`` is the place (time, tie) of the last success and ``failed`` the places of failures after it. Places
    no success can come before any more are only counted (``settled``).
    """

    def __init__(self, ok: tuple[int, int] | None = None, failed: list[tuple[int, int]] = (), settled: int = 0, until: int = -1):
        self.ok, self.failed, self.settled, self.until = ok, list(failed), settled, until

    def merge(self, other: TrailingRun) -> TrailingRun:
        ok = max((x.ok for x in (self, other) if x.ok is not None), default=None)
        # A success later than what was settled ends the settled part.
        settled = sum(x.settled for x in (self, other) if ok is None or ok[0] <= x.until)
        return TrailingRun(ok, [f for x in (self, other) for f in x.failed if ok is None or f > ok], settled, max(self.until, other.until))

    def settle(self, before: int) -> TrailingRun:
        """Count failures up to ``before`` instead of keeping their places."""
        if before <= self.until:
            return self
        late = [f for f in self.failed if f[0] > before]
        return TrailingRun(self.ok, late, self.settled + len(self.failed) - len(late), before)

    @property
    def length(self) -> int:
        return self.settled + len(self.failed)


_PARTIAL = ("polls long, oks long, errors long, changes long, ok_ms double, max_ms double, last_poll long, last_change long, "
            "ok_at long, ok_tie long, failed_at array<long>, failed_tie array<long>")


def _partial_metrics(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per key of each Arrow batch, so a key with most of the rows is shuffled as a few rows."""
    for df in frames:
        df = df[df["key"].notna()].sort_values(["key", "at", "tie"], kind="stable")
        if df.empty:
            continue
        ok, failed = df[~df["failed"]], df[df["failed"]]
        out = pd.DataFrame({"polls": df.groupby("key").size()})
        out["oks"], out["errors"] = ok.groupby("key").size(), failed.groupby("key").size()
        out["changes"] = df["changed"].groupby(df["key"]).sum()
        out["ok_ms"], out["max_ms"] = ok.groupby("key")["ms"].sum(), ok.groupby("key")["ms"].max()
        out["last_poll"], out["last_change"] = df.groupby("key")["at"].max(), df[df["changed"]].groupby("key")["at"].max()
        last = ok.groupby("key").tail(1).set_index("key")
        out["ok_at"], out["ok_tie"] = last["at"], last["tie"]
        end = failed.join(last[["at", "tie"]].rename(columns={"at": "oa", "tie": "ot"}), on="key")
        end = end[end["oa"].isna() | (end["at"] > end["oa"]) | ((end["at"] == end["oa"]) & (end["tie"] > end["ot"]))]
        out["failed_at"], out["failed_tie"] = end.groupby("key")["at"].agg(list), end.groupby("key")["tie"].agg(list)
        for c in ("failed_at", "failed_tie"):
            out[c] = [v if isinstance(v, list) else [] for v in out[c]]
        for c in ("oks", "errors", "changes"):
            out[c] = out[c].fillna(0).astype("int64")
        for c in ("last_change", "ok_at", "ok_tie"):
            out[c] = out[c].astype("Int64")
        out["ok_ms"] = out["ok_ms"].fillna(0.0)
        out["max_ms"] = out["max_ms"].fillna(-np.inf)
        out = out.reset_index()
        out["ts"] = pd.to_datetime(out["last_poll"].clip(lower=0), unit="us", utc=True)
        yield out


class _Metrics(StatefulProcessor):
    FIELDS = _PARTIAL + ", settled long, until long"

    def init(self, handle) -> None:
        self.state = handle.getValueState("metrics", self.FIELDS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, run = None, TrailingRun()
        if self.state.exists():
            total = list(self.state.get())
            run = TrailingRun((total[8], total[9]) if total[8] is not None else None, list(zip(total[10], total[11])), total[12], total[13])
            total = total[:8]
        newest = lambda a, b: max((x for x in (a, b) if x is not None), default=None)
        for r in rows:
            part = [r.polls, r.oks, r.errors, r.changes, r.ok_ms, r.max_ms, r.last_poll, r.last_change]
            total = part if total is None else [*(a + b for a, b in zip(total[:5], part)), *(newest(a, b) for a, b in zip(total[5:], part[5:]))]
            run = run.merge(TrailingRun((r.ok_at, r.ok_tie) if r.ok_at is not None else None, list(zip(r.failed_at, r.failed_tie))))
        run = run.settle(max(-1, timerValues.getCurrentWatermarkInMs() * MS - 1))
        ok = run.ok or (None, None)
        self.state.update((*total, *ok, [a for a, _ in run.failed], [t for _, t in run.failed], run.settled, run.until))
        yield Row(key=key[0], poll_count=total[0], consecutive_errors=run.length)

    def close(self) -> None:
        pass


def poll_metrics(stream: DataFrame, key: str, ts: str, tie: str, delay: str = "1 hour") -> DataFrame:
    """Counters, response times and trailing errors of every key, kept in state; emits the changed keys of a batch.

    The trailing run is exact for rows that come at most ``delay`` behind the newest: places of failures are
    kept for that span and only counted beyond it.
    """
    failed = F.coalesce(F.col("error").isNotNull() & (F.col("error") != ""), F.lit(False))
    rows = stream.select(F.col(key).alias("key"), _micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"), failed.alias("failed"),
                         F.coalesce("changed", F.lit(False)).alias("changed"), F.col("response_ms").cast("double").alias("ms"))
    kind = stream.schema[key].dataType.simpleString()
    parts = rows.mapInPandas(_partial_metrics, f"key {kind}, {_PARTIAL}, ts timestamp").withWatermark("ts", delay)
    return parts.groupBy("key").transformWithState(_Metrics(), f"key {kind}, poll_count long, consecutive_errors long", "Update", "EventTime")


def metrics_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The metrics of every key after the last batch, columns as ``feeds.poll_metrics`` has them."""
    v = state_of(spark, path, "metrics").select(F.col("key.key").alias(key), "value.*")
    return v.select(
        key, F.col("polls").alias("poll_count"), F.col("oks").alias("success_count"), F.col("errors").alias("error_count"), F.col("changes").alias("changed_count"),
        F.coalesce(F.expr("ok_ms / nullif(oks, 0)"), F.lit(0.0)).alias("avg_response_ms"), F.when(F.col("oks") > 0, F.col("max_ms")).otherwise(0.0).alias("max_response_ms"),
        F.timestamp_micros("last_poll").alias("last_poll_at"), F.timestamp_micros("last_change").alias("last_change_at"),
        (F.col("settled") + F.size("failed_at")).cast("long").alias("consecutive_errors"))


# --- validity windows ----------------------------------------------------------

class _Windows(_Timed):
    """Keys of a bucket: what waits is one value of the bucket, the end of the last window one entry a key."""

    Window = Row("key", "end_at", "start_at", "payload", "window_end")

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getMapState("last", f"key {self.kind}", "at long")
        self.known = handle.getValueState("known", "keys long")
        self.waiting = handle.getValueState("waiting", f"keys array<{self.kind}>, at array<long>, payload array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        waiting = self._held()
        for r in rows:
            held = waiting.get((r.key, r.at))
            if held is None or (r.payload is not None and r.payload < held):
                waiting[r.key, r.at] = r.payload
        self._hold(waiting)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What is not later than the watermark is complete: it ends its windows in order of time."""
        until, waiting, due = timerValues.getCurrentWatermarkInMs() * MS, self._held(), {}
        for k, at in waiting:
            if at <= until:
                due.setdefault(k, []).append(at)
        last = self._last_of(due)
        for k, ends in due.items():
            before = last.get(k)
            for at in sorted(ends):
                yield self.Window(k, at, before, waiting.pop((k, at)), EPOCH + timedelta(microseconds=at))
                before = at
            self.last.updateValue((k,), (before,))
        self._hold(waiting)

    def _last_of(self, keys) -> dict:
        """Ends of the last windows of these keys, in one go if the bucket has not many more."""
        known = self.known.get()[0] if self.known.exists() else 0
        if known <= 4 * len(keys):
            last = {k[0]: v[0] for k, v in self.last.iterator()} if known else {}
        else:
            last = {k: self.last.getValue((k,))[0] for k in keys if self.last.containsKey((k,))}
        self.known.update((known + sum(k not in last for k in keys),))
        return last

    def _held(self) -> dict:
        if not self.waiting.exists():
            return {}
        keys, ends, payloads = self.waiting.get()
        return dict(zip(zip(keys, ends), payloads))

    def _hold(self, waiting: dict) -> None:
        if waiting:
            self.waiting.update(([k for k, _ in waiting], [at for _, at in waiting], list(waiting.values())))
        else:
            self.waiting.clear()
        self.set_timer(-(-min(at for _, at in waiting) // MS) if waiting else None)


def event_windows(stream: DataFrame, key: str, end: str, payload: Column, delay: str = "1 hour") -> DataFrame:
    """key, start_at (null: open), end_at, payload, window_end of every event: its window is [previous end, own end).

    An event waits until the watermark has passed it, so events may come in any order within ``delay``. Of
    events that end at the same time the one with the smallest payload counts. Keys are dealt to ``BUCKETS``
    buckets, each with one timer: a call to the state costs more than a row, so what waits is read and written
    by the bucket. Of the keys seen before, only those with a window to end are touched.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(end, delay).select(F.col(key).alias("key"), end, _micros(end).alias("at"), payload.alias("payload"))
    bucket = F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithState(
        _Windows(kind), f"key {kind}, end_at long, start_at long, payload string, window_end timestamp", "Append", "EventTime", eventTimeColumnName="window_end")


def in_windows(polls: DataFrame, windows: DataFrame, key: str, ts: str, longest: str, delay: str = "1 hour") -> DataFrame:
    """Polls with the payload of the window they fall into: [start, end), and at most ``longest`` before the end.

    Both sides are streams and may run ahead of each other; ``longest`` bounds how long a poll waits for its
    window and a window for its polls. Polls without a key match nothing and do not move the watermark.
    """
    left = polls.withWatermark(ts, delay)
    inside = ((F.col(key) == F.col("key")) & (F.col(ts) < F.col("window_end")) & (F.col(ts) >= F.col("window_end") - F.expr(f"interval {longest}"))
              & (F.col("start_at").isNull() | (_micros(ts) >= F.col("start_at"))))
    return left.join(windows, inside, "inner").drop("key", "window_end")
