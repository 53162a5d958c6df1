"""Keyed stream state: expiry, timers, late rows, trailing errors, windows."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from frames import rows
from scorebook.session import fresh_path
from scorebook.streaming import state

SCHEMA = "game_pk long, event_id long, ts timestamp, kind string, v int, error string, changed boolean, response_ms double"
T0 = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def row(game, n, minutes, kind="live", v=0, error=None, changed=False, ms=1.0):
    return (game, n, at(minutes), kind, v, error, changed, ms)


def tick(minutes):
    return (None, -1, at(minutes), None, None, None, None, None)


def feed(spark, batches):
    path = fresh_path(spark, "feed")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


FAMILIES = {"live": ["v"], "sim": ["response_ms"]}


def snapshot(spark, batches, ttl_hours=2):
    path = fresh_path(spark, "snap")
    family = F.when(F.col("kind") == "sim", "sim").otherwise("live")
    gone = state.expiring_snapshot(feed(spark, batches), "game_pk", "ts", "event_id", FAMILIES, family, F.col("kind") == "final", ttl_hours, "30 minutes")
    run = state.append_to(gone, path)
    table = state.snapshot_table(spark, path, "game_pk", FAMILIES, "v int, response_ms double")
    return rows(table, "game_pk", "v", "response_ms"), rows(spark.read.parquet(f"{path}/out"), "key", "reason"), state.state_rows(run)


def test_a_final_row_takes_its_key_at_once(spark):
    live, gone, held = snapshot(spark, [
        [row(1, 1, 0, v=1), row(2, 2, 0, v=2), row(2, 3, 1, "sim", ms=7.0), row(3, 4, 2, v=3)],
        [row(2, 5, 5, "final"), row(1, 6, 6, v=4)],
        [row(2, 7, 4, v=9), row(3, 8, 1, v=9)],  # sent before the final row, and before what is known
    ])
    assert live == [(1, 4, None), (3, 3, None)] and gone == [(2, "final")]
    assert held[1] < held[0] and held[2] == held[1]


def test_old_families_and_keys_expire(spark):
    live, gone, held = snapshot(spark, [
        [row(1, 1, 0, v=1), row(1, 2, 0, "sim", ms=5.0), row(2, 3, 0, v=2), row(4, 4, 1, "final")],
        [row(1, 5, 100, v=6)], [tick(180)], [tick(180)]])  # the watermark ends at 150
    assert live == [(1, 6, None)] and gone == [(2, "expired")]
    assert held[-1] == 1  # closed keys are forgotten too


def test_a_key_comes_back_after_its_final_row(spark):
    batches = [[row(1, 1, 0, v=1)], [row(1, 2, 5, "final"), row(1, 3, 6, v=8)], [row(1, 4, 7, "sim", ms=2.0)]]
    assert snapshot(spark, batches)[0] == [(1, 8, 2.0)]
    assert snapshot(spark, [sum(batches, [])])[0] == [(1, 8, 2.0)]


def test_alert_on_the_watermark(spark):
    path = fresh_path(spark, "stale")
    batches = [[row(1, 1, 0), row(2, 2, 0), row(3, 3, 0, "done")], [row(1, 4, 9)], [tick(29)], [tick(29)], [row(1, 5, 30)], [row(2, 6, 31)], [tick(33)], [tick(33)]]
    state.append_to(state.stale_alerts(feed(spark, batches), "game_pk", "ts", F.col("kind") == "live", 600, "0 seconds"), path)
    got = spark.read.parquet(f"{path}/out").select("key", F.timestamp_micros("last_at").alias("t"))
    assert rows(got) == [(1, at(9).replace(tzinfo=None)), (2, at(0).replace(tzinfo=None))]
    assert rows(state.open_alerts(spark, path, "game_pk"), "game_pk") == []  # both have sent rows since


def test_a_silent_source_fires_once_a_key(spark):
    path, now = fresh_path(spark, "silent"), datetime.now(timezone.utc)
    one = [(g, g, now, k, 0, None, False, 1.0) for g, k in ((1, "live"), (2, "live"), (3, "done"))]
    alerts = state.stale_alerts(feed(spark, [one]), "game_pk", "ts", F.col("kind") == "live", 4)
    writer = alerts.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    q = state.start(writer.trigger(processingTime="1 second"), spark)
    try:
        until, seen = time.time() + 90, []
        while len(seen) < 2 and time.time() < until and q.isActive:
            time.sleep(1)
            try:
                seen = rows(spark.read.parquet(f"{path}/out"), "key")
            except Exception:  # nothing written yet
                seen = []
        batch = q.lastProgress["batchId"]
        while q.lastProgress["batchId"] < batch + 3 and time.time() < until:
            time.sleep(1)
        assert q.exception() is None
    finally:
        q.stop()
    assert rows(spark.read.parquet(f"{path}/out"), "key") == [(1,), (2,)]


def test_repeats_within_the_bound(spark):
    path = fresh_path(spark, "repeats")
    batches = [[row(1, 1, 0), row(1, 1, 0), row(1, 2, 3)], [row(1, 1, 0), row(2, 1, 20)], [row(1, 3, 60)], [row(1, 4, 61)], [row(1, 1, 0), row(1, 9, 5), row(1, 5, 62)], [row(1, 6, 200)], [row(1, 7, 201)]]
    run = state.append_to(state.drop_repeats_within(feed(spark, batches), "game_pk", ["event_id"], "ts", "30 minutes"), path)
    assert rows(spark.read.parquet(f"{path}/out"), "game_pk", "event_id") == [*((1, i) for i in range(1, 8)), (2, 1)]
    assert state.late_rows(run) == 2  # the first row once more, and a new one that came too late
    assert max(state.state_rows(run)) <= 6 and state.state_rows(run)[-1] == 2  # what is out of the bound is forgotten


def trail(polls):
    n = 0
    for _, _, failed in sorted(polls):
        n = n + 1 if failed else 0
    return n


@pytest.mark.parametrize("seed", range(30))
def test_trailing_runs_merge_in_any_order(seed):
    rng = random.Random(seed)
    polls = [(rng.randrange(40), i, rng.random() < 0.8) for i in range(rng.randrange(1, 40))]
    rng.shuffle(polls)
    parts = [state.TrailingRun(None, [(a, i)]) if bad else state.TrailingRun((a, i)) for a, i, bad in polls]
    while len(parts) > 1:
        x, y = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
        parts.append(x.merge(y))
    assert parts[0].length == trail(polls)


def test_settled_failures_are_counted_not_kept():
    run = state.TrailingRun((0, 0), [(k, k) for k in range(1, 100)]).settle(90)
    assert run.length == 99 and len(run.failed) == 9
    assert run.merge(state.TrailingRun((95, 0))).length == 5
    assert run.merge(state.TrailingRun((-5, 0))).length == 99


@pytest.mark.parametrize("order", ["in order", "shuffled"])
def test_poll_metrics_against_a_loop(spark, order):
    rng = random.Random(7)
    polls = [row(rng.randrange(4), i, i // 4, error="timeout" if rng.random() < 0.6 else None, changed=rng.random() < 0.3, ms=float(rng.randrange(100))) for i in range(240)]
    polls += [row(9, 500 + i, 20, error="down") for i in range(30)] + [row(8, 600, 1)]
    polls.sort(key=lambda r: r[2])
    if order == "shuffled":  # at most 25 minutes behind
        polls = sorted(polls, key=lambda r: r[2] + timedelta(minutes=rng.randrange(25)))
    path = fresh_path(spark, "metrics")
    changed = state.poll_metrics(feed(spark, [polls[k : k + 70] for k in range(0, len(polls), 70)]), "game_pk", "ts", "event_id", "30 minutes")
    writer = changed.writeStream.outputMode("update").foreachBatch(lambda b, _: b.count()).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    state.start(writer, spark).awaitTermination()
    got = {r.game_pk: r for r in state.metrics_table(spark, path, "game_pk").collect()}
    for g in {r[0] for r in polls}:
        mine = [r for r in polls if r[0] == g]
        ok = [r[7] for r in mine if not r[5]]
        r = got[g]
        assert (r.poll_count, r.success_count, r.error_count, r.changed_count) == (len(mine), len(ok), len(mine) - len(ok), sum(x[6] for x in mine))
        assert r.consecutive_errors == trail([(x[2], x[1], bool(x[5])) for x in mine])
        assert r.avg_response_ms == pytest.approx(sum(ok) / len(ok) if ok else 0) and r.max_response_ms == max(ok, default=0)
        assert r.last_poll_at == max(x[2] for x in mine).replace(tzinfo=None)


def test_windows_out_of_order(spark):
    path = fresh_path(spark, "windows")
    batches = [[row(1, 1, 10), row(1, 3, 30), row(2, 9, 5)], [row(1, 2, 20), row(1, 4, 60)], [row(1, 5, 200)], [row(1, 6, 201)], [tick(300)], [tick(300)]]
    state.append_to(state.event_windows(feed(spark, batches), "game_pk", "ts", F.col("event_id").cast("string"), "30 minutes"), path)
    minute = lambda c: ((F.col(c) - F.lit(int(T0.timestamp() * 10**6))) / 60000000).cast("int").alias(c)
    got = rows(spark.read.parquet(f"{path}/out").select("key", minute("start_at"), minute("end_at"), "payload"))
    assert got == [(1, None, 10, "1"), (1, 10, 20, "2"), (1, 20, 30, "3"), (1, 30, 60, "4"), (1, 60, 200, "5"), (1, 200, 201, "6"), (2, None, 5, "9")]


class Handle:
    """The state of one bucket in memory; counts what would go to the store."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, set(), {}

    def getValueState(self, name, schema):
        return Variable(self, self.held.setdefault(name, {}))

    getMapState = lambda self, name, key, value: self.getValueState(name, value)

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Variable:
    def __init__(self, handle, held):
        self.handle, self.held = handle, held

    def __getattr__(self, name):
        self.handle.calls += 1
        held = self.held
        return {"exists": lambda: bool(held), "get": lambda: held.get(()), "update": lambda v: held.update({(): v}), "clear": held.clear, "containsKey": held.__contains__,
                "getValue": held.get, "updateValue": held.__setitem__, "iterator": lambda: iter(list(held.items()))}[name]


class Timers:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: watermark


def test_windows_of_a_bucket_cost_calls_by_key_not_by_event():
    """Batches of a bucket against a loop: events in any order, equal times, keys that come once or always; one timer."""
    rng, handle, got, want, seen = random.Random(3), Handle(), [], [], {}
    Event = state.Row("key", "at", "payload")
    bucket = state._Windows("long")
    bucket.init(handle)
    waiting = {}
    for batch, keys in enumerate([range(40), range(40), range(3), range(41, 43), range(40), []]):
        events = [Event(k, (batch * 100 + rng.randrange(1, 180)) * 1000 + rng.randrange(3) * 500, rng.choice("abc")) for k in keys for _ in range(100)]
        list(bucket.handleInputRows((5,), iter(events), Timers(0)))
        for e in events:
            waiting[e.key, e.at] = min(e.payload, waiting.get((e.key, e.at), "z"))
        handle.calls, until = 0, batch * 100 + 100
        assert handle.timers == {-(-min(at for _, at in waiting) // 1000)}
        if min(handle.timers) <= until:
            got += bucket.handleExpiredTimer((5,), Timers(until), Timers(min(handle.timers)))
        due = sorted((k, at) for k, at in waiting if at <= until * 1000)
        for k, at in due:
            want.append((k, at, seen.get(k), waiting.pop((k, at)), state.EPOCH + timedelta(microseconds=at)))
            seen[k] = at
        assert handle.calls <= 3 * len({k for k, _ in due}) + 12 and (len(due) > 12 * len({k for k, _ in due}) or batch == 5)
        assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert list(bucket.handleInputRows((None,), iter([Event(None, 1, "a")]), Timers(0))) == [] and handle.held["known"][()] == (42,)
