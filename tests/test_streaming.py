"""A stream of several batches gives the rows of the batch operator."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frames import rows
from scorebook.operators import feeds
from scorebook.session import fresh_path
from scorebook.streaming import live

SCHEMA = "game_pk long, n long, ts timestamp, inning int, inning_half string, outs int, current_batter_id int, balls int"
T0 = datetime(2024, 5, 1, 18)


def _states():
    s = [(1, "Top", 0, 7, 0), (1, "Top", 0, 7, 1), (1, "Top", 0, 7, 1), (1, "Top", 1, 8, 0), (1, "Top", 2, 9, 0), (1, "Bottom", 0, 3, 0), (2, "Top", 0, 9, 0), (2, "Top", 0, 10, 2)]
    out = [(1, i, T0 + timedelta(minutes=20 * i), *v) for i, v in enumerate(s)]
    return out + [(2, 100 + i, T0 + timedelta(minutes=20 * i), *v) for i, v in enumerate(s[2:])]


def hour():
    return F.date_trunc("hour", F.col("ts"))


STEPS = {
    "changes": (lambda: live.changes_step("game_pk", ["ts"], hour(), ["inning", "inning_half", "outs", "current_batter_id", "balls"]), ["game_pk", "n"]),
    "transitions": (lambda: live.transitions_step("game_pk", ["ts"], hour()), ["game_pk", "n", "trigger"]),
    "flips": (lambda: live.inning_flips_step("game_pk", ["ts"], hour()), ["game_pk", "n", "inning_transition"]),
    "repeats": (lambda: live.drop_repeats_step("game_pk", ["ts"], hour(), ["balls"]), ["game_pk", "n"]),
    "previous end": (lambda: live.previous_end_step("game_pk", ["ts"], hour(), "ts"), ["game_pk", "n", "prev_ts"]),
}


def _stream(spark, parts):
    src = fresh_path(spark, "src")
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


@pytest.mark.parametrize("name", list(STEPS))
def test_stream_equals_batch(spark, name):
    make, cols = STEPS[name]
    data = sorted(_states(), key=lambda r: r[2])
    parts = [data[:5], list(reversed(data[5:9])), data[9:]]  # the second batch arrives out of order
    path = fresh_path(spark, "sink")
    sink = live.KeyedChanges(spark, path, "game_pk", ["ts"], make())
    live.run_to_end(_stream(spark, parts), sink, f"{path}/cp")
    assert rows(sink.read(), *cols) == rows(make()(spark.createDataFrame(data, SCHEMA)), *cols)
    assert rows(sink.snapshot(), "game_pk", "n") == [(1, 7), (2, 105)]


def test_replayed_batch_gives_the_same_output(spark):
    path = fresh_path(spark, "replay")
    sink = live.KeyedChanges(spark, path, "game_pk", ["ts"], STEPS["transitions"][0]())
    data = spark.createDataFrame(_states(), SCHEMA)
    sink(data.where("n % 100 < 4"), 0)
    sink(data.where("n % 100 >= 4"), 1)
    once = rows(sink.read(), "game_pk", "n", "trigger")
    sink(data.where("n % 100 >= 4"), 1)
    assert rows(sink.read(), "game_pk", "n", "trigger") == once


def test_transition_hierarchy(spark):
    got = rows(feeds.transitions_live(spark.createDataFrame(_states(), SCHEMA), "game_pk", ["ts"], hour()).where("game_pk = 1"), "n", "trigger")
    assert got == [(3, "out_recorded"), (4, "out_recorded"), (5, "half_start"), (6, "inning_start"), (7, "pa_start")]


def test_keyset_changes(spark):
    path = fresh_path(spark, "keys")
    sink = live.keyset_sink(spark, path, "game_pk")
    for i, ks in enumerate([[1, 2], [2, 3]]):
        sink(spark.createDataFrame([(k,) for k in ks], "game_pk long"), i)
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/out")
    assert rows(out, "batch", "change", "game_pk") == [(0, "added", 1), (0, "added", 2), (1, "added", 3), (1, "removed", 1)]


def test_expiry_and_stale(spark):
    now = T0
    s = spark.createDataFrame([(1, "Final", now - timedelta(hours=13), now), (2, "Final", now - timedelta(hours=11), now), (3, "Live", now, now - timedelta(seconds=121)),
                               (4, "Live", now, now - timedelta(seconds=119)), (5, "Final", None, None)],
                              "game_pk long, abstract_game_state string, game_datetime timestamp, last_change_at timestamp")
    assert rows(feeds.expire(s, now), "game_pk") == [(2,), (3,), (4,), (5,)]
    assert rows(feeds.stale(s, now), "game_pk") == [(3,)]


def test_alerts(spark):
    m = spark.createDataFrame([(1, "Live", 20, 3, 3, 100.0, T0), (2, "Final", 10, 9, 1, 2500.0, T0)],
                              "game_pk long, abstract_game_state string, poll_count long, error_count long, consecutive_errors long, avg_response_ms double, last_change_at timestamp")
    got = rows(feeds.feed_alerts(m, T0 + timedelta(seconds=121)), "game_pk", "kind")
    assert got == [(1, "consecutive_errors"), (1, "high_error_rate"), (1, "no_change"), (2, "slow_responses")]


def test_stale_alerts_follow_the_snapshot(spark):
    """A silent live game is found on any batch, whether or not it sent rows itself."""
    path = fresh_path(spark, "stale")
    sink = live.StaleAlerts(spark, path, "game_pk", "ts", seconds=120)
    df = spark.createDataFrame([(1, T0, "Live"), (2, T0, "Final"), (3, T0 + timedelta(minutes=5), "Live")], "game_pk long, ts timestamp, abstract_game_state string")
    sink(df.where("game_pk < 3"), 0, now=T0 + timedelta(seconds=60))
    sink(df.where("game_pk = 3"), 1, now=T0 + timedelta(minutes=6))
    assert rows(sink.read(), "game_pk", "quiet_seconds") == [(1, 360.0)]


def test_a_source_that_stops_is_noticed(spark):
    """After its only file the source is silent; the clock keeps batches running and the alert comes."""
    import time

    path = fresh_path(spark, "silent")
    now = datetime.now()
    spark.createDataFrame([(1, now, "Live"), (2, now, "Final")], "game_pk long, ts timestamp, abstract_game_state string").coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("game_pk long, ts timestamp, abstract_game_state string").parquet(f"{path}/in")
    sink = live.StaleAlerts(spark, f"{path}/state", "game_pk", "ts", seconds=3)
    q = live.with_clock(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime="1 second").start()
    try:
        until, seen = time.time() + 60, []
        while not seen and time.time() < until:
            time.sleep(1)
            if q.lastProgress and q.lastProgress["batchId"] >= 2:
                seen = sink.read().select("game_pk").distinct().collect()
        assert q.exception() is None and [r[0] for r in seen] == [1]
    finally:
        q.stop()


def test_missing_state_is_an_error(spark):
    sink = live.KeyedChanges(spark, fresh_path(spark, "gap"), "game_pk", ["ts"], lambda df: df)
    assert sink.previous(0) is None
    with pytest.raises(FileNotFoundError):
        sink.previous(3)


def test_result_folders_do_not_grow_with_keys(spark):
    data = [(None if k == 7 else k, n, T0, 1, "Top", 0, 7, 0) for n, k in enumerate(list(range(300)) * 2)]
    path = fresh_path(spark, "series")
    live.append_results(_stream(spark, [data[:300], data[300:]]).select("game_pk", "n"), f"{path}/data", f"{path}/cp").start().awaitTermination()
    files = spark.read.parquet(f"{path}/data").select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 2 * live.RESULT_FOLDERS
    assert rows(live.read_results(spark, f"{path}/data"), "game_pk", "n") == sorted(((k, n) for k, n, *_ in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    one = live.read_results(spark, f"{path}/data", F.lit(11).cast("long"))
    assert rows(one, "game_pk", "n") == [(11, 11), (11, 311)] and "PartitionFilters: [isnotnull(folder" in one._jdf.queryExecution().toString()
    assert rows(live.read_results(spark, f"{path}/data", F.lit(None).cast("long")), "n") == [(7,), (307,)]
