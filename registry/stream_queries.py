"""Live feeds with keyed state, timers and watermarks (I4, I8, I11, I12, I14, I15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import roles
from registry.core import query
from registry.metric_queries import METRICS
from scorebook.session import fresh_path
from scorebook.streaming import state

#: Ranges of event time that arrive one after the other, and files of each.
BATCHES, FILES = 4, 4
#: Rows of the last ``HELD`` hours of a range of which one in ten is delivered with the next range.
HELD = 3
DELAY = "6 hours"
#: Batch of a row by its event time, the same in both engines.
BATCH = "least(3, ({us} - lo) * 4 {div} (hi - lo + 1))"
SPANS = "spans AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi, date_trunc('hour', max(ts)) + INTERVAL 2 HOUR AS clock FROM polls)"
DEALT = f"dealt AS (SELECT polls.*, lo, hi, {BATCH.format(us='epoch_us(ts)', div='//')} AS batch FROM polls, spans)"


def _sql(body: str) -> str:
    return roles.with_ctes(["polls"], body, {p.split(" AS ", 1)[0]: p.split(" AS ", 1)[1][1:-1] for p in (SPANS, DEALT)})


def _dealt(spark, sf):
    """Polls with their batch, and the clock at the end."""
    p = roles.polls(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    span = p.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi"), F.expr("date_trunc('hour', max(ts)) + INTERVAL 2 HOURS").alias("clock")).first()
    dealt = p.withColumns({"us": F.unix_micros("ts"), "lo": F.lit(span.lo), "hi": F.lit(span.hi), "clock": F.lit(span.clock)})
    return dealt.withColumn("batch", F.coalesce(F.expr(BATCH.format(us="us", div="div")), F.lit(0)).cast("int"))


def _landing(dealt, batch, clock_hours: int = 0):
    """A stream of the rows in the order of ``batch``, then of two ticks without a key at the clock; every batch is ``FILES`` files."""
    spark, path = dealt.sparkSession, fresh_path(dealt.sparkSession, "feed")
    rows = dealt.withColumn("batch", batch)
    ticks = rows.groupBy().agg(F.max("clock").alias("clock")).select(
        F.explode(F.sequence(F.lit(0), F.lit(2 * FILES - 1))).alias("event_id"), (F.col("clock") + F.expr(f"INTERVAL {clock_hours} HOURS")).alias("ts"))
    ticks = ticks.withColumn("batch", (F.lit(BATCHES) + F.col("event_id") % 2).cast("int"))
    every = rows.unionByName(ticks, allowMissingColumns=True).cache()
    columns = roles.polls_columns()
    for b in range(BATCHES + 2):
        every.where(F.col("batch") == b).select(*columns).repartitionByRange(FILES, "event_id").write.mode("append").parquet(path)
    every.unpersist()
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", FILES).parquet(path)


def held_back(late: str = "event_id % 10 = 3"):
    """Some rows of the last hours of a range come with the next one."""
    return F.expr(f"CASE WHEN batch < 3 AND {late} AND (us + {HELD} * 3600000000L - lo) * 4 div (hi - lo + 1) > batch THEN batch + 1 ELSE batch END")


FAMILIES = {"live": ["inning", "outs"], "sim": ["response_ms"]}
FINAL = "event_type = 'signup' AND event_id % 3 = 0"
FAMILY = "CASE WHEN event_type = 'error' THEN 'sim' ELSE 'live' END"


@query("i11_expiring_snapshot_stream", _sql(f"""
SELECT game_pk, max(inning) FILTER (WHERE family = 'live') AS inning, max(outs) FILTER (WHERE family = 'live') AS outs, max(ts) FILTER (WHERE family = 'live') AS live_updated_at,
 max(response_ms) FILTER (WHERE family = 'sim') AS response_ms, max(ts) FILTER (WHERE family = 'sim') AS sim_updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, family ORDER BY ts DESC, event_id DESC) AS k FROM (
  SELECT *, {FAMILY} AS family, max(CASE WHEN {FINAL} THEN (ts, event_id) END) OVER (PARTITION BY game_pk) AS closed FROM polls)
  WHERE closed IS NULL OR (ts, event_id) > closed), spans
WHERE k = 1 AND ts + INTERVAL 36 HOUR > clock - INTERVAL 6 HOUR GROUP BY game_pk"""), doubles="response_ms")
def i11(spark, sf):
    path = fresh_path(spark, "snapshot-state")
    feed = _landing(_dealt(spark, sf), held_back())
    gone = state.expiring_snapshot(feed, "game_pk", "ts", "event_id", FAMILIES, F.expr(FAMILY), F.expr(FINAL), ttl_hours=36, delay=DELAY)
    state.append_to(gone, path)
    out = state.snapshot_table(spark, path, "game_pk", FAMILIES, "inning int, outs int, response_ms double")
    return out.select("game_pk", "inning", "outs", F.col("live_updated_at").cast("timestamp_ntz").alias("live_updated_at"), "response_ms",
                      F.col("sim_updated_at").cast("timestamp_ntz").alias("sim_updated_at"))


@query("i12_stale_timers_stream", _sql("""
SELECT game_pk, max(ts) AS last_change_at FROM polls, spans WHERE abstract_game_state = 'Live' GROUP BY game_pk, clock HAVING max(ts) + INTERVAL 12 HOUR < clock - INTERVAL 6 HOUR"""))
def i12(spark, sf):
    path = fresh_path(spark, "stale-state")
    feed = _landing(_dealt(spark, sf), held_back())
    state.append_to(state.stale_alerts(feed, "game_pk", "ts", F.col("abstract_game_state") == "Live", 12 * 3600, DELAY), path)
    return state.open_alerts(spark, path, "game_pk").select("game_pk", F.col("last_change_at").cast("timestamp_ntz").alias("last_change_at"))


@query("i4_repeats_within_stream", _sql("""
SELECT game_pk, count(*) AS n, CAST(NULL AS BIGINT) AS late FROM dealt WHERE NOT (batch = 0 AND event_id % 50 = 7) GROUP BY game_pk
UNION ALL SELECT NULL, NULL, count(*) FROM dealt WHERE batch = 0 AND event_id % 50 IN (7, 8)"""))
def i4(spark, sf):
    """Delivered again with the next range: the last hours of each. With the last range only: some rows of the first, which are late; others of it come again."""
    path, dealt = fresh_path(spark, "repeats-state"), _dealt(spark, sf)
    again = F.expr(f"CASE WHEN batch < 3 AND (us + {HELD} * 3600000000L - lo) * 4 div (hi - lo + 1) > batch THEN batch + 1 END")
    first = dealt.where("NOT (batch = 0 AND event_id % 50 = 7)")
    late = dealt.where("batch = 0 AND event_id % 50 IN (7, 8)").withColumn("batch", F.lit(3))
    sent = first.unionByName(first.where("NOT (batch = 0 AND event_id % 50 = 8)").withColumn("batch", again).where("batch IS NOT NULL")).unionByName(late)
    feed = _landing(sent, F.col("batch"))
    run = state.append_to(state.drop_repeats_within(feed.where("game_pk IS NOT NULL"), "game_pk", ["event_id"], "ts", DELAY), path)
    kept = spark.read.parquet(f"{path}/out").groupBy("game_pk").agg(F.count(F.lit(1)).alias("n")).withColumn("late", F.lit(None).cast("long"))
    return kept.unionByName(spark.createDataFrame([(None, None, state.late_rows(run))], "game_pk long, n long, late long"))


@query("i14_poll_metrics_state", roles.with_ctes(["polls"], METRICS.replace("any_value(abstract_game_state) AS abstract_game_state, ", "")), doubles="avg_response_ms max_response_ms")
def i14(spark, sf):
    path = fresh_path(spark, "metrics-state")
    feed = _landing(_dealt(spark, sf), held_back()).where("game_pk IS NOT NULL")
    changed = state.poll_metrics(feed, "game_pk", "ts", "event_id", DELAY)
    writer = changed.writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.count()).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    state.start(writer, spark).awaitTermination()
    out = state.metrics_table(spark, path, "game_pk")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_poll_at", "last_change_at")})


@query("i15_polls_in_windows_stream", roles.with_ctes(["polls"], """
SELECT p.game_pk, p.event_id, w.event_id AS window_event, w.start_ts AS window_start, w.ts AS window_end FROM (SELECT * FROM polls WHERE event_type NOT IN ('purchase', 'signup')) p
JOIN (SELECT *, lag(ts) OVER (PARTITION BY game_pk ORDER BY ts) AS start_ts FROM polls WHERE event_type IN ('purchase', 'signup')) w
ON p.game_pk = w.game_pk AND p.ts < w.ts AND (w.start_ts IS NULL OR p.ts >= w.start_ts) AND p.ts >= w.ts - INTERVAL 3 DAY"""))
def i15(spark, sf):
    path, dealt = fresh_path(spark, "windows-state"), _dealt(spark, sf)
    feed = _landing(dealt, held_back(), 24)
    ends = feed.where("event_type IN ('purchase', 'signup') OR game_pk IS NULL")
    windows = state.event_windows(ends, "game_pk", "ts", F.col("event_id").cast("string"), DELAY)
    # An inner join lets no row without a key reach the watermark, so the ticks get one that no window has.
    polls = feed.where("event_type NOT IN ('purchase', 'signup') OR game_pk IS NULL").select(F.coalesce("game_pk", F.lit(-1)).alias("game_pk"), "event_id", "ts")
    state.append_to(state.in_windows(polls, windows, "game_pk", "ts", "3 days", DELAY), path, state.JOINED)
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return spark.read.parquet(f"{path}/out").select("game_pk", "event_id", F.col("payload").cast("long").alias("window_event"), at("start_at").alias("window_start"), at("end_at").alias("window_end"))
