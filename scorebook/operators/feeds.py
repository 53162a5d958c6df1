"""Poll-log summaries, feed health and run lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.plans.ordered import scan


def _failed() -> Column:
    return F.col("error").isNotNull() & (F.col("error") != "")


def _changed() -> Column:
    return F.coalesce(F.col("changed"), F.lit(False))


def poll_summary(polls: DataFrame, key: str = "game_pk") -> DataFrame:
    n = F.count(F.lit(1)).cast("double")
    return polls.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_polls"), (F.count_if(_changed()) / n).alias("change_rate"),
        ((1 - F.count_if(_changed()) / n) * 100).alias("wasted_poll_pct"),
        (F.count_if(_failed()) / n).alias("error_rate"),
        F.coalesce(F.avg(F.when(~_failed(), F.col("response_ms"))), F.lit(0.0)).alias("avg_response_ms"))


def poll_metrics(polls: DataFrame, key: str = "game_pk", ts: str = "ts", tie: list[str] = ()) -> DataFrame:
    """Counters per game, the length of its trailing run of errors, and its last change.

    The trailing run is the number of failed polls after the last successful one: a count
    against a per-game maximum, so nothing has to be ordered.
    """
    at = F.struct(ts, *tie)
    good = polls.where(~_failed()).groupBy(key).agg(F.max(at).alias("__ok"))
    tail = polls.where(_failed()).join(good, key, "left").where(F.col("__ok").isNull() | (at > F.col("__ok"))) \
        .groupBy(key).agg(F.count(F.lit(1)).alias("consecutive_errors"))
    ok = F.when(~_failed(), F.col("response_ms"))
    base = polls.groupBy(key).agg(
        F.count(F.lit(1)).alias("poll_count"), F.count_if(~_failed()).alias("success_count"),
        F.count_if(_failed()).alias("error_count"), F.count_if(_changed()).alias("changed_count"),
        F.coalesce(F.avg(ok), F.lit(0.0)).alias("avg_response_ms"),
        F.coalesce(F.max(ok), F.lit(0.0)).alias("max_response_ms"),
        F.max(ts).alias("last_poll_at"), F.max(F.when(_changed(), F.col(ts))).alias("last_change_at"))
    return base.join(tail, key, "left").fillna({"consecutive_errors": 0})


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def feed_alerts(metrics: DataFrame, now, key: str = "game_pk", state: str = "abstract_game_state",
                stale_seconds: int = 120) -> DataFrame:
    """One row per alert: repeated errors, error rate, slow answers, live game without change."""
    def alert(cond: Column, level: str, kind: str) -> Column:
        return F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind")))

    rate = F.col("error_count") / F.nullif(F.col("poll_count"), F.lit(0))
    quiet = seconds_between(F.lit(now), F.col("last_change_at"))
    found = F.array_compact(F.array(
        alert(F.col("consecutive_errors") >= 3, "error", "consecutive_errors"),
        alert((F.col("poll_count") > 10) & (rate > 0.10), "warn", "high_error_rate"),
        alert(F.col("avg_response_ms") > 2000, "warn", "slow_responses"),
        alert((F.col(state) == "Live") & (quiet > stale_seconds), "warn", "no_change")))
    return metrics.select(key, F.explode(found).alias("a")).select(key, "a.level", "a.kind")


def feed_totals(metrics: DataFrame, state: str = "abstract_game_state") -> DataFrame:
    rate = F.sum("error_count") * 100.0 / F.nullif(F.sum("poll_count"), F.lit(0))
    return metrics.agg(
        F.count_if(F.coalesce(F.col(state) == "Live", F.lit(False))).alias("active_trackers"),
        F.count(F.lit(1)).alias("total_trackers"), F.sum("poll_count").alias("total_polls"),
        F.coalesce(rate, F.lit(0.0)).alias("error_rate_pct"))


def production_runs(evals: DataFrame) -> DataFrame:
    """All runs but the calibration runs, newest first; missing values count as calibration."""
    calibration = ((F.col("estimator") == "naive_mc") | F.col("estimator").isNull()) \
        & ((F.col("n_per_inning") >= 100) | F.col("n_per_inning").isNull())
    return evals.where(~calibration).orderBy(F.col("created_at").desc(), "eval_id")


def calibration_runs(evals: DataFrame) -> DataFrame:
    base = (F.col("estimator") == "naive_mc") | F.col("estimator").isNull()
    return evals.where(base & (F.col("n_per_inning") >= 100)).orderBy(F.col("created_at").desc(), "eval_id")


# --- change streams, batch form ----------------------------------------------

def drop_repeats(msgs: DataFrame, key: str, order: list[str], bucket: Column, cols: list[str]) -> DataFrame:
    """Leave out messages equal to the one just before in ``cols``."""
    rows = scan(msgs, [key], order, bucket, prev={"__p": F.struct(*cols)})
    return rows.where(F.col("__p").isNull() | ~F.col("__p").eqNullSafe(F.struct(*cols))).drop("__p")


def changes(states: DataFrame, key: str, order: list[str], bucket: Column, cols: list[str]) -> DataFrame:
    """Rows whose state differs from the previous one of the key; a key's first row is a change."""
    return drop_repeats(states, key, order, bucket, cols)


def transition_kind(prev: Column) -> Column:
    """Highest-ranking transition between the previous state and the row; NULL for none."""
    outs, before = F.coalesce("outs", F.lit(0)), F.coalesce(prev["outs"], F.lit(0))
    return (F.when(prev.isNull(), F.lit(None).cast("string"))
            .when(~F.col("inning").eqNullSafe(prev["inning"]), "inning_start")
            .when(~F.col("inning_half").eqNullSafe(prev["inning_half"]), "half_start")
            .when((outs > before) & (outs < 3), "out_recorded")
            .when(~F.col("current_batter_id").eqNullSafe(prev["current_batter_id"]), "pa_start"))


LIVE_STATE = ["inning", "inning_half", "outs", "current_batter_id"]


def transitions_live(states: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    rows = scan(states, [key], order, bucket, prev={"__p": F.struct(*LIVE_STATE)})
    return rows.withColumn("trigger", transition_kind(F.col("__p"))).where(F.col("trigger").isNotNull()).drop("__p")


def inning_flips(states: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Whether inning or half differ from the previous row; a key's first inning never does."""
    rows = scan(states, [key], order, bucket, prev={"__p": F.struct("inning", "inning_half")})
    flip = F.col("__p.inning").isNotNull() & ~(
        F.col("__p.inning").eqNullSafe(F.col("inning")) & F.col("__p.inning_half").eqNullSafe(F.col("inning_half")))
    return rows.withColumn("inning_transition", flip).drop("__p")


def latest(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key."""
    from scorebook.operators.windows import dedup_latest

    return dedup_latest(states, [key], [F.col(c).desc() for c in order])


def latest_families(states: DataFrame, key: str, ts: str, families: dict[str, list[str]],
                    family: str = "family") -> DataFrame:
    """Snapshot with, per column family, the values and time of its newest update."""
    aggs = []
    for name, cols in families.items():
        mine = F.col(family) == name
        aggs += [F.max_by(F.when(mine, F.struct(*cols)), F.when(mine, F.col(ts))).alias(f"__{name}"),
                 F.max(F.when(mine, F.col(ts))).alias(f"{name}_updated_at")]
    out = states.groupBy(key).agg(*aggs)
    return out.select(key, *[F.col(f"__{n}")[c].alias(c) for n, cols in families.items() for c in cols],
                      *[f"{n}_updated_at" for n in families])


def expire(state: DataFrame, now, hours: int = 12, col: str = "abstract_game_state",
           started: str = "game_datetime") -> DataFrame:
    """Snapshot without finished games that started more than ``hours`` ago."""
    old = seconds_between(F.lit(now), F.col(started)) > hours * 3600
    done = F.col(col).isin("Final", "Completed Early")
    return state.where(~F.coalesce(done & old, F.lit(False)))


def stale(snapshot: DataFrame, now, seconds: int = 120, key: str = "game_pk", state: str = "abstract_game_state",
          last: str = "last_change_at") -> DataFrame:
    quiet = seconds_between(F.lit(now), F.col(last))
    return snapshot.where((F.col(state) == "Live") & (quiet > seconds)).select(key, quiet.alias("quiet_seconds"))
