"""As-of joins, profile joins and key set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.operators.windows import dedup_latest, first_per
from scorebook.plans.ordered import latest_before


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str,
              strict: bool = True, how: str = "inner", bucket: Callable[[Column], Column] | None = None,
              prefix: str = "", probes: DataFrame | None = None) -> DataFrame:
    """Each left row with the latest earlier right row of its key.

    ``right`` has one row per (``on``, ``right_ts``). The match is found on distinct narrow keys
    only: (key, time) pairs of the left against those of the right. Wide rows are then fetched by
    equality on (key, matched time), where a hot key is already spread over its times. Pass
    ``bucket`` (time -> coarser time) when times are finer than dates, so the search itself
    splits inside a key.

    A right column whose name (with ``prefix``) is that of ``left_ts`` is not repeated.
    ``probes`` may supply the left's (key, time) pairs, or a superset, from a cheaper source.
    ``strict`` matches ``left_ts > right_ts``, otherwise ``>=``. Inner drops unmatched left rows.
    """
    match = latest_before(left if probes is None else probes, right, on, left_ts, right_ts, strict, bucket, out="__matched")
    if how == "inner":
        match = match.where(F.col("__matched").isNotNull())
    carried = [c for c in right.columns if c not in on and prefix + c != left_ts]
    values = right.select(*on, F.col(right_ts).alias("__matched"), *[F.col(c).alias(prefix + c) for c in carried])
    matched = match.join(values, [*on, "__matched"], "left").drop("__matched")
    return left.join(matched, [*on, left_ts], "inner" if how == "inner" else "left")


def latest_values_before(df: DataFrame, ids: DataFrame, key: str, day: str, before: Column | str) -> DataFrame:
    """Latest row per listed id dated before a fixed day."""
    limit = F.lit(before).cast("date") if isinstance(before, str) else before
    return first_per(df.where(F.col(day) < limit).join(ids.select(key).distinct(), key, "left_semi"),
                     [key], [F.col(day).desc()])


def wide_left(base: DataFrame, others: list[DataFrame], keys: list[str], drop: list[str]) -> DataFrame:
    """Left-join per-date tables onto ``base``; their own copies of ``drop`` are left out."""
    out = base
    for o in others:
        out = out.join(o.drop(*drop), keys, "left")
    return out


def batter_profile(b: DataFrame, a: DataFrame, d: DataFrame) -> DataFrame:
    return wide_left(b, [a, d], ["batter_id", "game_date"], ["season"])


def pitcher_profile(p: DataFrame, a: DataFrame) -> DataFrame:
    return wide_left(p, [a], ["pitcher_id", "game_date"], ["season"])


def event_state(state: DataFrame, gumbo: DataFrame, games: DataFrame) -> DataFrame:
    """Pitch state with the validity window of its timed event and the game's teams."""
    timed = gumbo.where((F.col("event_type") == "pitch") & F.col("pitch_number").isNotNull()).select(
        "game_pk", "at_bat_number", "pitch_number", "play_id", "event_start_ts", "event_end_ts",
        "prev_event_end_ts", "pa_start_ts", "pa_end_ts")
    keys = ["game_pk", "at_bat_number", "pitch_number"]
    timed = dedup_latest(timed, keys, [F.col("event_end_ts").desc_nulls_last()])
    teams = games.select("game_pk", "game_type", "home_team_id", "home_team_name", "away_team_id", "away_team_name")
    return state.join(timed, keys).join(teams, "game_pk", "left")


def all_players(events: DataFrame) -> DataFrame:
    """Distinct batters and pitchers; both sides are reduced before the union."""
    return (events.select(F.col("batter_id").alias("player_id")).distinct()
            .union(events.select(F.col("pitcher_id")).distinct()).distinct())


def new_players(events: DataFrame, players: DataFrame) -> DataFrame:
    return all_players(events).join(players.select("player_id"), "player_id", "left_anti")


def key_changes(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys that appeared or disappeared."""
    p, c = previous.select(key).distinct(), current.select(key).distinct()
    return (c.join(p, key, "left_anti").withColumn("change", F.lit("added"))
            .unionByName(p.join(c, key, "left_anti").withColumn("change", F.lit("removed"))))


def merge_schedule(live: DataFrame, schedule: DataFrame, key: str = "game_pk",
                   guarded: tuple[str, ...] = ("status", "abstract_game_state"),
                   live_mark: str = "live_updated_at") -> DataFrame:
    """Full merge of the snapshot with the schedule.

    Schedule columns overwrite the snapshot's, except the guarded ones of a game that has live
    data. Live-only columns and games stay.
    """
    shared = [c for c in schedule.columns if c != key]
    s = schedule.select(key, F.lit(True).alias("__in"), *[F.col(c).alias(f"__s_{c}") for c in shared])
    joined = live.join(s, key, "full_outer")
    has_live = F.col(live_mark).isNotNull() if live_mark in live.columns else F.lit(False)

    def pick(c: str) -> Column:
        new = F.col(f"__s_{c}")
        if c not in live.columns:
            return new.alias(c)
        take = F.coalesce(F.col("__in"), F.lit(False))
        if c in guarded:
            take = take & ~has_live
        return F.when(take, new).otherwise(F.col(c)).alias(c)

    rest = [c for c in live.columns if c != key and c not in shared]
    return joined.select(key, *[pick(c) for c in shared], *rest)
