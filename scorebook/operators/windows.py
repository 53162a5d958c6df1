"""De-duplication, first/last rows, in-game running state and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook import constants as K
from scorebook.functions.predicates import flag, state_flags
from scorebook.plans.ordered import scan


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.

    ``row_number() <= n`` is planned with a group limit on both sides of the shuffle, so at most
    ``n`` rows per key leave an input partition, whatever the size of the group.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(spec)).where(F.col("__rn") <= n).drop("__rn")


def dedup_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the latest load (``order`` descending) winning."""
    return first_per(df, keys, order)


PA = ["game_pk", "at_bat_number"]


def first_pitch(df: DataFrame) -> DataFrame:
    return first_per(df, PA, [F.col("pitch_number").asc()])


def terminal_pitch(df: DataFrame) -> DataFrame:
    return first_per(df, PA, [F.col("pitch_number").desc()])


# --- in-game running state ---------------------------------------------------

def _stints(events: DataFrame) -> DataFrame:
    """One row per plate appearance, pitcher and batter: the grain all game windows need."""
    r = F.col("pa_result")
    return events.groupBy(*PA, "pitcher_id", "batter_id").agg(
        F.count(F.lit(1)).alias("n_pitches"),
        F.count_if(F.coalesce(r.isin(K.WALKS), F.lit(False))).alias("n_walks"),
        F.count_if(F.coalesce(r.isin(K.HITS), F.lit(False))).alias("n_hits"),
        F.count_if(F.coalesce(r.isin(K.STRIKEOUTS), F.lit(False))).alias("n_k"),
        F.sum(F.coalesce(F.col("post_bat_score") - F.col("bat_score"), F.lit(0))).alias("n_runs"),
        F.max("pa_result").alias("pa_result"),
    )


def pa_context(stints: DataFrame, excluded: list[str]) -> DataFrame:
    """Values known before each plate appearance; one shuffle on the game serves all windows."""
    stints = stints.repartition("game_pk")
    outing = Window.partitionBy("game_pk", "pitcher_id").orderBy("at_bat_number")
    before = outing.rangeBetween(Window.unboundedPreceding, -1)
    pair = Window.partitionBy("game_pk", "batter_id", "pitcher_id").orderBy("at_bat_number")
    known = stints.select(
        *PA, "pitcher_id", "batter_id",
        F.max("pa_result").over(Window.partitionBy(*PA)).alias("target"),
        (F.dense_rank().over(pair) - 1).cast("long").alias("batter_ab_vs_pitcher"),
        F.dense_rank().over(outing).cast("long").alias("pitcher_bf_game"),
        *[F.sum(c).over(before).alias(f"__{c}") for c in COUNTERS])
    known = known.where(F.col("target").isNotNull() & ~F.col("target").isin(excluded))
    # Only appearances that survive the outcome filter count for the recent ratio; one that is
    # shared by two batters counts once.
    shared = Window.partitionBy("game_pk", "pitcher_id", "at_bat_number").orderBy("batter_id")
    known = known.withColumns({"__ord": F.dense_rank().over(outing), "__one": F.row_number().over(shared) == 1})
    last3 = Window.partitionBy("game_pk", "pitcher_id").orderBy("__ord").rangeBetween(-3, -1)
    reached = F.count(F.when(F.col("__one") & F.col("target").isin(K.WALKS + K.HITS), 1)).over(last3).cast("double")
    faced = F.count(F.when(F.col("__one"), 1)).over(last3)
    return known.withColumn("pitcher_recent_whip", reached / F.nullif(faced, F.lit(0))).drop("__ord", "__one")


COUNTERS = {"n_pitches": "pitcher_pitch_count", "n_walks": "pitcher_outing_walks",
            "n_hits": "pitcher_outing_hits", "n_k": "pitcher_outing_k", "n_runs": "pitcher_outing_runs"}


def game_state(events: DataFrame, excluded: list[str] = K.EXCLUDED_OUTCOMES) -> DataFrame:
    """Pre-pitch state of every pitch of a modelled plate appearance, with the final outcome.

    The running values split in two: what earlier plate appearances contribute, from windows
    over a frame with one row per plate appearance, and what earlier pitches of the same
    appearance contribute, from a window over a handful of rows. Pitches are therefore
    shuffled on the plate appearance, never on the game or the pitcher.
    """
    context = pa_context(_stints(events), excluded)

    in_pa = Window.partitionBy(*PA, "pitcher_id").orderBy("pitch_number")
    earlier = in_pa.rowsBetween(Window.unboundedPreceding, -1)
    r = F.col("pa_result")
    own = {
        "n_pitches": F.row_number().over(in_pa),
        "n_walks": F.count(F.when(r.isin(K.WALKS), 1)).over(earlier),
        "n_hits": F.count(F.when(r.isin(K.HITS), 1)).over(earlier),
        "n_k": F.count(F.when(r.isin(K.STRIKEOUTS), 1)).over(earlier),
        "n_runs": F.sum(F.coalesce(F.col("post_bat_score") - F.col("bat_score"), F.lit(0))).over(earlier),
    }
    pitches = state_flags(events).select(
        *PA, "pitch_number", "game_date", "batter_id", "pitcher_id", "bat_side", "pitch_hand",
        "inning", "is_bottom", F.col("outs_when_up").alias("outs"), "runner_1b", "runner_2b", "runner_3b",
        "balls", "strikes", F.col("bat_score_diff").alias("run_diff"), "is_home",
        F.col("n_thruorder_pitcher").alias("times_through_order"),
        F.col("n_priorpa_thisgame_player_at_bat").alias("batter_prior_pa"),
        *[e.alias(f"__own_{c}") for c, e in own.items()])
    # Null-safe on both players: a pitch without one keeps its row.
    same = [pitches[c].eqNullSafe(context[c]) if c in ("pitcher_id", "batter_id") else pitches[c] == context[c] for c in [*PA, "pitcher_id", "batter_id"]]
    joined = pitches.join(context, same).drop(*[context[c] for c in [*PA, "pitcher_id", "batter_id"]])

    def counter(c: str) -> Column:
        past, here = F.col(f"__{c}"), F.col(f"__own_{c}")
        if c == "n_runs":
            return F.when(past.isNull(), here).when(here.isNull(), past).otherwise(past + here)
        return (F.coalesce(past, F.lit(0)) + here).cast("long")

    out = joined.withColumns({name: counter(c) for c, name in COUNTERS.items()})
    ratio = ((F.col("pitcher_outing_walks") + F.col("pitcher_outing_hits")).cast("double")
             / F.nullif(F.col("pitcher_bf_game") - 1, F.lit(0)))
    return out.withColumn("pitcher_outing_whip", ratio).select(*K.STATE_COLUMNS)


def recent_whip(pas: DataFrame, n: int = 3) -> DataFrame:
    """Share of walks and hits among the pitcher's last ``n`` appearances before each one.

    ``pas`` holds one row per (game_pk, pitcher_id, at_bat_number) with its ``target``.
    """
    spec = Window.partitionBy("game_pk", "pitcher_id").orderBy("at_bat_number").rowsBetween(-n, -1)
    reached = F.count(F.when(F.col("target").isin(K.WALKS + K.HITS), 1)).over(spec).cast("double")
    return pas.select("game_pk", "pitcher_id", "at_bat_number",
                      (reached / F.nullif(F.count(F.lit(1)).over(spec), F.lit(0))).alias("pitcher_recent_whip"))


# --- timed events ------------------------------------------------------------

# A game has a few hundred rows at most, so windows over a game or a side of it are plain ones.

def event_windows(gumbo: DataFrame) -> DataFrame:
    """End time of the previous event of the game, the start of each event's validity."""
    order = Window.partitionBy("game_pk").orderBy("at_bat_number", F.col("play_event_index").asc_nulls_last())
    return gumbo.withColumn("prev_event_end_ts", F.lag("event_end_ts").over(order))


# --- labels ------------------------------------------------------------------

def _side() -> Window:
    return Window.partitionBy("game_pk", "is_bottom").orderBy("at_bat_number")


def pull_labels(pas: DataFrame) -> DataFrame:
    """Starter flag and pitcher-change label of each plate appearance of a side."""
    first = F.first("pitcher_id").over(_side().rowsBetween(Window.unboundedPreceding, 0))
    return pas.withColumns({
        "starter_flag": flag(F.col("pitcher_id") == first),
        "pulled": flag(F.lead("pitcher_id").over(_side()) != F.col("pitcher_id")),
    })


def re_features(pas: DataFrame) -> DataFrame:
    """Run expectancy of each appearance and its change since the side's previous one."""
    from scorebook.operators.lookups import run_expectancy

    df = run_expectancy(pas.withColumn(
        "bases", F.col("runner_1b") + 2 * F.col("runner_2b") + 4 * F.col("runner_3b"))).drop("bases")
    start = F.lit(K.RUN_EXPECTANCY[0][0])
    return df.withColumn("re_diff", F.col("current_re") - F.coalesce(F.lag("current_re").over(_side()), start))


# --- change runs -------------------------------------------------------------

def polls_per_change(polls: DataFrame, key: str, order: list[str], bucket: Column,
                     changed="changed", event="event_type") -> DataFrame:
    """Median number of idle polls after a change, by the event that opened the gap.

    Every change opens an island; the last, still open one is not counted, nor are polls
    before the first change.
    """
    is_change = F.when(F.coalesce(F.col(changed), F.lit(False)), 1).otherwise(0)
    rows = scan(polls.withColumn("__c", is_change), [key], order, bucket, totals={"__seen": F.col("__c")})
    rows = rows.withColumn("__island", F.coalesce("__seen", F.lit(0)) + F.col("__c"))
    islands = rows.where("__island > 0").groupBy(key, "__island").agg(
        F.count_if(F.col("__c") == 0).alias("idle"),
        F.max(F.when(F.col("__c") == 1, F.col(event))).alias("event_type"))
    last = islands.groupBy(key).agg(F.max("__island").alias("__last"))
    closed = islands.join(last, key).where("__island < __last")
    return closed.groupBy(key, "event_type").agg(F.expr("percentile(idle, 0.5)").alias("median_idle"))


def actual_horizons(events: DataFrame, entries: DataFrame) -> DataFrame:
    """States reached after an entry point: ``+1pa``, then each half-inning boundary ``+<n>hi``.

    ``events`` has one or more rows per plate appearance with ``inning, half, outs, bases,
    home_score, away_score``; ``entries`` has ``game_pk, entry_ab``.
    """
    pas = first_pitch(events).join(entries, "game_pk").where(F.col("at_bat_number") > F.col("entry_ab"))
    order = Window.partitionBy("game_pk", "entry_ab").orderBy("at_bat_number")
    pas = pas.withColumns({"__n": F.row_number().over(order), "__inning": F.lag("inning").over(order), "__half": F.lag("half").over(order)})
    turned = F.when(F.col("__inning").isNull(), 0).otherwise(
        F.when((F.col("__inning") != F.col("inning")) | (F.col("__half") != F.col("half")), 1).otherwise(0))
    pas = pas.withColumn("__turn", turned)
    pas = pas.withColumn("__no", F.coalesce(F.sum("__turn").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    label = F.array_compact(F.array(
        F.when(F.col("__n") == 1, F.lit("+1pa")),
        F.when(F.col("__turn") == 1, F.concat(F.lit("+"), F.col("__no").cast("string"), F.lit("hi")))))
    return pas.select("game_pk", "entry_ab", F.explode(label).alias("horizon"), "at_bat_number",
                      "inning", "half", "outs", "bases", "home_score", "away_score")
