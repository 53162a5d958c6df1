"""Filters, flags and labels as Column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(cond: Column) -> Column:
    """1/0, with NULL counted as 0."""
    return F.when(cond, 1).otherwise(0)


# --- row filters -------------------------------------------------------------

def only_types(df: DataFrame, types: list[str], col: str = "game_type") -> DataFrame:
    return df.where(F.col(col).isin(types))


def valid_outcomes(df: DataFrame, excluded: list[str], col: str = "pa_result") -> DataFrame:
    """Rows with an outcome that is not on the excluded list."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(excluded))


def has_match(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """EXISTS."""
    return df.join(other.select(*keys), keys, "left_semi")


def at_latest(df: DataFrame, date_col: str, by: list[str]) -> DataFrame:
    """Rows dated at the latest date of their group.

    The maximum is one pre-aggregated row per group, joined back, so a group with most of
    the rows is never gathered in one task.
    """
    top = df.groupBy(*by).agg(F.max(date_col).alias(date_col))
    return df.join(top, [*by, date_col], "left_semi")


def filter_dates(df: DataFrame, col: str = "game_date", seasons: list[int] | None = None,
                 date_range: tuple[str, str] | None = None, floor: str | None = None) -> DataFrame:
    """Load filters: seasons, an inclusive range, and a floor date."""
    if seasons:
        df = df.where(F.year(col).isin(seasons))
    if date_range:
        df = df.where(F.col(col).between(F.lit(date_range[0]).cast("date"), F.lit(date_range[1]).cast("date")))
    if floor:
        df = df.where(F.col(col) >= F.lit(floor).cast("date"))
    return df


def games_on(df: DataFrame, day: str | None = None, game_type: str | None = None,
             inning: int | None = None) -> DataFrame:
    """Apply only the filters that were given."""
    if day is not None:
        df = df.where(F.col("game_date") == F.lit(day).cast("date"))
    if game_type is not None:
        df = df.where(F.col("game_type") == game_type)
    if inning is not None:
        df = df.where(F.col("inning") == inning)
    return df


def trackable(games: DataFrame, now: datetime, hours: int = 8) -> DataFrame:
    """Games up to tomorrow that are not final, or that started in the last ``hours``."""
    now_c = F.lit(now)
    return games.where(
        (F.col("game_date") <= F.date_add(F.to_date(now_c), 1))
        & ((F.col("abstract_game_state") != "Final")
           | (F.col("game_datetime") > now_c - F.expr(f"INTERVAL {int(hours)} HOURS")))
    )


def needs_tracking(games: DataFrame, now: datetime, minutes: int = 60) -> DataFrame:
    """Live games, and previews that start within ``minutes``."""
    soon = F.col("game_datetime") <= F.lit(now) + F.expr(f"INTERVAL {int(minutes)} MINUTES")
    state = F.col("abstract_game_state")
    return games.where((state == "Live") | ((state == "Preview") & soon))


# --- flags and labels --------------------------------------------------------

def state_flags(df: DataFrame) -> DataFrame:
    """Half, side and runner flags of a pitch row."""
    bottom = flag(F.col("inning_topbot") == "Bot")
    return df.withColumns({
        "is_bottom": bottom,
        "runner_1b": flag(F.col("on_1b").isNotNull()),
        "runner_2b": flag(F.col("on_2b").isNotNull()),
        "runner_3b": flag(F.col("on_3b").isNotNull()),
        "is_home": bottom,
    })


def pitch_group(col="pitch_type") -> Column:
    """Pitch type to group; any other type gives NULL."""
    expr = None
    for name, members in K.PITCH_GROUPS.items():
        test = _c(col).isin(members)
        expr = F.when(test, name) if expr is None else expr.when(test, name)
    return expr


def discipline_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_swing": F.col("description").isin(K.SWINGS),
        "is_whiff": F.col("description").isin(K.WHIFFS),
        "is_outside_zone": F.col("zone").isin(K.OUTSIDE_ZONES),
    })


def platoon(hand, left, right) -> Column:
    """Left-handed variant for ``L``, the right-handed one for anything else, NULL included."""
    return F.when(_c(hand) == "L", _c(left)).otherwise(_c(right))


def opponent_hand(bat, throw) -> Column:
    """Side a batter takes against a pitcher: switch hitters take the opposite, default R."""
    b = F.upper(F.coalesce(_c(bat), F.lit("R")))
    p = F.upper(F.coalesce(_c(throw), F.lit("R")))
    return F.lower(F.when(b == "S", F.when(p == "R", "L").otherwise("R")).otherwise(b))


def rd_bucket(col, tail: int = 6) -> Column:
    """Run difference to its label; differences of ``tail`` and more share one label per side."""
    d = _c(col).cast("int")
    return (F.when(d <= -tail, f"rd_lte_m{tail}")
            .when(d >= tail, f"rd_gte_p{tail}")
            .when(d < 0, F.concat(F.lit("rd_m"), (-d).cast("string")))
            .when(d > 0, F.concat(F.lit("rd_p"), d.cast("string")))
            .when(d == 0, "rd_0"))


def bucket_rd(col, tail: int = 6) -> Column:
    """Label back to a representative difference (the tails stand for one more run)."""
    label = _c(col)
    n = F.regexp_extract(label, r"(\d+)$", 1).cast("int")
    n = F.when(label.like("rd\\_lte%") | label.like("rd\\_gte%"), n + 1).otherwise(n)
    return F.when(label.rlike(r"m\d+$"), -n).otherwise(n)


def phase(col) -> Column:
    return F.when(_c(col) <= 3, "early").when(_c(col) <= 6, "mid").otherwise("late")


def base_mask(first, second, third) -> Column:
    """Bit mask of occupied bases from three nullable columns."""
    return (F.when(_c(first).isNotNull(), 1).otherwise(0)
            .bitwiseOR(F.when(_c(second).isNotNull(), 2).otherwise(0))
            .bitwiseOR(F.when(_c(third).isNotNull(), 4).otherwise(0)))


def clamp(col, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(col)))


def home_lead(half, diff) -> Column:
    """Batting-side difference seen from the home side."""
    return F.when(_c(half) == 1, _c(diff)).otherwise(-_c(diff))


def horizon_no(label) -> Column:
    """Number of half-innings in a ``+<n>hi`` label; NULL for other labels."""
    return F.when(_c(label).like("+%hi"), F.regexp_extract(_c(label), r"^\+(\d+)hi$", 1).try_cast("int"))


def bases_text(mask) -> Column:
    """``1B 3B`` style text of a base mask, ``---`` when empty."""
    m = _c(mask)
    text = F.concat_ws(
        " ",
        F.when(m.bitwiseAND(1) > 0, "1B"),
        F.when(m.bitwiseAND(2) > 0, "2B"),
        F.when(m.bitwiseAND(4) > 0, "3B"),
    )
    return F.when(text == "", "---").otherwise(text)


def path_label(path) -> Column:
    """Last two segments of a path, trailing slashes ignored."""
    return F.nullif(F.substring_index(F.rtrim(_c(path), F.lit("/")), "/", -2), F.lit(""))


# --- live adjustments --------------------------------------------------------

def adjust_in_play(df: DataFrame) -> DataFrame:
    """Provisional runs and outs of a ball in play that has no result yet.

    Needs ``is_complete, event, is_in_play, description, half, outs, away_score, home_score``.
    """
    flat = [v for text, d in K.IN_PLAY_DELTAS.items()
            for v in (F.lit(text), F.struct(F.lit(d[0]).alias("runs"), F.lit(d[1]).alias("outs")))]
    hit = F.create_map(*flat)[F.col("description")]
    open_play = (~F.coalesce("is_complete", F.lit(False)) & F.col("event").isNull()
                 & F.coalesce("is_in_play", F.lit(False)) & hit.isNotNull())
    runs = F.when(open_play, hit["runs"]).otherwise(0)
    outs = F.when(open_play, hit["outs"]).otherwise(0)
    return df.withColumns({
        "outs": F.col("outs") + outs,
        "away_score": F.col("away_score") + F.when(F.col("half") == 0, runs).otherwise(0),
        "home_score": F.col("home_score") + F.when(F.col("half") == 0, 0).otherwise(runs),
    })


def seed_context(df: DataFrame) -> DataFrame:
    """Starting context of the current plate appearance from a pitcher's line so far.

    Needs ``batters_faced, pitches, walks, hits, strikeouts, runs, balls, strikes``.
    """
    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("double")

    bf = F.coalesce(F.col("batters_faced"), F.lit(0))
    whip = F.when(bf > 0, (n("walks") + n("hits")) / F.nullif(bf, F.lit(0))).otherwise(F.lit(0.0))
    return df.withColumns({
        "times_through_order": F.least(F.floor(bf / 9) + 1, F.lit(4)).cast("double"),
        "batter_prior_pa": F.lit(0.0),
        "pitcher_pitch_count": n("pitches"),
        "pitcher_bf_game": bf.cast("double"),
        "batter_ab_vs_pitcher": F.lit(0.0),
        "pitcher_outing_walks": n("walks"),
        "pitcher_outing_hits": n("hits"),
        "pitcher_outing_k": n("strikeouts"),
        "pitcher_outing_runs": n("runs"),
        "pitcher_outing_whip": whip,
        "pitcher_recent_whip": whip,
        "balls": n("balls"),
        "strikes": n("strikes"),
    })
