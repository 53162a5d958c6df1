"""Daily additive counts per player, split by the opponent's hand.

Every function is one ``groupBy`` over conditional aggregates, so Spark combines on the map
side and ships one row per (player, date) and input partition, however many pitches a player
or a day holds. ``entity``, ``day`` and ``season`` name the grouping columns.

Each table is filtered first: an aggregate that carried all tables' columns at once would
evaluate every condition for every pitch and outgrow the JIT compiler's method limit.

The aggregates are Spark SQL texts: there are about a hundred per table, and parsing a text is
far cheaper than building the same tree call by call through the Python gateway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook import constants as K

HANDS = {"l": "L", "r": "R"}

BATTER_COLS = ["pa", "abs", "hits", "singles", "doubles", "triples", "hr", "bb", "ibb", "k", "hbp", "sf",
               "woba_value", "woba_denom", "ev_sum", "bip", "hard_hit", "barrel"]
PITCHER_COLS = ["bf", "outs", "hits", "singles", "doubles", "triples", "hr", "bb", "ibb", "k", "hbp", "sf", "sh",
                "woba_value", "woba_denom"]
ARSENAL_COLS = ["woba_value", "woba_denom", "bip", "gb", "fb", "ld"]
DISCIPLINE_COLS = ["swings", "whiffs", "ooz", "chases"]


def gen(names: list[str], hands: list[str] = ("l", "r"), stem: str = "{name}_vs_{hand}") -> list[str]:
    """Column names of every (name, hand) pair."""
    return [stem.format(name=n, hand=h) for n in names for h in hands]


def batter_names() -> list[str]:
    return gen(BATTER_COLS)


def pitcher_names() -> list[str]:
    return gen(PITCHER_COLS) + ["pitches", "games"]


def batter_arsenal_names() -> list[str]:
    return gen([f"{g}_{c}" for g in K.PITCH_GROUPS for c in ARSENAL_COLS])


def discipline_names() -> list[str]:
    return gen([f"{g}_{c}" for g in K.PITCH_GROUPS for c in DISCIPLINE_COLS])


def pitcher_arsenal_names() -> list[str]:
    types = [t.lower() for t in K.PITCH_TYPES]
    return (gen(["pitches"]) + gen([f"{t}_n" for t in types])
            + [f"{t}_{k}_{part}" for k in ("velo", "spin") for t in types for part in ("sum", "n")]
            + ["arm_angle_sum", "arm_angle_n", "extension_sum", "extension_n"])


def any_of(values: list) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def count_where(cond: str) -> str:
    return f"count_if(coalesce({cond}, false))"


def sum_where(cond: str, value: str) -> str:
    """NULL when no row qualifies."""
    return f"sum(CASE WHEN {cond} THEN {value} END)"


# Row filters of the count tables.
FINISHED = f"(pa_result IS NOT NULL AND pa_result <> '{K.TRUNCATED}')"
CLASSIFIED = f"({FINISHED} AND pitch_type IS NOT NULL)"
# A pitch without description is left out like a bunt.
JUDGED = f"coalesce(pitch_type IS NOT NULL AND description NOT IN {any_of(K.BUNTS)}, false)"
KNOWN = f"coalesce(pitch_type IN {any_of(K.PITCH_TYPES)}, false)"

OUTCOMES = {
    "hits": f"pa_result IN {any_of(K.HITS)}",
    "singles": "pa_result = 'single'",
    "doubles": "pa_result = 'double'",
    "triples": "pa_result = 'triple'",
    "hr": "pa_result = 'home_run'",
    "bb": f"pa_result IN {any_of(K.WALKS)}",
    "ibb": "pa_result = 'intent_walk'",
    "k": f"pa_result IN {any_of(K.STRIKEOUTS)}",
    "hbp": "pa_result = 'hit_by_pitch'",
    "sf": "pa_result = 'sac_fly'",
    "sh": "pa_result = 'sac_bunt'",
}

# Hard and well-angled contact: the admissible angle widens with the speed above 98.
BARREL = ("(launch_speed >= 98 AND launch_angle >= greatest(26 - (launch_speed - 98), 8D)"
          " AND launch_angle <= least(30 + (launch_speed - 98), 50D))")

SWING, WHIFF = f"description IN {any_of(K.SWINGS)}", f"description IN {any_of(K.WHIFFS)}"
OUTSIDE = f"zone IN {any_of(K.OUTSIDE_ZONES)}"


def _named(aggs: dict[str, str], names: list[str]) -> list[Column]:
    return [F.expr(aggs[n]).alias(n) for n in names]


def batter_aggs(within: str = "true") -> list[Column]:
    aggs = {}
    for h, code in HANDS.items():
        side = f"{within} AND pitch_hand = '{code}'"
        hit_ball = f"{side} AND bb_type IS NOT NULL"
        cols = {
            "pa": count_where(side),
            "abs": count_where(f"{side} AND pa_result NOT IN {any_of(K.NOT_AT_BAT)}"),
            "woba_value": sum_where(side, "woba_value"),
            "woba_denom": sum_where(side, "woba_denom"),
            "ev_sum": sum_where(hit_ball, "launch_speed"),
            "bip": count_where(hit_ball),
            "hard_hit": count_where(f"{hit_ball} AND launch_speed >= 95"),
            "barrel": count_where(f"{hit_ball} AND {BARREL}"),
        } | {n: count_where(f"{side} AND {c}") for n, c in OUTCOMES.items()}
        aggs |= {f"{n}_vs_{h}": cols[n] for n in BATTER_COLS}
    return _named(aggs, batter_names())


def pitcher_aggs(within: str = "true") -> list[Column]:
    aggs = {}
    for h, code in HANDS.items():
        side = f"{within} AND bat_side = '{code}'"
        cols = {
            "bf": count_where(side),
            "outs": (count_where(f"{side} AND pa_result IN {any_of(K.ONE_OUT)}") + " + 2 * "
                     + count_where(f"{side} AND pa_result IN {any_of(K.TWO_OUTS)}")),
            "woba_value": sum_where(side, "woba_value"),
            "woba_denom": sum_where(side, "woba_denom"),
        } | {n: count_where(f"{side} AND {c}") for n, c in OUTCOMES.items()}
        aggs |= {f"{n}_vs_{h}": cols[n] for n in PITCHER_COLS}
    return _named(aggs, gen(PITCHER_COLS))


def batter_arsenal_aggs(within: str = "true") -> list[Column]:
    aggs = {}
    for g, types in K.PITCH_GROUPS.items():
        for h, code in HANDS.items():
            here = f"{within} AND pitch_type IN {any_of(types)} AND pitch_hand = '{code}'"
            cols = {
                "woba_value": sum_where(here, "woba_value"),
                "woba_denom": sum_where(here, "woba_denom"),
                "bip": count_where(f"{here} AND bb_type IS NOT NULL"),
            } | {n: count_where(f"{here} AND bb_type IN {any_of(kinds)}") for n, kinds in K.BATTED_BALLS.items()}
            aggs |= {f"{g}_{n}_vs_{h}": cols[n] for n in ARSENAL_COLS}
    return _named(aggs, batter_arsenal_names())


def discipline_aggs(within: str = "true") -> list[Column]:
    tests = {"swings": SWING, "whiffs": WHIFF, "ooz": OUTSIDE, "chases": f"{SWING} AND {OUTSIDE}"}
    aggs = {f"{g}_{n}_vs_{h}": count_where(f"{within} AND pitch_type IN {any_of(types)} AND pitch_hand = '{code}' AND {tests[n]}")
            for g, types in K.PITCH_GROUPS.items() for n in DISCIPLINE_COLS for h, code in HANDS.items()}
    return _named(aggs, discipline_names())


def pitcher_arsenal_aggs(within: str = "true") -> list[Column]:
    """Pitch mix by batter hand; sums with their non-null counts, so averages stay mergeable."""
    side = {h: f"{within} AND bat_side = '{code}'" for h, code in HANDS.items()}
    aggs = {f"pitches_vs_{h}": count_where(side[h]) for h in HANDS}
    for t in K.PITCH_TYPES:
        low, kind = t.lower(), f"pitch_type = '{t}'"
        aggs |= {f"{low}_n_vs_{h}": count_where(f"{side[h]} AND {kind}") for h in HANDS}
        for name, col in (("velo", "release_speed"), ("spin", "release_spin_rate")):
            aggs[f"{low}_{name}_sum"] = sum_where(f"{within} AND {kind}", col)
            aggs[f"{low}_{name}_n"] = f"count(CASE WHEN {within} AND {kind} THEN {col} END)"
    for name, col in (("arm_angle", "arm_angle"), ("extension", "release_extension")):
        aggs[f"{name}_sum"] = sum_where(within, col)
        aggs[f"{name}_n"] = f"count(CASE WHEN {within} THEN {col} END)"
    return _named(aggs, pitcher_arsenal_names())


def _daily(events: DataFrame, rows: str, aggs: list[Column], keys: tuple[str, str, str]) -> DataFrame:
    return events.where(rows).groupBy(*keys).agg(*aggs)


def batter_counts(events: DataFrame, entity="batter_id", day="game_date", season="season") -> DataFrame:
    return _daily(events, FINISHED, batter_aggs(), (entity, day, season))


def pitcher_counts(events: DataFrame, entity="pitcher_id", day="game_date", season="season") -> DataFrame:
    """Plate appearances and the day's pitch count in one pass over the events.

    The pitch count takes every pitch, the other columns only finished plate appearances. Days
    without one are dropped, as an aggregate of appearances joined to one of pitches would.
    """
    done = [F.expr("count(1)").alias("pitches"), F.expr(count_where(FINISHED)).alias("__done")]
    daily = _daily(events, "true", [*pitcher_aggs(FINISHED), *done], (entity, day, season))
    return daily.where("__done > 0").selectExpr(entity, day, season, *gen(PITCHER_COLS), "pitches", "1 AS games")


def batter_arsenal_counts(events: DataFrame, entity="batter_id", day="game_date", season="season") -> DataFrame:
    return _daily(events, CLASSIFIED, batter_arsenal_aggs(), (entity, day, season))


def batter_discipline_counts(events: DataFrame, entity="batter_id", day="game_date", season="season") -> DataFrame:
    return _daily(events, JUDGED, discipline_aggs(), (entity, day, season))


def pitcher_arsenal_counts(events: DataFrame, entity="pitcher_id", day="game_date", season="season") -> DataFrame:
    return _daily(events, KNOWN, pitcher_arsenal_aggs(), (entity, day, season))
