"""Roles: the given star-schema tables seen as sports tables.

Every role is a row-wise or grouped expression over a whole given table, written once and
rendered for both engines: as DataFrames here, as common table expressions for the SQL check.
A game is a block of 54 order keys, an order a plate appearance, a line item a pitch; line
items that repeat (order, line number) are loads of the same pitch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorebook.session import apply_defaults

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    apply_defaults(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Spark:
    name = "spark"

    @staticmethod
    def div(a, b):
        return f"(({a}) div ({b}))"

    @staticmethod
    def pick(values, index):
        return f"element_at(array({_items(values)}), cast(({index}) as int) + 1)"

    @staticmethod
    def day(start, n):
        return f"date_add(DATE'{start}', cast({n} as int))"

    @staticmethod
    def ymd(ts):
        return f"date_format({ts}, 'yyyyMMdd')"

    @staticmethod
    def plus_minutes(day, n):
        return f"timestampadd(MINUTE, cast({n} as int), cast({day} as timestamp_ntz))"

    text = "string"


class Duck(Spark):
    name = "duck"

    @staticmethod
    def div(a, b):
        return f"(({a}) // ({b}))"

    @staticmethod
    def pick(values, index):
        return f"list_extract([{_items(values)}], cast(({index}) as int) + 1)"

    @staticmethod
    def day(start, n):
        return f"(DATE '{start}' + cast({n} as int))"

    @staticmethod
    def ymd(ts):
        return f"strftime({ts}, '%Y%m%d')"

    @staticmethod
    def plus_minutes(day, n):
        return f"(cast({day} as timestamp) + to_minutes(cast({n} as bigint)))"

    text = "varchar"


def _items(values) -> str:
    return ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in values)


Steps = list[dict[str, str]]

# Outcome of a finished plate appearance by a number modulo 44.
OUTCOMES = (["strikeout"] * 9 + ["field_out"] * 8 + ["single"] * 6 + ["walk"] * 4 + ["double"] * 2 + ["home_run"] * 2
            + ["triple", "hit_by_pitch", "sac_fly", "sac_bunt", "grounded_into_double_play", "force_out", "intent_walk",
               "field_error", "truncated_pa", "double_play", "strikeout_double_play", "fielders_choice_out",
               "fielders_choice"])
IN_PLAY = ("single", "double", "triple", "home_run", "field_out", "sac_fly", "force_out", "double_play",
           "grounded_into_double_play", "fielders_choice", "fielders_choice_out", "field_error")
PITCHES = ["FF", "SI", "FC", "SL", "CU", "KC", "SV", "ST", "CH", "FS", "PO", None]
CALLS = ["swinging_strike", "swinging_strike_blocked", "foul", "foul_tip", "hit_into_play", "hit_into_play_no_out",
         "hit_into_play_score", "ball", "called_strike", "foul_bunt", "missed_bunt", "bunt_foul_tip", None]
WOBA = {"single": 0.875, "double": 1.25, "triple": 1.625, "home_run": 2.0, "walk": 0.6875, "hit_by_pitch": 0.75}


def _case(col: str, values: dict[str, float], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN cast({v} as double)" for k, v in values.items()) + f" ELSE {other} END"


def pitch_steps(d) -> tuple[Steps, list[str]]:
    """Line items as raw pitch rows under the provider's column names."""
    seed = "(l_partkey * 7 + l_suppkey)"
    bits = f"(CASE WHEN outs_when_up = 0 THEN 0 ELSE (l_orderkey * 5 + game_pk) % 8 END)"
    steps = [
        {"game_pk": d.div("l_orderkey", 54), "ab0": "l_orderkey % 54", "pitch_number": "l_linenumber",
         "last_no": "max(l_linenumber) OVER (PARTITION BY l_orderkey)"},
        {"hi": d.div("ab0", 3), "at_bat_number": "cast(ab0 + 1 as int)"},
        {"idx": f"{d.div('hi', 2)} * 3 + ab0 % 3", "inning": f"cast({d.div('hi', 2)} + 1 as int)",
         "inning_topbot": "CASE WHEN hi % 2 = 0 THEN 'Top' ELSE 'Bot' END", "away": "game_pk % 30",
         "home": f"(game_pk % 30 + 1 + {d.div('game_pk', 30)} % 29) % 30", "outs_when_up": "cast(ab0 % 3 as int)",
         "game_date": d.day("2018-04-01", f"(game_pk % 4) * 365 + {d.div('game_pk', 4)} % 180")},
        {"bat_team": "CASE WHEN inning_topbot = 'Top' THEN away ELSE home END",
         "fld_team": "CASE WHEN inning_topbot = 'Top' THEN home ELSE away END", "bits": bits,
         "away_idx": f"CASE WHEN inning_topbot = 'Top' THEN idx ELSE {d.div('hi', 2)} * 3 + 3 END",
         "home_idx": f"CASE WHEN inning_topbot = 'Top' THEN {d.div('hi', 2)} * 3 ELSE idx END",
         "events": f"CASE WHEN l_linenumber = last_no THEN {d.pick(OUTCOMES, seed + ' % 44')} END"},
        {"batter": "1000 + bat_team * 20 + CASE WHEN idx >= 18 AND idx % 9 = 4 THEN 12 ELSE idx % 9 END",
         "pitcher": f"5000 + fld_team * 20 + CASE WHEN idx < 14 THEN {d.div('game_pk', 30)} % 5 "
                    "WHEN idx < 20 THEN 5 + game_pk % 4 ELSE 9 + game_pk % 3 END",
         "away_score": f"cast({d.div('away_idx * (1 + game_pk % 3)', 6)} as int)",
         "home_score": f"cast({d.div('home_idx * (1 + ' + d.div('game_pk', 3) + ' % 3)', 6)} as int)",
         "bb_type": f"CASE WHEN events IN ({_items(IN_PLAY)}) THEN "
                    f"{d.pick(['ground_ball', 'fly_ball', 'line_drive', 'popup', None], 'l_partkey % 5')} END"},
        {"p_throws": "CASE WHEN pitcher % 4 = 0 THEN 'L' ELSE 'R' END",
         "bat_score": "CASE WHEN inning_topbot = 'Top' THEN away_score ELSE home_score END",
         "fld_score": "CASE WHEN inning_topbot = 'Top' THEN home_score ELSE away_score END"},
        {"stand": "CASE batter % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE CASE WHEN p_throws = 'L' THEN 'R' ELSE 'L' END END",
         "post_bat_score": "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE bat_score + CASE l_partkey % 11 WHEN 0 THEN 1 "
                           "WHEN 1 THEN 2 ELSE 0 END END",
         "bat_score_diff": "bat_score - fld_score", "game_year": "cast(year(game_date) as int)",
         "game_type": d.pick(["R"] * 10 + ["F", "S"], "game_pk % 12"),
         "balls": f"cast(least(3, {d.div('pitch_number - 1', 2)}) as int)",
         "strikes": f"cast(least(2, {d.div('pitch_number', 2)}) as int)",
         "on_1b": "CASE WHEN bits % 2 = 1 THEN 1000 + bat_team * 20 + (idx + 8) % 9 END",
         "on_2b": f"CASE WHEN {d.div('bits', 2)} % 2 = 1 THEN 1000 + bat_team * 20 + (idx + 7) % 9 END",
         "on_3b": f"CASE WHEN {d.div('bits', 4)} % 2 = 1 THEN 1000 + bat_team * 20 + (idx + 6) % 9 END",
         "pitch_type": d.pick(PITCHES, "(l_suppkey + l_partkey) % 12"),
         "description": d.pick(CALLS, "(l_partkey * 3 + l_linenumber) % 13"),
         "zone": "CASE WHEN cast(l_quantity as int) % 15 = 0 THEN NULL ELSE cast(l_quantity as int) % 15 END",
         "release_speed": "CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE 70 + l_quantity / 2 END",
         "release_spin_rate": "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE cast(1800 + l_partkey % 900 as double) END",
         "release_extension": "5 + cast(l_suppkey % 16 as double) / 8",
         "launch_speed": "CASE WHEN bb_type IS NOT NULL THEN 80 + l_quantity / 2 END",
         "launch_angle": "CASE WHEN bb_type IS NOT NULL THEN cast((l_suppkey * 3 + l_partkey) % 61 - 10 as double) END",
         "woba_value": f"CASE WHEN events IS NOT NULL THEN {_case('events', WOBA, 'cast(0 as double)')} END",
         "woba_denom": "CASE WHEN events IS NULL OR events = 'truncated_pa' THEN NULL "
                       "WHEN events IN ('intent_walk', 'sac_bunt') THEN cast(0 as double) ELSE cast(1 as double) END",
         "n_thruorder_pitcher": f"cast({d.div('idx', 9)} + 1 as int)",
         "n_priorpa_thisgame_player_at_bat": f"cast({d.div('idx', 9)} as int)",
         "_load_id": d.ymd("l_shipdate"),
         "_row": "(l_partkey * 1000000 + l_suppkey) * 64 + cast(l_quantity as bigint)"},
    ]
    cols = ("game_pk at_bat_number pitch_number game_date game_year game_type batter pitcher stand p_throws inning "
            "inning_topbot balls strikes outs_when_up on_1b on_2b on_3b home_score away_score bat_score fld_score "
            "post_bat_score bat_score_diff pitch_type zone release_speed release_spin_rate release_extension "
            "launch_speed launch_angle bb_type events description woba_value woba_denom n_thruorder_pitcher "
            "n_priorpa_thisgame_player_at_bat _load_id _row").split()
    return steps, cols


def game_steps(d) -> tuple[Steps, list[str]]:
    """One row per game from its orders: (game_pk, n, s) with s the whole total price."""
    states = ["Preview", "Live"] + ["Final"] * 9
    steps = [
        {"official_date": d.day("2018-04-01", f"(game_pk % 4) * 365 + {d.div('game_pk', 4)} % 180"),
         "abstract_game_state": d.pick(states, "game_pk % 11"),
         "game_type": d.pick(["R"] * 10 + ["F", "S"], "game_pk % 12"),
         "away_team_id": "cast(100 + game_pk % 30 as int)",
         "home_team_id": f"cast(100 + (game_pk % 30 + 1 + {d.div('game_pk', 30)} % 29) % 30 as int)",
         "home_score": "cast(s % 11 as int)", "away_score": f"cast({d.div('s', 11)} % 10 as int)",
         "venue_id": "cast(200 + game_pk % 30 as int)"},
        {"season": "cast(year(official_date) as int)", "game_datetime": d.plus_minutes("official_date", "720 + (game_pk % 40) * 15"),
         "status": "CASE WHEN game_pk % 17 = 5 THEN 'Postponed' WHEN game_pk % 17 = 6 THEN 'Cancelled' "
                   "WHEN abstract_game_state = 'Live' THEN 'In Progress' WHEN abstract_game_state = 'Preview' "
                   "THEN 'Scheduled' ELSE 'Final' END",
         "away_team_name": f"concat('Team ', cast(away_team_id as {d.text}))",
         "home_team_name": f"concat('Team ', cast(home_team_id as {d.text}))",
         "venue_name": f"concat('Park ', cast(venue_id as {d.text}))",
         "day_night": "CASE WHEN game_pk % 3 = 0 THEN 'day' ELSE 'night' END", "scheduled_innings": "9",
         "double_header": "'N'"},
    ]
    cols = ("game_pk official_date game_datetime season game_type status abstract_game_state away_team_id away_team_name "
            "home_team_id home_team_name away_score home_score venue_name venue_id day_night scheduled_innings "
            "double_header").split()
    return steps, cols


def roster_steps(d) -> tuple[Steps, list[str]]:
    """Games crossed with 52 roster places; place is 0..25 per side."""
    steps = [
        {"side": "CASE WHEN place < 26 THEN 'away' ELSE 'home' END", "no": "place % 26",
         "team": f"CASE WHEN place < 26 THEN game_pk % 30 ELSE (game_pk % 30 + 1 + {d.div('game_pk', 30)} % 29) % 30 END"},
        {"player_id": "CASE WHEN no < 14 THEN 1000 + team * 20 + no ELSE 5000 + team * 20 + no - 14 END",
         "team_id": "cast(100 + team as int)",
         "position": f"CASE WHEN no < 14 THEN {d.pick(['C', '1B', '2B', '3B', 'SS', 'LF', 'CF', 'RF', 'DH'], 'no % 9')} ELSE 'P' END",
         "batting_order": "CASE WHEN no < 9 THEN cast(no + 1 as int) END",
         "is_starting_pitcher": f"no >= 14 AND no - 14 = {d.div('game_pk', 30)} % 5"},
    ]
    return steps, "game_pk player_id team_id side position batting_order is_starting_pitcher".split()


def player_steps(d) -> tuple[Steps, list[str]]:
    """Customers as players."""
    steps = [{"player_id": "1000 + c_custkey", "full_name": "c_name",
              "position": d.pick(["C", "1B", "SS", "CF", "P"], "c_custkey % 5"),
              "bats": d.pick(["L", "R", "S"], "c_custkey % 3"), "throws": d.pick(["R", "L"], "c_custkey % 2"),
              "team_id": "100 + c_nationkey", "team_name": f"concat('Team ', cast(100 + c_nationkey as {d.text}))"}]
    return steps, "player_id full_name team_name position bats throws team_id".split()


def poll_steps(d) -> tuple[Steps, list[str]]:
    """Events as polls of a game per user."""
    steps = [
        {"game_pk": "user_id", "response_ms": "value * 40", "changed": "event_type IN ('purchase', 'signup')",
         "error": "CASE WHEN event_type = 'error' THEN 'timeout' END",
         "abstract_game_state": d.pick(["Live", "Preview", "Final"], "user_id % 3"),
         "inning": "cast(day(ts) as int)", "inning_half": "CASE WHEN hour(ts) < 12 THEN 'Top' ELSE 'Bottom' END",
         "outs": f"cast({d.div('hour(ts) % 12', 4)} as int)", "current_batter_id": "event_id % 3"},
    ]
    cols = ("game_pk event_id ts event_type response_ms changed error abstract_game_state inning inning_half outs "
            "current_batter_id").split()
    return steps, cols


def eval_game_steps(d) -> tuple[Steps, list[str]]:
    """Orders as evaluated games of three runs; probabilities are multiples of 1/1024."""
    steps = [
        {"eval_id": f"concat('run', cast(o_orderkey % 3 as {d.text}))", "game_pk": d.div("o_orderkey", 3),
         "entry_inning": "cast(1 + o_custkey % 9 as int)", "entry_run_diff": "cast(o_orderkey % 17 - 8 as int)",
         "entry_we_baseline": "cast((o_custkey * 37 + o_orderkey * 11) % 1025 as double) / 1024",
         "p_home_win": "cast((o_custkey * 53 + o_orderkey * 29) % 1025 as double) / 1024",
         "r": "(o_orderkey * 97 + o_custkey * 13) % 1024"},
        {"actual_home_win": "r < (o_custkey * 53 + o_orderkey * 29) % 1025",
         "entry_phase": "CASE WHEN entry_inning <= 3 THEN 'early' WHEN entry_inning <= 6 THEN 'mid' ELSE 'late' END",
         "entry_rd_bucket": f"CASE WHEN entry_run_diff <= -6 THEN 'rd_lte_m6' WHEN entry_run_diff >= 6 THEN 'rd_gte_p6' "
                            f"WHEN entry_run_diff < 0 THEN concat('rd_m', cast(-entry_run_diff as {d.text})) "
                            f"WHEN entry_run_diff > 0 THEN concat('rd_p', cast(entry_run_diff as {d.text})) ELSE 'rd_0' END"},
        {"correct": "(p_home_win > 0.5) = actual_home_win"},
    ]
    cols = ("eval_id game_pk entry_inning entry_run_diff entry_phase entry_rd_bucket entry_we_baseline p_home_win "
            "actual_home_win correct").split()
    return steps, cols


def horizon_steps(d) -> tuple[Steps, list[str]]:
    """One row per (order, line number) as a horizon of an evaluated game; input has pk, sk."""
    steps = [
        {"eval_id": f"concat('run', cast(l_orderkey % 3 as {d.text}))", "game_pk": d.div("l_orderkey", 3),
         "horizon": f"CASE WHEN l_linenumber = 7 THEN '+1pa' ELSE concat('+', cast(l_linenumber as {d.text}), 'hi') END",
         "pred_we": "CASE WHEN pk % 50 = 0 THEN NULL ELSE cast((pk * 31 + sk * 7) % 1025 as double) / 1024 END",
         "actual_we": "CASE WHEN sk % 50 = 0 THEN NULL ELSE cast((pk * 17 + sk * 3) % 1025 as double) / 1024 END"},
    ]
    return steps, "eval_id game_pk horizon pred_we actual_we".split()


def sim_steps(d) -> tuple[Steps, list[str]]:
    """One row per (order, line number) as a simulated game; input has pk, sk, q."""
    steps = [
        {"game_pk": d.div("l_orderkey", 54), "sim_id": "(l_orderkey % 54) * 8 + l_linenumber",
         "home_score": "cast(pk % 9 as int)", "away_score": "cast(sk % 8 as int)",
         "innings": "cast(9 + CASE WHEN pk % 13 = 0 THEN 1 + sk % 4 ELSE 0 END as int)",
         "total_pas": "cast(60 + q as int)", "home_pitcher_changes": "cast(pk % 5 as int)",
         "away_pitcher_changes": "cast(sk % 6 as int)", "pruned": "pk % 10 = 3"},
        {"pruned_at_pa": "CASE WHEN pruned THEN cast(20 + q as int) END"},
    ]
    cols = ("game_pk sim_id home_score away_score innings total_pas home_pitcher_changes away_pitcher_changes pruned "
            "pruned_at_pa pk sk").split()
    return steps, cols


def path_steps(d) -> tuple[Steps, list[str]]:
    """Orders as simulations of a game, line numbers as horizons 0..6; input has pk, sk."""
    steps = [
        {"game_pk": d.div("l_orderkey", 54), "sim_id": "l_orderkey % 54", "horizon": "cast(l_linenumber - 1 as int)",
         "inning": f"cast(least(9, 3 + {d.div('l_linenumber', 2)} + pk % 2) as int)",
         "half": "CASE WHEN (l_linenumber + sk) % 2 = 0 THEN 'Top' ELSE 'Bot' END", "outs": "cast(pk % 3 as int)",
         "bases": "cast(sk % 8 as int)", "home_score": "cast(pk % 7 as int)", "away_score": "cast(sk % 6 as int)",
         "we": "CASE WHEN pk % 41 = 0 THEN cast(-1 as double) ELSE cast((pk * 13 + sk) % 1025 as double) / 1024 END"},
    ]
    return steps, "game_pk sim_id horizon inning half outs bases home_score away_score we".split()


LINES = ("SELECT l_orderkey, l_linenumber, max(l_partkey) AS pk, max(l_suppkey) AS sk, "
         "max(cast(l_quantity as bigint)) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber")
GAMES = ("SELECT {div} AS game_pk, count(*) AS n, sum(cast(floor(o_totalprice) as bigint)) AS s FROM orders "
         "GROUP BY {div}")


# --- DataFrames --------------------------------------------------------------

def _apply(df: DataFrame, spec: tuple[Steps, list[str]]) -> DataFrame:
    from pyspark.sql import functions as F

    steps, cols = spec
    for step in steps:
        df = df.select("*", *[F.expr(e).alias(n) for n, e in step.items()])
    return df.select(*cols)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    return load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("pk"), F.max("l_suppkey").alias("sk"),
        F.max(F.col("l_quantity").cast("long")).alias("q"))


def _games(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    return load(spark, sf, "orders").groupBy(F.expr("o_orderkey div 54").alias("game_pk")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor("o_totalprice").cast("long")).alias("s"))


def raw_pitches(spark, sf) -> DataFrame:
    """The last number of an order is taken by (game, appearance), which is the order under another name: rows then
    lie as the de-duplication of pitches needs them, and only the columns of a line item are shuffled."""
    (first, numbered, *rest), cols = pitch_steps(Spark)
    last = {"last_no": first.pop("last_no").replace("l_orderkey", "game_pk, at_bat_number")}
    return _apply(load(spark, sf, "lineitem"), ([first, numbered, last, *rest], cols))


def events(spark, sf) -> DataFrame:
    """Processed pitches under our names, with the season."""
    from scorebook.sources.landing import processed_events

    df = processed_events(raw_pitches(spark, sf), order=["_load_id", "_row"])
    return df.withColumnRenamed("game_year", "season").drop("_load_id", "_row")


def games(spark, sf) -> DataFrame:
    return _apply(_games(spark, sf), game_steps(Spark)).withColumnRenamed("official_date", "game_date")


def rosters(spark, sf) -> DataFrame:
    from pyspark.sql import functions as F

    places = _games(spark, sf).select("game_pk", F.explode(F.sequence(F.lit(0), F.lit(51))).alias("place"))
    return _apply(places, roster_steps(Spark))


def players(spark, sf) -> DataFrame:
    return _apply(load(spark, sf, "customer"), player_steps(Spark))


def polls(spark, sf) -> DataFrame:
    return _apply(load(spark, sf, "events"), poll_steps(Spark))


def polls_columns() -> list[str]:
    return poll_steps(Spark)[1]


def eval_games(spark, sf) -> DataFrame:
    return _apply(load(spark, sf, "orders"), eval_game_steps(Spark))


def eval_horizons(spark, sf) -> DataFrame:
    return _apply(_lines(spark, sf), horizon_steps(Spark))


def sims(spark, sf) -> DataFrame:
    return _apply(_lines(spark, sf), sim_steps(Spark))


def paths(spark, sf) -> DataFrame:
    return _apply(_lines(spark, sf), path_steps(Spark))


# --- SQL ---------------------------------------------------------------------

def _sql(source: str, spec: tuple[Steps, list[str]]) -> str:
    steps, cols = spec
    q = source
    for step in steps:
        q = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in step.items()) + f" FROM ({q})"
    return "SELECT " + ", ".join(cols) + f" FROM ({q})"


_GAMES_SQL = GAMES.format(div=Duck.div("o_orderkey", 54))

CTE = {
    "raw_pitches": _sql("SELECT * FROM lineitem", pitch_steps(Duck)),
    "pitches": (
        "SELECT * EXCLUDE (batter, pitcher, stand, p_throws, events, game_year, _load_id, _row), batter AS batter_id, "
        "pitcher AS pitcher_id, stand AS bat_side, p_throws AS pitch_hand, events AS pa_result, game_year AS season, "
        "CAST(NULL AS DOUBLE) AS arm_angle FROM raw_pitches WHERE game_type IN ('R', 'F', 'D', 'L', 'W') "
        "QUALIFY row_number() OVER (PARTITION BY game_pk, at_bat_number, pitch_number ORDER BY _load_id DESC, _row DESC) = 1"),
    "games": _sql(_GAMES_SQL, game_steps(Duck)).replace("official_date, game_datetime", "official_date AS game_date, game_datetime", 1),
    "rosters": _sql(f"SELECT game_pk, unnest(range(0, 52)) AS place FROM ({_GAMES_SQL})", roster_steps(Duck)),
    "players": _sql("SELECT * FROM customer", player_steps(Duck)),
    "polls": _sql("SELECT * FROM events", poll_steps(Duck)),
    "eval_games": _sql("SELECT * FROM orders", eval_game_steps(Duck)),
    "eval_horizons": _sql(LINES, horizon_steps(Duck)),
    "sims": _sql(LINES, sim_steps(Duck)),
    "paths": _sql(LINES, path_steps(Duck)),
}
NEEDS = {"pitches": ["raw_pitches"]}


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the named roles (and what they need), then by extra expressions."""
    order: list[str] = []

    def add(n: str) -> None:
        for need in NEEDS.get(n, []):
            add(need)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


# --- further roles -----------------------------------------------------------

PRIORITIES = 5


def prediction_steps(d) -> tuple[Steps, list[str]]:
    """Orders as predictions of their priority class; probabilities are ratios of small whole numbers."""
    w = {f"w{i}": f"1 + (o_orderkey * {i + 3} + o_custkey * {i * i + 1}) % {7 + i}" for i in range(PRIORITIES)}
    total = " + ".join(w)
    p = ", ".join(f"cast({k} as double) / ({total})" for k in w)
    steps = [
        {"label": "cast(substr(o_orderpriority, 1, 1) as int) - 1", **w,
         "inning": "cast(1 + o_custkey % 9 as int)", "run_diff": "cast(o_orderkey % 17 - 8 as int)",
         "times_through_order": "cast(1 + o_orderkey % 4 as int)"},
        {"proba": f"array({p})" if d.name == "spark" else f"[{p}]"},
    ]
    return steps, "o_orderkey label proba inning run_diff times_through_order".split()


def timed_steps(d) -> tuple[Steps, list[str]]:
    """Raw pitches as timed events; every ninth is an action without pitch number."""
    steps = [
        {"play_event_index": "pitch_number", "is_action": "(at_bat_number + pitch_number) % 9 = 0",
         "event_end_ts": d.plus_minutes("game_date", "720 + at_bat_number * 10 + pitch_number"),
         "event_start_ts": d.plus_minutes("game_date", "719 + at_bat_number * 10 + pitch_number"),
         "pa_start_ts": d.plus_minutes("game_date", "720 + at_bat_number * 10"),
         "pa_end_ts": d.plus_minutes("game_date", "729 + at_bat_number * 10"),
         "play_id": f"concat(cast(game_pk as {d.text}), '-', cast(at_bat_number as {d.text}), '-', cast(pitch_number as {d.text}))"},
        {"event_type": "CASE WHEN is_action THEN 'action' ELSE 'pitch' END", "no": "CASE WHEN is_action THEN NULL ELSE pitch_number END"},
    ]
    cols = ("game_pk at_bat_number play_event_index no event_type play_id event_start_ts event_end_ts pa_start_ts pa_end_ts "
            "_load_id _row").split()
    return steps, cols


BUCKETS = ["rd_lte_m6", "rd_m5", "rd_m4", "rd_m3", "rd_m2", "rd_m1", "rd_0", "rd_p1", "rd_p2", "rd_p3", "rd_p4", "rd_p5", "rd_gte_p6"]


def conv_steps(d) -> tuple[Steps, list[str]]:
    """Convergence rows; input has state (0..116), l_linenumber, a, b."""
    steps = [{"inning": "cast(1 + state % 9 as int)", "rd_bucket": d.pick(BUCKETS, d.div("state", 9)),
              "level": f"concat('L', cast(l_linenumber as {d.text}))",
              "stabilization_n": d.pick([25, 50, 100, 200, 500, None], "a % 6"),
              **{f"std_at_{n}": f"cast((a * {i + 3} + b) % 64 as double) / 1024" for i, n in enumerate((25, 50, 100, 200, 500))}}]
    return steps, ["inning", "rd_bucket", "level", "stabilization_n", *[f"std_at_{n}" for n in (25, 50, 100, 200, 500)]]


CONV = f"SELECT l_orderkey % 117 AS state, l_linenumber, sum(pk) AS a, sum(sk) AS b FROM ({LINES}) GROUP BY 1, 2"


def predictions(spark, sf) -> DataFrame:
    return _apply(load(spark, sf, "orders"), prediction_steps(Spark))


def timed(spark, sf) -> DataFrame:
    return _apply(raw_pitches(spark, sf), timed_steps(Spark)).withColumnRenamed("no", "pitch_number")


def convergence(spark, sf) -> DataFrame:
    from pyspark.sql import functions as F

    per = _lines(spark, sf).groupBy(F.expr("l_orderkey % 117").alias("state"), "l_linenumber").agg(
        F.sum("pk").alias("a"), F.sum("sk").alias("b"))
    return _apply(per, conv_steps(Spark))


CTE |= {
    "predictions": _sql("SELECT * FROM orders", prediction_steps(Duck)),
    "timed": _sql("SELECT * FROM raw_pitches", timed_steps(Duck)).replace(" no, ", " no AS pitch_number, ", 1),
    "conv": _sql(CONV, conv_steps(Duck)).replace("CAST(sum", "sum"),
    "actual": "SELECT game_pk, horizon, CAST(1 + (game_pk + horizon) % 9 AS INTEGER) AS inning, CASE WHEN horizon % 2 = 0 THEN 'Top' ELSE 'Bot' END AS half, "
              "CAST(0 AS INTEGER) AS outs, CAST(0 AS INTEGER) AS bases, CAST((game_pk + horizon) % 7 AS INTEGER) AS home_score, "
              "CAST((game_pk * 3 + horizon) % 5 AS INTEGER) AS away_score FROM (SELECT DISTINCT game_pk, horizon FROM paths WHERE horizon <= 5)",
    "outcomes": "SELECT game_pk, sim_id, concat('k', CAST(game_pk % 5 AS VARCHAR)) AS state_key, sum(home_score) > sum(away_score) AS home_won FROM paths GROUP BY game_pk, sim_id",
    "weights": f"SELECT concat('k', CAST(l_orderkey % 5 AS VARCHAR)) AS state_key, CAST(l_linenumber - 1 AS INTEGER) AS hz, CAST(sum(sk) % 64 AS DOUBLE) / 256 AS weight "
               f"FROM ({LINES}) WHERE l_linenumber > 1 GROUP BY 1, 2",
}
NEEDS |= {"timed": ["raw_pitches"], "actual": ["paths"], "outcomes": ["paths"]}


def actual(spark, sf) -> DataFrame:
    d = paths(spark, sf).where("horizon <= 5").select("game_pk", "horizon").distinct()
    return d.selectExpr("game_pk", "horizon", "cast(1 + (game_pk + horizon) % 9 as int) AS inning",
                        "CASE WHEN horizon % 2 = 0 THEN 'Top' ELSE 'Bot' END AS half", "0 AS outs", "0 AS bases",
                        "cast((game_pk + horizon) % 7 as int) AS home_score", "cast((game_pk * 3 + horizon) % 5 as int) AS away_score")


def outcomes(spark, sf) -> DataFrame:
    from pyspark.sql import functions as F

    return paths(spark, sf).groupBy("game_pk", "sim_id").agg((F.sum("home_score") > F.sum("away_score")).alias("home_won")) \
        .withColumn("state_key", F.expr("concat('k', cast(game_pk % 5 as string))"))


def weights(spark, sf) -> DataFrame:
    from pyspark.sql import functions as F

    return _lines(spark, sf).where("l_linenumber > 1").groupBy(
        F.expr("concat('k', cast(l_orderkey % 5 as string))").alias("state_key"), F.expr("cast(l_linenumber - 1 as int)").alias("hz")
    ).agg((F.sum("sk") % 64).alias("w")).selectExpr("state_key", "hz", "cast(w as double) / 256 AS weight")
