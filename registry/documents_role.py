"""Nested documents built row by row from orders: schedules, play-by-play, boxscores, people, live states."""

from __future__ import annotations

from pyspark.sql import DataFrame

from registry.roles import load

ISO = "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T12:', lpad(cast({0} as string), 2, '0'), ':00Z')"


def _doc(spark, sf, key: str, expr: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(f"{key} AS game_pk", f"to_json({expr}) AS doc")


def schedules(spark, sf) -> DataFrame:
    game = ("named_struct('gamePk', o_orderkey * 2 + {i}, 'gameType', 'R', 'season', cast(year(o_orderdate) as string), 'officialDate', "
            "date_format(o_orderdate, 'yyyy-MM-dd'), 'dayNight', 'day')")
    games = "slice(array(" + ", ".join(game.format(i=i) for i in range(2)) + "), 1, cast(o_orderkey % 3 as int))"
    return _doc(spark, sf, "o_orderkey", f"named_struct('dates', array(named_struct('date', date_format(o_orderdate, 'yyyy-MM-dd'), 'games', {games})))")


def _event(i, e: int) -> str:
    n = f"(o_orderkey + {i} + {e})"
    return (f"named_struct('index', {e}, 'pitchNumber', CASE WHEN {n} % 4 = 3 THEN NULL ELSE {e} + 1 END, 'playId', concat('p', o_orderkey, '-', {i}, '-', {e}), "
            f"'type', CASE WHEN {n} % 4 = 3 THEN 'action' ELSE 'pitch' END, 'endTime', {ISO.format(10 * e + 1)}, 'isPitch', {n} % 4 <> 3, "
            f"'details', named_struct('description', CASE WHEN {n} % 5 = 0 THEN 'Foul' ELSE 'Ball' END, 'isInPlay', {n} % 6 = 0, 'isBall', {n} % 5 <> 0, 'type', named_struct('code', 'FF', 'description', 'Four-Seam')), "
            f"'count', named_struct('balls', cast({n} % 4 as int), 'strikes', cast({n} % 3 as int)), "
            f"'pitchData', named_struct('startSpeed', 80 + cast({n} % 40 as double) / 4, 'strikeZoneTop', 3.5D, 'strikeZoneBottom', 1.5D, 'coordinates', named_struct('pX', 0.5D, 'pZ', cast({n} % 8 as double) / 2)))")


def _play(i: int) -> str:
    events = "slice(array(" + ", ".join(_event(i, e) for e in range(3)) + f"), 1, cast((o_orderkey + {i}) % 4 as int))"
    return (f"named_struct('about', named_struct('atBatIndex', CASE WHEN {i} = 1 AND o_orderkey % 5 = 0 THEN NULL ELSE {i} END, 'inning', cast(1 + o_orderkey % 9 as int), 'halfInning', "
            f"CASE WHEN o_orderkey % 2 = 0 THEN 'top' ELSE 'bottom' END, 'isTopInning', o_orderkey % 2 = 0, 'isComplete', {i} < o_orderkey % 3, 'isScoringPlay', o_orderkey % 7 = 0, 'endTime', {ISO.format(30 + i)}), "
            f"'result', named_struct('event', CASE WHEN (o_orderkey + {i}) % 3 = 0 THEN 'Single' END, 'description', concat('play ', {i}), 'rbi', cast(o_orderkey % 4 as int)), "
            f"'matchup', named_struct('batter', named_struct('id', o_custkey + {i}, 'fullName', concat('B', o_custkey + {i})), 'pitcher', named_struct('id', o_custkey + 7, 'fullName', concat('P', o_custkey + 7)), "
            f"'batSide', named_struct('code', 'L'), 'postOnFirst', CASE WHEN o_orderkey % 3 = 1 THEN named_struct('id', o_custkey + 50) END), 'playEvents', {events})")


ALL_PLAYS = "slice(array(" + ", ".join(_play(i) for i in range(3)) + "), 1, cast(1 + o_orderkey % 3 as int))"


def play_documents(spark, sf) -> DataFrame:
    return _doc(spark, sf, "o_orderkey", f"named_struct('liveData', named_struct('plays', named_struct('allPlays', {ALL_PLAYS})))")


def _player(k: int, pos: str) -> str:
    return (f"named_struct('person', named_struct('id', o_orderkey * 100 + {k}, 'fullName', concat('N', o_orderkey * 100 + {k})), 'jerseyNumber', '{k}', 'position', named_struct('abbreviation', '{pos}'), "
            f"'stats', named_struct('batting', named_struct('hits', cast((o_orderkey + {k}) % 4 as int), 'atBats', 4), 'pitching', named_struct('strikeOuts', cast((o_orderkey + {k}) % 9 as int), 'numberOfPitches', cast(o_orderkey % 90 as int), "
            f"'battersFaced', cast(o_orderkey % 30 as int), 'baseOnBalls', 1, 'hits', 2, 'runs', 1)))")


def _side(base: int) -> str:
    ids = [base + k for k in (1, 2, 3, 11, 12, 13)]
    known = ids[:2] + ids[3:5]
    players = "map_from_arrays(array(" + ", ".join(f"concat('ID', o_orderkey * 100 + {k})" for k in known) + "), array(" + ", ".join(
        _player(k, "P" if k - base > 10 else "CF") for k in known) + "))"
    arr = lambda ks: "array(" + ", ".join(f"o_orderkey * 100 + {base + k}" for k in ks) + ")"
    return (f"named_struct('team', named_struct('id', cast({base} as bigint)), 'battingOrder', {arr((2, 1, 3))}, 'pitchers', slice({arr((11, 12))}, 1, cast(o_orderkey % 3 as int)), "
            f"'bullpen', {arr((12, 13))}, 'bench', {arr((3,))}, 'players', {players})")


BOX = f"named_struct('teams', named_struct('away', {_side(0)}, 'home', {_side(50)}))"


def boxscore_documents(spark, sf) -> DataFrame:
    return _doc(spark, sf, "o_orderkey", BOX)


def people_documents(spark, sf) -> DataFrame:
    p = ("named_struct('id', c_custkey, 'fullName', c_name, 'firstName', 'F', 'active', c_custkey % 2 = 0, 'primaryPosition', named_struct('abbreviation', 'SS'), 'batSide', named_struct('code', "
         "CASE WHEN c_custkey % 3 = 0 THEN 'S' ELSE 'R' END), 'currentTeam', CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE named_struct('id', cast(c_nationkey as bigint), 'name', 'T') END)")
    return load(spark, sf, "customer").selectExpr("c_custkey AS game_pk", f"to_json(named_struct('people', array({p}))) AS doc")


def live_documents(spark, sf) -> DataFrame:
    def off(base: str, bit: int) -> str:
        return f"'{base}', CASE WHEN o_orderkey div {bit} % 2 = 1 THEN named_struct('id', o_custkey + {bit}, 'fullName', concat('R', o_custkey + {bit})) END"

    line = (f"named_struct('currentInning', cast(1 + o_orderkey % 9 as int), 'inningHalf', CASE WHEN o_custkey % 2 = 0 THEN 'Top' ELSE 'Bottom' END, 'outs', CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderkey % 3 as int) END, "
            f"'balls', cast(o_orderkey % 4 as int), 'strikes', cast(o_orderkey % 3 as int), 'offense', named_struct({off('first', 1)}, {off('second', 2)}, {off('third', 4)}), "
            "'teams', named_struct('home', named_struct('runs', cast(o_orderkey % 11 as int), 'hits', 3), 'away', named_struct('runs', CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_orderkey % 13 as int) END)), "
            "'innings', array(named_struct('num', 1, 'home', named_struct('runs', 1))))")
    game = ("named_struct('status', named_struct('abstractGameState', element_at(array('Live', 'Final', 'Preview'), cast(o_custkey % 3 + 1 as int)), 'detailedState', 'x'), "
            "'teams', named_struct('home', named_struct('teamName', 'H'), 'away', named_struct('teamName', 'A', 'abbreviation', 'AA')))")
    return _doc(spark, sf, "o_orderkey", f"named_struct('gameData', {game}, 'liveData', named_struct('linescore', {line}, 'plays', named_struct('allPlays', {ALL_PLAYS}, 'currentPlay', {_play(2)}), 'boxscore', {BOX}))")


# --- the same facts for the SQL check ----------------------------------------

PLAYS_SQL = """SELECT o_orderkey AS game_pk, CAST(i AS INTEGER) + 1 AS at_bat_number, CAST(e AS INTEGER) AS play_event_index, CASE WHEN (o_orderkey + i + e) % 4 = 3 THEN NULL ELSE CAST(e AS INTEGER) + 1 END AS pitch_number,
 CASE WHEN (o_orderkey + i + e) % 4 = 3 THEN 'action' ELSE 'pitch' END AS event_type, CASE WHEN (o_orderkey + i + e) % 5 = 0 THEN 'Foul' ELSE 'Ball' END AS event_description, (o_orderkey + i + e) % 6 = 0 AS is_in_play,
 CAST((o_orderkey + i + e) % 4 AS INTEGER) AS post_balls, 80 + CAST((o_orderkey + i + e) % 40 AS DOUBLE) / 4 AS pitch_start_speed, CAST(1 + o_orderkey % 9 AS INTEGER) AS inning,
 CASE WHEN o_orderkey % 2 = 0 THEN 'top' ELSE 'bottom' END AS half_inning, o_custkey + i AS batter_id, o_custkey + 7 AS pitcher_id, CASE WHEN (o_orderkey + i) % 3 = 0 THEN 'Single' END AS pa_event, CAST(o_orderkey % 4 AS INTEGER) AS pa_rbi,
 CASE WHEN o_orderkey % 3 = 1 THEN o_custkey + 50 END AS pa_post_on_first_id, CAST(epoch_ms(date_trunc('day', o_orderdate)) + 43200000 + (10 * e + 1) * 60000 AS BIGINT) AS end_ms
 FROM orders, range(0, 3) t(i), range(0, 3) u(e) WHERE i < 1 + o_orderkey % 3 AND NOT (i = 1 AND o_orderkey % 5 = 0) AND e < (o_orderkey + i) % 4"""


def side_sql(base: int, side: str) -> str:
    known = [base + k for k in (1, 2, 11, 12)]
    return " UNION ALL ".join(
        f"SELECT o_orderkey AS game_pk, o_orderkey * 100 + {k} AS player_id, CAST({base} AS BIGINT) AS team_id, '{side}' AS side, '{'P' if k - base > 10 else 'CF'}' AS position, "
        f"CAST({ {base + 2: 1, base + 1: 2}.get(k, 'NULL')} AS INTEGER) AS batting_order, {'o_orderkey % 3 > 0' if k == base + 11 else 'false'} AS is_starting_pitcher FROM orders" for k in known)
