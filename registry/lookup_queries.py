"""Lookup tables, their use, and window-derived game facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import roles, sqlparts as S
from registry.core import query
from scorebook.operators import boards, joins as J, lookups as L
from scorebook.operators import windows as W
from scorebook.operators.windows import game_state
from scorebook.sources.landing import canonical_timed_events

MASK = "(CASE WHEN on_1b IS NULL THEN 0 ELSE 1 END + CASE WHEN on_2b IS NULL THEN 0 ELSE 2 END + CASE WHEN on_3b IS NULL THEN 0 ELSE 4 END)"
DONE = "pa_result IS NOT NULL AND pa_result <> 'truncated_pa'"

# --- transitions -------------------------------------------------------------

NEXT = f"""SELECT game_pk, at_bat_number, pa_result, pre_bases, outs,
 CASE WHEN n_inning = inning AND n_half = inning_topbot THEN n_bases ELSE 0 END AS post_bases, runs_scored,
 CASE WHEN n_inning = inning AND n_half = inning_topbot THEN n_outs - outs ELSE 3 - outs END AS outs_added
 FROM (SELECT *, lead(inning) OVER w AS n_inning, lead(inning_topbot) OVER w AS n_half, lead(pre_bases) OVER w AS n_bases, lead(outs) OVER w AS n_outs
 FROM (SELECT f.*, t.pa_result, CAST(t.post_bat_score - f.bat_score AS INTEGER) AS runs_scored FROM
 (SELECT game_pk, at_bat_number, inning, inning_topbot, outs_when_up AS outs, {MASK} AS pre_bases, bat_score FROM pitches
 QUALIFY row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number) = 1) f
 JOIN (SELECT game_pk, at_bat_number, pa_result, post_bat_score FROM pitches WHERE {DONE}) t USING (game_pk, at_bat_number))
 WINDOW w AS (PARTITION BY game_pk ORDER BY at_bat_number)) WHERE n_inning IS NOT NULL"""
TRANS = (f"SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY pa_result, pre_bases, outs) AS p FROM (SELECT pa_result, pre_bases, outs, post_bases, "
         f"runs_scored, outs_added, count(*) AS n FROM ({NEXT}) GROUP BY ALL)")

query("e10_next_state", S.core([], NEXT))(lambda spark, sf: L.next_states(roles.events(spark, sf)))
query("c4_first_with_terminal", S.core([], f"SELECT game_pk, at_bat_number, pa_result, pre_bases, outs, runs_scored FROM ({NEXT})"))(
    lambda spark, sf: L.next_states(roles.events(spark, sf)).select("game_pk", "at_bat_number", "pa_result", "pre_bases", "outs", "runs_scored"))
query("d12_transitions", S.core([], TRANS), doubles="p")(lambda spark, sf: L.transitions(roles.events(spark, sf)))


@query("d13_check_transitions", S.core([], f"SELECT pa_result, pre_bases, outs, sum(p) AS total_p FROM (SELECT * REPLACE (p * CASE WHEN outs = 2 THEN 0.9 ELSE 1 END AS p) FROM ({TRANS})) GROUP BY ALL HAVING abs(sum(p) - 1) > 1e-4"), doubles="total_p")
def d13a(spark, sf):
    """Probabilities of one number of outs are scaled, so that violations exist to be reported."""
    return L.check_transitions(L.transitions(roles.events(spark, sf)).withColumn("p", F.expr("p * CASE WHEN outs = 2 THEN 0.9D ELSE 1D END")))


# --- win expectancy ----------------------------------------------------------

STATES = f"""SELECT e.game_pk, inning, inning_topbot AS half, outs_when_up AS outs, {MASK} AS bases,
 greatest(-15, least(15, CAST(e.home_score - e.away_score AS INTEGER))) AS run_diff, CASE WHEN g.home_score > g.away_score THEN 1::DOUBLE ELSE 0::DOUBLE END AS home_win
 FROM pitches e JOIN games g ON e.game_pk = g.game_pk WHERE {DONE} AND inning BETWEEN 1 AND 9 AND g.abstract_game_state = 'Final' AND g.status NOT IN ('Postponed', 'Cancelled')"""


def _level(name, keys):
    cols = ", ".join(c if c in keys else f"CAST(NULL AS {'VARCHAR' if c == 'half' else 'INTEGER'}) AS {c}" for c in L.STATE)
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"SELECT '{name}' AS level, {cols}, count(*) AS n, round(avg(home_win), 6) AS p_home_win FROM states{by}"


LEVELS = " UNION ALL ".join(_level(n, k) for n, k in L.LEVELS.items())
WE = {"states": STATES, "levels": LEVELS}


def we_sql(src: str, out: str = "we") -> str:
    """Rows of ``src`` (with inning, half, outs, bases, run_diff) and their win expectancy."""
    def on(keys):
        m = {"inning": "least(x.inning, 9)", "run_diff": "greatest(-15, least(15, x.run_diff))"}
        return " AND ".join(f"{m.get(k, 'x.' + k)} = t.{k}" for k in keys)

    pick = [f"(SELECT max(t.p_home_win) FROM levels t WHERE t.level = '{n}' AND {on(k)}{' AND t.n >= 20' if n in ('full', 'no_bases') else ''})"
            for n, k in L.LEVELS.items() if k]
    return f"SELECT x.*, coalesce({', '.join(pick)}, (SELECT p_home_win FROM levels WHERE level = 'baseline')) AS {out} FROM ({src}) x"


def levels(spark, sf):
    return L.win_expectancy(roles.events(spark, sf), roles.games(spark, sf))


query("d11_win_expectancy", S.core([], "SELECT * FROM levels", roles=["games"], extra=WE), doubles="p_home_win")(levels)


@query("c10_pa_states", S.core([], "SELECT * FROM states", roles=["games"], extra=WE), doubles="home_win")
def c10(spark, sf):
    return L.pa_states(roles.events(spark, sf), roles.games(spark, sf))


@query("d11_facts", S.core([], "SELECT count(*) AS n_pas, count(DISTINCT game_pk) AS n_games FROM states", roles=["games"], extra=WE))
def d11f(spark, sf):
    return L.win_expectancy_facts(roles.events(spark, sf), roles.games(spark, sf))


@query("d13_check_levels", S.core([], "SELECT level, n, 'baseline too small' AS problem FROM levels WHERE level = 'baseline' AND n < 1000000", roles=["games"], extra=WE))
def d13b(spark, sf):
    return L.check_levels(levels(spark, sf), min_baseline=1_000_000).select("level", "n", "problem")


LOOK = "SELECT game_pk, at_bat_number, pitch_number, inning, CASE WHEN is_bottom = 1 THEN 'Bot' ELSE 'Top' END AS half, outs, runner_1b + 2 * runner_2b + 4 * runner_3b AS bases, run_diff FROM state"


@query("c16_we_lookup", S.core(["state"], we_sql(LOOK), roles=["games"], extra=WE), doubles="we")
def c16(spark, sf):
    st = game_state(roles.events(spark, sf)).selectExpr(
        "game_pk", "at_bat_number", "pitch_number", "inning", "CASE WHEN is_bottom = 1 THEN 'Bot' ELSE 'Top' END AS half", "outs",
        "runner_1b + 2 * runner_2b + 4 * runner_3b AS bases", "run_diff")
    return L.we_lookup(st, levels(spark, sf))


GRID = ("SELECT CAST(i AS INTEGER) AS inning, h AS half, CAST(o AS INTEGER) AS outs, CAST(b AS INTEGER) AS bases, CAST(d AS INTEGER) AS run_diff FROM range(1, 10) t1(i), "
        "(VALUES ('Top'), ('Bot')) t2(h), range(0, 3) t3(o), range(0, 8) t4(b), range(-15, 16) t5(d)")
query("c17_we_grid", S.core([], we_sql(GRID), roles=["games"], extra=WE), doubles="we")(lambda spark, sf: L.we_grid(levels(spark, sf)))
SENS = (f"SELECT inning, half, run_diff, dwe_drd, we_at_rd, we_at_rd_plus_1 FROM (SELECT inning, half, run_diff, lead(we) OVER w - we AS dwe_drd, we AS we_at_rd, lead(we) OVER w AS we_at_rd_plus_1 "
        f"FROM ({we_sql(GRID)}) WHERE outs = 0 AND bases = 0 WINDOW w AS (PARTITION BY inning, half ORDER BY run_diff)) WHERE we_at_rd_plus_1 IS NOT NULL")
query("e19_we_sensitivity", S.core([], SENS, roles=["games"], extra=WE), doubles="dwe_drd we_at_rd we_at_rd_plus_1")(
    lambda spark, sf: L.we_sensitivity(L.we_grid(levels(spark, sf))))


@query("d14_blowout_thresholds", S.core([], "SELECT CAST(i AS INTEGER) AS inning, h AS half, CAST(coalesce((SELECT min(run_diff) FROM levels WHERE level = 'coarse' AND inning = i AND half = h AND run_diff > 0 "
       "AND p_home_win >= 0.6) + 1, 16) AS INTEGER) AS win_threshold, CAST(coalesce((SELECT max(run_diff) FROM levels WHERE level = 'coarse' AND inning = i AND half = h AND run_diff < 0 AND p_home_win <= 1 - 0.6) - 1, -16) "
       "AS INTEGER) AS loss_threshold FROM range(1, 10) t1(i), (VALUES ('Top'), ('Bot')) t2(h)", roles=["games"], extra=WE))
def d14(spark, sf):
    return L.blowout_thresholds(levels(spark, sf).where("level = 'coarse'"), p=0.6)


# --- calibration -------------------------------------------------------------

KNOT_ROWS = [(c, x, y) for c in range(roles.PRIORITIES) for x, y in ((0.05, 0.02 * c), (0.15, 0.1 + 0.02 * c), (0.25, 0.3), (0.4, 0.5 + 0.05 * c))]


def _interp_sql():
    out = "CASE class "
    for c in range(roles.PRIORITIES):
        k = [(x, y) for cc, x, y in KNOT_ROWS if cc == c]
        e = f"CASE WHEN p < {k[0][0]} THEN {k[0][1]}::DOUBLE " + " ".join(
            f"WHEN p < {b[0]} THEN {a[1]}::DOUBLE + (p - {a[0]}::DOUBLE) * ({b[1]}::DOUBLE - {a[1]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE)" for a, b in zip(k, k[1:])) + f" ELSE {k[-1][1]}::DOUBLE END"
        out += f"WHEN {c} THEN {e} "
    return out + "END"


LONG = "SELECT o_orderkey, label, CAST(unnest(range(0, 5)) AS INTEGER) AS class, unnest(proba) AS p FROM predictions"


@query("c19_apply_calibration", roles.with_ctes(["predictions"], f"SELECT o_orderkey, class, p, v / CASE WHEN s > 0 THEN s ELSE 1 END AS p_calibrated FROM (SELECT *, sum(v) OVER (PARTITION BY o_orderkey) AS s "
       f"FROM (SELECT *, {_interp_sql()} AS v FROM ({LONG})))"), doubles="p p_calibrated")
def c19(spark, sf):
    rows = roles.predictions(spark, sf).select("o_orderkey", F.posexplode("proba").alias("class", "p"))
    knots = spark.createDataFrame(KNOT_ROWS, "class int, x double, y double")
    return L.apply_calibration(rows, knots, "o_orderkey")


# --- joins and sets ----------------------------------------------------------

@query("c1_event_state", S.core(["state"], """SELECT s.game_pk, s.at_bat_number, s.pitch_number, g.prev_event_end_ts, g.event_end_ts, g.play_id, m.home_team_id, m.away_team_name, s.target FROM state s
 JOIN (SELECT *, lag(event_end_ts) OVER (PARTITION BY game_pk ORDER BY at_bat_number, play_event_index) AS prev_event_end_ts FROM (SELECT * FROM timed QUALIFY row_number() OVER
 (PARTITION BY game_pk, at_bat_number, play_event_index ORDER BY _load_id DESC, _row DESC) = 1)) g ON s.game_pk = g.game_pk AND s.at_bat_number = g.at_bat_number AND s.pitch_number = g.pitch_number
 LEFT JOIN games m ON s.game_pk = m.game_pk WHERE g.event_type = 'pitch'""", roles=["games", "timed"]))
def c1(spark, sf):
    gumbo = canonical_timed_events(roles.timed(spark, sf), order=["_load_id", "_row"])
    return J.event_state(game_state(roles.events(spark, sf)), gumbo, roles.games(spark, sf)).select(
        "game_pk", "at_bat_number", "pitch_number", "prev_event_end_ts", "event_end_ts", "play_id", "home_team_id", "away_team_name", "target")


query("i15_validity_windows", S.core([], """SELECT game_pk, at_bat_number, play_event_index, lag(event_end_ts) OVER (PARTITION BY game_pk ORDER BY at_bat_number, play_event_index) AS valid_from,
 event_end_ts AS valid_until FROM (SELECT * FROM timed QUALIFY row_number() OVER (PARTITION BY game_pk, at_bat_number, play_event_index ORDER BY _load_id DESC, _row DESC) = 1)""", roles=["timed"]))(
    lambda spark, sf: canonical_timed_events(roles.timed(spark, sf), order=["_load_id", "_row"]).select(
        "game_pk", "at_bat_number", "play_event_index", F.col("prev_event_end_ts").alias("valid_from"), F.col("event_end_ts").alias("valid_until")))


@query("e9_event_windows", "SELECT user_id AS game_pk, CAST(day(ts) AS INTEGER) AS at_bat_number, event_id AS play_event_index, ts AS event_end_ts, lag(ts) OVER (PARTITION BY user_id ORDER BY day(ts), event_id) "
                           "AS prev_event_end_ts FROM events")
def e9(spark, sf):
    e = roles.load(spark, sf, "events").select(F.col("user_id").alias("game_pk"), F.dayofmonth("ts").alias("at_bat_number"),
                                               F.col("event_id").alias("play_event_index"), F.col("ts").alias("event_end_ts"))
    return W.event_windows(e)


@query("c2_left_dimension", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def c2(spark, sf):
    n = roles.load(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return roles.load(spark, sf, "customer").join(n, "c_nationkey", "left").select("c_custkey", "c_name", "n_name")


@query("c13_narrow_then_fetch", S.core([], "SELECT game_pk, at_bat_number, pitch_number, pitch_type, release_speed FROM pitches QUALIFY row_number() OVER (PARTITION BY game_pk, at_bat_number "
                                           "ORDER BY (pitch_number * 7919 + game_pk) % 101, pitch_number) = 1"), doubles="release_speed")
def c13(spark, sf):
    order = [(F.col("pitch_number") * 7919 + F.col("game_pk")) % 101, F.col("pitch_number")]
    return boards.sample_pa(roles.events(spark, sf), order=order).select("game_pk", "at_bat_number", "pitch_number", "pitch_type", "release_speed")


@query("c15_horizon_game_join", roles.with_ctes(["eval_horizons", "eval_games"], "SELECT h.eval_id, h.game_pk, h.horizon, h.pred_we, g.entry_we_baseline FROM eval_horizons h JOIN eval_games g "
                                                "ON h.eval_id = g.eval_id AND h.game_pk = g.game_pk"), doubles="pred_we entry_we_baseline")
def c15(spark, sf):
    g = roles.eval_games(spark, sf).select("eval_id", "game_pk", "entry_we_baseline")
    return roles.eval_horizons(spark, sf).join(g, ["eval_id", "game_pk"]).select("eval_id", "game_pk", "horizon", "pred_we", "entry_we_baseline")


PLAYERS = "SELECT batter_id AS player_id FROM pitches UNION SELECT pitcher_id FROM pitches"
query("g2_all_players", S.core([], PLAYERS))(lambda spark, sf: J.all_players(roles.events(spark, sf)))
query("c20_new_players", S.core([], f"SELECT player_id FROM ({PLAYERS}) WHERE player_id NOT IN (SELECT player_id FROM players)", roles=["players"]))(
    lambda spark, sf: J.new_players(roles.events(spark, sf), roles.players(spark, sf)))
CHG = "(SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = {0})"


def _keys(spark, sf, year):
    return roles.load(spark, sf, "orders").where(F.year("o_orderdate") == year).select(F.col("o_custkey").alias("k"))


query("g5_key_changes", f"SELECT k, 'added' AS change FROM {CHG.format(1996)} WHERE k NOT IN {CHG.format(1995)} UNION ALL SELECT k, 'removed' FROM {CHG.format(1995)} WHERE k NOT IN {CHG.format(1996)}")(
    lambda spark, sf: J.key_changes(_keys(spark, sf, 1995), _keys(spark, sf, 1996), "k"))
query("i9_keyset_change", f"SELECT k, 'added' AS change FROM {CHG.format(1998)} WHERE k NOT IN {CHG.format(1997)} UNION ALL SELECT k, 'removed' FROM {CHG.format(1997)} WHERE k NOT IN {CHG.format(1998)}")(
    lambda spark, sf: J.key_changes(_keys(spark, sf, 1997), _keys(spark, sf, 1998), "k"))


@query("c22_merge_schedule", roles.with_ctes(["games"], """SELECT coalesce(l.game_pk, s.game_pk) AS game_pk, CASE WHEN s.game_pk IS NULL OR l.live IS NOT NULL THEN l.status ELSE s.status END AS status,
 CASE WHEN s.game_pk IS NULL THEN l.venue_name ELSE s.venue_name END AS venue_name, l.live AS live_updated_at, l.inning FROM
 (SELECT game_pk, 'old' AS status, 'old park' AS venue_name, CASE WHEN game_pk % 2 = 0 THEN game_pk END AS live, CAST(game_pk % 9 AS BIGINT) AS inning FROM games WHERE game_pk % 5 <> 0) l
 FULL JOIN (SELECT game_pk, status, venue_name FROM games WHERE game_pk % 3 <> 0) s ON l.game_pk = s.game_pk"""))
def c22(spark, sf):
    g = roles.games(spark, sf)
    live = g.where("game_pk % 5 <> 0").selectExpr("game_pk", "'old' AS status", "'old park' AS venue_name",
                                                  "CASE WHEN game_pk % 2 = 0 THEN game_pk END AS live_updated_at", "game_pk % 9 AS inning")
    return J.merge_schedule(live, g.where("game_pk % 3 <> 0").select("game_pk", "status", "venue_name"))


@query("g4_distinct_on", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts", doubles="value")
def g4(spark, sf):
    return W.first_per(roles.load(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts").asc()]).select("user_id", "event_type", "event_id", "value")


@query("e1_dedup_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def e1(spark, sf):
    return W.dedup_latest(roles.load(spark, sf, "events"), ["user_id"], [F.col("ts").desc()]).select("user_id", "event_id", "event_type")


# --- samples -----------------------------------------------------------------

@query("e15_sample_pa", S.core([], "SELECT game_pk, at_bat_number, pitch_number FROM pitches QUALIFY row_number() OVER (PARTITION BY game_pk, at_bat_number "
                                   "ORDER BY ((game_pk * 31 + at_bat_number) * 7919 + pitch_number * 104729) % 1009, pitch_number) = 1"))
def e15(spark, sf):
    """One pitch per appearance, in an order both engines can compute."""
    order = [F.expr("((game_pk * 31 + at_bat_number) * 7919 + pitch_number * 104729) % 1009"), F.col("pitch_number")]
    return boards.sample_pa(roles.events(spark, sf), order=order).select("game_pk", "at_bat_number", "pitch_number")


@query("e16_stratified", roles.with_ctes(["eval_games"], "SELECT eval_id, game_pk, entry_inning, entry_rd_bucket FROM eval_games QUALIFY row_number() OVER (PARTITION BY entry_inning, entry_rd_bucket "
                                         "ORDER BY (game_pk * 7919) % 10007, eval_id, game_pk) <= 5"))
def e16(spark, sf):
    order = [(F.col("game_pk") * 7919) % 10007, F.col("eval_id"), F.col("game_pk")]
    return boards.stratified(roles.eval_games(spark, sf), ["entry_inning", "entry_rd_bucket"], 5, order=order).select(
        "eval_id", "game_pk", "entry_inning", "entry_rd_bucket")


@query("f6_max_games", S.core([], "SELECT game_pk, at_bat_number, pitch_number FROM pitches WHERE game_pk IN (SELECT game_pk FROM (SELECT DISTINCT game_pk FROM pitches) ORDER BY (game_pk * 7919) % 1009, game_pk LIMIT 10)"))
def f6(spark, sf):
    return boards.max_games(roles.events(spark, sf), 10, order=[(F.col("game_pk") * 7919) % 1009, F.col("game_pk")]).select("game_pk", "at_bat_number", "pitch_number")


SPLIT_H = "(o_orderkey * 7919) % 1048573"


@query("j4_split3", f"""SELECT o_orderkey, o_orderpriority, CASE WHEN r <= t THEN 'test' WHEN r <= t + c THEN 'calibrate' ELSE 'train' END AS split FROM (SELECT *, round((m - t) * 0.25) AS c FROM
 (SELECT *, round(m * 0.2) AS t FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ({SPLIT_H}) // 1024 % 1024, {SPLIT_H}, o_orderkey) AS r,
 count(*) OVER (PARTITION BY o_orderpriority) AS m FROM orders)))""")
def j4(spark, sf):
    return boards.split3(roles.load(spark, sf, "orders"), "o_orderpriority", ["o_orderkey"], order=F.expr(SPLIT_H)).select("o_orderkey", "o_orderpriority", "split")


@query("j5_encode", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS label_index FROM orders")
def j5(spark, sf):
    return boards.encode(roles.load(spark, sf, "orders"), "o_orderpriority").select("o_orderkey", "label_index")


# --- lineups and horizons ----------------------------------------------------

ENTRIES = "SELECT game_pk, CAST(20 + game_pk % 20 AS INTEGER) AS entry_ab FROM games"


def _entries(spark, sf):
    return roles.games(spark, sf).selectExpr("game_pk", "cast(20 + game_pk % 20 as int) AS entry_ab")


PAS = f"""SELECT e.game_pk, n.entry_ab, at_bat_number, batter_id, pitcher_id, CASE WHEN inning_topbot = 'Bot' THEN 'home' ELSE 'away' END AS batting_side,
 CASE WHEN inning_topbot = 'Bot' THEN 'away' ELSE 'home' END AS pitching_side FROM pitches e JOIN ({ENTRIES}) n ON e.game_pk = n.game_pk WHERE at_bat_number < n.entry_ab
 QUALIFY row_number() OVER (PARTITION BY e.game_pk, at_bat_number ORDER BY pitch_number) = 1"""
SEEN = """SELECT *, count(*) OVER (PARTITION BY game_pk, batting_side) AS n, row_number() OVER (PARTITION BY game_pk, batting_side ORDER BY first_ab DESC) AS back FROM
 (SELECT game_pk, entry_ab, batting_side, batter_id, min(at_bat_number) AS first_ab FROM pas GROUP BY ALL)"""
LINEUP = """SELECT game_pk, entry_ab, batting_side AS side, batter_id AS player_id, CAST(row_number() OVER (PARTITION BY game_pk, batting_side ORDER BY first_ab) AS INTEGER) AS slot FROM seen WHERE n >= 9 AND back <= 9
 UNION ALL SELECT r.game_pk, n.entry_ab, r.side, r.player_id, CAST(row_number() OVER (PARTITION BY r.game_pk, r.side ORDER BY batting_order) AS INTEGER) FROM rosters r JOIN entries n USING (game_pk)
 WHERE batting_order IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.game_pk = r.game_pk AND s.batting_side = r.side AND s.n >= 9)"""
USED = """SELECT game_pk, entry_ab, side, player_id, first_ab, first_ab = max(first_ab) OVER (PARTITION BY game_pk, side) AS is_current FROM (SELECT game_pk, entry_ab, pitching_side AS side, pitcher_id AS player_id,
 min(at_bat_number) AS first_ab FROM pas GROUP BY ALL) UNION ALL SELECT r.game_pk, n.entry_ab, r.side, r.player_id, 0, true FROM rosters r JOIN entries n USING (game_pk) WHERE is_starting_pitcher
 AND NOT EXISTS (SELECT 1 FROM pas p WHERE p.game_pk = r.game_pk AND p.pitching_side = r.side)"""
MID = {"entries": ENTRIES, "pas": PAS, "seen": SEEN, "lineup": LINEUP, "used": USED}


def mid_sql(body):
    return S.core([], body, roles=["games", "rosters"], extra=MID)


def _pas(spark, sf):
    return boards.pas_before(roles.events(spark, sf), _entries(spark, sf))


def _lineup(spark, sf):
    return boards.mid_game_lineup(_pas(spark, sf), roles.rosters(spark, sf), _entries(spark, sf))


def _used(spark, sf):
    return boards.mid_game_pitchers(_pas(spark, sf), roles.rosters(spark, sf), _entries(spark, sf))


query("e25_pas_before", mid_sql("SELECT * FROM pas"))(_pas)
query("e22_mid_game_lineup", mid_sql("SELECT * FROM lineup"))(_lineup)
query("e22_mid_game_pitchers", mid_sql("SELECT * FROM used"))(_used)
query("e23_bullpen", mid_sql("SELECT game_pk, side, player_id FROM rosters r WHERE position = 'P' AND NOT EXISTS (SELECT 1 FROM lineup l WHERE l.game_pk = r.game_pk AND l.player_id = r.player_id) "
                             "AND NOT EXISTS (SELECT 1 FROM used u WHERE u.game_pk = r.game_pk AND u.player_id = r.player_id)"))(
    lambda spark, sf: boards.bullpen(roles.rosters(spark, sf), _lineup(spark, sf), _used(spark, sf)))
query("e24_starting_lineup", roles.with_ctes(["rosters"], "SELECT game_pk, side, player_id, CAST(row_number() OVER (PARTITION BY game_pk, side ORDER BY batting_order) AS INTEGER) AS slot FROM rosters WHERE batting_order IS NOT NULL"))(
    lambda spark, sf: boards.starting_lineup(roles.rosters(spark, sf)))
query("e24_starting_pitchers", roles.with_ctes(["rosters"], "SELECT game_pk, side, player_id FROM rosters WHERE is_starting_pitcher"))(
    lambda spark, sf: boards.starting_pitchers(roles.rosters(spark, sf)))

HZ = f"""SELECT game_pk, entry_ab, unnest(CASE WHEN n = 1 THEN ['+1pa'] WHEN turn = 1 THEN ['+' || CAST(turns AS VARCHAR) || 'hi'] ELSE [] END) AS horizon, at_bat_number, inning, half, outs, bases, home_score, away_score FROM
 (SELECT *, CAST(sum(turn) OVER (PARTITION BY game_pk ORDER BY at_bat_number) AS BIGINT) AS turns FROM (SELECT *, row_number() OVER w AS n, CASE WHEN lag(inning) OVER w <> inning OR lag(half) OVER w <> half THEN 1 ELSE 0 END AS turn
 FROM (SELECT e.game_pk, n.entry_ab, at_bat_number, inning, CASE WHEN inning_topbot = 'Bot' THEN 1 ELSE 0 END AS half, outs_when_up AS outs, {MASK} AS bases, home_score, away_score FROM pitches e JOIN ({ENTRIES}) n ON e.game_pk = n.game_pk
 WHERE at_bat_number > n.entry_ab QUALIFY row_number() OVER (PARTITION BY e.game_pk, at_bat_number ORDER BY pitch_number) = 1) WINDOW w AS (PARTITION BY game_pk ORDER BY at_bat_number)))"""


@query("e21_actual_horizons", S.core([], HZ, roles=["games"]))
def e21(spark, sf):
    from scorebook.functions.predicates import base_mask

    e = roles.events(spark, sf).select("game_pk", "at_bat_number", "pitch_number", "inning", F.expr("CASE WHEN inning_topbot = 'Bot' THEN 1 ELSE 0 END").alias("half"),
                                       F.col("outs_when_up").alias("outs"), base_mask("on_1b", "on_2b", "on_3b").alias("bases"), "home_score", "away_score")
    return W.actual_horizons(e, _entries(spark, sf))
