"""Counts, running sums, rates, profiles, game state, as-of joins and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import roles, sqlparts as S
from registry.core import query
from scorebook.functions.features import ALL_FEATURES
from scorebook.operators import counts as C
from scorebook.operators import joins as J
from scorebook.operators.cumulate import carry_forward, cumulate, newest_state, rest_days, running_sums
from scorebook.operators.windows import first_pitch, game_state, pull_labels, re_features, recent_whip, terminal_pitch
from scorebook.plans import profiles as P
from scorebook.plans import vectors as V
from scorebook.sources.tables import staged

SPLIT = "2020-01-01"


def before(df, day=SPLIT):
    return df.where(F.col("game_date") < F.lit(day).cast("date"))


def since(df, day=SPLIT):
    return df.where(F.col("game_date") >= F.lit(day).cast("date"))


# --- daily counts ------------------------------------------------------------

@query("d1_batter_counts", S.core(["bc"], "SELECT * EXCLUDE (woba_value_vs_l, woba_value_vs_r, woba_denom_vs_l, woba_denom_vs_r, ev_sum_vs_l, "
                                          "ev_sum_vs_r, barrel_vs_l, barrel_vs_r, hard_hit_vs_l, hard_hit_vs_r) FROM bc"))
def d1(spark, sf):
    drop = [f"{c}_vs_{h}" for c in ("woba_value", "woba_denom", "ev_sum", "barrel", "hard_hit") for h in "lr"]
    return C.batter_counts(roles.events(spark, sf)).drop(*drop)


D2 = [f"{c}_vs_{h}" for c in ("woba_value", "woba_denom", "ev_sum") for h in "lr"]


@query("d2_conditional_sums", S.core(["bc"], f"SELECT batter_id, game_date, {', '.join(D2)} FROM bc"), doubles=D2)
def d2(spark, sf):
    return C.batter_counts(roles.events(spark, sf)).select("batter_id", "game_date", *D2)


D3 = [f"{c}_vs_{h}" for c in ("bip", "hard_hit", "barrel") for h in "lr"]


@query("d3_barrels", S.core(["bc"], f"SELECT batter_id, game_date, {', '.join(D3)} FROM bc"))
def d3(spark, sf):
    return C.batter_counts(roles.events(spark, sf)).select("batter_id", "game_date", *D3)


@query("d4_batter_arsenal_counts", S.core(["ac"], "SELECT * FROM ac"),
       doubles=[n for n in C.batter_arsenal_names() if S.is_float(n)])
def d4(spark, sf):
    return C.batter_arsenal_counts(roles.events(spark, sf))


@query("d5_discipline_counts", S.core(["dc"], "SELECT * FROM dc"))
def d5(spark, sf):
    return C.batter_discipline_counts(roles.events(spark, sf))


@query("d6_pitcher_counts", S.core(["pc"], "SELECT * FROM pc"), doubles=[n for n in C.pitcher_names() if S.is_float(n)])
def d6(spark, sf):
    return C.pitcher_counts(roles.events(spark, sf))


@query("c11_counts_with_pitches", S.core(["pc"], "SELECT pitcher_id, game_date, season, bf_vs_l, bf_vs_r, outs_vs_l, outs_vs_r, pitches, games FROM pc"))
def c11(spark, sf):
    return C.pitcher_counts(roles.events(spark, sf)).select(
        "pitcher_id", "game_date", "season", "bf_vs_l", "bf_vs_r", "outs_vs_l", "outs_vs_r", "pitches", "games")


@query("d7_pitcher_arsenal_counts", S.core(["pac"], "SELECT * FROM pac"),
       doubles=[n for n in C.pitcher_arsenal_names() if n.endswith("_sum")])
def d7(spark, sf):
    return C.pitcher_arsenal_counts(roles.events(spark, sf))


# --- running sums ------------------------------------------------------------

E14 = C.batter_names()
E14_FLOAT = [f"{s}_{n}" for s in "sc" for n in E14 if S.is_float(n)]


@query("e14_cumulate", S.core(["bs"], "SELECT * FROM bs"), doubles=E14_FLOAT)
def e14(spark, sf):
    return running_sums(C.batter_counts(roles.events(spark, sf)), "batter_id", E14)


@query("e14_cumulate_incremental", S.core(["bs"], f"SELECT * FROM bs WHERE game_date >= DATE '{SPLIT}'"), doubles=E14_FLOAT)
def e14_inc(spark, sf):
    """Chunk after the split, started from the newest state before it: equals the full run."""
    counts = C.batter_counts(roles.events(spark, sf))
    return cumulate(since(counts), "batter_id", E14, newest=newest_state(before(counts), "batter_id", E14))


@query("c9_carry_forward", S.core(["bs"], f"SELECT batter_id, season, game_date, s_pa_vs_l, s_pa_vs_r FROM bs WHERE game_date < "
                                          f"(SELECT min(game_date) FROM bc WHERE game_date >= DATE '{SPLIT}') "
                                          "QUALIFY row_number() OVER (PARTITION BY batter_id, season ORDER BY game_date DESC) = 1"))
def c9(spark, sf):
    counts = C.batter_counts(roles.events(spark, sf)).select("batter_id", "game_date", "season", "pa_vs_l", "pa_vs_r")
    target = running_sums(before(counts), "batter_id", ["pa_vs_l", "pa_vs_r"])
    return carry_forward(target, since(counts), ["batter_id", "season"]).select(
        "batter_id", "season", "game_date", "s_pa_vs_l", "s_pa_vs_r")


@query("e17_rest_days", S.core(["pc"], f"SELECT pitcher_id, game_date, CAST({S.REST} AS INTEGER) AS pitcher_rest_days FROM pc"))
def e17(spark, sf):
    return rest_days(C.pitcher_counts(roles.events(spark, sf)).select("pitcher_id", "game_date"), "pitcher_id")


# --- rates -------------------------------------------------------------------

def _rate_query(name, table, key, make, names):
    ints = [n for n in names if n[:2] in ("s_", "c_")]
    body = f"SELECT {key}, game_date, {', '.join(names)} FROM {table}"
    query(name, S.core([table], body), doubles=[n for n in names if n not in ints], digits=9)(
        lambda spark, sf: make(roles.events(spark, sf)).select(key, "game_date", *names))


_rate_query("d8_batting_rates", "batters", "batter_id", lambda e: P.batters(C.batter_counts(e)), list(S.batting_rates()))
_rate_query("d9_pitching_rates", "pitchers", "pitcher_id", lambda e: P.pitchers(C.pitcher_counts(e)), list(S.pitching_rates()))
_rate_query("d10_arsenal_rates", "arsenal", "batter_id", lambda e: P.batter_arsenal(C.batter_arsenal_counts(e)), list(S.arsenal_rates()))
_rate_query("d10_discipline_rates", "discipline", "batter_id", lambda e: P.batter_discipline(C.batter_discipline_counts(e)),
            list(S.discipline_rates()))
_rate_query("d10_pitch_mix_rates", "parsenal", "pitcher_id", lambda e: P.pitcher_arsenal(C.pitcher_arsenal_counts(e)),
            list(S.pitcher_arsenal_rates()))


# --- profiles ----------------------------------------------------------------

def _profile_columns(kind):
    if kind == "b":
        sums = [f"{s}_{n}" for names in (C.batter_names(), C.batter_arsenal_names(), C.discipline_names()) for s in "sc" for n in names]
        rate = [*S.batting_rates(), *S.arsenal_rates(), *S.discipline_rates()]
    else:
        sums = [f"{s}_{n}" for names in (C.pitcher_names(), C.pitcher_arsenal_names()) for s in "sc" for n in names]
        rate = [*S.pitching_rates(), *S.pitcher_arsenal_rates()]
    return [c for c in sums if S.is_float(c)] + [c for c in rate if c[:2] not in ("s_", "c_")]


query("c3_batter_profile", S.core(["bprofile"], "SELECT * FROM bprofile"), doubles=_profile_columns("b"), digits=9)(
    lambda spark, sf: P.batter_profile_by_tables(roles.events(spark, sf)))
query("c3_pitcher_profile", S.core(["pprofile"], "SELECT * FROM pprofile"), doubles=_profile_columns("p"), digits=9)(
    lambda spark, sf: P.pitcher_profile_by_tables(roles.events(spark, sf)))
query("c3_batter_profile_fused", S.core(["bprofile"], "SELECT * FROM bprofile"), doubles=_profile_columns("b"), digits=9)(
    lambda spark, sf: P.batter_profile_fused(roles.events(spark, sf)))
query("c3_pitcher_profile_fused", S.core(["pprofile"], "SELECT * FROM pprofile"), doubles=_profile_columns("p"), digits=9)(
    lambda spark, sf: P.pitcher_profile_fused(roles.events(spark, sf)))


# --- game state --------------------------------------------------------------

KEY = "game_pk, at_bat_number, pitch_number"
RATIOS = ["pitcher_outing_whip", "pitcher_recent_whip"]


def _state_part(name, cols, doubles=()):
    body = f"SELECT {KEY}, {', '.join(cols)} FROM state"
    query(name, S.core(["state"], body), doubles=doubles)(
        lambda spark, sf: game_state(roles.events(spark, sf)).select("game_pk", "at_bat_number", "pitch_number", *cols))


query("e2_game_state", S.core(["state"], "SELECT * FROM state"), doubles=RATIOS)(
    lambda spark, sf: game_state(roles.events(spark, sf)))
NO_PLAYER = {"batter_id": "at_bat_number % 10 = 0", "pitcher_id": "at_bat_number % 17 = 0"}
_nulls = ", ".join(f"CASE WHEN {w} THEN NULL ELSE {c} END AS {c}" for c, w in NO_PLAYER.items())
query("e2_game_state_unknown_players", roles.with_ctes(["pitches"], "SELECT * FROM state", {"known": f"SELECT * REPLACE ({_nulls}) FROM pitches", **{
    n: q.replace("FROM pitches", "FROM known").replace("JOIN pitches", "JOIN known") for n, q in S.STATE.items()}}), doubles=RATIOS)(
    lambda spark, sf: game_state(roles.events(spark, sf).withColumns({c: F.expr(f"CASE WHEN NOT ({w}) THEN {c} END") for c, w in NO_PLAYER.items()})))
_state_part("e2_pitch_count", ["pitcher_pitch_count"])
_state_part("e3_batters_faced", ["pitcher_bf_game", "batter_ab_vs_pitcher"])
_state_part("e4_outing_counts", ["pitcher_outing_walks", "pitcher_outing_hits", "pitcher_outing_k"])
_state_part("e5_outing_runs", ["pitcher_outing_runs"])
_state_part("e6_spread_target", ["target"])
_state_part("e7_outing_ratio", ["pitcher_outing_whip"], ["pitcher_outing_whip"])
_state_part("c12_recent_to_pitches", ["pitcher_id", "pitcher_recent_whip"], ["pitcher_recent_whip"])


@query("e8_recent_whip", S.core(["state"], "SELECT * FROM form"), doubles=["pitcher_recent_whip"])
def e8(spark, sf):
    pas = game_state(roles.events(spark, sf)).select("game_pk", "pitcher_id", "at_bat_number", "target").distinct()
    return recent_whip(pas)


@query("g3_distinct_pa", S.core(["state"], "SELECT * FROM turns"))
def g3(spark, sf):
    return game_state(roles.events(spark, sf)).select("game_pk", "pitcher_id", "at_bat_number", "target").distinct()


@query("e11_first_pitch", S.core([], "SELECT game_pk, at_bat_number, pitch_number, balls, strikes FROM pitches QUALIFY row_number() OVER "
                                     "(PARTITION BY game_pk, at_bat_number ORDER BY pitch_number) = 1"))
def e11(spark, sf):
    return first_pitch(roles.events(spark, sf)).select("game_pk", "at_bat_number", "pitch_number", "balls", "strikes")


@query("e11_terminal_pitch", S.core([], "SELECT game_pk, at_bat_number, pitch_number, pa_result FROM pitches QUALIFY row_number() OVER "
                                        "(PARTITION BY game_pk, at_bat_number ORDER BY pitch_number DESC) = 1"))
def e11b(spark, sf):
    return terminal_pitch(roles.events(spark, sf)).select("game_pk", "at_bat_number", "pitch_number", "pa_result")


LABELS = """SELECT game_pk, at_bat_number, is_bottom, pitcher_id,
 CASE WHEN pitcher_id = first_value(pitcher_id) OVER w THEN 1 ELSE 0 END AS starter_flag,
 CASE WHEN lead(pitcher_id) OVER w <> pitcher_id THEN 1 ELSE 0 END AS pulled FROM (SELECT * FROM state QUALIFY row_number() OVER
 (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number DESC) = 1) WINDOW w AS (PARTITION BY game_pk, is_bottom ORDER BY at_bat_number)"""


def _terminal(spark, sf):
    return terminal_pitch(game_state(roles.events(spark, sf)))


@query("e12_starter_flag", S.core(["state"], f"SELECT game_pk, at_bat_number, starter_flag FROM ({LABELS})"))
def e12(spark, sf):
    return pull_labels(_terminal(spark, sf)).select("game_pk", "at_bat_number", "starter_flag")


@query("e13_pull_label", S.core(["state"], f"SELECT game_pk, at_bat_number, pitcher_id, pulled FROM ({LABELS})"))
def e13(spark, sf):
    return pull_labels(_terminal(spark, sf)).select("game_pk", "at_bat_number", "pitcher_id", "pulled")


RE_CASE = "CASE 8 * least(greatest(outs, 0), 2) + runner_1b + 2 * runner_2b + 4 * runner_3b " + " ".join(
    f"WHEN {8 * o + b} THEN {v}::DOUBLE" for b, row in enumerate(S.K.RUN_EXPECTANCY) for o, v in enumerate(row)) + " END"
RE_SQL = f"""SELECT game_pk, at_bat_number, current_re, current_re - coalesce(lag(current_re) OVER (PARTITION BY game_pk, is_bottom
 ORDER BY at_bat_number), 0.481::DOUBLE) AS re_diff FROM (SELECT *, {RE_CASE} AS current_re FROM (SELECT * FROM state QUALIFY
 row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number DESC) = 1))"""


@query("e18_re_change", S.core(["state"], RE_SQL), doubles="current_re re_diff")
def e18(spark, sf):
    return re_features(_terminal(spark, sf)).select("game_pk", "at_bat_number", "current_re", "re_diff")


@query("c18_run_expectancy", S.core(["state"], f"SELECT {KEY}, {RE_CASE} AS current_re FROM state"), doubles="current_re")
def c18(spark, sf):
    from scorebook.operators.lookups import run_expectancy

    st = game_state(roles.events(spark, sf)).withColumn("bases", F.expr("runner_1b + 2 * runner_2b + 4 * runner_3b"))
    return run_expectancy(st).select("game_pk", "at_bat_number", "pitch_number", "current_re")


# --- as-of joins -------------------------------------------------------------

DAILY = ("SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, count(*) AS n_day FROM orders GROUP BY 1, 2")


def _daily(spark, sf):
    return roles.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n_day"))


def _orders(spark, sf):
    return roles.load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"),
                                                  F.to_date("o_orderdate").alias("o_date"))


def _asof_sql(op):
    return (f"SELECT o.o_orderkey, o.cust, o.o_date, d.day, d.n_day FROM (SELECT o_orderkey, o_custkey AS cust, CAST(o_orderdate AS DATE) "
            f"AS o_date FROM orders) o ASOF JOIN ({DAILY}) d ON o.cust = d.cust AND o.o_date {op} d.day")


@query("c5_asof_strict", _asof_sql(">"))
def c5(spark, sf):
    return J.asof_join(_orders(spark, sf), _daily(spark, sf), ["cust"], "o_date", "day", strict=True)


@query("c6_asof_inclusive", _asof_sql(">="))
def c6(spark, sf):
    return J.asof_join(_orders(spark, sf), _daily(spark, sf), ["cust"], "o_date", "day", strict=False)


@query("c5_asof_bucketed", "SELECT e.event_id, e.user_id, e.ts, p.p_ts, p.p_value FROM events e ASOF JOIN (SELECT user_id, ts AS p_ts, "
                           "value AS p_value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.p_ts")
def c5b(spark, sf):
    """Timestamps finer than dates: the search splits inside a key by hour."""
    e = roles.load(spark, sf, "events")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("value").alias("p_value"))
    return J.asof_join(e.select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "p_ts", strict=True,
                       bucket=lambda t: F.date_trunc("hour", t))


LATEST = "2020-06-01"


@query("c8_profiles_before", S.core(["batters"], "SELECT batter_id, game_date, s_pa, c_pa, season_ba FROM batters WHERE batter_id IN (SELECT player_id "
                                                 f"FROM players) AND game_date < DATE '{LATEST}' QUALIFY row_number() OVER (PARTITION BY batter_id ORDER BY game_date "
                                                 "DESC) = 1", roles=["players"]), doubles="season_ba")
def c8(spark, sf):
    ids = roles.players(spark, sf).select(F.col("player_id").alias("batter_id"))
    b = P.batters(C.batter_counts(roles.events(spark, sf)))
    return J.latest_values_before(b, ids, "batter_id", "game_date", LATEST).select("batter_id", "game_date", "s_pa", "c_pa", "season_ba")


def _vector_sql():
    cols = list(V.STATE_FEATURES)
    sel = [f"gs.{c}" for c in cols]
    for hand, pre, names, t in (("pitch_hand", "bat_", V.BATTER_SPLIT, "b"), ("bat_side", "pit_", V.PITCHER_SPLIT, "p")):
        sel += [f"CASE WHEN gs.{hand} = 'L' THEN {t}.{n}_vs_l ELSE {t}.{n}_vs_r END AS {pre}{n}" for n in names]
    sel += [f"b.{n} AS bat_{n}" for n in V.BATTER_PLAIN] + [f"p.{n} AS pit_{n}" for n in V.PITCHER_PLAIN]
    sel += ["p.pitcher_rest_days AS pit_rest_days"]
    return ("SELECT gs.game_pk, gs.at_bat_number, gs.pitch_number, gs.game_date, " + ", ".join(sel) + ", gs.target FROM state gs "
            "ASOF JOIN bprofile b ON gs.batter_id = b.batter_id AND gs.game_date > b.game_date "
            "ASOF JOIN pprofile p ON gs.pitcher_id = p.pitcher_id AND gs.game_date > p.game_date")


INT_FEATURES = set(V.STATE_FEATURES) - set(RATIOS) | {"bat_s_pa", "bat_c_pa", "pit_s_bf", "pit_c_bf", "pit_rest_days"}


def vectors(spark, sf):
    """Processed events and both profiles are tables: an as-of join reads a profile's dates, then its values."""
    e = staged(roles.events(spark, sf), "events")
    batters, pitchers = staged(P.batter_profile_fused(e), "batters"), staged(P.pitcher_profile_fused(e), "pitchers")
    return V.feature_vectors(game_state(e), batters, pitchers, appearances=e)


query("c7_feature_vectors", S.core(["state", "bprofile", "pprofile"], _vector_sql()),
      doubles=[f for f in ALL_FEATURES if f not in INT_FEATURES], digits=9)(vectors)


@query("b13_platoon", S.core(["bprofile", "state"], "SELECT gs.game_pk, gs.at_bat_number, gs.pitch_number, CASE WHEN gs.pitch_hand = 'L' THEN b.season_ba_vs_l "
                                                    "ELSE b.season_ba_vs_r END AS bat_season_ba, CASE WHEN gs.pitch_hand = 'L' THEN b.career_obp_vs_l ELSE b.career_obp_vs_r "
                                                    "END AS bat_career_obp FROM state gs ASOF JOIN bprofile b ON gs.batter_id = b.batter_id AND gs.game_date > b.game_date"),
       doubles="bat_season_ba bat_career_obp")
def b13(spark, sf):
    e = roles.events(spark, sf)
    b = P.batters(C.batter_counts(e)).select("batter_id", "game_date", "season_ba_vs_l", "season_ba_vs_r", "career_obp_vs_l", "career_obp_vs_r")
    rows = J.asof_join(game_state(e), b, ["batter_id"], "game_date", "game_date")
    return rows.select("game_pk", "at_bat_number", "pitch_number",
                       *V.platoon_columns("pitch_hand", "bat_", ["season_ba", "career_obp"], ""))


J13 = ("outing_runs outing_walks outing_hits outing_k pitcher_recent_whip avg_bf_per_app").split()


@query("j13_exit_training", S.core(["state", "pitchers"], f"""SELECT l.game_pk, s.game_date, l.pitcher_id, l.is_bottom, l.at_bat_number, s.pitcher_bf_game,
 l.starter_flag, coalesce(s.pitcher_outing_runs, 0) AS outing_runs, s.inning, s.run_diff, s.outs, s.runner_1b + s.runner_2b + s.runner_3b AS runners_on,
 s.runner_1b, s.runner_2b, s.runner_3b, s.pitcher_outing_walks AS outing_walks, s.pitcher_outing_hits AS outing_hits, s.pitcher_outing_k AS outing_k,
 s.times_through_order, s.pitcher_outing_whip AS outing_whip, coalesce(s.pitcher_recent_whip, 0) AS pitcher_recent_whip,
 coalesce(p.career_avg_bf_per_app, 20) AS avg_bf_per_app, coalesce(p.pitcher_rest_days, -1) AS pit_rest_days, l.pulled, r.current_re, r.re_diff
 FROM ({LABELS}) l JOIN (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number DESC) = 1) s
 USING (game_pk, at_bat_number) JOIN ({RE_SQL}) r USING (game_pk, at_bat_number)
 ASOF JOIN pitchers p ON l.pitcher_id = p.pitcher_id AND s.game_date >= p.game_date WHERE s.game_date >= DATE '2018-01-01'"""),
       doubles="outing_whip pitcher_recent_whip avg_bf_per_app current_re re_diff")
def j13(spark, sf):
    e = staged(roles.events(spark, sf), "events")
    return V.exit_training(game_state(e), P.pitchers(C.pitcher_counts(e)))
