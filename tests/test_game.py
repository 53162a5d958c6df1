"""Hand-written games: windows, transitions, lookups, metrics, documents."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import rows
from scorebook import constants as K
from scorebook.functions import predicates as B
from scorebook.functions.features import resolve_features
from scorebook.operators import lookups as L
from scorebook.operators import metrics as M
from scorebook.operators import simstats as X
from scorebook.operators.windows import game_state, polls_per_change
from scorebook.sources import documents as D

EVENT = ("game_pk int, at_bat_number int, pitch_number int, game_date date, batter_id int, pitcher_id int, bat_side string, pitch_hand string, inning int, "
         "inning_topbot string, outs_when_up int, on_1b int, on_2b int, on_3b int, balls int, strikes int, bat_score int, post_bat_score int, bat_score_diff int, "
         "n_thruorder_pitcher int, n_priorpa_thisgame_player_at_bat int, pa_result string")


def _pitch(ab, no, batter, pitcher, result=None, inning=1, half="Top", outs=0, bases=(None, None, None), score=0, post=0):
    from datetime import date

    return (1, ab, no, date(2020, 4, 1), batter, pitcher, "L", "R", inning, half, outs, *bases, 0, 0, score, post, 0, 1, 0, result)


def _game(spark):
    return spark.createDataFrame([
        _pitch(1, 1, 10, 50), _pitch(1, 2, 10, 50, "walk"),
        _pitch(2, 1, 11, 50, "single", bases=(10, None, None), post=1),
        _pitch(3, 1, 12, 50, "field_error", bases=(11, None, None), score=1, post=1),
        # the pitcher changes in the middle of an appearance
        _pitch(4, 1, 13, 50, outs=0, score=1, post=1), _pitch(4, 2, 13, 51, "strikeout", outs=0, score=1, post=1),
        _pitch(5, 1, 10, 51, "home_run", outs=1, score=1, post=3), _pitch(6, 1, 14, 51, None, outs=1, score=3, post=3),
    ], EVENT)


def test_game_state_counts_before_the_pitch(spark):
    got = rows(game_state(_game(spark)), "at_bat_number", "pitch_number", "pitcher_id", "pitcher_pitch_count", "pitcher_bf_game",
               "pitcher_outing_walks", "pitcher_outing_hits", "pitcher_outing_k", "pitcher_outing_runs", "target")
    assert got == [
        (1, 1, 50, 1, 1, 0, 0, 0, None, "walk"), (1, 2, 50, 2, 1, 0, 0, 0, 0, "walk"), (2, 1, 50, 3, 2, 1, 0, 0, 0, "single"),
        (4, 1, 50, 5, 4, 1, 1, 0, 1, "strikeout"), (4, 2, 51, 1, 1, 0, 0, 0, None, "strikeout"), (5, 1, 51, 2, 2, 0, 0, 1, 0, "home_run")]


def test_recent_ratio_skips_excluded_outcomes(spark):
    got = rows(game_state(_game(spark)), "at_bat_number", "pitch_number", "pitcher_recent_whip")
    assert got == [(1, 1, None), (1, 2, None), (2, 1, 1.0), (4, 1, 1.0), (4, 2, None), (5, 1, 0.0)]


def test_transitions(spark):
    g = spark.createDataFrame([
        _pitch(1, 1, 10, 50, "single"), _pitch(2, 1, 11, 50, "truncated_pa", bases=(10, None, None)), _pitch(3, 1, 12, 50, "field_out", outs=1, bases=(None, 10, None)),
        _pitch(4, 1, 20, 60, "walk", half="Bot"), _pitch(5, 1, 21, 60, "strikeout", half="Bot", bases=(20, None, None))], EVENT)
    got = rows(L.next_states(g), "at_bat_number", "pre_bases", "outs", "post_bases", "outs_added")
    # the truncated appearance is skipped, the half change empties the bases, the last has no successor
    assert got == [(1, 0, 0, 2, 1), (3, 2, 1, 0, 2), (4, 0, 0, 1, 0)]
    assert L.check_transitions(L.transitions(g)).count() == 0


def test_we_lookup_levels(spark):
    schema = "level string, inning int, half string, outs int, bases int, run_diff int, n long, p_home_win double"
    levels = spark.createDataFrame([
        ("full", 1, "Top", 0, 0, 0, 20, 0.51), ("full", 1, "Top", 1, 0, 0, 19, 0.99), ("no_bases", 1, "Top", 1, None, 0, 20, 0.52),
        ("no_bases", 9, "Bot", 0, None, 15, 19, 0.98), ("coarse", 9, "Bot", None, None, 15, 1, 0.97), ("baseline", None, None, None, None, None, 5000, 0.54)], schema)
    q = spark.createDataFrame([(1, 1, "Top", 0, 0, 0), (2, 1, "Top", 1, 0, 0), (3, 12, "Bot", 0, 3, 20), (4, 5, "Top", 0, 0, -20)],
                              "i int, inning int, half string, outs int, bases int, run_diff int")
    assert rows(L.we_lookup(q, levels), "i", "we") == [(1, 0.51), (2, 0.52), (3, 0.97), (4, 0.54)]
    assert L.we_grid(levels).count() == 13392


def test_interpolation_clamps(spark):
    knots = spark.createDataFrame([(0, 0.2, 0.1), (0, 0.6, 0.5), (1, 0.0, 0.0), (1, 1.0, 1.0)], "class int, x double, y double")
    df = spark.createDataFrame([(1, 0, 0.4), (1, 1, 0.6), (2, 0, 0.0), (2, 1, 0.0)], "r int, class int, p double")
    got = {(r["r"], r["class"]): r["p_calibrated"] for r in L.apply_calibration(df, knots, "r").collect()}
    assert got[(1, 0)] == pytest.approx(0.3 / 0.9) and got[(2, 0)] == pytest.approx(1.0) and got[(2, 1)] == pytest.approx(0.0)


# --- metrics -----------------------------------------------------------------

def test_brier_against_numpy(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1, 1, 1], 300)
    y = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(p[i].tolist(), int(y[i])) for i in range(300)], "proba array<double>, label int")
    one = np.eye(3)[y]
    assert M.brier(df).first()[0] == pytest.approx(((one - p) ** 2).sum(1).mean())
    d = M.brier_decomposition(df).first()
    rel = res = unc = 0.0
    for k in range(3):
        b = np.minimum((p[:, k] * 20).astype(int), 19)
        base = one[:, k].mean()
        for j in np.unique(b):
            m = b == j
            rel += m.sum() * (p[m, k].mean() - one[m, k].mean()) ** 2 / 300
            res += m.sum() * (one[m, k].mean() - base) ** 2 / 300
        unc += base * (1 - base)
    assert (d["reliability"], d["resolution"], d["uncertainty"]) == pytest.approx((rel, res, unc))
    assert d["brier_score"] == pytest.approx(rel - res + unc)


def test_binary_edges(spark):
    df = spark.createDataFrame([(0.0, 0)] * 10 + [(1.0, 1)] * 10, "p double, y int")
    r = M.brier_binary(df, "p", "y").first()
    assert (r["brier"], r["reliability"], r["resolution"], r["brier_skill"]) == (0.0, 0.0, 0.25, 1.0)
    assert M.brier_binary(df.limit(19), "p", "y").first()["brier"] is None
    assert rows(M.brier_binary_bins(df, "p", "y"), "bin", "n") == [(0, 10), (19, 10)]


def test_pareto_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(int(g), int(a), int(b), i) for i, (g, a, b) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 30, 200), rng.integers(0, 30, 200)))]
    df = spark.createDataFrame(pts, "g int, x int, y int, i int")
    want = [p for p in pts if not any(q[0] == p[0] and q[1] <= p[1] and q[2] <= p[2] and (q[1] < p[1] or q[2] < p[2]) for q in pts)]
    assert rows(M.pareto(df, "x", "y", by=["g"], bucket=lambda c: F.floor(c / 4))) == sorted(want)
    assert rows(M.pareto(df, "x", "y", by=["g"])) == sorted(want)


def test_bootstrap_is_seeded_and_centred(spark):
    df = spark.createDataFrame([(i, [0.7, 0.3], i % 2) for i in range(400)], "i long, proba array<double>, label int")
    a, b = (M.bootstrap_ci(df, "i", n=60, seed=7).first() for _ in range(2))
    assert a == b and a["ci_lower"] < a["mean"] < a["ci_upper"]
    assert a["mean"] == pytest.approx(M.brier(df).first()[0], abs=0.03)


def test_horizon_weights_against_numpy(spark):
    rng = np.random.default_rng(2)
    games, hz, err = [], [], []
    for g in range(60):
        y = int(rng.integers(0, 2))
        games.append(("r", g, 1, "rd_0", bool(y), 0.5))
        e = [float(np.clip(y + rng.normal(0, s), 0, 1)) for s in (0.3, 0.2, 0.1)]
        hz += [("r", g, f"+{k + 1}hi", v) for k, v in enumerate(e)]
        err.append([v - y for v in e])
    gdf = spark.createDataFrame(games, "eval_id string, game_pk int, entry_inning int, entry_rd_bucket string, actual_home_win boolean, entry_we_baseline double")
    hdf = spark.createDataFrame(hz, "eval_id string, game_pk int, horizon string, pred_we double")
    got = {r["hz"]: r["weight"] for r in X.horizon_weights(hdf, gdf).collect()}
    x = np.array(err)
    x = x - x.mean(0)
    n, p = x.shape
    emp = x.T @ x / n
    mu = np.trace(emp) / p
    beta = min(((x ** 2).sum(1) ** 2).sum() / n - (emp ** 2).sum(), 1e9) / (n * p)
    delta = ((emp - mu * np.eye(p)) ** 2).sum() / p
    s = min(beta, delta) / delta
    w = np.linalg.pinv((1 - s) * emp + s * mu * np.eye(p)) @ np.ones(p)
    w = np.maximum(w / w.sum(), 0)
    w = w / w.sum()
    assert sum(got.values()) == pytest.approx(1, abs=1e-3)
    for k, v in enumerate(w):
        assert got.get(k + 1, 0.0) == pytest.approx(v if v > 0.001 else 0.0, abs=2e-4)


def test_islands(spark):
    p = spark.createDataFrame([(1, i, c, e) for i, (c, e) in enumerate(
        [(False, None), (True, "a"), (False, None), (False, None), (True, "b"), (True, "a"), (False, None)])] + [(2, 0, False, None)],
        "g int, t int, changed boolean, event_type string")
    got = rows(polls_per_change(p, "g", ["t"], F.floor(F.col("t") / 2)), "g", "event_type", "median_idle")
    assert got == [(1, "a", 2.0), (1, "b", 0.0)]


# --- labels and documents ----------------------------------------------------

def test_buckets_round_trip(spark):
    df = spark.range(-9, 10).select(F.col("id").alias("d"), B.rd_bucket("id").alias("b")).withColumn("back", B.bucket_rd("b"))
    for r in df.collect():
        tail = 7 if r["d"] > 0 else -7
        assert r["back"] == (tail if abs(r["d"]) >= 6 else r["d"])
    assert df.select("b").distinct().count() == 13


def test_switch_hitter(spark):
    df = spark.createDataFrame([("S", "R"), ("S", "L"), ("L", "R"), (None, None)], "b string, t string")
    assert [r[0] for r in df.select(B.opponent_hand("b", "t")).collect()] == ["l", "r", "l", "r"]


@pytest.mark.parametrize("doc,want", [
    ({"done": True, "text": "In play, out(s)"}, (0, 2, 3)), ({"text": "In play, run(s)"}, (0, 3, 3)), ({"text": "In play, out(s)"}, (1, 2, 3)),
    ({"text": "In play, no out"}, (0, 2, 3)), ({"text": "Ball"}, (0, 2, 3)), ({"text": "In play, run(s)", "half": 1}, (0, 2, 4)), ({"event": "Single", "text": "In play, run(s)"}, (0, 2, 3))])
def test_in_play(spark, doc, want):
    df = spark.createDataFrame([(doc.get("done", False), doc.get("event"), True, doc["text"], doc.get("half", 0), 0, 2, 3)],
                               "is_complete boolean, event string, is_in_play boolean, description string, half int, outs int, away_score int, home_score int")
    assert tuple(B.adjust_in_play(df).select("outs", "away_score", "home_score").first()) == want


def test_documents_with_gaps(spark):
    plays = {"liveData": {"plays": {"allPlays": [
        {"about": {"atBatIndex": 0, "inning": 1}, "playEvents": [{"index": 0, "endTime": "2024-05-01T18:00:01.500Z"}, {"index": 1}]},
        {"about": {}, "playEvents": [{"index": 0}]}, {"about": {"atBatIndex": 2}}]}}}
    df = spark.createDataFrame([(1, json.dumps(plays)), (2, "{}"), (3, "{bad")], "game_pk int, doc string")
    good, bad = D.with_errors(df, D.GAME)
    assert rows(bad, "game_pk") == [(3,)] and good.count() == 2
    got = D.flatten_plays(good.drop("parsed"))
    assert rows(got, "at_bat_number", "play_event_index") == [(1, 0), (1, 1)]
    assert got.where("play_event_index = 0").select(F.unix_millis("event_end_ts") % 10000).first()[0] == 1500


def test_boxscore_slots(spark):
    box = {"teams": {"away": {"team": {"id": 9}, "battingOrder": [2], "pitchers": [3, 4],
                              "players": {"ID2": {"person": {"id": 2}, "position": {"abbreviation": "CF"}, "extra": 1}, "ID3": {"person": {"id": 3}}, "ID4": {"person": {"id": 4}}}}}}
    df = spark.createDataFrame([(1, json.dumps(box))], "game_pk int, doc string")
    assert rows(D.flatten_boxscore(df), "player_id", "batting_order", "is_starting_pitcher") == [(2, 1, False), (3, None, True), (4, None, False)]


def test_feature_resolution():
    assert resolve_features(["game_pk", "a", "target", "b"], exclude=["b"]) == ["a"]
    with pytest.raises(ValueError):
        resolve_features(["a"], exclude=["z"])
    with pytest.raises(ValueError):
        resolve_features(["game_pk"])


def test_run_expectancy_constant(spark):
    df = spark.createDataFrame([(0, 0), (7, 2), (3, 5)], "bases int, outs int")
    assert rows(L.run_expectancy(df), "bases", "current_re") == [(0, 0.481), (3, K.RUN_EXPECTANCY[3][2]), (7, 0.669)]
    assert math.isclose(K.FIP_CONSTANT, 3.2)
