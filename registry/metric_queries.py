"""Scores, diagnostics, simulation statistics, calibrated tables, boards and feed summaries."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import functions as F

from registry import roles, sqlparts as S
from registry.core import query
from registry.lookup_queries import GRID, SENS, WE, levels, we_sql
from scorebook.operators import boards, feeds, lookups as L, metrics as M, simstats as X
from scorebook.operators import counts as C
from scorebook.operators.bootstrap import bootstrap_exact
from scorebook.operators.skyline import skyline
from scorebook.plans import profiles as P

P5 = ["predictions"]
LONG = "SELECT o_orderkey, label, inning, run_diff, times_through_order, CAST(unnest(range(0, 5)) AS INTEGER) AS class, unnest(proba) AS p FROM predictions"
OBS = f"SELECT *, CASE WHEN class = label THEN 1::DOUBLE ELSE 0::DOUBLE END AS o FROM ({LONG})"


def _bin(n):
    return f"CAST(least(floor(p * {n}), {n - 1}) AS INTEGER)"


def murphy_sql(src: str, by: str = "") -> str:
    """Multiclass decomposition over rows (by, class, p, o)."""
    k = f"{by}, " if by else ""
    return (f"SELECT {k}max(n) AS n, sum(rel) AS reliability, sum(res) AS resolution, sum(unc) AS uncertainty, sum(rel) - sum(res) + sum(unc) AS brier_score FROM (SELECT {k}class, CAST(max(tn) AS BIGINT) AS n, "
            f"sum(m * power(sp / m - so / m, 2)) / max(tn) AS rel, sum(m * power(so / m - base, 2)) / max(tn) AS res, max(base) * (1 - max(base)) AS unc FROM (SELECT *, CAST(sum(m) OVER (PARTITION BY {k}class) AS BIGINT) AS tn, "
            f"sum(so) OVER (PARTITION BY {k}class) / sum(m) OVER (PARTITION BY {k}class) AS base FROM (SELECT {k}class, {_bin(20)} AS bin, count(*) AS m, sum(p) AS sp, sum(o) AS so FROM ({src}) GROUP BY ALL)) GROUP BY ALL) "
            + (f"GROUP BY {by}" if by else ""))


def pred(spark, sf):
    return roles.predictions(spark, sf)


query("d15_brier", roles.with_ctes(P5, f"SELECT avg(s) AS brier FROM (SELECT o_orderkey, sum(power(o - p, 2)) AS s FROM ({OBS}) GROUP BY o_orderkey)"), doubles="brier")(lambda spark, sf: M.brier(pred(spark, sf)))
query("d16_brier_per_class", roles.with_ctes(P5, f"SELECT class, avg(power(o - p, 2)) AS brier FROM ({OBS}) GROUP BY class"), doubles="brier")(lambda spark, sf: M.brier_per_class(pred(spark, sf)))
query("d17_calibration_curve", roles.with_ctes(P5, f"SELECT class, {_bin(10)} AS bin, avg(p) AS predicted, avg(o) AS actual, count(*) AS n FROM ({OBS}) GROUP BY ALL"), doubles="predicted actual")(
    lambda spark, sf: M.calibration_curve(pred(spark, sf)))
MC = "reliability resolution uncertainty brier_score"
query("d18_brier_decomposition", roles.with_ctes(P5, murphy_sql(OBS)), doubles=MC)(lambda spark, sf: M.brier_decomposition(pred(spark, sf)))

BINS = f"SELECT {{k}}{_bin(20)} AS bin, count(*) AS m, sum(p) AS sp, sum(o) AS so, sum(power(p - o, 2)) AS sb FROM ({{src}}) GROUP BY ALL"


def binary_sql(src: str, by: str = "") -> str:
    """Binary decomposition over rows (by, p, o)."""
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    inner = (f"SELECT {k}CAST(max(tn) AS BIGINT) AS n, sum(sb) / max(tn) AS brier, sum(m * power(sp / m - so / m, 2)) / max(tn) AS reliability, sum(m * power(so / m - base, 2)) / max(tn) AS resolution, max(base) * (1 - max(base)) AS uncertainty "
             f"FROM (SELECT *, sum(m) OVER ({part}) AS tn, sum(so) OVER ({part}) / sum(m) OVER ({part}) AS base FROM ({BINS.format(k=k, src=src)})) " + (f"GROUP BY {by}" if by else ""))
    cols = ["brier", "reliability", "resolution", "uncertainty"]
    return (f"SELECT {k}n, " + ", ".join(f"CASE WHEN n >= 20 THEN {c} END AS {c}" for c in cols)
            + f", CASE WHEN n >= 20 THEN CASE WHEN uncertainty > 0 THEN 1 - brier / uncertainty ELSE 0 END END AS brier_skill FROM ({inner})")


EG = "SELECT *, p_home_win AS p, CAST(actual_home_win AS INTEGER)::DOUBLE AS o FROM eval_games"
BC = "brier reliability resolution uncertainty brier_skill"
query("d19_brier_binary", roles.with_ctes(["eval_games"], binary_sql(EG)), doubles=BC)(lambda spark, sf: M.brier_binary(roles.eval_games(spark, sf), "p_home_win", "actual_home_win"))
query("d19_brier_binary_bins", roles.with_ctes(["eval_games"], "SELECT bin, bin / 20::DOUBLE AS bin_lo, (bin + 1) / 20::DOUBLE AS bin_hi, m AS n, sp / m AS mean_pred, so / m AS actual_rate, sp / m - so / m AS gap, "
      f"m * power(sp / m - so / m, 2) / sum(m) OVER () AS reliability_contrib FROM ({BINS.format(k='', src=EG)})"), doubles="bin_lo bin_hi mean_pred actual_rate gap reliability_contrib")(
    lambda spark, sf: M.brier_binary_bins(roles.eval_games(spark, sf), "p_home_win", "actual_home_win"))
query("d19_documents_quality", binary_sql("SELECT lang, least(0.99::DOUBLE, n_chars / 20000::DOUBLE) AS p, quality::DOUBLE AS o FROM documents JOIN labels USING (doc_id)", "lang"), doubles=BC)(
    lambda spark, sf: M.brier_binary(roles.load(spark, sf, "documents").join(roles.load(spark, sf, "labels"), "doc_id").withColumn("p", F.least(F.lit(0.99), F.col("n_chars") / 20000)), "p", "quality", by=["lang"]))

STRATA = {"early_inning": "inning <= 3", "mid_inning": "inning BETWEEN 4 AND 6", "late_inning": "inning >= 7", "ahead": "run_diff > 0", "tied": "run_diff = 0", "behind": "run_diff < 0",
          "close_game": "abs(run_diff) <= 2", "blowout": "abs(run_diff) > 4", "tto_1": "times_through_order = 1", "tto_2": "times_through_order = 2", "tto_3_plus": "times_through_order >= 3"}
STRAT_SQL = " UNION ALL ".join(f"SELECT '{n}' AS stratum, class, p, o FROM obs WHERE {c}" for n, c in STRATA.items())
query("d20_brier_by_stratum", roles.with_ctes(P5, murphy_sql(STRAT_SQL, "stratum"), {"obs": OBS}), doubles=MC)(lambda spark, sf: M.brier_by_stratum(pred(spark, sf), M.game_strata()))
query("d21_brier_skill", roles.with_ctes(P5, f"SELECT n, brier, naive_brier, 1 - brier / naive_brier AS brier_skill FROM (SELECT count(*) AS n, avg(s) AS brier FROM (SELECT sum(power(o - p, 2)) AS s FROM ({OBS}) GROUP BY o_orderkey)), "
      "(SELECT sum(f * (1 - f)) AS naive_brier FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM predictions) AS f FROM predictions GROUP BY label))"), doubles="brier naive_brier brier_skill")(
    lambda spark, sf: M.brier_skill(pred(spark, sf)))
query("d21_class_counts", roles.with_ctes(P5, "SELECT label AS class, count(*) AS n FROM predictions GROUP BY label"))(lambda spark, sf: M.class_counts(pred(spark, sf)))

def bootstrap_sql(metric: str) -> str:
    """Every replicate written out: the same draws in SQL arithmetic, then percentiles of the replicates."""
    prime, cdf, total = 2147483647, [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        cdf.append(total)
    draws = f"SELECT *, (o_orderkey % {prime} * 48271 + r * 69621 + 42) % {prime} AS x0 FROM scores, range(1000) t(r)"
    for i, add in enumerate((12345, 54321)):
        draws = f"SELECT *, (x{i} * x{i} + o_orderkey % {prime} + {add} * (r + 1)) % {prime} AS x{i + 1} FROM ({draws})"
    w = " + ".join(f"(x2::DOUBLE / {prime} >= {c!r})::INT" for c in cdf)
    return roles.with_ctes(P5, "SELECT avg(v) AS mean, quantile_cont(v, 0.025) AS ci_lower, quantile_cont(v, 0.975) AS ci_upper, stddev_pop(v) AS std FROM "
                           f"(SELECT r, {metric} AS v FROM (SELECT r, score, hit, {w} AS w FROM ({draws})) GROUP BY r)",
                           {"obs": OBS, "scores": "SELECT o_orderkey, sum(power(o - p, 2)) AS score, max(label) = arg_min(class, {'a': -p, 'b': class}) AS hit FROM obs GROUP BY o_orderkey"})


query("d22_bootstrap_ci", bootstrap_sql("sum(w * score) / sum(w)"), doubles="mean ci_lower ci_upper std")(lambda spark, sf: M.bootstrap_ci(pred(spark, sf), "o_orderkey"))


@query("d22_bootstrap_exact")
def d22x(spark, sf):
    """n of n rows in every replicate; the draws have no SQL, a test adds them up and repeats them."""
    return bootstrap_exact(pred(spark, sf), "o_orderkey", {"score": M.row_brier()}, lambda s: s("score") / s("draws"))


@query("j2_pluggable_metric", bootstrap_sql("sum(w * hit::INT)::DOUBLE / sum(w)"), doubles="mean ci_lower ci_upper std")
def j2(spark, sf):
    """Accuracy instead of the default score: any weighted aggregate can be the metric."""
    rows = pred(spark, sf).withColumn("hit", F.when(F.array_position("proba", F.array_max("proba")) - 1 == F.col("label"), 1.0).otherwise(0.0))
    return M.bootstrap_ci(rows, "o_orderkey", metric=lambda w: F.sum(w * F.col("hit")) / F.sum(w), uses=["hit"])


query("d23_summarise_runs", "SELECT o_orderpriority AS metric, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM orders GROUP BY 1", doubles="mean std", digits=4)(
    lambda spark, sf: M.summarise_runs(roles.load(spark, sf, "orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"))))

HG = "SELECT h.horizon, h.pred_we, h.actual_we, g.entry_we_baseline AS e, g.actual_home_win FROM eval_horizons h JOIN eval_games g ON h.eval_id = g.eval_id AND h.game_pk = g.game_pk WHERE h.horizon LIKE '+%hi' AND h.pred_we IS NOT NULL{0}"


def diag_sql(where=""):
    src = HG.format(where)
    score = binary_sql(f"SELECT horizon, pred_we AS p, CAST(actual_home_win AS INTEGER)::DOUBLE AS o FROM ({src})", "horizon")
    return (f"SELECT a.*, b.brier_skill AS bss, b.reliability, coalesce((entry_mae - pred_mae) / nullif(entry_mae, 0), 0) AS improvement FROM (SELECT horizon, count(*) AS n, avg(abs(pred_we - actual_we)) AS pred_mae, avg(abs(e - actual_we)) AS entry_mae, "
            f"avg(pred_we - e) AS mean_predicted_move, avg(actual_we - e) AS mean_actual_move, avg(abs((pred_we - e) - (actual_we - e))) AS move_mae, avg((pred_we - e) - (actual_we - e)) AS move_bias FROM ({src}) WHERE actual_we IS NOT NULL "
            f"GROUP BY horizon) a LEFT JOIN ({score}) b USING (horizon)")


DD = "pred_mae entry_mae mean_predicted_move mean_actual_move move_mae move_bias bss reliability improvement"
EH = ["eval_horizons", "eval_games"]
query("d24_horizon_diagnostics", roles.with_ctes(EH, diag_sql()), doubles=DD)(lambda spark, sf: M.horizon_diagnostics(roles.eval_horizons(spark, sf), roles.eval_games(spark, sf)))
query("d24_horizon_diagnostics_inning", roles.with_ctes(EH, diag_sql(" AND g.entry_inning = 4")), doubles=DD)(
    lambda spark, sf: M.horizon_diagnostics(roles.eval_horizons(spark, sf), roles.eval_games(spark, sf), inning=4))
for _c in ("entry_inning", "entry_phase"):
    query(f"d25_accuracy_by_{_c[6:]}", roles.with_ctes(["eval_games"], f"SELECT {_c}, count(*) AS n, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE correct)::DOUBLE / count(*) AS accuracy FROM eval_games GROUP BY 1"),
          doubles="accuracy")(lambda spark, sf, c=_c: M.accuracy_by(roles.eval_games(spark, sf), c))


# --- simulation statistics ---------------------------------------------------

query("d26_aggregate_sims", roles.with_ctes(["sims"], "SELECT *, sqrt(p_home_win * (1 - p_home_win) / n_sims) AS p_home_win_se FROM (SELECT game_pk, count(*) AS n_sims, avg(CASE WHEN home_score > away_score THEN 1::DOUBLE ELSE 0 END) AS p_home_win, avg(home_score) AS mean_home_score, "
      "avg(away_score) AS mean_away_score, avg(home_score + away_score) AS mean_total_runs, avg(innings) AS mean_innings, sum(home_score + away_score)::DOUBLE / nullif(sum(innings * 2 - CASE WHEN home_score > away_score AND innings >= 9 THEN 1 ELSE 0 END), 0) AS runs_per_inning "
      "FROM sims GROUP BY game_pk)"), doubles="p_home_win p_home_win_se mean_home_score mean_away_score mean_total_runs mean_innings runs_per_inning")(lambda spark, sf: X.aggregate_sims(roles.sims(spark, sf)))
_PC = ", ".join(f"CAST(floor(quantile_cont({e}, {p / 100})) AS INTEGER) AS {n}_p{p}" for n, e in (("home", "home_score"), ("away", "away_score"), ("total", "home_score + away_score")) for p in (10, 25, 50, 75, 90))
_MS = ", ".join(f"avg({e}) AS {n}_mean, stddev_pop({e}) AS {n}_std" for n, e in (("home", "home_score"), ("away", "away_score"), ("total", "home_score + away_score")))
query("d27_sim_distribution", roles.with_ctes(["sims"], f"SELECT game_pk, count(*) AS n_sims, {_PC}, {_MS}, avg(CASE WHEN innings > 9 THEN 1::DOUBLE ELSE 0 END) AS extras_frac, avg(home_pitcher_changes) AS mean_pitcher_changes_home, "
      "avg(away_pitcher_changes) AS mean_pitcher_changes_away, count(*) FILTER (WHERE pruned) AS n_pruned, avg(CASE WHEN pruned THEN 1::DOUBLE ELSE 0 END) AS prune_rate, avg(pruned_at_pa) FILTER (WHERE pruned) AS mean_pa_at_prune FROM sims GROUP BY game_pk"),
      doubles="home_mean home_std away_mean away_std total_mean total_std extras_frac mean_pitcher_changes_home mean_pitcher_changes_away prune_rate mean_pa_at_prune")(lambda spark, sf: X.sim_distribution(roles.sims(spark, sf)))


@query("d28_outcome_counts", roles.with_ctes(["sims"], "SELECT game_pk, outcome, CAST(sum(n) AS BIGINT) AS n FROM (SELECT game_pk, 'single' AS outcome, pk % 7 AS n FROM sims UNION ALL SELECT game_pk, 'walk', sk % 4 FROM sims "
                                               "UNION ALL SELECT game_pk, 'home_run', pk % 3 FROM sims WHERE pk % 2 = 0) GROUP BY ALL"))
def d28(spark, sf):
    s = roles.sims(spark, sf).withColumn("outcome_counts", F.expr(
        "CASE WHEN pk % 2 = 0 THEN map('single', pk % 7, 'walk', sk % 4, 'home_run', pk % 3) ELSE map('single', pk % 7, 'walk', sk % 4) END"))
    return X.outcome_counts(s)


PATHS = {"reached": "SELECT p.*, o.home_won, p.home_score - p.away_score AS rd FROM paths p JOIN actual a USING (game_pk, horizon) JOIN outcomes o USING (game_pk, sim_id)",
         "center": "SELECT game_pk, horizon, count(*) AS n_reached, avg(CAST(home_won AS INTEGER)) AS sim_p_home, CAST(floor(quantile_cont(inning, 0.5)) AS INTEGER) AS inning, "
                   "CASE WHEN floor(quantile_cont(CASE WHEN half = 'Bot' THEN 1 ELSE 0 END, 0.5)) = 1 THEN 'Bot' ELSE 'Top' END AS half, CASE WHEN horizon = 0 THEN CAST(floor(quantile_cont(outs, 0.5)) AS INTEGER) ELSE 0 END AS outs, "
                   "CASE WHEN horizon = 0 THEN CAST(floor(quantile_cont(bases, 0.5)) AS INTEGER) ELSE 0 END AS bases FROM reached GROUP BY game_pk, horizon",
         "rowsw": we_sql("SELECT r.game_pk, r.horizon, r.rd, CAST(r.rd AS INTEGER) AS run_diff, c.n_reached, c.sim_p_home, c.inning, c.half, c.outs, c.bases, row_number() OVER (PARTITION BY r.game_pk, r.horizon ORDER BY r.sim_id) AS k "
                         "FROM reached r JOIN center c ON r.game_pk = c.game_pk AND r.horizon = c.horizon"),
         "truth": we_sql("SELECT *, CAST(home_score - away_score AS INTEGER) AS run_diff FROM actual", "actual_we"),
         "corr": "SELECT game_pk, horizon, var_samp(we - base) AS correction_var FROM (SELECT p.game_pk, p.sim_id, p.horizon, p.we, CASE WHEN p.horizon = 1 THEN 0.5::DOUBLE ELSE b.we END AS base FROM paths p LEFT JOIN "
                 "(SELECT * FROM paths WHERE we >= 0) b ON b.game_pk = p.game_pk AND b.sim_id = p.sim_id AND b.horizon = p.horizon - 1 WHERE p.horizon >= 1 AND p.we >= 0) GROUP BY game_pk, horizon"}
_STDS = ", ".join(f"CASE WHEN max(n_reached) >= {k} THEN stddev_pop(we) FILTER (WHERE k <= {k}) END AS std_at_{k}" for k in X.CHECKS)
D29 = (f"SELECT s.*, t.actual_we, t.home_score AS actual_home_score, t.away_score AS actual_away_score, c.correction_var FROM (SELECT game_pk, horizon, max(n_reached) AS n_reached, max(sim_p_home) AS sim_p_home, avg(we) AS pred_we, stddev_pop(we) AS pred_we_std, "
       f"avg(rd) AS pred_run_diff_mean, stddev_pop(rd) AS pred_run_diff_std, {_STDS} FROM rowsw GROUP BY game_pk, horizon) s JOIN truth t ON s.game_pk = t.game_pk AND s.horizon = t.horizon LEFT JOIN corr c ON s.game_pk = c.game_pk AND s.horizon = c.horizon")


@query("d29_horizon_checkpoints", S.core([], D29, roles=["games", "paths", "actual", "outcomes"], extra={**WE, **PATHS}),
       doubles="sim_p_home pred_we pred_we_std pred_run_diff_mean pred_run_diff_std std_at_25 std_at_50 std_at_100 std_at_200 std_at_500 actual_we correction_var")
def d29(spark, sf):
    return X.horizon_checkpoints(roles.paths(spark, sf), roles.actual(spark, sf), levels(spark, sf), roles.outcomes(spark, sf))


# --- calibrated tables -------------------------------------------------------

BEST = ("SELECT inning, rd_bucket, concat(CAST(inning AS VARCHAR), '|', rd_bucket) AS state_key, level, stabilization_n, coalesce(nullif(CASE stabilization_n WHEN 25 THEN std_at_25 WHEN 50 THEN std_at_50 WHEN 100 THEN std_at_100 WHEN 200 THEN std_at_200 ELSE std_at_500 END, 0), std_at_500) AS std, "
        "CAST(CASE WHEN rd_bucket = 'rd_lte_m6' THEN -7 WHEN rd_bucket = 'rd_gte_p6' THEN 7 WHEN rd_bucket LIKE 'rd_m%' THEN -CAST(right(rd_bucket, 1) AS INTEGER) ELSE CAST(right(rd_bucket, 1) AS INTEGER) END AS INTEGER) AS rd FROM conv WHERE stabilization_n IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY inning, rd_bucket ORDER BY stabilization_n, level) = 1")


@query("d30_n_lookup", S.core([], f"SELECT b.inning, b.rd_bucket, b.state_key, b.level, greatest(CAST(b.stabilization_n AS BIGINT), CAST(ceil(g.we * (1 - g.we) / (0.02::DOUBLE * 0.02::DOUBLE)) AS BIGINT)) AS n FROM ({BEST}) b LEFT JOIN ({we_sql(GRID)}) g "
                              "ON g.inning = b.inning AND g.run_diff = b.rd AND g.half = 'Top' AND g.outs = 0 AND g.bases = 0", roles=["games", "conv"], extra=WE))
def d30(spark, sf):
    return X.n_lookup(roles.convergence(spark, sf), L.we_grid(levels(spark, sf)))


query("d31_stopping_thresholds", roles.with_ctes(["conv"], f"SELECT state_key, std AS threshold FROM ({BEST}) WHERE std IS NOT NULL"), doubles="threshold")(
    lambda spark, sf: X.stopping_thresholds(roles.convergence(spark, sf)))


@query("d32_gamma_schedule", S.core([], f"SELECT b.state_key, CASE WHEN s.m > 1e-6 THEN round(greatest(0.1::DOUBLE, least(0.5::DOUBLE, b.std / s.m)), 4) ELSE 1 END AS gamma FROM ({BEST}) b LEFT JOIN (SELECT inning, run_diff, avg(abs(round(dwe_drd, 6))) AS m "
                                    f"FROM ({SENS}) GROUP BY ALL) s ON s.inning = b.inning AND s.run_diff = b.rd WHERE b.std IS NOT NULL", roles=["games", "conv"], extra=WE), doubles="gamma")
def d32(spark, sf):
    return X.gamma_schedule(roles.convergence(spark, sf), L.we_sensitivity(L.we_grid(levels(spark, sf))))


ERR = ("SELECT concat(CAST(g.entry_inning AS VARCHAR), '|', g.entry_rd_bucket, '@', g.eval_id) AS state_key, h.game_pk, CAST(substr(h.horizon, 2, length(h.horizon) - 3) AS INTEGER) AS hz, h.pred_we, CAST(g.actual_home_win AS INTEGER)::DOUBLE AS y, g.entry_we_baseline AS e "
       "FROM eval_horizons h JOIN eval_games g ON h.eval_id = g.eval_id AND h.game_pk = g.game_pk WHERE h.horizon LIKE '+%hi' AND h.pred_we IS NOT NULL")
ELIG = ("SELECT state_key, hz FROM (SELECT *, first_value(eb) OVER (PARTITION BY state_key ORDER BY hz) AS entry FROM (SELECT *, row_number() OVER (PARTITION BY state_key ORDER BY hz) AS r FROM (SELECT state_key, hz, count(*) AS n, avg(power(pred_we - y, 2)) AS b, "
        "avg(power(e - y, 2)) AS eb FROM err GROUP BY ALL)) JOIN (SELECT state_key FROM err GROUP BY ALL HAVING count(DISTINCT game_pk) >= 5) USING (state_key) WHERE r <= 15 AND n >= 5) WHERE b < entry")


def _all_runs(spark, sf):
    """All runs, each with states of its own."""
    games = roles.eval_games(spark, sf).withColumn("entry_rd_bucket", F.concat("entry_rd_bucket", F.lit("@"), "eval_id"))
    return roles.eval_horizons(spark, sf), games


query("d33_eligible_horizons", roles.with_ctes(EH, ELIG, {"err": ERR}))(lambda spark, sf: X.eligible_horizons(X.horizon_errors(*_all_runs(spark, sf)), min_games=5))
query("d33_horizon_weights")(lambda spark, sf: X.horizon_weights(*_all_runs(spark, sf), min_games=5))

query("d34_weighted_estimate", roles.with_ctes(["paths", "outcomes", "weights"], "SELECT game_pk, count(*) AS n_sims, avg(e) AS p_home_win, stddev_samp(e) / sqrt(count(*)) AS p_home_win_se FROM (SELECT o.game_pk, o.sim_id, greatest(0, least(1, sum(w.weight * "
      "CASE WHEN p.we >= 0 THEN p.we ELSE CAST(o.home_won AS INTEGER)::DOUBLE END))) AS e FROM outcomes o JOIN weights w USING (state_key) LEFT JOIN paths p ON p.game_pk = o.game_pk AND p.sim_id = o.sim_id AND p.horizon = w.hz GROUP BY o.game_pk, o.sim_id) GROUP BY game_pk"),
      doubles="p_home_win p_home_win_se")(lambda spark, sf: X.weighted_estimate(roles.paths(spark, sf), roles.outcomes(spark, sf), roles.weights(spark, sf)))


@query("d35_weighted_mean_ess", roles.with_ctes(["paths"], "SELECT b.game_pk, m AS mean, CASE WHEN ess > 1 THEN sqrt(v / ess) ELSE sqrt(v) END AS se, ess FROM (SELECT x.game_pk, sum(w * power(we - m, 2)) / sum(w) AS v FROM x JOIN (SELECT game_pk, sum(w * we) / sum(w) AS m FROM x "
                                                  "GROUP BY game_pk) USING (game_pk) GROUP BY x.game_pk) a JOIN (SELECT game_pk, sum(w * we) / sum(w) AS m, power(sum(w), 2) / sum(w * w) AS ess FROM x GROUP BY game_pk) b USING (game_pk)",
                                                  {"x": "SELECT game_pk, we, power(greatest(1e-10, least(1, we)), 0.3) AS w FROM paths WHERE we >= 0"}), doubles="mean se ess", digits=5)
def d35(spark, sf):
    p = roles.paths(spark, sf).where("we >= 0").withColumn("w", X.tempered_weight(F.col("we"), F.lit(0.3)))
    return X.weighted_mean_ess(p, "w", "we", ["game_pk"])


# --- feeds -------------------------------------------------------------------

NOW, NOW_SQL = datetime(2024, 1, 31), "TIMESTAMP '2024-01-31'"
METRICS = ("SELECT game_pk, any_value(abstract_game_state) AS abstract_game_state, count(*) AS poll_count, count(*) FILTER (WHERE error IS NULL) AS success_count, count(*) FILTER (WHERE error IS NOT NULL) AS error_count, count(*) FILTER (WHERE changed) AS changed_count, "
           "coalesce(avg(response_ms) FILTER (WHERE error IS NULL), 0) AS avg_response_ms, coalesce(max(response_ms) FILTER (WHERE error IS NULL), 0) AS max_response_ms, max(ts) AS last_poll_at, max(ts) FILTER (WHERE changed) AS last_change_at, "
           "count(*) FILTER (WHERE error IS NOT NULL AND ts > ok) AS consecutive_errors FROM (SELECT *, max(ts) FILTER (WHERE error IS NULL) OVER (PARTITION BY game_pk) AS ok FROM polls) GROUP BY game_pk")


def metrics(spark, sf):
    p = roles.polls(spark, sf)
    state = p.groupBy("game_pk").agg(F.max("abstract_game_state").alias("abstract_game_state"))
    return feeds.poll_metrics(p, tie=["event_id"]).join(state, "game_pk")


query("d36_poll_summary", roles.with_ctes(["polls"], "SELECT game_pk, count(*) AS total_polls, count(*) FILTER (WHERE changed)::DOUBLE / count(*) AS change_rate, (1 - count(*) FILTER (WHERE changed)::DOUBLE / count(*)) * 100 AS wasted_poll_pct, "
      "count(*) FILTER (WHERE error IS NOT NULL)::DOUBLE / count(*) AS error_rate, avg(response_ms) FILTER (WHERE error IS NULL) AS avg_response_ms FROM polls GROUP BY game_pk"), doubles="change_rate wasted_poll_pct error_rate avg_response_ms")(
    lambda spark, sf: feeds.poll_summary(roles.polls(spark, sf)))
query("d37_poll_metrics", roles.with_ctes(["polls"], METRICS), doubles="avg_response_ms max_response_ms")(metrics)
ALERTS = (f"SELECT game_pk, 'error' AS level, 'consecutive_errors' AS kind FROM m WHERE consecutive_errors >= 3 UNION ALL SELECT game_pk, 'warn', 'high_error_rate' FROM m WHERE poll_count > 10 AND error_count::DOUBLE / poll_count > 0.10 "
          f"UNION ALL SELECT game_pk, 'warn', 'slow_responses' FROM m WHERE avg_response_ms > 2000 UNION ALL SELECT game_pk, 'warn', 'no_change' FROM m WHERE abstract_game_state = 'Live' AND epoch({NOW_SQL} - last_change_at) > 120")
query("d38_feed_alerts", roles.with_ctes(["polls"], ALERTS, {"m": METRICS}))(lambda spark, sf: feeds.feed_alerts(metrics(spark, sf), NOW))
query("d38_feed_totals", roles.with_ctes(["polls"], "SELECT count(*) FILTER (WHERE abstract_game_state = 'Live') AS active_trackers, count(*) AS total_trackers, CAST(sum(poll_count) AS BIGINT) AS total_polls, sum(error_count) * 100::DOUBLE / sum(poll_count) AS error_rate_pct FROM m",
      {"m": METRICS}), doubles="error_rate_pct")(lambda spark, sf: feeds.feed_totals(metrics(spark, sf)))
query("i12_stale", roles.with_ctes(["polls"], f"SELECT game_pk, epoch({NOW_SQL} - last_change_at) AS quiet_seconds FROM m WHERE abstract_game_state = 'Live' AND epoch({NOW_SQL} - last_change_at) > 120", {"m": METRICS}), doubles="quiet_seconds", digits=3)(
    lambda spark, sf: feeds.stale(metrics(spark, sf), NOW))

query("e20_polls_per_change", roles.with_ctes(["polls"], "SELECT game_pk, event_type, median(idle)::DOUBLE AS median_idle FROM (SELECT game_pk, island, count(*) FILTER (WHERE NOT changed) AS idle, max(event_type) FILTER (WHERE changed) AS event_type, max(island) OVER (PARTITION BY game_pk) AS last FROM "
      "(SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY game_pk ORDER BY ts, event_id) AS island FROM polls) WHERE island > 0 GROUP BY game_pk, island) WHERE island < last GROUP BY game_pk, event_type"), doubles="median_idle")(
    lambda spark, sf: _islands(roles.polls(spark, sf)))


def _islands(p):
    from scorebook.operators.windows import polls_per_change

    return polls_per_change(p, "game_pk", ["ts", "event_id"], F.date_trunc("hour", F.col("ts")))


# --- feature selection -------------------------------------------------------

query("d39_drop_rare", S.core([], "SELECT game_pk, at_bat_number, pa_result FROM pitches WHERE pa_result IN (SELECT pa_result FROM pitches GROUP BY pa_result HAVING count(*) >= 200)"))(
    lambda spark, sf: M.drop_rare(roles.events(spark, sf).where("pa_result IS NOT NULL"), "pa_result", cv=40).select("game_pk", "at_bat_number", "pa_result"))
FEAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_extendedprice * (1 - l_discount) END AS net FROM lineitem)" for i, a in enumerate(FEAT) for b in FEAT[i + 1:])
BLK = {"l_quantity": "size", "l_extendedprice": "size", "l_discount": "terms", "l_tax": "terms", "net": "size"}


def pairs(spark, sf):
    """One feature is unknown on some rows, which must not cost the other pairs those rows."""
    return M.correlation_pairs(roles.load(spark, sf, "lineitem").selectExpr("*", "CASE WHEN l_linenumber <> 2 THEN l_extendedprice * (1 - l_discount) END AS net"), FEAT)


query("d40_correlation_pairs", PAIRS, doubles="r")(pairs)
_B = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BLK.items()) + " END"
query("d40_correlation_report", f"SELECT least(a, b) AS block_a, greatest(a, b) AS block_b, avg(abs(r)) AS mean_abs_r FROM (SELECT {_B.format('feature_a')} AS a, {_B.format('feature_b')} AS b, r FROM ({PAIRS})) GROUP BY ALL", doubles="mean_abs_r")(
    lambda spark, sf: M.correlation_report(pairs(spark, sf), spark.createDataFrame(list(BLK.items()), "feature string, block string")))
query("d40_high_pairs", f"SELECT * FROM ({PAIRS}) WHERE abs(r) >= 0.3", doubles="r")(lambda spark, sf: M.high_pairs(pairs(spark, sf), 0.3))
query("f5_top_pairs", f"SELECT * FROM ({PAIRS}) ORDER BY abs(r) DESC LIMIT 3", doubles="r")(lambda spark, sf: M.top_pairs(pairs(spark, sf), 3))
IMP = "SELECT p_brand AS feature, sum(p_size)::DOUBLE AS value FROM part WHERE p_size > 25 GROUP BY 1"


@query("d41_importance_by_block", f"SELECT block, sum(coalesce(value, 0)) / (SELECT sum(value) FROM ({IMP})) AS share FROM (SELECT DISTINCT p_brand AS feature, right(p_brand, 1) AS block FROM part) LEFT JOIN ({IMP}) USING (feature) GROUP BY block", doubles="share")
def d41(spark, sf):
    part = roles.load(spark, sf, "part")
    imp = part.where("p_size > 25").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").cast("double").alias("value"))
    return M.importance_by_block(imp, part.select(F.col("p_brand").alias("feature"), F.expr("right(p_brand, 1)").alias("block")).distinct())


@query("d42_pareto", "SELECT p_partkey, p_brand, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_retailprice <= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size < a.p_size))", doubles="p_retailprice")
def d42(spark, sf):
    p = roles.load(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return M.pareto(p, "p_retailprice", "p_size", by=["p_brand"], bucket=lambda c: F.floor(c / 100))


def _unbeaten(table: str, key: str, by: str, costs: list[str]) -> str:
    le, lt = " AND ".join(f"b.{c} <= a.{c}" for c in costs), " OR ".join(f"b.{c} < a.{c}" for c in costs)
    same = f"b.{by} = a.{by} AND " if by else ""
    return f"SELECT {key}, {', '.join(costs)} FROM {table} a WHERE NOT EXISTS (SELECT 1 FROM {table} b WHERE {same}{le} AND ({lt}))"


COSTS3 = "(SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS price, p_size AS size, (p_partkey * 7919) % 1009 AS wait FROM part)"
COSTS4 = ("(SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_extendedprice AS DOUBLE) AS price, 50 - CAST(l_quantity AS DOUBLE) AS few, "
          "round(0.2 - CAST(l_discount AS DOUBLE), 2) AS full_price, CAST(l_tax AS DOUBLE) AS tax FROM lineitem)")


@query("d42_skyline_3", _unbeaten(COSTS3, "p_partkey", "", ["price", "size", "wait"]), doubles="price")
def d42s3(spark, sf):
    p = roles.load(spark, sf, "part").selectExpr("p_partkey", "CAST(p_retailprice AS DOUBLE) AS price", "p_size AS size", "(p_partkey * 7919) % 1009 AS wait")
    return skyline(p, ["price", "size", "wait"])


@query("d42_skyline_4", _unbeaten(COSTS4, "l_orderkey, l_linenumber", "l_suppkey", ["price", "few", "full_price", "tax"]), doubles="price few full_price tax")
def d42s4(spark, sf):
    p = roles.load(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "CAST(l_extendedprice AS DOUBLE) AS price", "50 - CAST(l_quantity AS DOUBLE) AS few",
                                                     "round(0.2D - CAST(l_discount AS DOUBLE), 2) AS full_price", "CAST(l_tax AS DOUBLE) AS tax")
    return skyline(p, ["price", "few", "full_price", "tax"], ["l_suppkey"]).drop("l_suppkey")


@query("d42_select_weighted", "SELECT p_brand, p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice <= 1500 QUALIFY row_number() OVER (PARTITION BY p_brand "
                             "ORDER BY p_size + 0.003 * ln(greatest(p_retailprice, 0.1)), p_partkey) = 1", doubles="p_retailprice")
def d42w(spark, sf):
    part = roles.load(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    return M.select_weighted(part, "p_retailprice", "p_size", by=["p_brand"], max_cost=1500).select("p_brand", "p_partkey", "p_retailprice", "p_size")


@query("d42_select_knee", "SELECT p_brand, p_retailprice, p_size, p_partkey FROM part a WHERE p_retailprice <= 1.5 * (SELECT min(p_retailprice) FROM part b WHERE b.p_brand = a.p_brand) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) = 1", doubles="p_retailprice")
def d42b(spark, sf):
    p = roles.load(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return M.select_knee(p, "p_retailprice", "p_size", by=["p_brand"])


SIZES = "SELECT p_size, avg(p_retailprice) AS mean, stddev_pop(p_retailprice) AS sd FROM part GROUP BY p_size"


@query("d43_one_se", f"WITH t AS ({SIZES}) SELECT min(p_size) AS p_size FROM t WHERE mean <= (SELECT mean + sd FROM t ORDER BY mean, p_size LIMIT 1)")
def d43(spark, sf):
    t = roles.load(spark, sf, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("mean"), F.stddev_pop("p_retailprice").alias("sd"))
    return M.one_se(t, "p_size", "mean", "sd")


query("d44_describe_split", roles.with_ctes(["games"], "SELECT game_type, count(*) AS n_rows, count(DISTINCT game_pk) AS n_games, min(game_date) AS first_date, max(game_date) AS last_date, array_to_string(list_sort(list(DISTINCT year(game_date))), ',') AS seasons FROM games GROUP BY game_type"))(
    lambda spark, sf: M.describe_split(roles.games(spark, sf), by="game_type").withColumn("seasons", F.array_join(F.col("seasons").cast("array<string>"), ",")))
query("d45_seasons", roles.with_ctes(["games"], "SELECT DISTINCT season FROM games ORDER BY season DESC"))(lambda spark, sf: M.seasons(roles.games(spark, sf)))


# --- boards ------------------------------------------------------------------

def _board_sql(table, key, vol, hand, cols, limit, offset):
    return (f"SELECT b.{key}, b.game_date, {cols}, p.full_name, p.team_name, p.position, p.{hand} FROM {table} b LEFT JOIN players p ON b.{key} = p.player_id WHERE b.season = 2019 AND b.game_date = (SELECT max(game_date) FROM {table} WHERE season = 2019) "
            f"AND b.{vol} >= 1 ORDER BY b.{vol} DESC, b.{key} LIMIT {limit} OFFSET {offset}")


_bat = ["s_pa", "c_pa"] + [f"{s}_{n}" for s in ("season", "career") for n in ("ba", "obp", "slg", "ops", "woba", "k_pct", "bb_pct")]
_batx = [f"CAST(b.{s}_{n}_vs_l + b.{s}_{n}_vs_r AS DOUBLE) / nullif(b.{s}_bip_vs_l + b.{s}_bip_vs_r, 0) AS {sp}_{o}" for s, sp in (("s", "season"), ("c", "career")) for n, o in (("ev_sum", "avg_ev"), ("barrel", "barrel_pct"))]
query("f1_batter_board", S.core(["batters"], _board_sql("batters", "batter_id", "s_pa", "bats", ", ".join([f"b.{c}" for c in _bat] + _batx), 20, 2), roles=["players"]),
      doubles=_bat[2:] + [f"{sp}_{o}" for sp in ("season", "career") for o in ("avg_ev", "barrel_pct")])(
    lambda spark, sf: boards.batter_board(P.batters(C.batter_counts(roles.events(spark, sf))), roles.players(spark, sf), 2019, 20, 2))
_pit = ["s_bf", "c_bf"] + [f"{s}_{n}" for s in ("season", "career") for n in ("ip", "whip", "k_pct", "bb_pct", "hr9", "woba")]
query("f1_pitcher_board", S.core(["pitchers"], _board_sql("pitchers", "pitcher_id", "s_bf", "throws", ", ".join(f"b.{c}" for c in _pit), 20, 0), roles=["players"]), doubles=_pit[2:])(
    lambda spark, sf: boards.pitcher_board(P.pitchers(C.pitcher_counts(roles.events(spark, sf))), roles.players(spark, sf), 2019, 20))
query("f4_order_horizons", roles.with_ctes(["eval_horizons"], "SELECT horizon, count(*) AS n FROM eval_horizons GROUP BY 1 ORDER BY CAST(regexp_extract(horizon, '([0-9]+)', 1) AS INTEGER), horizon"))(
    lambda spark, sf: boards.order_horizons(roles.eval_horizons(spark, sf).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"))))
RUNS = "SELECT o_orderkey AS eval_id, o_orderdate AS created_at, CASE o_custkey % 3 WHEN 0 THEN 'naive_mc' WHEN 1 THEN 'smc' END AS estimator, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 200 END AS n_per_inning FROM orders"


def _runs(spark, sf):
    return roles.load(spark, sf, "orders").selectExpr("o_orderkey AS eval_id", "o_orderdate AS created_at", "CASE o_custkey % 3 WHEN 0 THEN 'naive_mc' WHEN 1 THEN 'smc' END AS estimator",
                                                      "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 200 END AS n_per_inning")


query("f8_production_runs", f"SELECT * FROM ({RUNS}) WHERE NOT ((estimator = 'naive_mc' OR estimator IS NULL) AND (n_per_inning >= 100 OR n_per_inning IS NULL)) ORDER BY created_at DESC, eval_id")(
    lambda spark, sf: feeds.production_runs(_runs(spark, sf)))
query("f8_calibration_runs", f"SELECT * FROM ({RUNS}) WHERE (estimator = 'naive_mc' OR estimator IS NULL) AND n_per_inning >= 100 ORDER BY created_at DESC, eval_id")(
    lambda spark, sf: feeds.calibration_runs(_runs(spark, sf)))
