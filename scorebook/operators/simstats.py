"""Statistics of simulated games and the tables calibrated from them.

``results`` has one row per (game_pk, sim_id): ``home_score, away_score, innings, total_pas,
home_pitcher_changes, away_pitcher_changes, pruned, pruned_at_pa, outcome_counts``.
``paths`` has one row per (game_pk, sim_id, horizon) that was reached; horizon 0 is the next
plate appearance, 1.. the half-inning boundaries: ``inning, half, outs, bases, home_score,
away_score, we``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook import constants as K
from scorebook.functions.predicates import bucket_rd
from scorebook.operators.lookups import we_lookup
from scorebook.plans.ordered import scan

CHECKS = [25, 50, 100, 200, 500]


def _home_won() -> Column:
    return F.col("home_score") > F.col("away_score")


def aggregate_sims(results: DataFrame) -> DataFrame:
    """Win share with its binomial error, mean scores, runs per half-inning played."""
    won = F.when(_home_won(), 1.0).otherwise(0.0)
    halves = F.col("innings") * 2 - F.when(_home_won() & (F.col("innings") >= K.LAST_INNING), 1).otherwise(0)
    out = results.groupBy("game_pk").agg(
        F.count(F.lit(1)).alias("n_sims"), F.avg(won).alias("p_home_win"),
        F.avg("home_score").alias("mean_home_score"), F.avg("away_score").alias("mean_away_score"),
        F.avg(F.col("home_score") + F.col("away_score")).alias("mean_total_runs"),
        F.avg("innings").alias("mean_innings"),
        F.sum(F.col("home_score") + F.col("away_score")).alias("__runs"), F.sum(halves).alias("__halves"))
    p = F.col("p_home_win")
    per = F.col("__runs").cast("double") / F.nullif(F.col("__halves"), F.lit(0))
    return out.withColumns({
        "p_home_win_se": F.sqrt(p * (1 - p) / F.col("n_sims")),
        "runs_per_inning": F.coalesce(per, F.lit(0.0)),
    }).drop("__runs", "__halves")


def sim_distribution(results: DataFrame) -> DataFrame:
    """Score percentiles, spread, extra innings, pitcher changes and pruning per game.

    ``percentile`` keeps one counter per distinct score, not the scores themselves.
    """
    total = F.col("home_score") + F.col("away_score")
    pcts = F.array(*[F.lit(p) for p in (0.10, 0.25, 0.50, 0.75, 0.90)])
    aggs = [F.count(F.lit(1)).alias("n_sims")]
    for name, col in (("home", F.col("home_score")), ("away", F.col("away_score")), ("total", total)):
        aggs += [F.percentile(col, pcts).alias(f"__{name}"), F.avg(col).alias(f"{name}_mean"),
                 F.stddev_pop(col).alias(f"{name}_std")]
    pruned = F.coalesce(F.col("pruned"), F.lit(False))
    aggs += [
        F.avg(F.when(F.col("innings") > K.LAST_INNING, 1.0).otherwise(0.0)).alias("extras_frac"),
        F.avg("home_pitcher_changes").alias("mean_pitcher_changes_home"),
        F.avg("away_pitcher_changes").alias("mean_pitcher_changes_away"),
        F.count_if(pruned).alias("n_pruned"),
        F.avg(F.when(pruned, 1.0).otherwise(0.0)).alias("prune_rate"),
        F.avg(F.when(pruned, F.col("pruned_at_pa"))).alias("mean_pa_at_prune"),
    ]
    out = results.groupBy("game_pk").agg(*aggs)
    cols = {f"{n}_p{p}": F.col(f"__{n}")[i].cast("int")
            for n in ("home", "away", "total") for i, p in enumerate((10, 25, 50, 75, 90))}
    return out.withColumns(cols).drop("__home", "__away", "__total")


def outcome_counts(results: DataFrame, by: list[str] = ("game_pk",)) -> DataFrame:
    """Outcome counters of all simulations added up."""
    return results.select(*by, F.explode("outcome_counts").alias("outcome", "__n")).groupBy(*by, "outcome").agg(
        F.sum("__n").alias("n"))


def horizon_checkpoints(paths: DataFrame, actual: DataFrame, levels: DataFrame, sims: DataFrame,
                        entry_we: DataFrame | None = None) -> DataFrame:
    """Simulated against realised state at every horizon the real game reached.

    ``actual`` has ``game_pk, horizon, inning, half ('Top'/'Bot'), outs, bases, home_score,
    away_score``; ``sims`` has ``game_pk, sim_id, home_won``; ``entry_we`` has ``game_pk,
    entry_we``. The expectancy of a checkpoint is taken at the median inning and half of the
    simulations that reached it, with each one's own run difference; boundaries have empty bases
    and no outs.
    """
    keys = ["game_pk", "horizon"]
    reached = paths.join(actual.select(*keys), keys, "left_semi").join(sims, ["game_pk", "sim_id"])
    reached = reached.withColumn("__rd", (F.col("home_score") - F.col("away_score")).cast("int"))

    # Correction against the previous boundary of the same simulation (a few rows per sim).
    lag = Window.partitionBy("game_pk", "sim_id").orderBy("horizon")
    before = F.lag(F.struct("horizon", "we")).over(lag)
    entry = entry_we if entry_we is not None else None
    steps = paths.select("game_pk", "sim_id", "horizon", "we", before.alias("__b")).where("horizon >= 1 AND we >= 0")
    steps = steps.join(entry, "game_pk", "left") if entry is not None else steps.withColumn("entry_we", F.lit(0.5))
    base = F.when(F.col("horizon") == 1, F.coalesce("entry_we", F.lit(0.5))).when(
        (F.col("__b.horizon") == F.col("horizon") - 1) & (F.col("__b.we") >= 0), F.col("__b.we"))
    corr = steps.groupBy(*keys).agg(F.var_samp(F.col("we") - base).alias("correction_var"))

    half = F.when(F.col("half") == "Bot", 1).otherwise(0)
    center = reached.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reached"), F.avg(F.col("home_won").cast("double")).alias("sim_p_home"),
        F.percentile("inning", F.lit(0.5)).cast("int").alias("inning"),
        F.percentile(half, F.lit(0.5)).cast("int").alias("__half"),
        F.percentile("outs", F.lit(0.5)).cast("int").alias("outs"),
        F.percentile("bases", F.lit(0.5)).cast("int").alias("bases"))
    pa = F.col("horizon") == 0
    center = center.withColumns({
        "half": F.when(F.col("__half") == 1, "Bot").otherwise("Top"),
        "outs": F.when(pa, F.col("outs")).otherwise(0), "bases": F.when(pa, F.col("bases")).otherwise(0),
    }).drop("__half")

    # Within a (game, horizon) the expectancy depends on the run difference alone: simulations are counted per
    # difference, in all and among the first k, before anything is looked up.
    order = Window.partitionBy(*keys).orderBy("sim_id")
    first = reached.select(*keys, "__rd", F.row_number().over(order).alias("__n"))
    rows = first.groupBy(*keys, "__rd").agg(F.count(F.lit(1)).alias("__all"), *[F.count_if(F.col("__n") <= k).alias(f"__at_{k}") for k in CHECKS])
    rows = we_lookup(rows.join(center, keys).withColumn("run_diff", F.col("__rd")), levels)
    group = Window.partitionBy(*keys)

    def mean(x: str, n: str) -> Column:
        return F.sum(F.col(n) * F.col(x)).over(group) / F.nullif(F.sum(n).over(group), F.lit(0))

    sizes = ["__all", *[f"__at_{k}" for k in CHECKS]]
    rows = rows.withColumns({f"__m{n}": mean("we", n) for n in sizes} | {"__m_rd": mean("__rd", "__all")})

    def spread_of(x: str, m: str, n: str) -> Column:
        return F.sqrt(F.sum(F.col(n) * (F.col(x) - F.col(m)) ** 2) / F.nullif(F.sum(n), F.lit(0)))

    spread = rows.groupBy(*keys).agg(
        F.max("n_reached").alias("n_reached"), F.max("sim_p_home").alias("sim_p_home"),
        F.max("__m__all").alias("pred_we"), spread_of("we", "__m__all", "__all").alias("pred_we_std"),
        F.max("__m_rd").alias("pred_run_diff_mean"), spread_of("__rd", "__m_rd", "__all").alias("pred_run_diff_std"),
        *[F.when(F.max("n_reached") >= k, spread_of("we", f"__m__at_{k}", f"__at_{k}")).alias(f"std_at_{k}") for k in CHECKS])
    truth = we_lookup(actual.withColumn("run_diff", (F.col("home_score") - F.col("away_score")).cast("int")),
                      levels, out="actual_we")
    return spread.join(truth.select(*keys, "actual_we", F.col("home_score").alias("actual_home_score"),
                                    F.col("away_score").alias("actual_away_score")), keys) \
        .join(corr, keys, "left")


# --- tables calibrated from evaluation runs ----------------------------------

def _state_key() -> Column:
    return F.concat_ws("|", F.col("inning").cast("string"), F.col("rd_bucket"))


def best_levels(conv: DataFrame) -> DataFrame:
    """Per (inning, rd_bucket), the level that settles with the fewest simulations.

    Ties go to the alphabetically first level. ``std`` is the spread at that number, or at 500
    where it was not measured (a spread of 0 counts as not measured).
    """
    spreads = F.create_map(*[v for n in CHECKS for v in (F.lit(n), F.nullif(F.col(f"std_at_{n}"), F.lit(0.0)))])
    std = F.coalesce(F.try_element_at(spreads, F.col("stabilization_n").cast("int")), F.col("std_at_500"))
    rows = conv.where(F.col("stabilization_n").isNotNull())
    pick = F.min_by(F.struct("level", "stabilization_n", std.alias("std")), F.struct("stabilization_n", "level"))
    return rows.groupBy("inning", "rd_bucket").agg(pick.alias("b")).select(
        "inning", "rd_bucket", _state_key().alias("state_key"), "b.level", "b.stabilization_n", "b.std")


def n_lookup(conv: DataFrame, grid: DataFrame, se: float = 0.02) -> DataFrame:
    """Simulations to run per state, never fewer than the target standard error needs."""
    best = best_levels(conv).withColumns({"__rd": bucket_rd("rd_bucket"),
                                          "__inn": F.least(F.col("inning"), F.lit(K.LAST_INNING))})
    start = grid.where("half = 'Top' AND outs = 0 AND bases = 0").select(
        F.col("inning").alias("__inn"), F.col("run_diff").alias("__rd"), F.col("we").alias("__p"))
    joined = best.join(start, ["__inn", "__rd"], "left")
    floor = F.ceil(F.col("__p") * (1 - F.col("__p")) / (se * se))
    return joined.select("inning", "rd_bucket", "state_key", "level",
                         F.greatest(F.col("stabilization_n").cast("long"), floor).alias("n"))


def stopping_thresholds(conv: DataFrame) -> DataFrame:
    return best_levels(conv).where(F.col("std").isNotNull()).select("state_key", F.round("std", 6).alias("threshold"))


def gamma_schedule(conv: DataFrame, sens: DataFrame | None = None) -> DataFrame:
    """Tempering per state: simulated spread over table sensitivity, kept within [0.1, 0.5]."""
    best = best_levels(conv).where(F.col("std").isNotNull())
    if sens is None:
        return best.select("state_key", F.lit(1.0).alias("gamma"))
    mean = sens.groupBy(F.col("inning").alias("__inn"), F.col("run_diff").alias("__rd")).agg(
        F.avg(F.abs("dwe_drd")).alias("__s"))
    joined = best.withColumns({"__rd": bucket_rd("rd_bucket"),
                               "__inn": F.least(F.col("inning"), F.lit(K.LAST_INNING))}).join(
        mean, ["__inn", "__rd"], "left")
    raw = F.greatest(F.lit(0.1), F.least(F.lit(0.5), F.col("std") / F.col("__s")))
    return joined.select("state_key", F.when(F.col("__s") > 1e-6, F.round(raw, 4)).otherwise(1.0).alias("gamma"))


# --- horizon weights ---------------------------------------------------------

def horizon_errors(horizons: DataFrame, games: DataFrame) -> DataFrame:
    """Rows (state_key, game_pk, hz, pred, outcome, entry) usable for the weights.

    Expects the rows of one run.
    """
    h = horizons.where(F.col("horizon").like("+%hi") & F.col("pred_we").isNotNull()).select(
        "eval_id", "game_pk", F.regexp_extract("horizon", r"^\+(\d+)hi$", 1).cast("int").alias("hz"), "pred_we")
    g = games.where(F.col("actual_home_win").isNotNull() & F.col("entry_we_baseline").isNotNull()
                    & F.col("entry_inning").isNotNull() & F.col("entry_rd_bucket").isNotNull()).select(
        "eval_id", "game_pk", F.concat_ws("|", F.col("entry_inning").cast("string"), "entry_rd_bucket").alias("state_key"),
        F.col("actual_home_win").cast("double").alias("outcome"), F.col("entry_we_baseline").alias("entry"))
    return h.join(g, ["eval_id", "game_pk"])


def eligible_horizons(errors: DataFrame, min_games: int = 30, max_horizons: int | None = None) -> DataFrame:
    """Horizons per state that enough games reached and whose Brier score beats the entry's.

    The entry score is taken once, on the first horizon with enough games. ``max_horizons`` keeps only the
    first horizons of a state; by default all count.
    """
    per = errors.groupBy("state_key", "hz").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("pred_we") - F.col("outcome")) ** 2).alias("brier"),
        F.avg((F.col("entry") - F.col("outcome")) ** 2).alias("entry_brier"))
    size = errors.groupBy("state_key").agg(F.count_distinct("game_pk").alias("n_games")).where(
        F.col("n_games") >= min_games)
    if max_horizons is not None:
        rank = F.row_number().over(Window.partitionBy("state_key").orderBy("hz"))
        per = per.withColumn("__r", rank).where(F.col("__r") <= max_horizons)
    per = per.join(size, "state_key")
    per = per.where(F.col("n") >= min_games)
    first = F.first("entry_brier").over(Window.partitionBy("state_key").orderBy("hz").rowsBetween(
        Window.unboundedPreceding, 0))
    return per.withColumn("__entry", first).where(F.col("brier") < F.col("__entry")).select("state_key", "hz")


def _min_variance(m: int, n: int, cross: np.ndarray, fourth: float) -> np.ndarray | None:
    """Minimum-variance weights from a shrunk covariance (Ledoit and Wolf, 2004)."""
    cov = cross / n
    mu = np.trace(cov) / m
    spread = float((cov ** 2).sum())
    beta = (fourth / n - spread) / (m * n)
    delta = (spread - 2.0 * mu * np.trace(cov) + m * mu * mu) / m
    beta = min(beta, delta)
    shrink = 0.0 if beta == 0 else beta / delta
    cov = (1 - shrink) * cov + shrink * mu * np.eye(m)
    w = np.linalg.pinv(cov) @ np.ones(m)
    if abs(w.sum()) < 1e-12:
        return None
    w = np.maximum(w / w.sum(), 0.0)
    return None if w.sum() < 1e-12 else w / w.sum()


def horizon_weights(horizons: DataFrame, games: DataFrame, min_games: int = 30,
                    max_horizons: int | None = None) -> DataFrame:
    """Weight of each horizon per state, from the covariance of the prediction errors.

    All passes over the games are Spark aggregates: means, then the second moments of the
    centred errors and the fourth moment the shrinkage needs. Python sees one row of horizons
    squared sums per state and inverts that matrix.
    """
    errors = horizon_errors(horizons, games)
    valid = eligible_horizons(errors, min_games, max_horizons)
    rows = errors.join(valid, ["state_key", "hz"]).withColumn("err", F.col("pred_we") - F.col("outcome"))
    need = valid.groupBy("state_key").agg(F.count(F.lit(1)).alias("__need"))
    # One value per horizon of a game.
    per_game = rows.groupBy("state_key", "eval_id", "game_pk").agg(
        F.array_sort(F.collect_list(F.struct("hz", "err"))).alias("__e"), F.count(F.lit(1)).alias("__have"))
    complete = per_game.join(need, "state_key").where("__have = __need").select(
        "state_key", "eval_id", "game_pk", F.col("__e.hz").alias("hz"), F.col("__e.err").alias("e"))

    each = complete.select("state_key", "hz", "e", F.posexplode("e").alias("i", "x"))
    means = each.groupBy("state_key", "i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m")).where(F.col("n") >= min_games)
    means = means.groupBy("state_key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("mean"))
    centred = complete.join(means, "state_key").select(
        "state_key", "n", "hz", F.zip_with("e", "mean", lambda a, b: a - b).alias("x"))
    square = F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    sums = centred.groupBy("state_key").agg(F.max("n").alias("n"), F.max("hz").alias("hz_all"), F.sum(square * square).alias("fourth"))
    pairs = centred.select("state_key", "x", F.posexplode("x").alias("i", "a")).select("state_key", "i", "a", F.posexplode("x").alias("j", "b"))
    cross = (pairs.groupBy("state_key", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
             .groupBy("state_key").agg(F.array_sort(F.collect_list(F.struct("i", "j", "v")))["v"].alias("cross")))
    moments = sums.join(cross, "state_key")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                m = len(r.hz_all)
                w = _min_variance(m, r.n, np.array(r.cross, dtype=float).reshape(m, m), r.fourth)
                if w is not None:
                    out += [(r.state_key, int(h), round(float(v), 4)) for h, v in zip(r.hz_all, w) if v > 0.001]
            yield pd.DataFrame(out, columns=["state_key", "hz", "weight"])

    solved = moments.mapInPandas(solve, "state_key string, hz int, weight double")
    return solved.select("state_key", F.concat(F.lit("+"), F.col("hz").cast("string"), F.lit("hi")).alias("horizon"),
                         "hz", "weight")


# --- weighted estimates ------------------------------------------------------

def cap_weights(weights: DataFrame, max_horizon: int | None = None) -> DataFrame:
    """Drop horizons beyond the cap and rescale the rest to one."""
    if max_horizon is None:
        return weights
    kept = weights.where(F.col("hz") <= max_horizon)
    total = F.sum("weight").over(Window.partitionBy("state_key"))
    return kept.withColumn("weight", F.col("weight") / F.nullif(total, F.lit(0.0)))


def weighted_estimate(paths: DataFrame, sims: DataFrame, weights: DataFrame,
                      max_horizon: int | None = None) -> DataFrame:
    """Home win estimate as a weighted mean of the expectancies along each simulated path.

    ``sims`` has ``game_pk, sim_id, state_key, home_won``; a horizon the simulation did not
    reach contributes its outcome.
    """
    w = cap_weights(weights, max_horizon).select("state_key", F.col("hz").alias("horizon"), "weight")
    rows = sims.join(w, "state_key").join(paths.select("game_pk", "sim_id", "horizon", "we"),
                                          ["game_pk", "sim_id", "horizon"], "left")
    we = F.when(F.col("we") >= 0, F.col("we")).otherwise(F.col("home_won").cast("double"))
    per_sim = rows.groupBy("game_pk", "sim_id").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("weight") * we))).alias("estimate"))
    return per_sim.groupBy("game_pk").agg(
        F.count(F.lit(1)).alias("n_sims"), F.avg("estimate").alias("p_home_win"),
        (F.stddev_samp("estimate") / F.sqrt(F.count(F.lit(1)))).alias("p_home_win_se"))


def tempered_weight(we: Column, gamma: Column) -> Column:
    """Importance weight before normalisation."""
    return F.pow(F.greatest(F.lit(1e-10), F.least(F.lit(1.0), we)), gamma)


def weighted_mean_ess(df: DataFrame, w: str, x: str, by: list[str]) -> DataFrame:
    """Importance-weighted mean, standard error and effective sample size per group."""
    base = df.groupBy(*by).agg(F.sum(w).alias("__w"), F.sum(F.col(w) * F.col(w)).alias("__w2"),
                               (F.sum(F.col(w) * F.col(x)) / F.nullif(F.sum(w), F.lit(0.0))).alias("__m"),
                               F.avg(x).alias("__plain"))
    dev = df.join(base.select(*by, "__m"), by).groupBy(*by).agg(
        F.sum(F.col(w) * (F.col(x) - F.col("__m")) ** 2).alias("__ss"))
    out = base.join(dev, by)
    tiny = F.col("__w") < 1e-15
    var = F.col("__ss") / F.nullif(F.col("__w"), F.lit(0.0))
    ess = F.col("__w") * F.col("__w") / F.nullif(F.col("__w2"), F.lit(0.0))
    se = F.when(ess > 1, F.sqrt(var / F.nullif(ess, F.lit(0.0)))).otherwise(F.sqrt(var))
    return out.select(*by, F.when(tiny, F.col("__plain")).otherwise(F.col("__m")).alias("mean"),
                      F.when(tiny, F.lit(0.0)).otherwise(se).alias("se"), ess.alias("ess"))
