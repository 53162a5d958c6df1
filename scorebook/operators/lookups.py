"""Empirical lookup tables: state transitions, win and run expectancy, and their use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook import constants as K
from scorebook.functions.predicates import base_mask, clamp
from scorebook.operators.windows import PA, first_pitch

STATE = ["inning", "half", "outs", "bases", "run_diff"]
LEVELS = {"full": STATE, "no_bases": ["inning", "half", "outs", "run_diff"],
          "coarse": ["inning", "half", "run_diff"], "baseline": []}


# --- transitions -------------------------------------------------------------

def next_states(events: DataFrame) -> DataFrame:
    """One row per finished plate appearance with the state it led to.

    The state before is that of its first pitch; the state after is the first pitch of the next
    finished appearance, or empty bases and the outs to three when the half-inning ended. The
    last appearance of a game has no successor and is left out.
    """
    cols = ["inning", "inning_topbot", "outs_when_up", "on_1b", "on_2b", "on_3b"]
    first = first_pitch(events.select(*PA, "pitch_number", *cols, "bat_score")).drop("pitch_number")
    last = events.where(F.col("pa_result").isNotNull() & (F.col("pa_result") != K.TRUNCATED)) \
        .select(*PA, "pa_result", "post_bat_score")
    pas = first.join(last, PA).withColumn("pre_bases", base_mask("on_1b", "on_2b", "on_3b"))
    order = Window.partitionBy("game_pk").orderBy("at_bat_number")
    pas = pas.withColumns({n: F.lead(c).over(order) for n, c in (
        ("__inning", "inning"), ("__half", "inning_topbot"), ("__outs", "outs_when_up"), ("__bases", "pre_bases"))})
    same = (F.col("__inning") == F.col("inning")) & (F.col("__half") == F.col("inning_topbot"))
    return pas.where(F.col("__inning").isNotNull()).select(
        *PA, "pa_result", "pre_bases", F.col("outs_when_up").alias("outs"),
        F.when(same, F.col("__bases")).otherwise(0).alias("post_bases"),
        (F.col("post_bat_score") - F.col("bat_score")).cast("int").alias("runs_scored"),
        F.when(same, F.col("__outs") - F.col("outs_when_up")).otherwise(3 - F.col("outs_when_up")).alias("outs_added"))


TRANSITION_KEY = ["pa_result", "pre_bases", "outs"]


def transitions(events: DataFrame) -> DataFrame:
    """Counts of each transition and its probability given (outcome, bases, outs)."""
    counted = next_states(events).groupBy(*TRANSITION_KEY, "post_bases", "runs_scored", "outs_added").agg(
        F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*TRANSITION_KEY))
    return counted.withColumn("p", F.col("n").cast("double") / total)


def check_transitions(table: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Keys whose probabilities do not sum to one."""
    return table.groupBy(*TRANSITION_KEY).agg(F.sum("p").alias("total_p")).where(
        F.abs(F.col("total_p") - 1) > tolerance)


# --- win expectancy ----------------------------------------------------------

def pa_states(events: DataFrame, games: DataFrame) -> DataFrame:
    """State of each finished appearance of a final game, and whether the home side won."""
    done = games.where((F.col("abstract_game_state") == "Final") & ~F.col("status").isin(K.DEAD_STATUSES)).select(
        "game_pk", F.when(F.col("home_score") > F.col("away_score"), 1.0).otherwise(0.0).alias("home_win"))
    ends = events.where(F.col("pa_result").isNotNull() & (F.col("pa_result") != K.TRUNCATED)
                        & F.col("inning").between(1, K.LAST_INNING))
    return ends.select(
        "game_pk", "inning", F.col("inning_topbot").alias("half"), F.col("outs_when_up").alias("outs"),
        base_mask("on_1b", "on_2b", "on_3b").alias("bases"),
        clamp((F.col("home_score") - F.col("away_score")).cast("int"),
              -K.RUN_DIFF_LIMIT, K.RUN_DIFF_LIMIT).alias("run_diff"),
    ).join(done, "game_pk")


def win_rates(states: DataFrame, digits: int | None = 6) -> DataFrame:
    """Number of appearances and home win rate at the four nested levels, in one shuffle.

    The finest level is aggregated first (a few thousand rows at most, however large the input),
    the coarser ones are sums over it.
    """
    full = states.groupBy(*STATE).agg(F.count(F.lit(1)).alias("n"), F.sum("home_win").alias("wins"))
    out = None
    for level, keys in LEVELS.items():
        part = full if level == "full" else full.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"))
        p = F.col("wins") / F.nullif(F.col("n"), F.lit(0))
        part = part.select(
            F.lit(level).alias("level"),
            *[(F.col(c) if c in keys else F.lit(None).cast("string" if c == "half" else "int")).alias(c) for c in STATE],
            "n", (F.round(p, digits) if digits is not None else p).alias("p_home_win"))
        out = part if out is None else out.unionByName(part)
    return out


def win_expectancy(events: DataFrame, games: DataFrame, digits: int | None = 6) -> DataFrame:
    return win_rates(pa_states(events, games), digits)


def win_expectancy_facts(events: DataFrame, games: DataFrame) -> DataFrame:
    """Appearances and distinct games behind the table."""
    return pa_states(events, games).agg(F.count(F.lit(1)).alias("n_pas"),
                                        F.count_distinct("game_pk").alias("n_games"))


def check_levels(levels: DataFrame, min_baseline: int = 1000) -> DataFrame:
    """Rows with a rate outside [0, 1], no observation, or too small a baseline."""
    bad = F.array_compact(F.array(
        F.when(~F.col("p_home_win").between(0, 1), "rate out of range"),
        F.when(F.col("n") <= 0, "no observations"),
        F.when((F.col("level") == "baseline") & (F.col("n") < min_baseline), "baseline too small")))
    return levels.withColumn("problem", F.explode(bad))


def we_lookup(df: DataFrame, levels: DataFrame, min_n: int = K.MIN_SAMPLE, out: str = "we") -> DataFrame:
    """Win expectancy of a state: the finest level with enough observations.

    Inning and run difference are clamped to the table. The coarse level and the baseline are
    taken whatever their size. The level tables are bounded by the state space (9 innings x 2
    halves x 3 outs x 8 bases x 31 differences = 13,392 rows), hence broadcast.
    """
    keyed = df.withColumns({
        "__inning": F.least(F.col("inning"), F.lit(K.LAST_INNING)),
        "__diff": clamp(F.col("run_diff"), -K.RUN_DIFF_LIMIT, K.RUN_DIFF_LIMIT),
    })
    src = {"inning": "__inning", "run_diff": "__diff"}
    picks: list[Column] = []
    for level, keys in LEVELS.items():
        t = levels.where(F.col("level") == level)
        if level in ("full", "no_bases"):
            t = t.where(F.col("n") >= min_n)
        t = t.select(*[F.col(k).alias(f"__{level}_{k}") for k in keys], F.col("p_home_win").alias(f"__{level}_p"))
        if keys:
            cond = [F.col(src.get(k, k)) == F.col(f"__{level}_{k}") for k in keys]
            keyed = keyed.join(F.broadcast(t), cond, "left")
        else:
            keyed = keyed.withColumn("__baseline_p", t.select("__baseline_p").scalar())
        picks.append(F.col(f"__{level}_p"))
    return keyed.select(*df.columns, F.coalesce(*picks).alias(out))


def state_grid(spark: SparkSession) -> DataFrame:
    """All 9 x 2 x 3 x 8 x 31 states, enumerated from one range."""
    n = 2 * K.RUN_DIFF_LIMIT + 1
    i = F.col("id")
    return spark.range(K.LAST_INNING * 2 * 3 * 8 * n).select(
        (F.floor(i / (2 * 3 * 8 * n)) + 1).cast("int").alias("inning"),
        F.when(F.floor(i / (3 * 8 * n)) % 2 == 0, "Top").otherwise("Bot").alias("half"),
        (F.floor(i / (8 * n)) % 3).cast("int").alias("outs"),
        (F.floor(i / n) % 8).cast("int").alias("bases"),
        (i % n - K.RUN_DIFF_LIMIT).cast("int").alias("run_diff"))


def we_grid(levels: DataFrame) -> DataFrame:
    return we_lookup(state_grid(levels.sparkSession), levels)


def we_sensitivity(grid: DataFrame, digits: int | None = 6) -> DataFrame:
    """Change of win expectancy for one more run, at half-inning boundaries."""
    spec = Window.partitionBy("inning", "half").orderBy("run_diff")
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    up = F.lead("we").over(spec)
    return (grid.where("outs = 0 AND bases = 0")
            .select("inning", "half", "run_diff", r(up - F.col("we")).alias("dwe_drd"),
                    r(F.col("we")).alias("we_at_rd"), r(up).alias("we_at_rd_plus_1"))
            .where(F.col("we_at_rd_plus_1").isNotNull()))


def blowout_thresholds(coarse: DataFrame, p: float = 0.99, margin: int = 1, never: int = 16) -> DataFrame:
    """Per inning and half, the leads beyond which a game counts as decided."""
    d, w = F.col("run_diff"), F.col("p_home_win")
    found = coarse.groupBy("inning", "half").agg(
        F.min(F.when((d > 0) & (w >= p), d)).alias("__win"),
        F.max(F.when((d < 0) & (w <= 1 - p), d)).alias("__loss"))
    grid = coarse.sparkSession.range(2 * K.LAST_INNING).select(
        (F.floor(F.col("id") / 2) + 1).cast("int").alias("inning"),
        F.when(F.col("id") % 2 == 0, "Top").otherwise("Bot").alias("half"))
    return grid.join(found, ["inning", "half"], "left").select(
        "inning", "half",
        F.coalesce(F.col("__win") + margin, F.lit(never)).cast("int").alias("win_threshold"),
        F.coalesce(F.col("__loss") - margin, F.lit(-never)).cast("int").alias("loss_threshold"))


# --- run expectancy ----------------------------------------------------------

def run_expectancy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(b, o, v) for b, row in enumerate(K.RUN_EXPECTANCY) for o, v in enumerate(row)],
        "bases int, outs int, re double")


def run_expectancy(df: DataFrame, out: str = "current_re") -> DataFrame:
    """Expected runs of the rest of the half-inning, from base mask and outs (24 constants)."""
    table = run_expectancy_table(df.sparkSession).select(
        F.col("bases").alias("__b"), F.col("outs").alias("__o"), F.col("re").alias(out))
    cond = [F.col("bases") == F.col("__b"), clamp(F.col("outs"), 0, 2) == F.col("__o")]
    return df.join(F.broadcast(table), cond, "left").drop("__b", "__o")


# --- calibration curves ------------------------------------------------------

def knots_below(value: Column, knots: Column) -> Column:
    """How many knots have x <= value, by binary search over the sorted array."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(knots) + F.lit(1.0))).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), F.size(knots).alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.try_element_at(knots, mid + 1)["x"] <= value
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(steps, start, half, lambda s: s["lo"])


def interpolate(value: Column, knots: Column) -> Column:
    """Piecewise-linear value at ``value``; the ends are extended flat."""
    at = F.when(value.isNotNull(), knots_below(value, knots))
    found = F.struct(F.when(at > 0, F.try_element_at(knots, at)).alias("a"), F.try_element_at(knots, at + 1).alias("b"))

    def line(f: Column) -> Column:
        a, b = f["a"], f["b"]
        inner = a["y"] + (value - a["x"]) * (b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
        return F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(inner)

    return F.transform(F.array(found), line)[0]  # the search once, not once per use


def curve_arrays(knots: DataFrame, cls: str = "class") -> dict:
    """Knots (class, x, y) as two arrays per class, in order of x.

    A curve holds at most as many knots as the fitted isotonic steps; it is data of the model, not of the scored
    rows, so it travels with the function that reads it.
    """
    curves: dict = {}
    for c, x, y in sorted(knots.where(F.col(cls).isNotNull() & F.col("x").isNotNull()).select(cls, F.col("x").cast("double"), F.col("y").cast("double")).collect(),
                          key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0.0)):
        curves.setdefault(c, ([], []))
        curves[c][0].append(x)
        curves[c][1].append(float("nan") if y is None else y)
    return {c: (np.array(x), np.array(y)) for c, (x, y) in curves.items()}


def curve_values(value: np.ndarray, curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Piecewise-linear values; the ends are extended flat."""
    x, y = curve
    at = np.searchsorted(x, value, side="right")
    a, b = np.maximum(at - 1, 0), np.minimum(at, len(x) - 1)
    with np.errstate(all="ignore"):
        inner = y[a] + (value - x[a]) * (y[b] - y[a]) / (x[b] - x[a])
    return np.where(at == 0, y[0], np.where(at == len(x), y[-1], inner))


def calibrate_vector(df: DataFrame, knots: DataFrame, proba: str = "proba", out: str = "calibrated") -> DataFrame:
    """Calibrate an array of class probabilities in place and rescale it to sum one: no explode, no shuffle.

    ``knots`` (class, x, y) are the model's own curves, ``ml.CALIBRATION_CELLS`` knots a class or so at most (16 KB);
    unknown probabilities and classes without a curve give 0.
    """
    curves = {int(c): v for c, v in curve_arrays(knots).items()}

    @F.arrow_udf("array<double>")
    def rescaled(p: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(p), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = p.flatten()
        value, known = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        place = np.arange(len(value)) - np.repeat(ends - size, size)
        raw, total = np.zeros(len(value)), np.zeros(len(size))
        for c in range(int(size.max(initial=0))):
            at = np.flatnonzero(place == c)
            if c in curves:
                raw[at] = np.where(known[at], curve_values(value[at], curves[c]), 0.0)
                raw[at[np.isnan(raw[at])]] = 0.0
            total[size > c] += raw[at]
        raw /= np.repeat(np.where(total > 0, total, 1.0), size)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(raw))
        return pc.if_else(p.is_valid(), lists, pa.scalar(None, lists.type)) if p.null_count else lists

    return df.withColumn(out, rescaled(F.col(proba).cast("array<double>")))


def apply_calibration(df: DataFrame, knots: DataFrame, row_id: str, cls: str = "class",
                      p: str = "p") -> DataFrame:
    """Calibrate one probability per (row, class) and rescale each row to sum one.

    Rows come in long form; classes without a curve are dropped. The curves go out with the function that reads
    them, a batch of rows at a time. The row total is a window over at most one value per class.
    """
    curves = curve_arrays(knots, cls)
    classes = list(curves)

    @F.arrow_udf("double")
    def calibrated(code: pa.Array, p: pa.Array) -> pa.Array:
        which, known = code.to_numpy(zero_copy_only=False), p.is_valid().to_numpy(zero_copy_only=False)
        value, out = pc.fill_null(p, 0.0).to_numpy(zero_copy_only=False), np.zeros(len(p))
        for i, c in enumerate(classes):
            at = which == i
            out[at] = curve_values(value[at], curves[c])
        return pa.array(out, mask=~known | np.isnan(out))

    code = F.coalesce(*[F.when(F.col(cls) == F.lit(c), F.lit(i)) for i, c in enumerate(classes)]) if classes else F.lit(None).cast("int")
    rows = df.withColumn("__c", code).where("__c IS NOT NULL")
    rows = rows.withColumn("__v", calibrated("__c", F.col(p).cast("double"))).drop("__c")
    total = F.sum("__v").over(Window.partitionBy(row_id))
    return rows.withColumn("p_calibrated", F.col("__v") / F.when(total > 0, total).otherwise(F.lit(1.0))).drop("__v")
