"""Scoring of probabilistic predictions and model-selection summaries.

Multiclass input has one row per prediction with ``proba`` (array of class probabilities) and
``label`` (0-based class index). Everything is an aggregate whose groups are classes and bins,
combined on the map side: shuffles carry (classes x bins) rows per partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook import constants as K


def _sq(c: Column) -> Column:
    return c * c


def row_brier(proba="proba", label="label") -> Column:
    terms = F.transform(F.col(proba), lambda p, i: _sq(F.when(i == F.col(label), 1.0).otherwise(0.0) - p))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def brier(df: DataFrame, proba="proba", label="label") -> DataFrame:
    return df.agg(F.avg(row_brier(proba, label)).alias("brier"))


def _by_class(df: DataFrame, proba: str, label: str, keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, F.col(label).alias("__y"), F.posexplode(proba).alias("class", "p")) \
        .withColumn("o", F.when(F.col("class") == F.col("__y"), 1.0).otherwise(0.0))


def brier_per_class(df: DataFrame, proba="proba", label="label") -> DataFrame:
    return _by_class(df, proba, label).groupBy("class").agg(F.avg(_sq(F.col("o") - F.col("p"))).alias("brier"))


def bin_of(p: Column, bins: int) -> Column:
    """Equal-width bin of a probability; 1.0 belongs to the last bin."""
    return F.greatest(F.lit(0), F.least(F.floor(p * bins), F.lit(bins - 1))).cast("int")


def calibration_curve(df: DataFrame, bins: int = 10, proba="proba", label="label") -> DataFrame:
    rows = _by_class(df, proba, label)
    return rows.groupBy("class", bin_of(F.col("p"), bins).alias("bin")).agg(
        F.avg("p").alias("predicted"), F.avg("o").alias("actual"), F.count(F.lit(1)).alias("n"))


def _murphy(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Components per ``keys`` from rows of (keys, bin, n, sp, so)."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n, total = F.col("n"), F.sum("n").over(whole)
    base = F.sum("so").over(whole) / total
    gap = F.col("sp") / n - F.col("so") / n
    rows = binned.select(*keys, "n", base.alias("__base"), total.alias("__n"),
                         (n * _sq(gap)).alias("__rel"), (n * _sq(F.col("so") / n - base)).alias("__res"))
    base = F.max("__base")
    return rows.groupBy(*keys).agg(
        F.max("__n").alias("n"),
        (F.sum("__rel") / F.max("__n")).alias("reliability"),
        (F.sum("__res") / F.max("__n")).alias("resolution"),
        (base * (1 - base)).alias("uncertainty"))


def brier_decomposition(df: DataFrame, bins: int = 20, by: list[str] = (), proba="proba", label="label") -> DataFrame:
    """Reliability, resolution and uncertainty, computed per class and summed over the classes."""
    by = list(by)
    binned = _by_class(df, proba, label, by).groupBy(*by, "class", bin_of(F.col("p"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("o").alias("so"))
    out = _murphy(binned, [*by, "class"]).groupBy(*by).agg(
        F.max("n").alias("n"), F.sum("reliability").alias("reliability"),
        F.sum("resolution").alias("resolution"), F.sum("uncertainty").alias("uncertainty"))
    return out.withColumn("brier_score", F.col("reliability") - F.col("resolution") + F.col("uncertainty"))


def _binary_bins(df: DataFrame, p: str, y: str, bins: int, by: list[str]) -> DataFrame:
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(p).cast("double").alias("p"), F.col(y).cast("int").cast("double").alias("o"))
    return rows.groupBy(*by, bin_of(F.col("p"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("o").alias("so"),
        F.sum(_sq(F.col("p") - F.col("o"))).alias("sb"))


def brier_binary(df: DataFrame, p: str, y: str, bins: int = 20, by: list[str] = (),
                 min_n: int = K.MIN_SAMPLE) -> DataFrame:
    """Exact Brier score, its components and skill; NULL below ``min_n`` predictions."""
    by = list(by)
    binned = _binary_bins(df, p, y, bins, by)
    score = binned.groupBy(*by).agg((F.sum("sb") / F.sum("n")).alias("brier"), F.sum("n").alias("__n"))
    parts = _murphy(binned, by)
    if by:
        out = parts.join(score.drop("__n"), by)
    else:
        out = parts.withColumn("brier", score.select("brier").scalar())
    skill = F.when(F.col("uncertainty") > 0, 1 - F.col("brier") / F.nullif(F.col("uncertainty"), F.lit(0.0))) \
        .otherwise(F.lit(0.0))
    out = out.withColumn("brier_skill", skill)
    values = ["brier", "reliability", "resolution", "uncertainty", "brier_skill"]
    return out.select(*by, "n", *[F.when(F.col("n") >= min_n, F.col(c)).alias(c) for c in values])


def brier_binary_bins(df: DataFrame, p: str, y: str, bins: int = 20, by: list[str] = ()) -> DataFrame:
    """Per-bin details of the binary decomposition."""
    by = list(by)
    binned = _binary_bins(df, p, y, bins, by)
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    mean_p, rate = F.col("sp") / F.col("n"), F.col("so") / F.col("n")
    return binned.select(*by, "bin", (F.col("bin") / bins).alias("bin_lo"), ((F.col("bin") + 1) / bins).alias("bin_hi"),
                         "n", mean_p.alias("mean_pred"), rate.alias("actual_rate"), (mean_p - rate).alias("gap"),
                         (F.col("n") * _sq(mean_p - rate) / total).alias("reliability_contrib"))


def game_strata() -> dict[str, Column]:
    """Named, overlapping predicates on the game situation (fixed limits)."""
    inning, diff, tto = F.col("inning"), F.col("run_diff"), F.col("times_through_order")
    return {
        "early_inning": inning <= 3, "mid_inning": (inning >= 4) & (inning <= 6), "late_inning": inning >= 7,
        "ahead": diff > 0, "tied": diff == 0, "behind": diff < 0,
        "close_game": F.abs(diff) <= 2, "blowout": F.abs(diff) > 4,
        "tto_1": tto == 1, "tto_2": tto == 2, "tto_3_plus": tto >= 3,
    }


def brier_by_stratum(df: DataFrame, strata: dict[str, Column], bins: int = 20,
                     proba="proba", label="label") -> DataFrame:
    """Decomposition per stratum; a row counts in every stratum it satisfies."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in strata.items()]))
    rows = df.select(proba, label, F.explode(names).alias("stratum"))
    return brier_decomposition(rows, bins, ["stratum"], proba, label)


def class_counts(df: DataFrame, label="label") -> DataFrame:
    return df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def brier_skill(df: DataFrame, proba="proba", label="label") -> DataFrame:
    """Brier score against always predicting the class shares."""
    per = df.groupBy(F.col(label)).agg(F.count(F.lit(1)).alias("n"), F.sum(row_brier(proba, label)).alias("s"))
    sums = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(_sq(F.col("n").cast("double"))).alias("n2"))
    sums = sums.select("n", (F.col("s") / F.col("n")).alias("brier"),
                       (1 - F.col("n2") / _sq(F.col("n").cast("double"))).alias("naive_brier"))
    skill = F.when(F.col("naive_brier") > 0, 1 - F.col("brier") / F.nullif(F.col("naive_brier"), F.lit(0.0)))
    return sums.withColumn("brier_skill", F.coalesce(skill, F.lit(0.0)))


# --- bootstrap ---------------------------------------------------------------

PRIME = 2147483647


def poisson_weight(row: Column, replicate: Column, seed: int) -> Column:
    """Poisson(1) draw as a pure function of row and replicate (inverse of the distribution).

    The uniform number is plain 64-bit arithmetic modulo 2^31 - 1, which any engine can repeat.
    """
    x = (F.pmod(row, F.lit(PRIME)) * 48271 + replicate * 69621 + seed) % PRIME
    for add in (12345, 54321):
        x = (x * x + F.pmod(row, F.lit(PRIME)) + add * (replicate + 1)) % PRIME
    u = x.cast("double") / float(PRIME)
    cdf, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        cdf.append(total)
    out = F.lit(0)
    for c in cdf:
        out = out + F.when(u >= c, 1).otherwise(0)
    return out


def mean_brier(weight: Column) -> Column:
    """Default metric: weighted mean of the row scores."""
    return F.sum(weight * F.col("__score")) / F.sum(weight)


def bootstrap_ci(df: DataFrame, row_id: str, metric: Callable[[Column], Column] = mean_brier, n: int = 1000,
                 seed: int = 42, proba="proba", label="label", uses: list[str] = ()) -> DataFrame:
    """Mean, 2.5/97.5 percentiles and sd of a metric over resampled data.

    Drawing n of n rows is replaced by independent Poisson(1) weights per row and replicate, so
    replicates are weighted aggregates combined on the map side and no row is moved. ``metric``
    maps the weight column to an aggregate; ``__score`` holds the row's Brier score. Only the row's whole
    number ``row_id``, that score and the columns the metric ``uses`` are repeated per replicate.
    """
    rows = df.select(F.col(row_id).cast("long").alias("__id"), row_brier(proba, label).alias("__score"), *uses)
    draws = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate")).withColumn("replicate", F.col("replicate").cast("long"))
    draws = draws.withColumn("__w", poisson_weight(F.col("__id"), F.col("replicate"), seed))
    per = draws.groupBy("replicate").agg(metric(F.col("__w")).alias("value"))
    return per.agg(F.avg("value").alias("mean"), F.expr("percentile(value, 0.025)").alias("ci_lower"),
                   F.expr("percentile(value, 0.975)").alias("ci_upper"), F.stddev_pop("value").alias("std"))


def summarise_runs(df: DataFrame, metric="metric", value="value") -> DataFrame:
    """Mean and population sd of each metric over repeated splits."""
    return df.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


# --- evaluation tables -------------------------------------------------------

def horizon_diagnostics(horizons: DataFrame, games: DataFrame, inning: int | None = None) -> DataFrame:
    """Errors of predicted against realised win expectancy per half-inning horizon."""
    if inning is not None:
        games = games.where(F.col("entry_inning") == inning)
    joined = horizons.where(F.col("horizon").like("+%hi") & F.col("pred_we").isNotNull()).join(
        games.select("eval_id", "game_pk", "entry_we_baseline", "actual_home_win"), ["eval_id", "game_pk"])
    full = joined.where(F.col("actual_we").isNotNull() & F.col("entry_we_baseline").isNotNull())
    pred, real, entry = F.col("pred_we"), F.col("actual_we"), F.col("entry_we_baseline")
    move, real_move = pred - entry, real - entry
    agg = full.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(pred - real)).alias("pred_mae"),
        F.avg(F.abs(entry - real)).alias("entry_mae"), F.avg(move).alias("mean_predicted_move"),
        F.avg(real_move).alias("mean_actual_move"), F.avg(F.abs(move - real_move)).alias("move_mae"),
        F.avg(move - real_move).alias("move_bias"))
    score = brier_binary(joined, "pred_we", "actual_home_win", by=["horizon"]).select(
        "horizon", F.col("brier_skill").alias("bss"), "reliability")
    better = (F.col("entry_mae") - F.col("pred_mae")) / F.nullif(F.col("entry_mae"), F.lit(0.0))
    return agg.join(score, "horizon", "left").withColumn("improvement", F.coalesce(better, F.lit(0.0)))


def accuracy_by(games: DataFrame, col: str) -> DataFrame:
    return games.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("correct", F.lit(False))).alias("correct"),
    ).withColumn("accuracy", F.col("correct").cast("double") / F.nullif(F.col("n"), F.lit(0)))


# --- feature and model selection ---------------------------------------------

def drop_rare(df: DataFrame, label: str, cv: int = 5, test: float = 0.2, calib: float = 0.25) -> DataFrame:
    """Rows of classes large enough to leave ``cv`` examples in the calibration part."""
    need = max(20, math.ceil(cv / ((1 - test) * calib)))
    kept = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= need).select(label)
    return df.join(kept, label, "left_semi")


def correlation_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """Correlation of every feature pair i < j over the rows where both are known; constant features give 0.

    A task adds up its rows' products as small matrices (features are fixed by the schema), around the
    features' means, so that large means do not cancel; Spark adds the tasks' sums per pair.
    """
    k = len(features)
    upper = np.triu_indices(k, 1)
    mean = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    shift = np.array([m or 0.0 for m in mean])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k, k))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(float) - shift
            known = ~np.isnan(x)
            x, w = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([w.T @ w, x.T @ w, w.T @ x, (x * x).T @ w, w.T @ (x * x), x.T @ x])
        if total[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), *[pa.array(t[upper]) for t in total]], ["i", "j", *SUMS])

    doubles = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    per = doubles.mapInArrow(products, "i long, j long, " + ", ".join(f"{s} double" for s in SUMS)).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    var = (F.col("n") * F.col("xx") - F.col("x") ** 2) * (F.col("n") * F.col("yy") - F.col("y") ** 2)
    r = F.when(var > 1e-18 * F.col("n") ** 2 * F.col("xx") * F.col("yy"), (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(var)).otherwise(0.0)
    name = F.array(*[F.lit(f) for f in features])
    pairs = df.sparkSession.createDataFrame([(int(i), int(j)) for i, j in zip(*upper)], "i long, j long")
    return pairs.join(per, ["i", "j"], "left").select(
        F.element_at(name, (F.col("i") + 1).cast("int")).alias("feature_a"), F.element_at(name, (F.col("j") + 1).cast("int")).alias("feature_b"),
        F.coalesce(r, F.lit(0.0)).alias("r"))


SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def correlation_report(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mean absolute correlation within and between feature blocks."""
    a = blocks.select(F.col("feature").alias("feature_a"), F.col("block").alias("__a"))
    b = blocks.select(F.col("feature").alias("feature_b"), F.col("block").alias("__b"))
    named = pairs.join(a, "feature_a").join(b, "feature_b")
    return named.groupBy(F.least("__a", "__b").alias("block_a"), F.greatest("__a", "__b").alias("block_b")).agg(
        F.avg(F.abs("r")).alias("mean_abs_r"))


def high_pairs(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    return pairs.where(F.abs("r") >= threshold)


def top_pairs(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` pairs with the largest absolute correlation."""
    return pairs.orderBy(F.abs("r").desc(), "feature_a", "feature_b").limit(k)


def importance_by_block(importance: DataFrame, blocks: DataFrame) -> DataFrame:
    """Importances normalised to one and summed by block; features without one count 0."""
    full = blocks.join(importance, "feature", "left").withColumn("__v", F.coalesce("value", F.lit(0.0)))
    per = full.groupBy("block").agg(F.sum("__v").alias("__v"))
    total = per.agg(F.sum("__v")).scalar()
    return per.select("block", F.when(total > 0, F.col("__v") / total).otherwise(F.col("__v")).alias("share"))


def pareto(df: DataFrame, x: str, y: str, by: list[str] = (),
           bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows no other row of the group beats on two costs.

    Only the smallest ``y`` per ``x`` can survive, so rows shrink to one per (group, x) first;
    a row then survives if its ``y`` is below the running minimum over smaller ``x``. With
    ``bucket`` (x -> coarser x) the running minimum splits inside a group.
    """
    by = list(by)
    best = df.groupBy(*by, F.col(x)).agg(F.min(y).alias("__y"))
    best = best.withColumn("__b", bucket(F.col(x)) if bucket else F.lit(0))
    part = [*by, "__b"]
    inside = Window.partitionBy(*part).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = best.groupBy(*part).agg(F.min("__y").alias("__top"))
    tops = tops.select(*part, F.min("__top").over(across).alias("__carry"))
    best = best.withColumn("__in", F.min("__y").over(inside)).join(tops, part)
    floor = F.least("__in", "__carry")
    front = best.where(floor.isNull() | (F.col("__y") < floor)).select(*by, x, F.col("__y").alias(y))
    return df.join(front, [*by, x, y], "left_semi")


def select_knee(df: DataFrame, cost: str, quality: str, by: list[str] = (), within: float = 1.5) -> DataFrame:
    """Best quality (lowest) among rows within ``within`` times the smallest cost."""
    by = list(by)
    fastest = df.groupBy(*by).agg(F.min(cost).alias("__min"))
    rows = df.join(fastest, by) if by else df.withColumn("__min", fastest.scalar())
    rest = [c for c in df.columns if c not in by]
    pick = F.min_by(F.struct(*rest), F.struct(quality, cost, *[c for c in rest if c not in (quality, cost)]))
    return rows.where(F.col(cost) <= within * F.col("__min")).groupBy(*by).agg(pick.alias("__r")).select(*by, "__r.*")


def select_weighted(df: DataFrame, cost: str, quality: str, weight: float = 0.003, by: list[str] = (),
                    max_cost: float | None = None) -> DataFrame:
    """Row with the smallest quality + weight * ln(cost)."""
    by = list(by)
    if max_cost is not None:
        df = df.where(F.col(cost) <= max_cost)
    score = F.col(quality) + weight * F.log(F.greatest(F.col(cost), F.lit(0.1)))
    rest = [c for c in df.columns if c not in by]
    pick = F.min_by(F.struct(*rest), F.struct(score, *rest))
    return df.groupBy(*by).agg(pick.alias("__r")).select(*by, "__r.*")


def one_se(df: DataFrame, size: str, mean: str, sd: str) -> DataFrame:
    """Smallest size whose mean is within one sd of the best mean."""
    best = df.agg(F.min_by(F.struct(mean, sd), F.struct(mean, size)).alias("b"))
    limit = best.select(F.col(f"b.{mean}") + F.col(f"b.{sd}")).scalar()
    return df.where(F.col(mean) <= limit).agg(F.min(size).alias(size))


def describe_split(df: DataFrame, by: str | None = None, game="game_pk", day="game_date") -> DataFrame:
    groups = [by] if by else []
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(game).alias("n_games"),
        F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        F.array_sort(F.collect_set(F.year(day))).alias("seasons"))


def seasons(df: DataFrame, col="season") -> DataFrame:
    return df.select(col).distinct().orderBy(F.col(col).desc())
