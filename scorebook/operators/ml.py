"""Models on the feature table with Spark ML, calibration and reports."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.operators.lookups import calibrate_vector


def check_taxonomy(df: DataFrame, classes: list[str], col: str) -> DataFrame:
    """Values seen but not listed, and listed but not seen."""
    seen = df.select(F.col(col).alias("class")).where(F.col(col).isNotNull()).distinct()
    listed = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    return (seen.join(listed, "class", "left_anti").withColumn("problem", F.lit("not listed"))
            .unionByName(listed.join(seen, "class", "left_anti").withColumn("problem", F.lit("not seen"))))


def assemble(df: DataFrame, features: list[str], fill: float = 0.0) -> DataFrame:
    """Feature vector column; missing values become ``fill``."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fill)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def train_outcome_model(df: DataFrame, features: list[str], label: str = "label_index", trees: int = 50,
                        depth: int = 8, seed: int = 42):
    """Multiclass outcome model (distributed forest)."""
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
                                  seed=seed).fit(assemble(df, features))


def class_weight(df: DataFrame, label: str = "pulled") -> DataFrame:
    """Weight column n0/n1 for the positive class, 1 for the other."""
    counts = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    w = counts.select(F.col("n0") / F.greatest(F.col("n1"), F.lit(1))).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, w).otherwise(F.lit(1.0)))


def train_exit_model(df: DataFrame, features: list[str], label: str = "pulled", rounds: int = 20, depth: int = 4,
                     seed: int = 42):
    """Binary boosted trees with balanced classes."""
    data = assemble(class_weight(df, label), features).withColumn(label, F.col(label).cast("double"))
    return GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth,
                         seed=seed).fit(data)


def exit_model(rows: DataFrame, features: list[str], keep: list[str], label: str = "pulled", split: str = "split") -> DataFrame:
    """``keep``, label, p and p_calibrated of the test part: trees learned on the train part, isotonic curve on the middle one."""
    model = train_exit_model(rows.where(F.col(split) == "train"), features, label)

    def scored(part: str) -> DataFrame:
        return class_probabilities(rows.where(F.col(split) == part), model, features, [*keep, label]).withColumn("p", F.element_at("proba", 2))

    curve = IsotonicRegression(featuresCol="p", labelCol=label).fit(scored("calibrate").withColumn(label, F.col(label).cast("double")))
    return curve.transform(scored("test")).select(*keep, label, "p", F.col("prediction").alias("p_calibrated"))


def class_probabilities(df: DataFrame, model, features: list[str], keep: list[str]) -> DataFrame:
    scored = model.transform(assemble(df, features))
    return scored.select(*keep, vector_to_array("probability").alias("proba"))


#: Cells of equal size that a class's scores are reduced to, and so the most knots of its curve.
CALIBRATION_CELLS = 1000
#: Slices of [0, 1] that are counted first.
CALIBRATION_GRID = 1 << 16


def calibration_cells(scored: DataFrame, n_classes: int, label: str = "label_index", proba: str = "proba", cells: int = CALIBRATION_CELLS,
                      grid: int = CALIBRATION_GRID) -> DataFrame:
    """class, cell, n, x (mean score), y (share of the class): one pass over the scores for all classes.

    Scores are counted in ``grid`` narrow slices, which combine on the map side; slices next to each other are
    then joined to about ``cells`` cells of equal numbers. A slice with more rows than a cell is a cell.
    """
    from pyspark.sql import Window

    long = scored.select(F.col(label).alias("y"), F.posexplode(proba).alias("class", "p")).where((F.col("class") < n_classes) & F.col("p").isNotNull())
    slot = F.least(F.floor(F.col("p") * grid), F.lit(grid - 1))
    fine = long.groupBy("class", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sx"), F.count_if(F.col("y") == F.col("class")).alias("sy"))
    order = Window.partitionBy("class").orderBy("slot")  # ``grid`` rows at most
    below = F.sum("n").over(order) - F.col("n")
    fine = fine.withColumn("cell", F.floor(below * cells / F.sum("n").over(Window.partitionBy("class"))))
    return fine.groupBy("class", "cell").agg(F.sum("n").alias("n"), (F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"))


def pool_adjacent(x: list[float], y: list[float], n: list[int]) -> list[tuple[float, float]]:
    """Knots of the weighted isotonic curve of points in order of x: ends of each level, or its only point."""
    levels: list[list] = []  # mean, weight, first x, last x
    for a, b, w in zip(x, y, n):
        levels.append([b, w, a, a])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            mean, weight, _, last = levels.pop()
            before = levels[-1]
            before[0] = (before[0] * before[1] + mean * weight) / (before[1] + weight)
            before[1] += weight
            before[3] = last
    return [(at, mean) for mean, _, first, last in levels for at in ([first, last] if last > first else [first])]


def fit_calibration(scored: DataFrame, n_classes: int, label: str = "label_index", proba: str = "proba", cells: int = CALIBRATION_CELLS) -> DataFrame:
    """Knots (class, x, y) of one isotonic curve per class, about ``cells`` a class at most, from ``calibration_cells``."""
    def curve(key, rows):
        import pandas as pd

        rows = rows.sort_values("cell")
        knots = pool_adjacent(rows["x"].tolist(), rows["y"].tolist(), rows["n"].tolist())
        return pd.DataFrame({"class": [key[0]] * len(knots), "x": [k[0] for k in knots], "y": [k[1] for k in knots]})

    table = calibration_cells(scored, n_classes, label, proba, cells)
    return table.groupBy("class").applyInPandas(curve, "class int, x double, y double")


def score(df: DataFrame, model, features: list[str], row_id: str, knots: DataFrame | None = None) -> DataFrame:
    """(row, class, p, p_calibrated) of every class; calibrated values sum to one per row.

    Calibration works on the row's array; classes become rows only in the result.
    """
    rows = class_probabilities(df, model, features, [row_id])
    rows = rows.withColumn("calibrated", F.col("proba")) if knots is None else calibrate_vector(rows, knots)
    return rows.select(row_id, F.posexplode(F.arrays_zip("proba", "calibrated")).alias("class", "v")).select(
        row_id, "class", F.col("v.proba").alias("p"), F.col("v.calibrated").alias("p_calibrated"))


AUC_BUCKETS = 256


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Area under the ROC curve by ranks over distinct scores.

    Counts per score are combined first; the running number of negatives below a score comes
    from two levels: buckets cut at quantiles of the scores themselves, so that no task orders all of them,
    however narrow the range they lie in.
    """
    from pyspark.sql import Window

    per = df.groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    shares = F.array(*[F.lit(i / AUC_BUCKETS) for i in range(1, AUC_BUCKETS)])
    cuts = F.lit(per.agg(F.percentile_approx("p", shares, 10_000)).first()[0] or [0.0])
    per = per.withColumn("__b", F.size(F.filter(cuts, lambda c: c < F.col("p"))))
    inside = Window.partitionBy("__b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    tops = per.groupBy("__b").agg(F.sum("neg").alias("__n"))
    across = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__b", F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__before"))
    ranked = per.withColumn("__in", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(tops, "__b")
    below = F.col("__in") + F.col("__before")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return ranked.agg((area / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def binary_report(df: DataFrame, p: str, y: str, min_auc: float = 0.6, max_brier: float = 0.25,
                  min_rows: int = 1000) -> DataFrame:
    """AUC, log loss, Brier score, positive rate, and whether the gates hold."""
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    yes = F.col(y) == 1
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(yes, 1.0).otherwise(0.0)).alias("pos_rate"),
                 F.avg(-F.log(F.when(yes, q).otherwise(1 - q))).alias("log_loss"),
                 F.avg((F.col(p) - F.when(yes, 1.0).otherwise(0.0)) ** 2).alias("brier"))
    out = out.withColumn("auc", auc(df, p, y).scalar())
    ok = (F.col("auc") >= min_auc) & (F.col("brier") <= max_brier) & (F.col("n") >= min_rows)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


# --- feature ranking ---------------------------------------------------------

def relevance(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One-way F statistic of each feature against the classes, from means and variances per class."""
    x = {f: F.col(f).cast("double") for f in features}
    wide = df.groupBy(label).agg(*[v.alias(f"{c}_{i}") for i, f in enumerate(features) for c, v in (
        ("n", F.count(x[f])), ("m", F.avg(x[f])), ("v", F.var_pop(x[f])))])
    # One row per class; only these few rows are turned into one per feature.
    per = wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{c}_{i}").alias(c) for c in "nmv"])
                                          for i, f in enumerate(features)])).alias("r")).select("r.*").where("n > 0")
    mean = per.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    tot = per.join(mean, "feature").groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between, within = F.col("b"), F.col("w")
    f = (between / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(within / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))
    return tot.select("feature", F.coalesce(f, F.lit(0.0)).alias("f_stat"))


def mrmr(df: DataFrame, features: list[str], label: str, k: int) -> list[str]:
    """Features ranked by relevance over mean absolute correlation with those already taken.

    Spark computes the F statistics and the correlation matrix; the greedy choice runs over
    these few numbers (their count is the number of features, fixed by the schema).
    """
    from scorebook.operators.metrics import correlation_pairs

    rel = {r["feature"]: r["f_stat"] for r in relevance(df, features, label).collect()}
    idx = {f: i for i, f in enumerate(features)}
    corr = np.zeros((len(features), len(features)))
    for r in correlation_pairs(df, features).collect():
        i, j = idx[r["feature_a"]], idx[r["feature_b"]]
        corr[i, j] = corr[j, i] = abs(r["r"])
    taken: list[str] = []
    while len(taken) < min(k, len(features)):
        rest = [f for f in features if f not in taken]

        def value(f: str) -> float:
            if not taken:
                return rel.get(f, 0.0)
            return rel.get(f, 0.0) / max(float(np.mean([corr[idx[f], idx[t]] for t in taken])), 1e-3)

        taken.append(max(rest, key=value))
    return taken
