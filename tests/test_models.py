"""Skylines, calibration, trained models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import rows
from scorebook.operators import lookups, ml, skyline


def brute_skyline(points):
    best = lambda p, q: all(b <= a for a, b in zip(p[1:], q[1:])) and any(b < a for a, b in zip(p[1:], q[1:]))
    known = [p for p in points if None not in p[1:]]
    return sorted((p for p in points if None in p[1:] or not any(q[0] == p[0] and best(p, q) for q in known)), key=str)


@pytest.mark.parametrize("k, span, cells", [(2, 6, 3), (3, 5, 2), (3, 1000, 6), (4, 30, 3)])
def test_skyline_brute_force(spark, monkeypatch, k, span, cells):
    rng = random.Random(k * span)
    monkeypatch.setattr(skyline, "HELD", 20)
    points = [(rng.choice(["a", "b", None]), *(rng.randrange(span) for _ in range(k))) for _ in range(300)]
    points += [("hot", *(x := [rng.randrange(span) for _ in range(k - 1)]), 2 * span - sum(x)) for _ in range(300)]  # many of them unbeaten
    points += points[:20] + [("a", None, *([0] * (k - 1)))]
    names = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame(points, "g string, " + ", ".join(f"{n} int" for n in names)).repartition(5)
    assert sorted((tuple(r) for r in skyline.skyline(df, names, ["g"], cells).collect()), key=str) == brute_skyline(points)
    assert skyline.skyline(df.limit(0), names, ["g"]).count() == 0


@pytest.mark.parametrize("whole, worth, chunk", [(0, 1, 50), (40, 8, 100), (10_000, 32, 100_000)])
def test_skyline_groups_of_all_sizes(spark, monkeypatch, whole, worth, chunk):
    for name, value in (("WHOLE", whole), ("WORTH", worth), ("CHUNK", chunk), ("HELD", 20)):
        monkeypatch.setattr(skyline, name, value)
    if whole == 10_000:  # many small groups: none is worth a grid
        monkeypatch.setattr(skyline, "_by_grid", None)
    rng = random.Random(whole)
    points = [(f"s{g}", *(rng.randrange(9) for _ in range(3))) for g in range(60) for _ in range(rng.randrange(12))]
    points += [("hot", a, b, 60 - a - b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(200))]
    df = spark.createDataFrame(points, "g string, c0 int, c1 int, c2 int").repartition(3)
    assert sorted((tuple(r) for r in skyline.skyline(df, ["c0", "c1", "c2"], ["g"], 3).collect()), key=str) == brute_skyline(points)


def test_skyline_never_pairs_the_table_with_itself(spark):
    df = spark.range(1000).selectExpr("id", "id % 37 AS a", "id % 31 AS b", "id % 29 AS c")
    plan = skyline.skyline(df, ["a", "b", "c"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def brute_isotonic(y, w):
    """min over ends of max over starts of weighted means."""
    n = len(y)
    mean = [[np.average(y[i : j + 1], weights=w[i : j + 1]) if i <= j else None for j in range(n)] for i in range(n)]
    return [min(max(mean[i][j] for i in range(k + 1)) for j in range(k, n)) for k in range(n)]


def test_pooling_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randrange(1, 25)
        y, w = [rng.random() for _ in range(n)], [rng.randrange(1, 9) for _ in range(n)]
        knots = dict(ml.pool_adjacent(list(range(n)), y, w))
        xs = sorted(knots)
        got = [np.interp(i, xs, [knots[x] for x in xs]) for i in range(n)]
        want = brute_isotonic(y, w)
        assert all(got[i] == pytest.approx(want[i]) for i in xs) and got == pytest.approx(want)


def test_calibration_is_isotonic_and_bounded(spark):
    rng = random.Random(3)
    data = [([p, 1 - p], int(rng.random() < p * p)) for p in (rng.randrange(0, 101) / 100 for _ in range(5000))] + [([0.5, None], None)]
    data = [(p, None if y is None else 1 - y) for p, y in data]  # label 0 with chance p squared
    df = spark.createDataFrame(data, "proba array<double>, label_index int").repartition(4)
    exact = ml.fit_calibration(df, 2)
    pts = {}
    for p, y in data:
        pts.setdefault(p[0], []).append(1.0 if y == 0 else 0.0)
    xs = sorted(pts)
    want = brute_isotonic([np.mean(pts[x]) for x in xs], [len(pts[x]) for x in xs])
    got = exact.where("class = 0").orderBy("x").collect()
    assert [r.y for r in got] == pytest.approx([want[int(np.argmin([abs(x - r.x) for x in xs]))] for r in got])
    small = ml.fit_calibration(df, 2, cells=10)
    assert max(r.n for r in small.groupBy("class").agg(F.count("*").alias("n")).collect()) <= 20
    assert all(abs(r.y - r.x**2) < 0.12 for r in small.where("class = 0").collect())
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 2  # all classes come from one pass


def test_binary_search_of_a_knot(spark):
    for n in (0, 1, 2, 3, 8, 33):
        knots = [(float(2 * i), float(i * i)) for i in range(n)]
        df = spark.createDataFrame([(float(v), knots) for v in range(-3, 2 * n + 3)] + [(None, knots)], "v double, k array<struct<x:double,y:double>>")
        got = df.select("v", lookups.interpolate(F.col("v"), F.col("k")).alias("y")).collect()
        for r in got:
            want = float(np.interp(r.v, [a for a, _ in knots], [b for _, b in knots])) if n and r.v is not None else None
            assert r.y == (pytest.approx(want) if want is not None else None)


def labelled(spark, n=1500):
    rng = random.Random(4)
    data = []
    for i in range(n):
        a, b, noise = rng.random(), rng.random(), rng.random()
        y = 0 if a < 0.4 else 1 if b < 0.5 else 2
        data.append((i, a, b, noise, a + 0.001 * noise, y if rng.random() < 0.9 else rng.randrange(3), rng.choice(["train", "train", "calibrate", "test"])))
    return spark.createDataFrame(data, "row_id long, a double, b double, noise double, a_again double, label_index int, split string")


def test_outcome_model_and_scores(spark):
    df = labelled(spark)
    model = ml.train_outcome_model(df.where("split = 'train'"), ["a", "b", "noise"])
    test = df.where("split = 'test'")
    scored = ml.class_probabilities(test, model, ["a", "b", "noise"], ["row_id", "label_index"]).collect()
    assert all(sum(r.proba) == pytest.approx(1) and min(r.proba) >= 0 for r in scored)
    assert np.mean([int(np.argmax(r.proba)) == r.label_index for r in scored]) > 0.8
    knots = ml.fit_calibration(ml.class_probabilities(df.where("split = 'calibrate'"), model, ["a", "b", "noise"], ["label_index"]), 3)
    out = ml.score(test, model, ["a", "b", "noise"], "row_id", knots).collect()
    by = {}
    for r in out:
        by.setdefault(r.row_id, []).append(r)
    plain = {r.row_id: r.proba for r in scored}
    curve = {}
    for k in knots.orderBy("class", "x").collect():
        curve.setdefault(k["class"], []).append((k.x, k.y))
    for i, rs in by.items():
        raw = [float(np.interp(plain[i][r["class"]], *zip(*curve[r["class"]]))) for r in sorted(rs, key=lambda r: r["class"])]
        assert [r.p_calibrated for r in sorted(rs, key=lambda r: r["class"])] == pytest.approx([v / sum(raw) for v in raw])
    assert len(by) == test.count()


def test_exit_model(spark):
    df = labelled(spark).withColumn("pulled", (F.col("a") + 0.2 * F.col("noise") > 0.8).cast("int"))
    got = ml.exit_model(df, ["a", "b", "noise"], ["row_id"]).collect()
    assert len(got) == df.where("split = 'test'").count() and all(0 <= r.p_calibrated <= 1 for r in got)
    ordered = sorted(got, key=lambda r: r.p)
    assert all(x.p_calibrated <= y.p_calibrated + 1e-9 for x, y in zip(ordered, ordered[1:]))
    assert np.mean([(r.p > 0.5) == r.pulled for r in got]) > 0.85


def test_mrmr_skips_the_repeated_feature(spark):
    df = labelled(spark).withColumn("c", F.col("label_index").cast("string"))
    names = ml.mrmr(df, ["a", "b", "noise", "a_again"], "c", 2)
    assert names[0] in ("a", "a_again", "b") and set(names) in ({"a", "b"}, {"a_again", "b"})
    f = {r.feature: r.f_stat for r in ml.relevance(df, ["a", "noise"], "c").collect()}
    x = np.array([(r.a, r.noise, r.label_index) for r in df.collect()])
    for i, name in enumerate(("a", "noise")):
        groups = [x[x[:, 2] == k, i] for k in range(3)]
        between = sum(len(g) * (g.mean() - x[:, i].mean()) ** 2 for g in groups) / 2
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(x) - 3)
        assert f[name] == pytest.approx(between / within)
    assert rows(df.groupBy("c").count(), "c")[0] == ("0",)


def test_calibration_in_batches_equals_single_values(spark):
    """Curves are read by arrays: no search is interpreted row by row, and every value is that of ``interpolate``."""
    rng = random.Random(4)
    knots = [(c, x, rng.random()) for c in (0, 2) for x in sorted(rng.random() for _ in range(7))]
    curves = spark.createDataFrame(knots, "class int, x double, y double")
    ps = [[rng.choice([None, rng.random(), 0.0, 1.0, knots[3][1]]) for _ in range(rng.randrange(5))] for _ in range(60)] + [None, [], [float("nan"), 0.5, 0.1]]
    df = spark.createDataFrame(list(enumerate(ps)), "r long, proba array<double>")
    got = {r.r: r.calibrated for r in lookups.calibrate_vector(df, curves).collect()}
    one = df.select("r", F.posexplode("proba").alias("class", "p")).join(curves.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("k")), "class")
    want = {(r.r, r["class"]): r.v for r in one.select("r", "class", lookups.interpolate(F.col("p"), F.col("k")).alias("v")).collect()}
    for i, p in enumerate(ps):
        raw = None if p is None else [want.get((i, c)) or 0.0 for c in range(len(p))]
        assert got[i] == (None if p is None else [v / (sum(raw) or 1.0) for v in raw])
    rows = df.select("r", F.posexplode("proba").alias("class", "p"))
    long = lookups.apply_calibration(rows, curves, "r")
    assert "aggregate(" not in long._jdf.queryExecution().executedPlan().toString()
    for r in long.collect():
        total = sum(v for (i, _), v in want.items() if i == r.r and v is not None)
        assert (r.p_calibrated is None) if r.p is None else r.p_calibrated == pytest.approx(want[r.r, r["class"]] / (total or 1.0))
    assert lookups.apply_calibration(rows, curves.limit(0), "r").count() == 0
