"""Bucketed scans equal plain windows, whatever the buckets and the skew."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from frames import rows
from scorebook.operators.joins import asof_join
from scorebook.plans.ordered import scan


def _events(spark, seed, n=400, hot=0.5):
    rnd = random.Random(seed)
    data = [(0 if rnd.random() < hot else rnd.randint(1, 6), i, rnd.choice([None, 1, 2, 3])) for i in range(n)]
    return spark.createDataFrame(data, "k long, t long, v long")


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
def test_scan_equals_window(spark, width):
    df = _events(spark, width)
    got = scan(df, ["k"], ["t"], F.floor(F.col("t") / width), totals={"s": F.col("v")}, prev={"p": F.col("v"), "pt": F.col("t")},
               following={"n": F.col("t")}, opening={"o": F.col("t")}, number="i")
    w = Window.partitionBy("k").orderBy("t")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.sum("v").over(before).alias("s"), F.lag("v").over(w).alias("p"), F.lag("t").over(w).alias("pt"),
                     F.lead("t").over(w).alias("n"), F.first("t").over(w).alias("o"), F.row_number().over(w).cast("long").alias("i"))
    assert rows(got) == rows(want, *got.columns)


def test_scan_shuffles_on_key_and_bucket_only(spark):
    """No exchange of the rows on the key alone: a hot key is spread over its buckets."""
    plan = scan(_events(spark, 1), ["k"], ["t"], F.floor(F.col("t") / 10), totals={"s": F.col("v")}) \
        ._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line]
    assert any("__bucket" in line for line in wide)


def _profiles(spark):
    d = date(2020, 5, 1)
    return spark.createDataFrame([(1, d, 10), (1, d + timedelta(5), 20), (2, d + timedelta(1), 30)], "id int, day date, x int")


def _left(spark):
    d = date(2020, 5, 1)
    return spark.createDataFrame([(1, d, "same"), (1, d + timedelta(5), "second"), (1, d + timedelta(9), "later"), (2, d, "early"), (3, d, "none")],
                                 "id int, at date, tag string")


def test_asof_strict_and_inclusive(spark):
    strict = rows(asof_join(_left(spark), _profiles(spark), ["id"], "at", "day"), "tag", "x")
    assert strict == [("later", 20), ("second", 10)]
    inclusive = rows(asof_join(_left(spark), _profiles(spark), ["id"], "at", "day", strict=False), "tag", "x")
    assert inclusive == [("later", 20), ("same", 10), ("second", 20)]


def test_asof_left_keeps_unmatched_and_empty_right(spark):
    assert len(rows(asof_join(_left(spark), _profiles(spark), ["id"], "at", "day", how="left"), "tag", "x")) == 5
    assert rows(asof_join(_left(spark), _profiles(spark).limit(0), ["id"], "at", "day")) == []


@pytest.mark.parametrize("strict", [True, False])
def test_asof_buckets_equal_brute_force(spark, strict):
    rnd = random.Random(3)
    t0 = datetime(2020, 1, 1)
    left = [(rnd.choice([1, 1, 1, 2]), t0 + timedelta(minutes=rnd.randint(0, 3000)), i) for i in range(200)]
    right = sorted({(rnd.choice([1, 2]), t0 + timedelta(minutes=rnd.randint(0, 3000))) for _ in range(80)})
    l_df = spark.createDataFrame(left, "k int, ts timestamp, i int")
    r_df = spark.createDataFrame(right, "k int, at timestamp")
    got = rows(asof_join(l_df, r_df, ["k"], "ts", "at", strict, bucket=lambda c: F.date_trunc("hour", c)), "i", "at")
    want = []
    for k, ts, i in left:
        fit = [a for kk, a in right if kk == k and (a < ts if strict else a <= ts)]
        if fit:
            want.append((i, max(fit)))
    assert got == sorted(want)
