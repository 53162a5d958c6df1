"""Exact resampling, look-ups by key, compaction plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import rows
from scorebook.operators import bootstrap as B
from scorebook.session import fresh_path
from scorebook.sources import tables as T


def weights(df, seed=5, replicates=40, leaves=8, run=4):
    """Weight of every id in every replicate: a replicate's sums of the rows' own indicators."""
    ids = sorted(r.i for r in df.select("i").collect())
    return B.replicate_sums(df, "i", {f"w{i}": F.when(F.col("i") == i, 1.0) for i in ids}, replicates, seed, leaves, run).orderBy("replicate").collect()


def test_draws_add_up_and_do_not_depend_on_partitions(spark):
    df = spark.range(30).withColumnRenamed("id", "i")
    a, b = weights(df.repartition(7)), weights(df.coalesce(1))
    assert a == b
    assert all(r.draws == 30 and sum(r[2:]) == 30 for r in a)
    assert a != weights(df, seed=6)


def test_draws_are_multinomial(spark):
    w = np.array([r[2:] for r in weights(spark.range(12).withColumnRenamed("id", "i"), replicates=4000, run=5)])
    assert np.abs(w.mean(axis=0) - 1).max() < 0.07  # each row is drawn once on average
    assert np.abs(w.var(axis=0) - 11 / 12).max() < 0.1
    assert np.abs(np.corrcoef(w.T)[np.triu_indices(12, 1)] + 1 / 11).max() < 0.07  # and the draws compete


def test_the_tree_split_by_hand():
    counts, seed, n = np.array([3, 0, 5, 2]), 9, 50
    by_leaf = np.array([B.leaf_draws(counts, k, n, seed) for k in range(4)])
    assert (by_leaf.sum(axis=0) == 10).all() and not by_leaf[1].any()
    left = B._generator(seed, 1, 0).binomial(np.full(n, 10), 0.3)
    assert (by_leaf[0] + by_leaf[1] == left).all()
    assert (by_leaf[2] == B._generator(seed, 3, 0).binomial(10 - left, 5 / 7)).all()
    first = B.run_weights(by_leaf[2], 5, 2, 2, 4, 0, seed)
    rest = B.run_weights(by_leaf[2] - first.sum(axis=1), 3, 3, 2, 4, 1, seed)
    assert (first.sum(axis=1) + rest.sum(axis=1) == by_leaf[2]).all()


def test_interval_of_a_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(10, 3, 900)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(900, None)], "i long, x double")
    r = B.bootstrap_exact(df.where("x is not null"), "i", {"x": F.col("x")}, lambda s: s("x") / s("draws"), 500).first()
    assert r.mean == pytest.approx(x.mean(), abs=0.03) and r.std == pytest.approx(x.std() / 30, rel=0.15)
    assert r.ci_lower < x.mean() < r.ci_upper
    assert B.replicate_sums(df.limit(0), "i", {"x": F.col("x")}, 5).count() == 0


def scanned(df):
    """Rows that the scans give when the frame is collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_unlisted_row_groups_are_not_read(spark):
    path = fresh_path(spark, "by-key")
    df = spark.range(200_000).selectExpr("id * 2 % 100000 AS game_pk", "id", "repeat(md5(cast(id AS string)), 3) AS x")
    T.write_by_key(df.repartition(8), path, row_group_bytes=64 << 10)
    few = spark.createDataFrame([(k,) for k in (4, 40_000, 40_002, 99_998, 3, None)], "game_pk long")  # 3 is in no file
    got = T.read_keys(spark, path, few)
    assert rows(got, "id") == rows(df.where("game_pk in (4, 40000, 40002, 99998)"), "id")
    assert 0 < scanned(got) < 60_000
    assert "In(game_pk" in got._jdf.queryExecution().toString() or "game_pk IN" in got._jdf.queryExecution().toString()
    odd = T.read_keys(spark, path, spark.createDataFrame([(k,) for k in range(20_001, 20_019, 2)], "game_pk long"))
    assert odd.collect() == [] and scanned(odd) == 0  # inside the span of a file: only its Bloom filter tells
    many = spark.range(0, 3000).selectExpr("id * 2 AS game_pk")
    got = T.read_keys(spark, path, many, listed=50)
    assert got.count() == df.join(many, "game_pk", "left_semi").count()
    assert "game_pk" in got._jdf.queryExecution().toString() and T.read_keys(spark, path, many.limit(0)).count() == 0


def plain_first_fit(lengths, target):
    bins, out = [], []
    for x in lengths:
        at = next((i for i, b in enumerate(bins) if sum(b) + x <= target), len(bins))
        if at == len(bins):
            bins.append([])
        bins[at].append(x)
        out.append(at)
    return out


def test_plan_equals_a_plain_packing(spark):
    rng = random.Random(3)
    files = [(t, f"{t}/f{i:03d}", rng.randrange(1, 120)) for t in ("a", "b") for i in range(150)]
    plan = T.compaction_plan(spark.createDataFrame(files, "table string, path string, length long"), 100, 20).collect()
    for t in ("a", "b"):
        mine = sorted(((n, p) for u, p, n in files if u == t and 2 * n < 100), key=lambda x: (-x[0], x[1]))
        bins = plain_first_fit([n for n, _ in mine], 100)
        want = {p: b for (_, p), b in zip(mine, bins) if bins.count(b) > 1}
        got = [r for r in plan if r.table == t]
        assert {r.path: r.bin for r in got} == want
        for k in {r.batch for r in got}:
            assert sum(r.batch == k for r in got) <= 20
        assert all(len({r.batch for r in got if r.bin == b}) == 1 for b in set(want.values()))


def test_compaction_resumes(spark):
    src, dst = fresh_path(spark, "frag"), fresh_path(spark, "packed")
    df = spark.range(40_000).selectExpr("id", "md5(cast(id AS string)) AS x")
    df.repartition(24).write.parquet(src)
    df.selectExpr("id + 1000000 AS id", "x").coalesce(1).write.mode("append").parquet(src)  # one long file, which stays
    size = T.data_files(spark, src)[1]
    kept = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.files.maxPartitionBytes")
    one = T.run_compaction(spark, src, dst, size // 8, 8, most_batches=1).first()
    assert one.batches_left == one.batches - 1 > 0
    with pytest.raises(ValueError, match="missing"):
        T.compacted(spark, src, dst)
    first = spark.read.parquet(f"{dst}/batches/b=000000").select(F.input_file_name().alias("f")).distinct().collect()
    two = T.run_compaction(spark, src, dst, size // 8, 8).first()
    assert two.batches_left == 0 and two.files_after < two.files_before / 2
    assert spark.read.parquet(f"{dst}/batches/b=000000").select(F.input_file_name().alias("f")).distinct().collect() == first  # not written again
    assert rows(T.compacted(spark, src, dst)) == rows(spark.read.parquet(src))
    assert kept == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.files.maxPartitionBytes"))
