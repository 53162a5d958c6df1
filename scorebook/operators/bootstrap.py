"""Bootstrap by exact draws: every replicate draws as many rows as there are, with replacement.

The draws of a replicate are split down a tree. Rows are dealt to leaves by a hash of their id; a node
gives its draws to its halves by a binomial number with the halves' row counts as odds, and a leaf gives its
draws to runs of ``RUN`` rows, and these to their rows, in order of id. Each of these numbers comes from a
generator whose counter is its place in the tree, so it depends on seed and rows only: not on how the table is
partitioned, nor on the task that computes it. Rows are moved once, as id and terms; all replicates of a row are
added up in arrays where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most leaves of the tree, a power of two; their row counts are all that the driver gets.
LEAVES = 4096
RUN = 256


def _generator(seed: int, node: int, run: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, run, node]))


def leaf_draws(counts: np.ndarray, leaf: int, replicates: int, seed: int) -> np.ndarray:
    """Draws that fall into a leaf, for every replicate: down the path from the root."""
    lo, hi, node = 0, len(counts), 1
    below = np.concatenate(([0], np.cumsum(counts)))
    draws = np.full(replicates, below[-1], np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, both = below[mid] - below[lo], below[hi] - below[lo]
        first = _generator(seed, node, 0).binomial(draws, left / both if both else 0.0)
        if leaf < mid:
            draws, hi, node = first, mid, 2 * node
        else:
            draws, lo, node = draws - first, mid, 2 * node + 1
    return draws


def run_weights(left: np.ndarray, rows_left: int, size: int, leaf: int, leaves: int, run: int, seed: int) -> np.ndarray:
    """Weights (replicate, row) of the next ``size`` of the ``rows_left`` rows of a leaf that has ``left`` draws for them."""
    rng = _generator(seed, leaves + leaf, run + 1)
    mine = rng.binomial(left, size / rows_left) if size < rows_left else left
    return rng.multinomial(mine, np.full(size, 1.0 / size))


def _sums(counts: np.ndarray, replicates: int, seed: int, terms: int, run: int):
    """Sums of every replicate over the rows of a task, which are sorted by leaf and id."""
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, leaf, held = np.zeros((terms + 1, replicates)), None, []
        left, rows_left, number = None, 0, 0

        def take(rows: np.ndarray) -> None:
            nonlocal left, rows_left, number
            w = run_weights(left, rows_left, len(rows), leaf, len(counts), number, seed)
            total[0] += w.sum(axis=1)
            total[1:] += (w @ rows).T
            left, rows_left, number = left - w.sum(axis=1), rows_left - len(rows), number + 1

        for b in it:
            leaves, values = b.column("leaf").to_numpy(), np.stack([b.column(f"t{i}").to_numpy() for i in range(terms)], axis=1) if terms else np.zeros((b.num_rows, 0))
            cuts = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if leaves[lo] != leaf:
                    leaf, number, held = int(leaves[lo]), 0, []
                    left, rows_left = leaf_draws(counts, leaf, replicates, seed), int(counts[leaf])
                rows = np.concatenate([*held, values[lo:hi]])
                while len(rows) >= run or (len(rows) and len(rows) == rows_left):
                    some = min(run, len(rows))
                    take(rows[:some])
                    rows = rows[some:]
                held = [rows]
        if total[0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(total[0].astype(np.int64)), *(pa.array(t) for t in total[1:])],
                                             ["replicate", "draws", *(f"t{i}" for i in range(terms))])

    return work


def replicate_sums(df: DataFrame, row_id: str, terms: dict[str, Column], replicates: int = 1000, seed: int = 42, leaves: int = LEAVES, run: int = RUN) -> DataFrame:
    """replicate, draws (the number of rows, exactly) and the sum of every term over the rows drawn.

    A row that is drawn k times counts k times; an unknown term counts as zero. Rows of the same id are told
    apart by their terms; if these are equal too, it makes no difference which is drawn.
    """
    rows = df.select(F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(leaves)).cast("int").alias("leaf"), F.col(row_id).alias("id"),
                     *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"t{i}") for i, c in enumerate(terms.values())])
    counts = np.zeros(leaves, np.int64)
    for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.leaf] = r.n
    # Neighbouring leaves are joined until they hold two runs on average.
    join = 1
    while join < leaves and counts.sum() * join < 2 * run * leaves:
        join *= 2
    counts, rows = counts.reshape(-1, join).sum(axis=1), rows.withColumn("leaf", F.floor(F.col("leaf") / join).cast("int"))
    names = [f"t{i}" for i in range(len(terms))]
    dealt = rows.repartition("leaf").sortWithinPartitions("leaf", "id", *names).select("leaf", *names)
    parts = dealt.mapInArrow(_sums(counts, replicates, seed, len(terms), run), "replicate long, draws long" + "".join(f", {n} double" for n in names))
    return parts.groupBy("replicate").agg(F.sum("draws").alias("draws"), *[F.sum(n).alias(t) for n, t in zip(names, terms)])


def bootstrap_exact(df: DataFrame, row_id: str, terms: dict[str, Column], metric: Callable[[Callable[[str], Column]], Column],
                    replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Mean, 2.5/97.5 percentiles and sd of a metric of the sums of ``terms`` (and of ``draws``) over exact resamples."""
    values = replicate_sums(df, row_id, terms, replicates, seed).select(metric(F.col).alias("v"))
    return values.agg(F.avg("v").alias("mean"), F.expr("percentile(v, 0.025)").alias("ci_lower"), F.expr("percentile(v, 0.975)").alias("ci_upper"), F.stddev_pop("v").alias("std"))
