"""Rows that no other row beats on two or more costs (skyline)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.sources.tables import staged

#: Cells along each cost. A group has at most CELLS ** costs cells, whatever its rows.
CELLS = 6
#: Rows of partial skylines that a task holds before it sends them on.
HELD = 200_000
#: Rows that a task cuts into groups at once, and the least of one group among them worth reducing before they are sent on.
CHUNK, WORTH = 100_000, 32
#: Partial skylines of up to so many rows in all are finished as one group; longer ones by a grid.
WHOLE = 10_000
#: Numbers compared at once.
AT_ONCE = 4_000_000


def beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points some row of ``by`` is no worse than everywhere, and better than somewhere."""
    out = np.zeros(len(points), bool)
    step = max(1, AT_ONCE // max(1, by.size))
    for lo in range(0, len(points) if len(by) else 0, step):
        p = points[lo : lo + step, None, :]
        out[lo : lo + step] = ((by <= p).all(axis=2) & (by < p).any(axis=2)).any(axis=1)
    return out


def front(points: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
    """The skyline of ``points`` and of the skyline ``held``; points with small sums come first, as they beat the most."""
    held = points[:0] if held is None else held
    points = points[np.argsort(points.sum(axis=1), kind="stable")]
    for lo in range(0, len(points), 256):
        new = points[lo : lo + 256]
        new = new[~beaten(new, held)]
        new = new[~beaten(new, new)]
        held = np.concatenate([held[~beaten(held, new)], new])
    return np.unique(held, axis=0)


def _columns(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) if b.num_rows else np.zeros((0, len(names)))


def _batch(groups: list, parts: list[np.ndarray], keys: list[str], costs: list[str], schema: pa.Schema) -> pa.RecordBatch:
    flat = np.concatenate(parts)
    times = [len(p) for p in parts]
    cols = [pa.array([g[i] for g, n in zip(groups, times) for _ in range(n)], schema.field(k).type) for i, k in enumerate(keys)]
    return pa.RecordBatch.from_arrays([*cols, *(pa.array(flat[:, i]) for i in range(len(costs)))], [*keys, *costs])


def _partial(costs: list[str]):
    """Skylines of the groups of a task, a chunk at a time: fewer rows, the same skyline.

    Groups with few rows in a chunk are sent on as they are; the others are held and sent whenever ``HELD`` rows are held.
    """
    def cut(rows: pa.Table, held: dict) -> pa.RecordBatch:
        codes = rows.column("__g").combine_chunks().dictionary_encode()
        at, names = codes.indices.to_numpy(), codes.dictionary
        points = np.stack([rows.column(c).to_numpy() for c in costs], axis=1)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(names)))
        few = np.ones(len(at), bool)
        for i in np.flatnonzero(np.diff(ends, prepend=0) >= WORTH).tolist():
            of = order[ends[i - 1] if i else 0 : ends[i]]
            few[of] = False
            g = names[i].as_py()
            held[g] = front(points[of], held.get(g))
        return pa.RecordBatch.from_arrays([names.take(pa.array(at[few])), *(pa.array(points[few, i]) for i in range(len(costs)))], ["__g", *costs])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, size, schema = {}, [], 0, None

        def sent() -> Iterator[pa.RecordBatch]:
            if held:
                yield _batch([(g,) for g in held], list(held.values()), ["__g"], costs, schema)
                held.clear()

        for b in it:
            schema = b.schema
            kept.append(b)
            size += b.num_rows
            if size >= CHUNK:
                yield cut(pa.Table.from_batches(kept), held)
                kept, size = [], 0
                if sum(map(len, held.values())) > HELD:
                    yield from sent()
        if size:
            yield cut(pa.Table.from_batches(kept), held)
        yield from sent()

    return run


def _sorted_groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Runs of equal keys in sorted rows, a batch's part at a time, and whether the key is new."""
    last = None
    for b in it:
        if not b.num_rows:
            continue
        values = list(zip(*(b.column(k).to_pylist() for k in keys)))
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield values[lo], b.slice(lo, hi - lo), values[lo] != last
            last = values[lo]


def _per_cell(keys: list[str], costs: list[str]):
    """The skyline of every cell, over rows sorted by cell."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, schema = None, None, None
        for k, part, new in _sorted_groups(it, keys):
            if new and key is not None:
                yield _batch([key], [held], keys, costs, schema)
                held = None
            key, held, schema = k, front(_columns(part, costs), held), part.schema
        if key is not None:
            yield _batch([key], [held], keys, costs, schema)

    return run


def _unbeaten(keys: list[str], costs: list[str]):
    """A cell's own points (``own``, sorted last) that none of the points sent to it beats."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = None
        for k, part, new in _sorted_groups(it, keys):
            own = part.column("own").to_numpy(zero_copy_only=False)
            points = _columns(part, costs)
            sent = front(points[~own], None if new else sent)
            left = points[own][~beaten(points[own], sent)]
            if len(left):
                yield _batch([k], [left], keys, costs, part.schema)

    return run


def skyline(df: DataFrame, costs: list[str], by: list[str] = (), cells: int = CELLS) -> DataFrame:
    """The rows of each group that no row of it beats: no worse on every cost, and better on one.

    Equal rows stay together; a row with an unknown cost beats none and is beaten by none; rows without a group
    value are a group. Costs are compared as doubles.

    Tasks send on partial skylines of groups with many rows in them. A group of which up to ``WHOLE`` rows are left is
    finished by one task. More are laid into a grid cut at quantiles: a cell with another cell below it in every
    direction is dropped as a whole, every other cell is reduced to its own skyline, and these are compared with the
    cells that lie nowhere above, never with all rows.
    """
    names = [f"__x{i}" for i in range(len(costs))]
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    marked = df.withColumns({"__g": group, **{n: F.col(c).cast("double") for n, c in zip(names, costs)}})
    known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    fields = ", ".join(f"{n} double" for n in names)
    points = staged(marked.where(known).select("__g", *names).mapInArrow(_partial(names), f"__g string, {fields}"), "skyline")
    large = staged(points.groupBy("__g").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > WHOLE).select("__g"), "skyline-large")
    small = points.join(large, "__g", "left_anti").repartition("__g").sortWithinPartitions("__g").mapInArrow(_per_cell(["__g"], names), f"__g string, {fields}")
    best = small if large.isEmpty() else small.unionByName(_by_grid(points.join(large, "__g", "left_semi"), names, fields, cells))
    kept = marked.where(known).join(best, ["__g", *names], "left_semi").select(*df.columns)
    return kept.unionByName(marked.where(~known).select(*df.columns))


def _by_grid(points: DataFrame, names: list[str], fields: str, cells: int) -> DataFrame:
    """Skylines of groups with many points, by cells."""
    k = len(names)
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    cuts = points.agg(*[F.percentile_approx(n, shares, 1000).alias(n) for n in names]).first()
    place = lambda n: F.size(F.filter(F.lit(cuts[n] or [0.0]), lambda c: c < F.col(n)))
    laid = points.withColumn("cell", F.array(*map(place, names)))
    full = laid.select("__g", "cell").distinct().groupBy("__g").agg(F.collect_list("cell").alias("cells"))

    def everywhere(a: Column, b: Column, strict: bool) -> Column:
        return reduce(lambda x, y: x & y, [a[i] < b[i] if strict else a[i] <= b[i] for i in range(k)])

    alive = full.select("__g", F.filter("cells", lambda c: ~F.exists("cells", lambda d: everywhere(d, c, True))).alias("cells"))
    alive = staged(alive.select("__g", F.explode("cells").alias("cell"), "cells").select(
        "__g", "cell", F.filter("cells", lambda c: everywhere(F.col("cell"), c, False) & (c != F.col("cell"))).alias("above")), "skyline-cells")
    own = laid.join(alive.select("__g", "cell"), ["__g", "cell"]).select("__g", F.concat_ws(",", F.transform("cell", lambda c: c.cast("string"))).alias("at"), *names)
    own = staged(own.repartition("__g", "at").sortWithinPartitions("__g", "at").mapInArrow(_per_cell(["__g", "at"], names), f"__g string, at string, {fields}"), "skyline-own")
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    targets = alive.select("__g", text("cell").alias("at"), F.explode("above").alias("target")).select("__g", "at", text("target").alias("target"))
    sent = own.join(targets, ["__g", "at"]).select("__g", F.col("target").alias("at"), F.lit(False).alias("own"), *names)
    both = own.select("__g", "at", F.lit(True).alias("own"), *names).union(sent)
    return both.repartition("__g", "at").sortWithinPartitions("__g", "at", "own").mapInArrow(_unbeaten(["__g", "at"], names), f"__g string, at string, {fields}").drop("at")
