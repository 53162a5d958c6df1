"""Ordered computations that stay parallel inside one hot key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here each key is
cut into *buckets*, contiguous ranges of its order (an hour, a block of plate appearances).
Rows are shuffled once on ``(key, bucket)``; windows run inside a bucket; one edge row per
bucket carries totals and boundary values across buckets, and is joined back. The edge table
has one row per bucket, so the only window over a whole key sees buckets, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__bucket"


def _by(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    totals: dict[str, Column] | None = None,
    prev: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    opening: dict[str, Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add ordered values to every row of ``df``.

    ``bucket`` must be non-decreasing along ``order``; ``order`` must be unique per key; keys
    and bucket must not be NULL.

    totals     sum of the expression over all earlier rows of the key (NULL for the first row)
    prev       value of the expression on the row before (NULL for the first row)
    following  value of the expression on the row after (NULL for the last row)
    opening    value of the expression on the first row of the key
    number     1-based position of the row in its key
    """
    totals, prev, following, opening = totals or {}, prev or {}, following or {}, opening or {}
    spec = Window.partitionBy(*keys, _B).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    upto = spec.rowsBetween(Window.unboundedPreceding, 0)

    def pack(exprs: dict[str, Column]) -> Column:
        return F.struct(*[e.alias(n) for n, e in exprs.items()]) if exprs else F.struct(F.lit(1).alias("_"))

    rows = df.withColumn(_B, bucket)
    local = rows.select(
        "*",
        pack(prev).alias("__self_prev"),
        pack(following).alias("__self_next"),
        pack(opening).alias("__self_open"),
        *[e.alias(f"__x_{n}") for n, e in totals.items()],
    )
    local = local.select(
        "*",
        F.row_number().over(spec).cast("long").alias("__pos"),
        F.lag("__self_prev").over(spec).alias("__prev"),
        F.lead("__self_next").over(spec).alias("__next"),
        F.first("__self_open").over(upto).alias("__open"),
        F.first("__self_next").over(upto).alias("__first"),
        *[F.sum(f"__x_{n}").over(before).alias(f"__before_{n}") for n in totals],
        *[F.sum(f"__x_{n}").over(upto).alias(f"__upto_{n}") for n in totals],
    )

    # The last row of a bucket knows everything its successors need.
    across = Window.partitionBy(*keys).orderBy(_B)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = local.where(F.col("__next").isNull()).select(
        *_by(keys), _B,
        F.sum("__pos").over(earlier).alias("__carry_pos"),
        F.lag("__self_prev").over(across).alias("__carry_prev"),
        F.lead("__first").over(across).alias("__carry_next"),
        F.first("__open").over(across.rowsBetween(Window.unboundedPreceding, 0)).alias("__carry_open"),
        *[F.sum(f"__upto_{n}").over(earlier).alias(f"__carry_{n}") for n in totals],
    )
    # Plain equality keeps the (keys, bucket) partitioning of ``local``: no second shuffle of rows.
    joined = local.join(edges, [*keys, _B], "left")

    out: list[Column] = [F.col(c) for c in df.columns]
    for n in totals:
        a, b = F.col(f"__before_{n}"), F.col(f"__carry_{n}")
        out.append(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b).alias(n))
    for n in prev:
        out.append(F.coalesce("__prev", "__carry_prev")[n].alias(n))
    for n in following:
        out.append(F.coalesce("__next", "__carry_next")[n].alias(n))
    for n in opening:
        out.append(F.col("__carry_open")[n].alias(n))
    if number:
        out.append((F.col("__pos") + F.coalesce("__carry_pos", F.lit(0))).alias(number))
    return joined.select(*out)


def latest_before(
    probes: DataFrame,
    marks: DataFrame,
    keys: list[str],
    probe_at: str,
    mark_at: str,
    strict: bool,
    bucket=None,
    out: str = "matched_at",
) -> DataFrame:
    """For each distinct ``(keys, probe_at)`` the largest ``mark_at`` before (or at) it.

    The answer is a running maximum, so it splits: maximum of earlier buckets, then a window
    inside the bucket. ``bucket`` maps a time column to its bucket; without it the key's own
    date-grain rows form one range (bounded by the number of dates).
    """
    side_probe, side_mark = (0, 1) if strict else (1, 0)
    p = probes.select(*keys, F.col(probe_at).alias("__at")).distinct() \
        .withColumn("__mark", F.lit(None).cast(marks.schema[mark_at].dataType)) \
        .withColumn("__side", F.lit(side_probe))
    m = marks.select(*keys, F.col(mark_at).alias("__at"), F.col(mark_at).alias("__mark")) \
        .withColumn("__side", F.lit(side_mark))
    both = p.unionByName(m.select(*p.columns))
    part = list(keys)
    if bucket is not None:
        both = both.withColumn(_B, bucket(F.col("__at")))
        part.append(_B)
    spec = Window.partitionBy(*part).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("__hit", F.max("__mark").over(spec)).where(F.col("__side") == side_probe)
    if bucket is not None:
        per = both.groupBy(*part).agg(F.max("__mark").alias("__top"))
        across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(*part, F.max("__top").over(across).alias("__carry"))
        hit = hit.join(per, part, "left").withColumn("__hit", F.coalesce("__hit", "__carry"))
    return hit.select(*keys, F.col("__at").alias(probe_at), F.col("__hit").alias(out))
