"""Season and career running sums over daily counts, full or incremental."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.operators.windows import dedup_latest


def running_sums(counts: DataFrame, entity: str, cols: list[str], day="game_date", season="season",
                 keep: list[str] = ()) -> DataFrame:
    """``s_<col>`` and ``c_<col>`` up to and including each day.

    Input is one row per (entity, day), so a group never exceeds the number of days played.
    A season follows the calendar, hence ordering the career by (season, day) lets both windows
    share one shuffle on ``entity`` and one sort.
    """
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    career = f"(PARTITION BY {entity} ORDER BY {season}, {day} {frame})"
    in_season = f"(PARTITION BY {entity}, {season} ORDER BY {day} {frame})"
    return counts.selectExpr(
        entity, day, season, *keep,
        *[f"sum({c}) OVER {career} AS c_{c}" for c in cols],
        *[f"sum({c}) OVER {in_season} AS s_{c}" for c in cols],
    ).select(entity, day, season, *keep, *[f"s_{c}" for c in cols], *[f"c_{c}" for c in cols])


def carry_forward(target: DataFrame, new: DataFrame, keys: list[str], day="game_date") -> DataFrame:
    """Latest row per key of ``target`` dated before the first day of ``new``."""
    first = new.agg(F.min(day)).scalar()
    return dedup_latest(target.where(F.col(day) < first), keys, [F.col(day).desc()])


def newest_state(counts: DataFrame, entity: str, cols: list[str], season="season") -> DataFrame:
    """One row per entity after all its ``counts``: last season, its sums, and the career sums.

    This is the small table an increment starts from; ``advance`` moves it on by a chunk.
    """
    per = counts.groupBy(entity, season).agg(*[F.sum(c).alias(c) for c in cols])
    last = F.max_by(F.struct(*[F.col(c).alias(f"s_{c}") for c in cols]), season)
    return per.groupBy(entity).agg(F.max(season).alias(season), last.alias("__s"), *[F.sum(c).alias(f"c_{c}") for c in cols]).select(
        entity, season, "__s.*", *[f"c_{c}" for c in cols])


def advance(newest: DataFrame, rows: DataFrame, entity: str, day="game_date") -> DataFrame:
    """The newest state after a chunk's cumulative ``rows``: entities without a row keep theirs."""
    last = dedup_latest(rows, [entity], [F.col(day).desc()]).select(*newest.columns)
    return newest.join(last.select(entity), entity, "left_anti").unionByName(last)


def cumulate(new: DataFrame, entity: str, cols: list[str], target: DataFrame | None = None,
             day="game_date", season="season", newest: DataFrame | None = None) -> DataFrame:
    """Cumulative rows for the days in ``new``, starting from ``newest`` (see ``newest_state``) or, where only
    the finished table is at hand, from the latest rows of ``target``.

    An entity's newest row is all that counts: its career sums always carry over, its season sums where the
    season is the same. Any split into successive chunks gives the same rows as one full run, NULL sums included.
    """
    sums = running_sums(new, entity, cols, day, season)
    if target is None and newest is None:
        return sums
    if newest is None:
        newest = carry_forward(target, new, [entity], day)
    prev = newest.selectExpr(entity, f"{season} AS __season", *[f"s_{c} AS __s_{c}" for c in cols], *[f"c_{c} AS __pc_{c}" for c in cols])
    joined = sums.join(prev, [entity], "left").selectExpr("*", *[f"CASE WHEN __season = {season} THEN __s_{c} END AS __ps_{c}" for c in cols])

    def added(prev: str, cur: str) -> str:
        """Sum that is NULL only where both sides are."""
        return f"coalesce({prev} + {cur}, {prev}, {cur}) AS {cur}"

    return joined.selectExpr(entity, day, season, *[added(f"__ps_{c}", f"s_{c}") for c in cols],
                             *[added(f"__pc_{c}", f"c_{c}") for c in cols])


def recompute_entities(counts: DataFrame, changed: DataFrame, entity: str, cols: list[str],
                       day="game_date", season="season") -> DataFrame:
    """Rows of every entity named in ``changed``, from all its counts.

    For late days: a count that arrives before already cumulated days changes all later rows
    of its entity, and only those.
    """
    touched = counts.join(changed.select(entity).distinct(), [entity], "left_semi")
    return running_sums(touched, entity, cols, day, season)


def rest_days(df: DataFrame, entity: str, day="game_date", history: DataFrame | None = None,
              out: str = "pitcher_rest_days") -> DataFrame:
    """Days since the previous appearance, -1 for the first; ``history`` supplies earlier days."""
    spec = Window.partitionBy(entity).orderBy(day)
    before = F.lag(day).over(spec)
    if history is None:
        return df.withColumn(out, F.coalesce(F.date_diff(day, before), F.lit(-1)))
    last = carry_forward(history, df, [entity], day).select(entity, F.col(day).alias("__last"))
    joined = df.join(last, [entity], "left")
    gap = F.date_diff(F.col(day), F.coalesce(before, F.col("__last")))
    return joined.withColumn(out, F.coalesce(gap, F.lit(-1))).drop("__last")
