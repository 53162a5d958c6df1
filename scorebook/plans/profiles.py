"""Player profiles: counts -> running sums -> rates, table by table or fused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.functions import rates
from scorebook.operators import counts as C
from scorebook.operators.cumulate import cumulate, rest_days, running_sums
from scorebook.operators.joins import batter_profile, pitcher_profile


def batters(counts: DataFrame, target: DataFrame | None = None) -> DataFrame:
    return rates.batting_rates(cumulate(counts, "batter_id", C.batter_names(), target))


def pitchers(counts: DataFrame, target: DataFrame | None = None) -> DataFrame:
    sums = cumulate(counts, "pitcher_id", C.pitcher_names(), target)
    return rest_days(rates.pitching_rates(sums), "pitcher_id", history=target)


def batter_arsenal(counts: DataFrame, target: DataFrame | None = None) -> DataFrame:
    return rates.batter_arsenal_rates(cumulate(counts, "batter_id", C.batter_arsenal_names(), target))


def batter_discipline(counts: DataFrame, target: DataFrame | None = None) -> DataFrame:
    return rates.discipline_rates(cumulate(counts, "batter_id", C.discipline_names(), target))


def pitcher_arsenal(counts: DataFrame, target: DataFrame | None = None) -> DataFrame:
    return rates.pitcher_arsenal_rates(cumulate(counts, "pitcher_id", C.pitcher_arsenal_names(), target))


def batter_profile_by_tables(events: DataFrame) -> DataFrame:
    """Three tables joined on (batter, date)."""
    return batter_profile(batters(C.batter_counts(events)), batter_arsenal(C.batter_arsenal_counts(events)),
                          batter_discipline(C.batter_discipline_counts(events)))


def pitcher_profile_by_tables(events: DataFrame) -> DataFrame:
    return pitcher_profile(pitchers(C.pitcher_counts(events)), pitcher_arsenal(C.pitcher_arsenal_counts(events)))


# --- one pass of windows ------------------------------------------------------
# The count tables of a player share their grouping keys, so after their aggregations they are
# already partitioned alike: outer joins on those keys move nothing, and one window pass over the
# joined daily rows replaces a window pass per table and wide joins of the results. A date
# without rows in a part gets NULL for that part's columns, as left joins of the finished tables
# would give; NULL days leave the part's running sums unchanged.

def _merge_daily(parts: dict[str, DataFrame], entity: str) -> DataFrame:
    keys, out = [entity, "game_date", "season"], None
    for name, daily in parts.items():
        marked = daily.withColumn(f"__in_{name}", F.lit(True))
        out = marked if out is None else out.join(marked, keys, "full_outer")
    return out


def _profile_sums(parts: dict[str, DataFrame], entity: str, base: str) -> DataFrame:
    """Running sums of all parts, then the rows of the base part."""
    keys = [entity, "game_date", "season"]
    names = {p: [c for c in df.columns if c not in keys] for p, df in parts.items()}
    sums = running_sums(_merge_daily(parts, entity), entity, [n for ns in names.values() for n in ns],
                        keep=[f"__in_{p}" for p in parts]).where(f"__in_{base}")
    cols = [f"{s}_{n}" if p == base else f"CASE WHEN __in_{p} THEN {s}_{n} END AS {s}_{n}"
            for p, ns in names.items() for s in ("s", "c") for n in ns]
    return sums.selectExpr(*keys, *cols)


def batter_profile_fused(events: DataFrame) -> DataFrame:
    parts = {"b": C.batter_counts(events), "a": C.batter_arsenal_counts(events), "d": C.batter_discipline_counts(events)}
    sums = _profile_sums(parts, "batter_id", base="b")
    return rates.discipline_rates(rates.batter_arsenal_rates(rates.batting_rates(sums)))


def pitcher_profile_fused(events: DataFrame) -> DataFrame:
    parts = {"p": C.pitcher_counts(events), "a": C.pitcher_arsenal_counts(events)}
    sums = _profile_sums(parts, "pitcher_id", base="p")
    return rest_days(rates.pitcher_arsenal_rates(rates.pitching_rates(sums)), "pitcher_id")
