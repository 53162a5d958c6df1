"""Rates from cumulative counts.

``s_``/``c_`` count columns give ``season_``/``career_`` rates, for each hand and, where the
quantity has one, for both hands together. Every denominator goes through NULLIF. Expressions
are Spark SQL texts, see :mod:`scorebook.operators.counts`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook import constants as K

SPANS = {"s": "season", "c": "career"}
BATTING_TOTALS = ["pa", "abs", "hits", "hr", "bb", "k", "hbp", "sf"]
PITCHING_TOTALS = ["bf", "outs", "hits", "hr", "bb", "k", "hbp", "sf", "sh"]


def ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den, F.lit(0))


def _over(num: str, den: str) -> str:
    return f"(double({num}) / nullif({den}, 0))"


def _getter(span: str, hand: str | None) -> Callable[[str], str]:
    """Count by name for one hand, or the sum over both."""
    if hand:
        return lambda n: f"{span}_{n}_vs_{hand}"
    return lambda n: f"({span}_{n}_vs_l + {span}_{n}_vs_r)"


def _batting(g) -> dict[str, str]:
    obp = _over(f"{g('hits')} + {g('bb')} + {g('hbp')}", f"{g('abs')} + {g('bb')} + {g('hbp')} + {g('sf')}")
    slg = _over(f"{g('singles')} + 2 * {g('doubles')} + 3 * {g('triples')} + 4 * {g('hr')}", g("abs"))
    return {
        "ba": _over(g("hits"), g("abs")),
        "obp": obp,
        "slg": slg,
        "ops": f"{obp} + {slg}",
        "woba": _over(g("woba_value"), g("woba_denom")),
        "k_pct": _over(g("k"), g("pa")),
        "bb_pct": _over(g("bb"), g("pa")),
        "iso": _over(f"{g('doubles')} + 2 * {g('triples')} + 3 * {g('hr')}", g("abs")),
        "babip": _over(f"{g('hits')} - {g('hr')}", f"{g('abs')} - {g('k')} - {g('hr')} + {g('sf')}"),
    }


def _contact(g) -> dict[str, str]:
    return {"avg_ev": _over(g("ev_sum"), g("bip")),
            "hard_hit_pct": _over(g("hard_hit"), g("bip")),
            "barrel_pct": _over(g("barrel"), g("bip"))}


def _pitching(g) -> dict[str, str]:
    ip = f"double({g('outs')}) / 3D"
    per_ip = lambda x: f"({x}) / nullif({ip}, 0D)"
    return {
        "ip": ip,
        "whip": per_ip(f"{g('bb')} + {g('hits')}"),
        "k9": per_ip(f"9 * double({g('k')})"),
        "bb9": per_ip(f"9 * double({g('bb')})"),
        "hr9": per_ip(f"9 * double({g('hr')})"),
        "h9": per_ip(f"9 * double({g('hits')})"),
        "k_pct": _over(g("k"), g("bf")),
        "bb_pct": _over(g("bb"), g("bf")),
        "fip": per_ip(f"13 * {g('hr')} + 3 * ({g('bb')} + {g('hbp')}) - 2 * {g('k')}") + f" + {K.FIP_CONSTANT}D",
        "babip": _over(f"{g('hits')} - {g('hr')}",
                       f"{g('bf')} - {g('k')} - {g('hr')} - {g('bb')} - {g('hbp')} + {g('sf')}"),
        "woba": _over(g("woba_value"), g("woba_denom")),
    }


def _label(exprs: dict[str, str], span: str, hand: str | None) -> dict[str, str]:
    tail = f"_vs_{hand}" if hand else ""
    return {f"{SPANS[span]}_{n}{tail}": e for n, e in exprs.items()}


def _add(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in cols.items()])


def batting_rates(df: DataFrame, spans: str = "sc") -> DataFrame:
    cols: dict[str, str] = {}
    for s in spans:
        cols |= {f"{s}_{n}": _getter(s, None)(n) for n in BATTING_TOTALS}
        for h in ("l", "r", None):
            cols |= _label(_batting(_getter(s, h)), s, h)
        for h in ("l", "r"):
            cols |= _label(_contact(_getter(s, h)), s, h)
    return _add(df, cols)


def pitching_rates(df: DataFrame, spans: str = "sc") -> DataFrame:
    cols: dict[str, str] = {}
    for s in spans:
        both, name = _getter(s, None), SPANS[s]
        cols |= {f"{s}_{n}": both(n) for n in PITCHING_TOTALS}
        for h in ("l", "r", None):
            cols |= _label(_pitching(_getter(s, h)), s, h)
        cols |= {f"{name}_avg_bf_per_app": _over(both("bf"), f"{s}_games"),
                 f"{name}_avg_pitches_per_app": _over(f"{s}_pitches", f"{s}_games"),
                 f"{name}_pitches_per_out": _over(f"{s}_pitches", both("outs"))}
    return _add(df, cols)


def batter_arsenal_rates(df: DataFrame, spans: str = "sc") -> DataFrame:
    cols: dict[str, str] = {}
    for s in spans:
        for h in ("l", "r"):
            g = _getter(s, h)
            for p in K.PITCH_GROUPS:
                cols[f"{SPANS[s]}_woba_vs_{p}_vs_{h}"] = _over(g(f"{p}_woba_value"), g(f"{p}_woba_denom"))
                cols |= {f"{SPANS[s]}_{kind}_pct_vs_{p}_vs_{h}": _over(g(f"{p}_{kind}"), g(f"{p}_bip"))
                         for kind in K.BATTED_BALLS}
    return _add(df, cols)


def discipline_rates(df: DataFrame, spans: str = "sc") -> DataFrame:
    cols: dict[str, str] = {}
    for s in spans:
        for h in ("l", "r"):
            g = _getter(s, h)
            for p in K.PITCH_GROUPS:
                cols[f"{SPANS[s]}_chase_rate_vs_{p}_vs_{h}"] = _over(g(f"{p}_chases"), g(f"{p}_ooz"))
                cols[f"{SPANS[s]}_whiff_rate_vs_{p}_vs_{h}"] = _over(g(f"{p}_whiffs"), g(f"{p}_swings"))
    return _add(df, cols)


def pitcher_arsenal_rates(df: DataFrame, spans: str = "sc") -> DataFrame:
    cols: dict[str, str] = {}
    for s in spans:
        name = SPANS[s]
        for t in (t.lower() for t in K.PITCH_TYPES):
            cols |= {f"{name}_{t}_pct_vs_{h}": _over(f"{s}_{t}_n_vs_{h}", f"{s}_pitches_vs_{h}") for h in ("l", "r")}
            cols |= {f"{name}_{t}_{k}": _over(f"{s}_{t}_{k}_sum", f"{s}_{t}_{k}_n") for k in ("velo", "spin")}
        cols |= {f"{name}_{k}": _over(f"{s}_{k}_sum", f"{s}_{k}_n") for k in ("arm_angle", "extension")}
    return _add(df, cols)
