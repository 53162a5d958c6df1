"""Names of the vector's features, their blocks, and column-list resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorebook.constants import PITCH_GROUPS, PITCH_TYPES

SPANS = ["season", "career"]
BATTING = ["ba", "obp", "slg", "ops", "woba", "k_pct", "bb_pct", "iso", "babip"]
PITCHING = ["whip", "k9", "bb9", "hr9", "h9", "k_pct", "bb_pct", "fip", "babip", "woba", "ip"]
CONTACT = ["avg_ev", "hard_hit_pct", "barrel_pct"]
METADATA = ["game_pk", "at_bat_number", "pitch_number", "game_date", "target"]


def _spans(prefix: str, names: list[str]) -> list[str]:
    return [f"{prefix}_{s}_{n}" for n in names for s in SPANS]


def _by_group(stem: str) -> list[str]:
    return [f"{stem}_vs_{g}" for g in PITCH_GROUPS]


_SITUATION = ["inning", "outs", "runner_1b", "runner_2b", "runner_3b"]
_IN_GAME = ["times_through_order", "batter_prior_pa", "pitcher_bf_game", "batter_ab_vs_pitcher"]
_OUTING = ["pitcher_outing_walks", "pitcher_outing_hits", "pitcher_outing_k",
           "pitcher_outing_runs", "pitcher_outing_whip", "pitcher_recent_whip"]

# Count features and those that carry a home bias are left out of the simulation variant.
SIM_EXCLUDED = ["balls", "strikes", "run_diff", "is_home", "is_bottom", "pitcher_pitch_count"]

BLOCKS: dict[str, list[str]] = {
    "game_state": _SITUATION + SIM_EXCLUDED + _IN_GAME + _OUTING,
    "game_state_no_count": _SITUATION + _IN_GAME + _OUTING,
    "batter_profile": _spans("bat", BATTING) + ["bat_s_pa", "bat_c_pa"],
    "pitcher_profile": _spans("pit", PITCHING) + ["pit_s_bf", "pit_c_bf", "pit_rest_days"],
    "batter_arsenal": _spans("bat", _by_group("woba")),
    "batter_batted_ball": _spans("bat", _by_group("gb_pct") + _by_group("fb_pct") + _by_group("ld_pct")),
    "batter_contact_quality": _spans("bat", CONTACT),
    "batter_discipline": _spans("bat", _by_group("chase_rate") + _by_group("whiff_rate")),
    "pitcher_arsenal": [f"pit_{s}_{t.lower()}_{k}" for k in ("pct", "velo", "spin")
                        for s in SPANS for t in PITCH_TYPES] + _spans("pit", ["arm_angle", "extension"]),
}
ALL_FEATURES = list(dict.fromkeys(f for names in BLOCKS.values() for f in names))


def resolve_features(columns: list[str], mode: str = "auto", blocks: list[str] = (),
                     add: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Feature columns: all but metadata (``auto``), or blocks plus additions (``explicit``)."""
    if mode == "auto":
        names = [c for c in columns if c not in METADATA]
    else:
        names = list(dict.fromkeys([f for b in blocks for f in BLOCKS[b]] + list(add)))
    unknown = [c for c in exclude if c not in names]
    if unknown:
        raise ValueError(f"cannot exclude {unknown}: not among the resolved features")
    names = [c for c in names if c not in set(exclude)]
    if not names:
        raise ValueError("no features left")
    return names


def sim_features(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in SIM_EXCLUDED]


def block_of(feature: str) -> str:
    """Narrowest block naming the feature: ``game_state_no_count`` before ``game_state``."""
    return next((b for b, names in reversed(BLOCKS.items()) if feature in names), "unknown")


def blocks(columns: list[str]) -> dict[str, list[str]]:
    """Features grouped by block, order kept."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(block_of(c), []).append(c)
    return out


def blocks_frame(spark: SparkSession, columns: list[str]) -> DataFrame:
    return spark.createDataFrame([(c, block_of(c)) for c in columns], "feature string, block string")


def align(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns in the model's order, and the names that were dropped."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*features), sorted(set(df.columns) - set(features))
