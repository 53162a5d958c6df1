"""The feature vector: pitch state with the profiles known before the game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook import constants as K
from scorebook.functions import features as N
from scorebook.operators.joins import asof_join

STATE_FEATURES = [f for f in N.BLOCKS["game_state"]]


def platoon_columns(hand: str, prefix: str, names: list[str], source: str) -> list[Column]:
    """``<prefix><name>`` as the variant of ``name`` against ``hand``; inputs are ``<source><name>_vs_l/_vs_r``.

    Anything but ``L``, NULL included, takes the right-handed variant.
    """
    return [F.expr(f"CASE WHEN {hand} = 'L' THEN {source}{n}_vs_l ELSE {source}{n}_vs_r END").alias(f"{prefix}{n}")
            for n in names]


def _split_names(names: list[str]) -> list[str]:
    return [f"{s}_{n}" for n in names for s in N.SPANS]


def _groups(stem: str) -> list[str]:
    return [f"{stem}_vs_{g}" for g in K.PITCH_GROUPS]


BATTER_SPLIT = _split_names(N.BATTING + _groups("woba") + _groups("gb_pct") + _groups("fb_pct") + _groups("ld_pct")
                            + N.CONTACT + _groups("chase_rate") + _groups("whiff_rate"))
BATTER_PLAIN = ["s_pa", "c_pa"]
PITCHER_SPLIT = _split_names(N.PITCHING) + [f"{s}_{t.lower()}_pct" for t in K.PITCH_TYPES for s in N.SPANS]
PITCHER_PLAIN = (["s_bf", "c_bf"] + [f"{s}_{t.lower()}_{k}" for k in ("velo", "spin") for t in K.PITCH_TYPES for s in N.SPANS]
                 + _split_names(["arm_angle", "extension"]))


def feature_vectors(state: DataFrame, batters: DataFrame, pitchers: DataFrame, strict: bool = True,
                    appearances: DataFrame | None = None) -> DataFrame:
    """Keys, 172 features and the target of every pitch with an earlier profile on both sides.

    Only the columns the vector uses leave the profiles. Each as-of match is resolved on
    (player, date) pairs and fetched by equality, see :func:`asof_join`. Those pairs are read from
    ``appearances``, the events behind ``state``, or from ``state`` itself.
    """
    pairs = state if appearances is None else appearances
    b_cols = [f"{n}_vs_{h}" for n in BATTER_SPLIT for h in ("l", "r")] + BATTER_PLAIN
    p_cols = [f"{n}_vs_{h}" for n in PITCHER_SPLIT for h in ("l", "r")] + PITCHER_PLAIN + ["pitcher_rest_days"]
    b = batters.selectExpr("batter_id", "game_date", *[f"{c} AS b_{c}" for c in b_cols])
    p = pitchers.selectExpr("pitcher_id", "game_date", *[f"{c} AS p_{c}" for c in p_cols])
    # The hand is chosen right after each join: one variant instead of two travels on.
    keys = ["game_pk", "at_bat_number", "pitch_number", "game_date"]
    rows = asof_join(state, b, ["batter_id"], "game_date", "game_date", strict, probes=pairs).select(
        *keys, "pitcher_id", "bat_side", *STATE_FEATURES, "target",
        *platoon_columns("pitch_hand", "bat_", BATTER_SPLIT, "b_"),
        *[F.expr(f"b_{c} AS bat_{c}") for c in BATTER_PLAIN])
    batter_features = [f"bat_{c}" for c in BATTER_SPLIT + BATTER_PLAIN]
    return asof_join(rows, p, ["pitcher_id"], "game_date", "game_date", strict, probes=pairs).select(
        *keys, *STATE_FEATURES, *batter_features,
        *platoon_columns("bat_side", "pit_", PITCHER_SPLIT, "p_"),
        *[F.expr(f"p_{c} AS pit_{c}") for c in PITCHER_PLAIN],
        F.col("p_pitcher_rest_days").alias("pit_rest_days"), "target")


def exit_training(state: DataFrame, pitchers: DataFrame, since: str = "2018-01-01") -> DataFrame:
    """One row per plate appearance with the label whether the pitcher was replaced after it."""
    from scorebook.operators.windows import pull_labels, re_features, terminal_pitch

    cols = ["game_pk", "at_bat_number", "pitch_number", "game_date", "pitcher_id", "is_bottom", "inning", "outs",
            "runner_1b", "runner_2b", "runner_3b", "run_diff", "times_through_order", "pitcher_bf_game",
            "pitcher_outing_walks", "pitcher_outing_hits", "pitcher_outing_k", "pitcher_outing_runs",
            "pitcher_outing_whip", "pitcher_recent_whip"]
    pas = terminal_pitch(state.where(F.col("target").isNotNull()).select(*cols)).drop("pitch_number")
    pas = pull_labels(pas)
    known = pitchers.select("pitcher_id", "game_date", "career_avg_bf_per_app", "pitcher_rest_days")
    rows = asof_join(pas, known, ["pitcher_id"], "game_date", "game_date", strict=False)
    rows = rows.where(F.col("game_date") >= F.lit(since).cast("date"))

    def zero(c: str, default=0) -> Column:
        return F.coalesce(F.col(c), F.lit(default))

    rows = rows.select(
        "game_pk", "game_date", "pitcher_id", "is_bottom", "at_bat_number", "pitcher_bf_game", "starter_flag",
        zero("pitcher_outing_runs").alias("outing_runs"), "inning", "run_diff", "outs",
        (F.col("runner_1b") + F.col("runner_2b") + F.col("runner_3b")).alias("runners_on"),
        "runner_1b", "runner_2b", "runner_3b", zero("pitcher_outing_walks").alias("outing_walks"),
        zero("pitcher_outing_hits").alias("outing_hits"), zero("pitcher_outing_k").alias("outing_k"),
        "times_through_order", F.col("pitcher_outing_whip").alias("outing_whip"),
        zero("pitcher_recent_whip", 0.0).alias("pitcher_recent_whip"),
        zero("career_avg_bf_per_app", 20.0).alias("avg_bf_per_app"),
        zero("pitcher_rest_days", -1).alias("pit_rest_days"), "pulled")
    return re_features(rows)
