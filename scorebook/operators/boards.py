"""Leaderboards, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.predicates import at_latest
from scorebook.functions.rates import ratio
from scorebook.operators.windows import PA, first_per


def _board(df: DataFrame, players: DataFrame, season: int, key: str, volume: str, cols: list[Column],
           limit: int, offset: int, hand: str) -> DataFrame:
    """Top of the season by volume: filter, one top-k, then the player names of those rows only."""
    rows = at_latest(df.where(F.col("season") == season), "game_date", ["season"]).where(F.col(volume) >= 1)
    top = rows.select(key, "game_date", *cols).orderBy(F.col(volume).desc(), key).offset(offset).limit(limit)
    names = players.select(F.col("player_id").alias(key), "full_name", "team_name", "position", hand)
    return top.join(names, key, "left").orderBy(F.col(volume).desc(), key)


def batter_board(df: DataFrame, players: DataFrame, season: int, limit: int = 50, offset: int = 0) -> DataFrame:
    cols = [F.col("s_pa"), F.col("c_pa")]
    for s, span in (("s", "season"), ("c", "career")):
        cols += [F.col(f"{span}_{n}") for n in ("ba", "obp", "slg", "ops", "woba", "k_pct", "bb_pct")]
        bip = F.col(f"{s}_bip_vs_l") + F.col(f"{s}_bip_vs_r")
        cols += [ratio(F.col(f"{s}_ev_sum_vs_l") + F.col(f"{s}_ev_sum_vs_r"), bip).alias(f"{span}_avg_ev"),
                 ratio(F.col(f"{s}_barrel_vs_l") + F.col(f"{s}_barrel_vs_r"), bip).alias(f"{span}_barrel_pct")]
    return _board(df, players, season, "batter_id", "s_pa", cols, limit, offset, "bats")


def pitcher_board(df: DataFrame, players: DataFrame, season: int, limit: int = 50, offset: int = 0) -> DataFrame:
    cols = [F.col("s_bf"), F.col("c_bf")]
    for span in ("season", "career"):
        cols += [F.col(f"{span}_{n}") for n in ("ip", "whip", "k_pct", "bb_pct", "hr9", "woba")]
    return _board(df, players, season, "pitcher_id", "s_bf", cols, limit, offset, "throws")


def order_horizons(df: DataFrame, col: str = "horizon") -> DataFrame:
    """Sorted by the number inside the label."""
    return df.orderBy(F.regexp_extract(col, r"(\d+)", 1).cast("int"), col)


def hash_order(*cols, seed: int) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def sample_pa(df: DataFrame, seed: int = 42, order: list[Column] | None = None) -> DataFrame:
    """One row per plate appearance, chosen by a seeded hash of its pitch number.

    Only key columns pass through the choice; wide rows are fetched by key afterwards.
    """
    keys = [*PA, "pitch_number"]
    order = order or [hash_order("pitch_number", seed=seed), F.col("pitch_number")]
    return sample_rows(df, first_per(df.select(*keys), PA, order), keys)


def sample_rows(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(chosen.select(*keys), keys, "left_semi")


def stratified(df: DataFrame, cols: list[str], k: int, seed: int = 42, order: list[Column] | None = None,
               row: list[str] = ()) -> DataFrame:
    """At most ``k`` rows per stratum, by a seeded hash of the row key."""
    return first_per(df, cols, order or [hash_order(*row, seed=seed), *[F.col(c) for c in row]], k)


def max_games(df: DataFrame, n: int, seed: int = 42, key: str = "game_pk",
              order: list[Column] | None = None) -> DataFrame:
    """All rows of at most ``n`` pseudo-randomly chosen games."""
    keys = df.select(key).distinct().orderBy(*(order or [hash_order(key, seed=seed), F.col(key)])).limit(n)
    return df.join(keys, key, "left_semi")


def split3(df: DataFrame, label: str, row: list[str], test: float = 0.2, calib: float = 0.25, seed: int = 42,
           order: Column | None = None, buckets: int = 1024) -> DataFrame:
    """Train/calibrate/test split with equal class shares in every part.

    Rows are ranked within their class by a hash, in two steps: rank inside (class, hash bucket)
    plus the sizes of the buckets before it. A class holding most of the rows is thus spread
    over ``buckets`` tasks, and the shares are exact.
    """
    h = order if order is not None else F.pmod(hash_order(*row, seed=seed), F.lit(1 << 40))
    rows = df.withColumn("__h", h).withColumn("__b", F.pmod(F.floor(F.col("__h") / (1 << 10)), F.lit(buckets)))
    inside = Window.partitionBy(label, "__b").orderBy("__h", *row)
    across = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    sizes = sizes.select(label, "__b", F.coalesce(F.sum("__c").over(across), F.lit(0)).alias("__before"),
                         F.sum("__c").over(Window.partitionBy(label)).alias("__size"))
    ranked = rows.withColumn("__r", F.row_number().over(inside)).join(sizes, [label, "__b"])
    rank = F.col("__r") + F.col("__before")
    n_test = F.round(F.col("__size") * test)
    n_calib = F.round((F.col("__size") - n_test) * calib)
    part = F.when(rank <= n_test, "test").when(rank <= n_test + n_calib, "calibrate").otherwise("train")
    return ranked.withColumn("split", part).drop("__h", "__b", "__r", "__before", "__size")


def encode(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Index of each class in sorted order; only the distinct classes are ranked. A NULL label has a NULL index."""
    classes = df.where(F.col(label).isNotNull()).select(label).distinct().select(
        label, (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias(out))
    return df.join(classes, label, "left")


# --- lineups -----------------------------------------------------------------

def pas_before(events: DataFrame, entries: DataFrame, entry: str = "entry_ab") -> DataFrame:
    """First pitch of each appearance before the entry point, with the sides it concerns."""
    e = events.join(entries, "game_pk").where(F.col("at_bat_number") < F.col(entry))
    rows = first_per(e, ["game_pk", entry, "at_bat_number"], [F.col("pitch_number").asc()])
    top = F.col("inning_topbot") == "Bot"
    return rows.select("game_pk", entry, "at_bat_number", "batter_id", "pitcher_id",
                       F.when(top, "home").otherwise("away").alias("batting_side"),
                       F.when(top, "away").otherwise("home").alias("pitching_side"))


def seen_lineup(pas: DataFrame, entry: str = "entry_ab", size: int = 9) -> DataFrame:
    """Last ``size`` distinct batters of each side in order of first appearance.

    Only sides that have seen ``size`` batters are rebuilt this way; others still use the card.
    """
    keys = ["game_pk", entry, "batting_side"]
    first = pas.groupBy(*keys, "batter_id").agg(F.min("at_bat_number").alias("first_ab"))
    seen = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= size)
    kept = first_per(first.join(seen.drop("__n"), keys), keys, [F.col("first_ab").desc()], size)
    slot = F.row_number().over(Window.partitionBy(*keys).orderBy("first_ab"))
    return kept.select("game_pk", entry, F.col("batting_side").alias("side"), F.col("batter_id").alias("player_id"),
                       slot.alias("slot"))


def mid_game_lineup(pas: DataFrame, roster: DataFrame, entries: DataFrame, entry: str = "entry_ab") -> DataFrame:
    """Lineup at the entry point: rebuilt where nine batters were seen, else the starting card."""
    seen = seen_lineup(pas, entry)
    card = starting_lineup(roster).join(entries, "game_pk").select("game_pk", entry, "side", "player_id", "slot")
    card = card.join(seen.select("game_pk", entry, "side").distinct(), ["game_pk", entry, "side"], "left_anti")
    return seen.unionByName(card.where(F.col("slot") <= 9))


def mid_game_pitchers(pas: DataFrame, roster: DataFrame, entries: DataFrame, entry: str = "entry_ab") -> DataFrame:
    """Pitchers used per side; the current one is the last that newly came in."""
    keys = ["game_pk", entry, "pitching_side"]
    used = pas.groupBy(*keys, "pitcher_id").agg(F.min("at_bat_number").alias("first_ab")).select(
        "game_pk", entry, F.col("pitching_side").alias("side"), F.col("pitcher_id").alias("player_id"), "first_ab")
    last = used.groupBy("game_pk", entry, "side").agg(F.max("first_ab").alias("first_ab")).withColumn(
        "is_current", F.lit(True))
    out = used.join(last, ["game_pk", entry, "side", "first_ab"], "left").fillna({"is_current": False})
    starters = roster.where("is_starting_pitcher").join(entries, "game_pk").select(
        "game_pk", entry, "side", "player_id", F.lit(0).alias("first_ab"), F.lit(True).alias("is_current"))
    none = starters.join(used.select("game_pk", entry, "side").distinct(), ["game_pk", entry, "side"], "left_anti")
    return out.select(*none.columns).unionByName(none)


def starting_lineup(roster: DataFrame) -> DataFrame:
    """Batters in order; ``slot`` counts 1..9 however the card numbers them."""
    order = Window.partitionBy("game_pk", "side").orderBy("batting_order")
    return roster.where(F.col("batting_order").isNotNull()).select(
        "game_pk", "side", "player_id", F.row_number().over(order).alias("slot"))


def starting_pitchers(roster: DataFrame) -> DataFrame:
    return roster.where("is_starting_pitcher").select("game_pk", "side", "player_id")


def bullpen(roster: DataFrame, lineup: DataFrame, used: DataFrame) -> DataFrame:
    """Pitchers of the roster neither in the lineup nor used, the current one included."""
    pool = roster.where(F.col("position") == "P").select("game_pk", "side", "player_id")
    keys = ["game_pk", "player_id"]
    return pool.join(lineup.select(*keys), keys, "left_anti").join(used.select(*keys), keys, "left_anti")
