"""Landing tables: append-only Parquet with a load id, and their canonical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook import constants as K
from scorebook.functions.predicates import only_types
from scorebook.operators.windows import dedup_latest

LOAD_ID = "_load_id"


def read_landing(spark: SparkSession, root: str, table: str, suffix: str = "") -> DataFrame:
    """All loads of a landing table; files may differ in columns."""
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{table}{suffix}")


def conform(df: DataFrame, stub_schema: T.StructType | str) -> DataFrame:
    """Same columns as a union by name with a zero-row stub: those old files lack become NULL.

    Written as a projection, so no union node stands between the scan and its filters.
    """
    stub = T.StructType.fromDDL(stub_schema) if isinstance(stub_schema, str) else stub_schema
    have = {f.name: f.dataType for f in df.schema.fields}
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in stub.fields if f.name not in have]
    other = {f.name: F.col(f.name).cast(f.dataType) for f in stub.fields if have.get(f.name, f.dataType) != f.dataType}
    return df.withColumns(other).select("*", *lacking) if other else df.select("*", *lacking)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def append_landing(df: DataFrame, path: str, load_id: str) -> None:
    df.withColumn(LOAD_ID, F.lit(load_id)).write.mode("append").parquet(path)


# Provider's column names (left) and ours; anything else keeps its name (fixed values).
RENAMES = {
    "batter": "batter_id", "pitcher": "pitcher_id", "stand": "bat_side", "p_throws": "pitch_hand",
    "type": "pitch_result_type", "events": "pa_result",
}

# Measurements that older files do not have (fixed values).
LATE_COLUMNS = ("spin_axis double, arm_angle double, bat_speed double, swing_length double, "
                "swing_path_tilt double, attack_angle double, attack_direction double, hyper_speed double, "
                "intercept_ball_minus_batter_pos_x_inches double, intercept_ball_minus_batter_pos_y_inches double")
LATE_TIMED_COLUMNS = "pitch_start_speed double, pitch_plate_x double, pitch_plate_z double"

# Columns of the event table after renaming (fixed values).
EVENT_COLUMNS = """
game_pk at_bat_number pitch_number game_date game_year game_type
batter_id pitcher_id player_name bat_side pitch_hand home_team away_team
inning inning_topbot balls strikes outs_when_up on_1b on_2b on_3b
home_score away_score bat_score fld_score post_home_score post_away_score post_bat_score post_fld_score
home_score_diff bat_score_diff
pitch_type pitch_name pitch_result_type zone
release_speed effective_speed release_spin_rate spin_axis release_pos_x release_pos_y release_pos_z
release_extension pfx_x pfx_z plate_x plate_z vx0 vy0 vz0 ax ay az sz_top sz_bot
api_break_z_with_gravity api_break_x_arm api_break_x_batter_in arm_angle
launch_speed launch_angle launch_speed_angle hit_distance_sc bb_type hit_location hc_x hc_y
bat_speed swing_length swing_path_tilt attack_angle attack_direction hyper_speed
intercept_ball_minus_batter_pos_x_inches intercept_ball_minus_batter_pos_y_inches
pa_result description des
estimated_ba_using_speedangle estimated_woba_using_speedangle estimated_slg_using_speedangle
woba_value woba_denom babip_value iso_value delta_run_exp delta_pitcher_run_exp delta_home_win_exp
home_win_exp bat_win_exp
fielder_2 fielder_3 fielder_4 fielder_5 fielder_6 fielder_7 fielder_8 fielder_9
if_fielding_alignment of_fielding_alignment
age_pit age_bat n_thruorder_pitcher n_priorpa_thisgame_player_at_bat
pitcher_days_since_prev_game batter_days_since_prev_game
""".split()

EVENT_KEY = ["game_pk", "at_bat_number", "pitch_number"]


def canonical_events(landing: DataFrame, keep: list[str] = (LOAD_ID,)) -> DataFrame:
    """Event columns under our names, in our order; late columns are filled with NULL.

    The date becomes a DATE once, here. A column a provider does not send is left out.
    """
    df = conform(landing, LATE_COLUMNS)
    names = {RENAMES.get(c, c): c for c in df.columns}
    cols = [f"CAST({c} AS date) AS {c}" if c == "game_date" else f"{names[c]} AS {c}" for c in EVENT_COLUMNS if c in names]
    return df.selectExpr(*cols, *[c for c in keep if c in names])


def processed_events(landing: DataFrame, order: list[str] = (LOAD_ID,)) -> DataFrame:
    """Regular and postseason pitches, one row per pitch, the latest load winning."""
    df = only_types(canonical_events(landing, keep=list(order)), K.EVENT_GAME_TYPES)
    return dedup_latest(df, EVENT_KEY, [F.col(c).desc() for c in order])


STATUS = "struct<detailedState:string,abstractGameState:string>"
TEAM = "struct<score:int,team:struct<id:int,name:string>>"
TEAMS = f"struct<away:{TEAM},home:{TEAM}>"
VENUE = "struct<id:int,name:string>"


def canonical_games(landing: DataFrame, order: list[str] = (LOAD_ID,)) -> DataFrame:
    """Games with their JSON columns parsed once each, the latest load winning."""
    df = only_types(landing, K.SCHEDULE_GAME_TYPES)
    df = dedup_latest(df, ["game_pk"], [F.col(c).desc() for c in order])
    s, t, v = F.from_json("status", STATUS), F.from_json("teams", TEAMS), F.from_json("venue", VENUE)
    df = df.withColumns({"__s": s, "__t": t, "__v": v})
    return df.select(
        "game_pk", F.col("official_date").cast("date").alias("game_date"), F.col("game_date").alias("game_datetime"),
        "season", "game_type",
        F.col("__s.detailedState").alias("status"), F.col("__s.abstractGameState").alias("abstract_game_state"),
        F.col("__t.away.team.id").alias("away_team_id"), F.col("__t.away.team.name").alias("away_team_name"),
        F.col("__t.home.team.id").alias("home_team_id"), F.col("__t.home.team.name").alias("home_team_name"),
        F.col("__t.away.score").alias("away_score"), F.col("__t.home.score").alias("home_score"),
        F.col("__v.name").alias("venue_name"), F.col("__v.id").alias("venue_id"),
        "day_night", "scheduled_innings", "double_header", *order)


def canonical_timed_events(landing: DataFrame, order: list[str] = (LOAD_ID,)) -> DataFrame:
    """Timed events, de-duplicated first, then with the previous event's end time."""
    from scorebook.operators.windows import event_windows

    df = conform(landing, LATE_TIMED_COLUMNS).where(F.col("game_pk").isNotNull())
    df = dedup_latest(df, ["game_pk", "at_bat_number", "play_event_index"], [F.col(c).desc() for c in order])
    return event_windows(df)
