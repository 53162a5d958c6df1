"""They must equal the data provider's codes and published tables."""

# Outcome taxonomy of a plate appearance (fixed values).
OUTCOME_CLASSES = [
    "double", "double_play", "field_out", "fielders_choice", "fielders_choice_out", "force_out",
    "grounded_into_double_play", "hit_by_pitch", "home_run", "sac_bunt", "sac_fly", "single",
    "strikeout", "strikeout_double_play", "triple", "walk",
]
EXCLUDED_OUTCOMES = [
    "catcher_interf", "ejection", "field_error", "game_advisory", "intent_walk",
    "sac_bunt_double_play", "sac_fly_double_play", "triple_play", "truncated_pa",
]
TRUNCATED = "truncated_pa"
HITS = ["single", "double", "triple", "home_run"]
WALKS = ["walk", "intent_walk"]
STRIKEOUTS = ["strikeout", "strikeout_double_play"]
NOT_AT_BAT = ["walk", "intent_walk", "hit_by_pitch", "sac_fly", "sac_bunt"]
ONE_OUT = ["field_out", "strikeout", "force_out", "fielders_choice_out", "sac_fly", "sac_bunt"]
TWO_OUTS = ["grounded_into_double_play", "double_play", "strikeout_double_play"]

# Pitch codes and their groups (fixed values).
PITCH_TYPES = ["FF", "SI", "FC", "SL", "CU", "KC", "SV", "ST", "CH", "FS"]
PITCH_GROUPS = {
    "fb": ["FF", "SI", "FC"],
    "brk": ["SL", "CU", "KC", "SV", "ST"],
    "offspeed": ["CH", "FS"],
}

# Pitch descriptions (fixed values).
SWINGS = [
    "swinging_strike", "swinging_strike_blocked", "foul", "foul_tip",
    "hit_into_play", "hit_into_play_no_out", "hit_into_play_score",
]
WHIFFS = ["swinging_strike", "swinging_strike_blocked"]
BUNTS = ["foul_bunt", "missed_bunt", "bunt_foul_tip"]
OUTSIDE_ZONES = [11, 12, 13, 14]

# Batted-ball kinds (fixed values).
BATTED_BALLS = {"gb": ["ground_ball"], "fb": ["fly_ball", "popup"], "ld": ["line_drive"]}

# Game types kept in the event and in the game tables (fixed values).
EVENT_GAME_TYPES = ["R", "F", "D", "L", "W"]
SCHEDULE_GAME_TYPES = ["R", "F", "D", "L", "W", "S"]
DEAD_STATUSES = ["Postponed", "Cancelled"]

# Run expectancy by base mask (1B=1, 2B=2, 3B=4) and outs; published 2010-2015 averages (fixed values).
RUN_EXPECTANCY = [
    [0.481, 0.254, 0.098],
    [0.859, 0.509, 0.224],
    [1.100, 0.664, 0.319],
    [1.437, 0.884, 0.429],
    [1.350, 0.950, 0.353],
    [1.784, 1.130, 0.478],
    [1.920, 1.352, 0.570],
    [2.282, 1.520, 0.669],
]

# Text of an unresolved ball in play -> (runs, outs) (fixed values).
IN_PLAY_DELTAS = {
    "In play, run(s)": (1, 0),
    "In play, out(s)": (0, 1),
    "In play, no out": (0, 0),
}

RUN_DIFF_LIMIT = 15
LAST_INNING = 9
MIN_SAMPLE = 20
FIP_CONSTANT = 3.20

# The columns of the game state table and their order.
STATE_COLUMNS = [
    "game_pk", "at_bat_number", "pitch_number", "game_date", "batter_id", "pitcher_id", "bat_side", "pitch_hand",
    "inning", "is_bottom", "outs", "runner_1b", "runner_2b", "runner_3b", "balls", "strikes", "run_diff", "is_home",
    "times_through_order", "batter_prior_pa", "pitcher_pitch_count", "pitcher_bf_game", "batter_ab_vs_pitcher",
    "pitcher_outing_walks", "pitcher_outing_hits", "pitcher_outing_k", "pitcher_outing_runs",
    "pitcher_outing_whip", "pitcher_recent_whip", "target",
]
