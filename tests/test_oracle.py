"""Registered queries against their SQL on the smallest tables, and the shape of the registry."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from registry.roles import TABLES
from tools.check_oracle import compare, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

# One query per family here; tools/check_oracle.py runs them all.
SAMPLE = [
    "d1_batter_counts", "d6_pitcher_counts", "d5_discipline_counts", "e14_cumulate_incremental", "d8_batting_rates", "c3_pitcher_profile_fused",
    "e2_game_state", "e13_pull_label", "e18_re_change", "c5_asof_strict", "c6_asof_inclusive", "c5_asof_bucketed", "d12_transitions",
    "d11_win_expectancy", "c16_we_lookup", "c19_apply_calibration", "d18_brier_decomposition", "d20_brier_by_stratum", "d24_horizon_diagnostics",
    "d27_sim_distribution", "d33_eligible_horizons", "d42_pareto", "e20_polls_per_change", "e21_actual_horizons", "e22_mid_game_lineup",
    "a5_flatten_plays", "a7_flatten_boxscore", "a14_upsert_partitions", "a28_eval_convergence", "i3_game_detail", "i6_transitions",
    "i6_transitions_stream", "j4_split3", "j10_binary_report",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert compare(rows_of(df.columns, df.collect()), rows_of(cols, cur.fetchall())) == "ok"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 190


def test_feature_vector_width():
    from scorebook.functions.features import ALL_FEATURES

    assert len(ALL_FEATURES) == 172
