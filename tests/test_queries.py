"""Registered queries against their oracle SQL; all of them with TOUCHLINE_ALL=1."""

import os

import pytest
from checker import SF, compare, connect

from __spark_entry__ import entry, oracle_sql, queries

CHOSEN = """C1_feature_matrix C2_value_bets_all_outcomes C3_value_bets_predicted F2_odds_features F5_calendar W1_team_form W5_h2h_stats
W7_fixture_density_true_14d W16_tournament_context J11_team_history_asof J12_h2h_asof J15_match_detail A4_db_stats A6_feature_schema_stats
A10_dashboard_stats A16_league_table E5_confusion E11_betting_sim E13_max_drawdown E17_calibration_bins_quantile E26_evaluate_predictions
E30_auc E30_ndcg E31_drift_alerts M2_temporal_split_gap_compat M4_expanding_split M5_season_split M8_impute_median M11_pipeline S4_feature_store_write
S5_pages_to_results S6_pages_to_upcoming J17_upsert_upcoming J18_insert_results_update P9_upcoming_cli P12_dq_rules X1_stream_upsert
X2_stream_job_stats X3_stream_value_bets C4_backtest C12_rules_fallback""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(oracle_sql()) if os.environ.get("TOUCHLINE_ALL") else CHOSEN)
def test_query_equals_oracle(spark, con, key):
    assert compare(queries()[key](spark, SF), con, oracle_sql()[key]) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() == 4


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
