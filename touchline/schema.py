"""Explicit table schemas and the column lists that other modules rely on."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


L, I, D, S, B, TS = (
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.StringType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)

TOURNAMENT = _schema(("id", L), ("name", S), ("country", S), ("url_slug", S))
SEASON = _schema(("id", L), ("tournament_id", L), ("name", S), ("start_year", I), ("end_year", I))
TEAM = _schema(("id", L), ("name", S))
MATCH = _schema(
    ("id", L), ("tournament_id", L), ("season_id", L), ("home_team_id", L), ("away_team_id", L),
    ("match_date", TS), ("status", S), ("home_score", I), ("away_score", I),
    ("odds_home", D), ("odds_draw", D), ("odds_away", D), ("num_bookmakers", I),
)
MODEL_VERSION = _schema(
    ("id", L), ("version", S), ("algorithm", S), ("is_active", B), ("accuracy", D),
    ("metrics", T.MapType(S, D)), ("hyperparameters", S), ("created_at", TS),
)
PREDICTION = _schema(
    ("id", L), ("match_id", L), ("model_version_id", L), ("prob_home", D), ("prob_draw", D),
    ("prob_away", D), ("predicted_outcome", S), ("confidence", D), ("predicted_at", TS),
)
MODEL_FEATURES = _schema(
    ("match_id", L), ("feature_schema_version", S), ("features", T.MapType(S, D)), ("computed_at", TS),
)
TASK_EXECUTION = _schema(
    ("id", L), ("task_id", L), ("status", S), ("started_at", TS), ("duration_seconds", D), ("matches_scraped", I),
)
RAW_MATCH = _schema(
    ("seq", L), ("tournament_slug", S), ("tournament_name", S), ("country", S), ("home_team", S),
    ("away_team", S), ("match_date", TS), ("home_score", I), ("away_score", I),
    ("odds_home", D), ("odds_draw", D), ("odds_away", D), ("num_bookmakers", I),
)

MATCH_FEATURE_COLUMNS = [f.name for f in MATCH.fields]
ODDS = ["odds_home", "odds_draw", "odds_away"]
PROBS = ["prob_home", "prob_draw", "prob_away"]

# Outcome codes in class order 0, 1, 2.
OUTCOMES = ["H", "D", "A"]
OUTCOME_NAMES = ["Home Win", "Draw", "Away Win"]

MATCH_STATUSES = ["SCHEDULED", "FINISHED", "LIVE"]
