"""The full feature matrix: form, head-to-head, odds and calendar, one row per match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.match import calendar
from touchline.functions.odds import odds_features
from touchline.operators.history import H2H_COLUMNS, WINDOWS, form_columns, team_features, with_h2h
from touchline.plans.ordering import BLOCK_ROWS

# Feature names in their declared order.
ODDS_COLUMNS = ["implied_prob_home", "implied_prob_draw", "implied_prob_away", "bookmaker_margin", "odds_home_away_ratio",
                "favorite_outcome", "favorite_implied_prob", "odds_quality_score"]
TEMPORAL_COLUMNS = ["day_of_week", "month", "is_weekend", "days_from_season_start", "home_rest_days", "away_rest_days",
                    "rest_days_diff", "home_matches_last_14_days", "away_matches_last_14_days"]


def feature_columns(windows: Sequence[int] = WINDOWS) -> list[str]:
    """The declared order; 65 names with the default windows."""
    return [*form_columns(windows), *H2H_COLUMNS, *ODDS_COLUMNS, *TEMPORAL_COLUMNS]


def row_features() -> dict:
    """Features that need only the match row itself."""
    return {**odds_features(), **calendar()}


def feature_matrix(matches: DataFrame, windows: Sequence[int] = WINDOWS, *, keep: Sequence[str] = (),
                   asked: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All features keyed by ``match_id``; ``keep`` names match columns to carry along.

    With a boolean match column ``asked`` only matches where it is true get features; all others are their history.

    Odds and calendar columns ride on the head-to-head pass, so there are two history
    exchanges (by team, by pair) and one join on the match id.
    """
    pairs = with_h2h(matches, asked=asked, block_rows=block_rows)
    pairs = pairs.select("match_id", *keep, *H2H_COLUMNS, *[c.alias(n) for n, c in row_features().items()])
    teams = team_features(matches, windows, asked=asked, block_rows=block_rows)
    return pairs.join(teams, "match_id").select("match_id", *keep, *[
        F.col(c).cast("double").alias(c) for c in feature_columns(windows)])


def compose_features(sets: Sequence[DataFrame]) -> DataFrame:
    """Full outer join of feature sets on the match id."""
    out = sets[0]
    for other in sets[1:]:
        out = out.join(other, "match_id", "full")
    return out


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in expected if c not in have]


def ensure_features(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Add absent feature columns as 0.0 and put all in the declared order."""
    added = {c: F.lit(0.0) for c in missing_columns(df, expected)}
    return (df.withColumns(added) if added else df).select("match_id", *expected)
