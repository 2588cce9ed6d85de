"""Relational joins between matches, dimensions, predictions and models.

Join strategies are left to Catalyst: dimension sides are broadcast when their size
statistics allow it, hot keys are split by adaptive skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.match import days, is_finished, match_result, ntz


def match_names(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Add ``home_team`` and ``away_team`` names."""
    home = teams.select(F.col("id").alias("home_team_id"), F.col("name").alias("home_team"))
    away = teams.select(F.col("id").alias("away_team_id"), F.col("name").alias("away_team"))
    return matches.join(home, "home_team_id").join(away, "away_team_id")


def first_hit(dim: DataFrame, text: str) -> DataFrame:
    """The dimension row with the lowest id whose name contains ``text`` in any case."""
    return dim.filter(F.col("name").ilike(f"%{text}%")).agg(F.min("id").alias("id"))


def match_info(matches: DataFrame, tournaments: DataFrame, seasons: DataFrame, teams: DataFrame, *,
               tournament: str | None = None, season: str | None = None, team: str | None = None,
               status: str | None = None) -> DataFrame:
    """Matches with names; rows without tournament or season vanish. Order and page it with ``page``."""
    rows = matches
    if tournament:
        rows = rows.join(first_hit(tournaments, tournament).withColumnRenamed("id", "tournament_id"),
                         "tournament_id", "left_semi")
    if season:
        rows = rows.join(first_hit(seasons, season).withColumnRenamed("id", "season_id"), "season_id", "left_semi")
    if team:
        hit = first_hit(teams, team).scalar()
        rows = rows.filter((F.col("home_team_id") == hit) | (F.col("away_team_id") == hit))
    if status:
        rows = rows.filter(F.col("status") == status)
    t = tournaments.select(F.col("id").alias("tournament_id"), F.col("name").alias("tournament_name"))
    s = seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season_name"))
    return match_names(rows.join(t, "tournament_id").join(s, "season_id"), teams).select(
        "id", "home_team", "away_team", "match_date", "status", "home_score", "away_score",
        "tournament_name", "season_name")


def prediction_match(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    games = matches.withColumnRenamed("id", "match_id")
    return predictions.withColumnRenamed("id", "prediction_id").join(games, "match_id")


def upcoming_predictions(predictions: DataFrame, matches: DataFrame, models: DataFrame, as_of, ahead: int = 7) -> DataFrame:
    """Predictions of scheduled matches in the window, with nested match and model."""
    start = ntz(as_of)
    games = matches.filter((F.col("status") == "SCHEDULED") & F.col("match_date").between(start, start + days(ahead)))
    game = games.select(F.col("id").alias("match_id"), F.struct(*games.columns).alias("match"))
    model = models.select(F.col("id").alias("model_version_id"), F.struct(*models.columns).alias("model"))
    return predictions.join(game, "match_id").join(model, "model_version_id")


def prediction_history(predictions: DataFrame, matches: DataFrame, *, start=None, end=None) -> DataFrame:
    """Predictions of finished matches with the actual result, newest first."""
    rows = predictions
    if start is not None:
        rows = rows.filter(F.col("predicted_at") >= ntz(start))
    if end is not None:
        rows = rows.filter(F.col("predicted_at") <= ntz(end))
    return (
        prediction_match(rows, matches.filter(is_finished()))
        .withColumn("actual_result", match_result())
        .orderBy(F.col("predicted_at").desc(), "prediction_id")
    )


def unpredicted_matches(matches: DataFrame, predictions: DataFrame, model_version_id: int | Column) -> DataFrame:
    done = predictions.filter(F.col("model_version_id") == model_version_id).select(F.col("match_id").alias("id"))
    return matches.join(done, "id", "left_anti")


def tournament_team_ids(matches: DataFrame, tournament_id: int | None = None) -> DataFrame:
    """Distinct (tournament, team) pairs from both sides of each match."""
    rows = matches if tournament_id is None else matches.filter(F.col("tournament_id") == tournament_id)
    home = rows.select("tournament_id", F.col("home_team_id").alias("team_id"))
    away = rows.select("tournament_id", F.col("away_team_id").alias("team_id"))
    return home.union(away).distinct()


def teams_in_tournament(teams: DataFrame, matches: DataFrame, tournament_id: int) -> DataFrame:
    ids = tournament_team_ids(matches, tournament_id).select(F.col("team_id").alias("id"))
    return teams.join(ids, "id", "left_semi").orderBy("name", "id")


def match_detail(matches: DataFrame, tournaments: DataFrame, seasons: DataFrame, teams: DataFrame) -> DataFrame:
    """Matches with optional tournament and season and both teams; NULL dimensions stay.

    The parts that grow per match come as their own frames: ``match_predictions`` and
    ``history.h2h_asof`` (last five meetings), both keyed by match.
    """
    t = tournaments.select(F.col("id").alias("tournament_id"), F.col("name").alias("tournament_name"),
                           F.col("country").alias("country"))
    s = seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season_name"))
    rows = matches.join(t, "tournament_id", "left").join(s, "season_id", "left")
    return match_names(rows, teams).withColumn("result", match_result(require_finished=True))


def match_predictions(predictions: DataFrame, models: DataFrame, match_ids: DataFrame | None = None) -> DataFrame:
    """All predictions of the wanted matches with their model version, newest first per match."""
    rows = predictions if match_ids is None else predictions.join(match_ids, "match_id", "left_semi")
    m = models.select(F.col("id").alias("model_version_id"), "version", "algorithm")
    return rows.withColumnRenamed("id", "prediction_id").join(m, "model_version_id", "left")
