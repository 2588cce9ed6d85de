"""Value bets: outcomes priced above what the model thinks they are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.match import days, ntz
from touchline.functions.odds import edge, expected_value, has_odds, kelly, predicted_outcome
from touchline.operators.joins import match_names
from touchline.schema import ODDS, OUTCOMES, PROBS


def outcome_unpivot(df: DataFrame) -> DataFrame:
    """One row per outcome with its class number, probability and odds."""
    cases = [F.struct(F.lit(i).alias("cls"), F.lit(o).alias("outcome"),
                      F.col(p).alias("prob"), F.col(q).alias("odds"))
             for i, (o, p, q) in enumerate(zip(OUTCOMES, PROBS, ODDS))]
    return df.select("*", F.inline(F.array(*cases)))


def upcoming(matches: DataFrame, as_of, ahead: int | None = None) -> DataFrame:
    start = ntz(as_of)
    chosen = (F.col("status") == "SCHEDULED") & (F.col("match_date") >= start)
    if ahead is not None:
        chosen = chosen & (F.col("match_date") <= start + days(ahead))
    return matches.filter(chosen)


def value_bets_predicted(predictions: DataFrame, matches: DataFrame, model_version_id: int | Column, as_of, *,
                         ahead: int = 7, min_ev: float = 0.05, max_odds: float = 10.0,
                         min_confidence: float | None = None, limit: int | None = 20) -> DataFrame:
    """Bets on the predicted outcome of one model's stored predictions, best expected value first."""
    chosen = predictions.filter(F.col("model_version_id") == model_version_id).withColumnRenamed("id", "prediction_id")
    if min_confidence:
        chosen = chosen.filter(F.col("confidence") >= min_confidence)
    games = upcoming(matches, as_of, ahead).filter(has_odds()).withColumnRenamed("id", "match_id")
    pick = F.col("predicted_outcome")

    def of_pick(cols: list[str]) -> Column:
        return F.when(pick == "H", F.col(cols[0])).when(pick == "D", F.col(cols[1])).otherwise(F.col(cols[2]))

    bets = (
        chosen.join(games, "match_id")
        .withColumn("market_odds", of_pick(ODDS))
        .withColumn("predicted_probability", of_pick(PROBS))
        .filter(F.col("market_odds") <= max_odds)
        .withColumn("expected_value", expected_value("predicted_probability", "market_odds"))
        .filter(F.col("expected_value") >= min_ev)
        .select("prediction_id", "match_id", "home_team_id", "away_team_id", "match_date", "predicted_outcome",
                "predicted_probability", "market_odds", "expected_value",
                kelly("predicted_probability", "market_odds").alias("kelly_fraction"), "confidence")
    )
    return top_by(bets, "expected_value", "prediction_id", limit)


def value_bets_all_outcomes(scored: DataFrame, teams: DataFrame, as_of, *, ahead: int = 7, min_edge: float = 0.05,
                            limit: int | None = 20) -> DataFrame:
    """Every outcome of upcoming matches whose edge reaches ``min_edge``; ``scored`` has match columns and probabilities."""
    bets = (
        outcome_unpivot(upcoming(scored, as_of, ahead).filter(has_odds()))
        .filter(F.col("odds") > 1)
        .withColumn("edge", edge("prob", "odds"))
        .filter(F.col("edge") >= min_edge)
        .withColumn("expected_value", expected_value("prob", "odds"))
    )
    named = match_names(bets, teams)
    return top_by(
        named.select("match_id", "home_team", "away_team", "match_date", F.col("outcome").alias("bet_type"),
                     F.col("prob").alias("model_probability"), F.col("odds").alias("market_odds"),
                     "edge", "expected_value"),
        "edge", "match_id", limit, "bet_type")


def top_by(df: DataFrame, score: str, tie: str, limit: int | None, *more: str) -> DataFrame:
    """Highest ``score`` first with a stable tie order; a top-k, so no full sort is needed."""
    ranked = df.orderBy(F.col(score).desc(), tie, *more)
    return ranked.limit(limit) if limit is not None else ranked


def value_bet_summary(bets: DataFrame) -> DataFrame:
    return bets.agg(
        F.count("*").alias("bets"), F.avg("expected_value").alias("avg_ev"), F.avg("market_odds").alias("avg_odds"),
        F.avg("kelly_fraction").alias("avg_kelly"))


def write_value_bets_json(bets: DataFrame, path: str) -> None:
    bets.write.mode("overwrite").json(path)


def value_bets_json(bets: DataFrame) -> DataFrame:
    return bets.select(F.to_json(F.struct(*bets.columns)).alias("value_bet"))


def with_pick(df: DataFrame) -> DataFrame:
    """Predicted outcome and confidence from the three probabilities."""
    return df.withColumn("predicted_outcome", predicted_outcome()).withColumn("confidence", F.greatest(*PROBS))


# The baseline's probabilities.
CONSTANT_PROBS = (0.40, 0.30, 0.30)


def constant_predictions(matches: DataFrame, predictions: DataFrame, model_version_id: int) -> DataFrame:
    """The fixed baseline prediction for every match this model has not predicted yet."""
    from touchline.operators.joins import unpredicted_matches

    rows = unpredicted_matches(matches, predictions, model_version_id).select(
        F.col("id").alias("match_id"), F.lit(model_version_id).alias("model_version_id"),
        *[F.lit(v).alias(p) for v, p in zip(CONSTANT_PROBS, PROBS)])
    return with_pick(rows)
