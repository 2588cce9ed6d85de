"""Row validation: rules as violation codes, bad rows quarantined with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.match import ntz
from touchline.schema import MATCH_STATUSES, ODDS, OUTCOMES, PROBS

# Limits of the match quality rules.
ODDS_RANGE, MARGIN_RANGE, MAX_SCORE, OLDEST = (1.01, 100.0), (1.0, 1.3), 15, "1990-01-01 00:00:00"


def _outside(c: str, low: float, high: float) -> Column:
    return (F.col(c) < low) | (F.col(c) > high)


def prediction_rules() -> dict[str, Column]:
    rules = {f"{p}_range": _outside(p, 0, 1) for p in [*PROBS, "confidence"]}
    return {**rules, "outcome_domain": ~F.col("predicted_outcome").isin(*OUTCOMES)}


def match_domain_rules() -> dict[str, Column]:
    return {"status_domain": ~F.col("status").isin(*MATCH_STATUSES)}


def model_rules() -> dict[str, Column]:
    return {"accuracy_range": _outside("accuracy", 0, 1)}


def value_bet_rules() -> dict[str, Column]:
    return {"expected_value_range": _outside("expected_value", -1, 100)}


def match_quality_rules(as_of) -> dict[str, Column]:
    """Odds, margin, score, date and team rules; ``*_known`` flags come from ``with_known_teams``."""
    raw = 1 / F.col(ODDS[0]) + 1 / F.col(ODDS[1]) + 1 / F.col(ODDS[2])
    rules = {f"{o}_range": _outside(o, *ODDS_RANGE) for o in ODDS}
    rules["odds_margin"] = (raw <= MARGIN_RANGE[0]) | (raw >= MARGIN_RANGE[1])
    rules |= {f"{s}_range": _outside(s, 0, MAX_SCORE) for s in ("home_score", "away_score")}
    return {**rules, "date_in_future": F.col("match_date") > ntz(as_of), "date_too_old": F.col("match_date") <= ntz(OLDEST),
            "same_teams": F.col("home_team_id") == F.col("away_team_id"),
            "unknown_team": ~(F.col("home_known") & F.col("away_known"))}


def with_known_teams(matches: DataFrame, teams: DataFrame) -> DataFrame:
    for side in ("home", "away"):
        known = teams.select(F.col("id").alias(f"{side}_team_id"), F.lit(True).alias(f"{side}_known"))
        matches = matches.join(known, f"{side}_team_id", "left").withColumn(
            f"{side}_known", F.coalesce(f"{side}_known", F.lit(False)))
    return matches


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the codes of broken rules. A rule over NULL is not broken."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


def good_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") == 0).drop("violations")


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("violations") > 0)
