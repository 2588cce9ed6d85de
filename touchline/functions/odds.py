"""Column expressions about odds, probabilities and stakes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.match import col
from touchline.schema import ODDS, PROBS

# Fixed values used where any of the three odds is missing.
DEFAULT_PROBS = {"implied_prob_home": 0.45, "implied_prob_draw": 0.28, "implied_prob_away": 0.27}
DEFAULT_MARGIN, DEFAULT_RATIO, DEFAULT_FAVOURITE, DEFAULT_FAVOURITE_PROB = 0.05, 1.0, 0, 0.45


def has_odds() -> Column:
    return F.col(ODDS[0]).isNotNull() & F.col(ODDS[1]).isNotNull() & F.col(ODDS[2]).isNotNull()


def implied_probs() -> dict[str, Column]:
    """Raw inverse odds, the bookmaker margin and the normalised probabilities; NULL without odds."""
    raw = [1 / F.col(o) for o in ODDS]
    total = raw[0] + raw[1] + raw[2]
    return {
        "raw_home": raw[0], "raw_draw": raw[1], "raw_away": raw[2],
        "odds_margin": total - 1,
        "norm_home": raw[0] / total, "norm_draw": raw[1] / total, "norm_away": raw[2] / total,
    }


def favourite(h: Column, d: Column, a: Column) -> Column:
    """Index of the largest, the first one on ties."""
    return F.when((h >= d) & (h >= a), 0).when(d >= a, 1).otherwise(2)


def odds_quality(bookmakers: Column | str = "num_bookmakers", null_value: float = 1.0) -> Column:
    """Share of five bookmakers, at most 1. Zero counts as one; NULL gives ``null_value``."""
    n = col(bookmakers)
    return F.when(n.isNull(), F.lit(null_value)).when(n == 0, F.lit(0.2)).otherwise(
        F.least(F.lit(1.0), n.cast("double") / 5))


def odds_features(null_quality: float = 1.0) -> dict[str, Column]:
    p, ok = implied_probs(), has_odds()
    norm = (p["norm_home"], p["norm_draw"], p["norm_away"])

    def or_default(value: Column, default) -> Column:
        return F.when(ok, value).otherwise(F.lit(default))

    return {
        "implied_prob_home": or_default(norm[0], DEFAULT_PROBS["implied_prob_home"]),
        "implied_prob_draw": or_default(norm[1], DEFAULT_PROBS["implied_prob_draw"]),
        "implied_prob_away": or_default(norm[2], DEFAULT_PROBS["implied_prob_away"]),
        "bookmaker_margin": or_default(p["odds_margin"], DEFAULT_MARGIN),
        "odds_home_away_ratio": or_default(
            F.when(F.col("odds_away") > 0, F.col("odds_home") / F.col("odds_away")).otherwise(F.lit(1.0)), DEFAULT_RATIO),
        "favorite_outcome": or_default(favourite(*norm), DEFAULT_FAVOURITE),
        "favorite_implied_prob": or_default(F.greatest(*norm), DEFAULT_FAVOURITE_PROB),
        "odds_quality_score": odds_quality(null_value=null_quality),
    }


def odds_transform() -> dict[str, Column]:
    """Balance, draw likelihood and certainty of the normalised market."""
    p = implied_probs()
    return {
        "odds_balance": p["norm_home"] - p["norm_away"],
        "draw_likelihood": p["norm_draw"],
        "market_certainty": F.greatest(p["norm_home"], p["norm_draw"], p["norm_away"]),
    }


def expected_value(prob: Column | str, odds: Column | str) -> Column:
    return col(prob) * col(odds) - 1


def kelly(prob: Column | str, odds: Column | str) -> Column:
    """Kelly stake share, at least 0; 0 for odds of at most 1 or NULL."""
    p, b = col(prob), col(odds) - 1
    return F.when(col(odds) > 1, F.greatest(F.lit(0.0), (b * p - (1 - p)) / b)).otherwise(F.lit(0.0))


def edge(prob: Column | str, odds: Column | str) -> Column:
    return col(prob) - 1 / col(odds)


def predicted_outcome(h: Column | str = PROBS[0], d: Column | str = PROBS[1], a: Column | str = PROBS[2]) -> Column:
    h, d, a = col(h), col(d), col(a)
    return F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")


def confidence(h: Column | str = PROBS[0], d: Column | str = PROBS[1], a: Column | str = PROBS[2]) -> Column:
    return F.greatest(col(h), col(d), col(a))


def double_chance() -> dict[str, Column]:
    h, d, a = (F.col(p) for p in PROBS)
    return {"home_or_draw": h + d, "draw_or_away": d + a, "home_or_away": h + a}


def goal_markets(home_rate: Column | str, away_rate: Column | str) -> dict[str, Column]:
    """Both teams score, and over 2.5 goals, for independent Poisson goal counts."""
    lh, la = col(home_rate), col(away_rate)
    total = lh + la
    return {
        "btts_prob": (1 - F.exp(-lh)) * (1 - F.exp(-la)),
        "over_2_5_prob": 1 - F.exp(-total) * (1 + total + total * total / 2),
    }
