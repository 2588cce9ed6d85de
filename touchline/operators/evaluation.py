"""Classification, betting and ranking metrics of stored or fresh predictions.

All functions read a scored frame: keys, ``label`` and ``pred`` codes, three probability
columns and (for betting) odds and ``match_date``. ``by`` groups it, e.g. per model version.
Everything that can share one pass over the frame does: the classification metrics are
one aggregation whose 3x3 confusion cells give the derived metrics.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.match import encode_target, is_finished, match_result, micros, ntz
from touchline.functions.odds import has_odds
from touchline.operators.value_bets import outcome_unpivot
from touchline.plans.materialize import materialize
from touchline.plans.ordering import BLOCK_ROWS, prefix_sums, with_rank
from touchline.schema import ODDS, OUTCOMES, PROBS

MODEL = ["model_version_id"]
EPS = sys.float_info.epsilon
KELLY_FRACTION = 0.25
MONEY = ["odds", "kelly", "stake", "won", "returned", "profit"]
CELLS = [(i, j) for i in range(3) for j in range(3)]


def scored_frame(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Predictions of finished matches with the coded label and predicted class."""
    games = matches.filter(is_finished()).select(
        F.col("id").alias("match_id"), "match_date", micros().alias("us"), *ODDS,
        encode_target(match_result()).alias("label"))
    picks = predictions.select(
        "match_id", "model_version_id", *PROBS, encode_target("predicted_outcome").alias("pred"))
    return picks.join(games, "match_id")


def prob_of(code: Column | str) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c == 0, F.col(PROBS[0])).when(c == 1, F.col(PROBS[1])).otherwise(F.col(PROBS[2]))


def log_loss_clip(p: Column) -> Column:
    return F.avg(-F.log(F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))))


def log_loss_eps(p: Column) -> Column:
    return F.avg(-F.log(p + 1e-10))


def brier() -> Column:
    """Mean over classes of the mean squared error."""
    errors = [(F.col(p) - (F.col("label") == i).cast("double")) for i, p in enumerate(PROBS)]
    return F.avg((errors[0] * errors[0] + errors[1] * errors[1] + errors[2] * errors[2]) / 3)


def in_top2() -> Column:
    """Fewer than two classes beat the label; on equal probabilities the higher class wins."""
    own = prob_of("label")
    beaten = sum((((F.col(p) > own) | ((F.col(p) == own) & (F.lit(i) > F.col("label")))).cast("int")
                  for i, p in enumerate(PROBS)), F.lit(0))
    return (beaten < 2).cast("double")


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_metrics(scored: DataFrame, by: Sequence[str] = MODEL, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per group with every classification metric and the confusion cells ``c<label><pred>``.

    ``extra`` aggregates ride on the same pass.
    """
    own = prob_of("label")
    sums = scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"),
        log_loss_clip(own).alias("log_loss"), log_loss_eps(own).alias("log_loss_eps"),
        brier().alias("brier_score"), F.avg(in_top2()).alias("top_2_accuracy"), *extra,
        *[F.count_if((F.col("label") == i) & (F.col("pred") == j)).alias(f"c{i}{j}") for i, j in CELLS])
    cell = {(i, j): F.col(f"c{i}{j}") for i, j in CELLS}
    support = [cell[i, 0] + cell[i, 1] + cell[i, 2] for i in range(3)]
    called = [cell[0, j] + cell[1, j] + cell[2, j] for j in range(3)]
    cols: dict[str, Column] = {}
    for i, o in enumerate(OUTCOMES):
        cols[f"support_{o}"] = support[i]
        cols[f"called_{o}"] = called[i]
        cols[f"precision_{o}"] = _safe(cell[i, i], called[i])
        cols[f"recall_{o}"] = _safe(cell[i, i], support[i])
        cols[f"f1_{o}"] = _safe(2 * cell[i, i], support[i] + called[i])
    wide = sums.withColumns(cols)
    present = sum((((F.col(f"support_{o}") + F.col(f"called_{o}")) > 0).cast("int") for o in OUTCOMES), F.lit(0))
    merged: dict[str, Column] = {}
    for m in ("precision", "recall", "f1"):
        parts = [F.col(f"{m}_{o}") for o in OUTCOMES]
        merged[f"{m}_macro"] = (parts[0] + parts[1] + parts[2]) / present
        merged[f"{m}_weighted"] = sum((p * F.col(f"support_{o}") for p, o in zip(parts, OUTCOMES)), F.lit(0.0)) / F.col("n")
    expected = sum((F.col(f"support_{o}") * F.col(f"called_{o}") for o in OUTCOMES), F.lit(0)) / (F.col("n") * F.col("n"))
    merged["cohen_kappa"] = (F.col("accuracy") - expected) / (1 - expected)
    return wide.withColumns(merged)


def confusion(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Always nine cells per group."""
    m = classification_metrics(scored, by)
    return m.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("label"), F.lit(j).alias("pred"), F.col(f"c{i}{j}").alias("n")) for i, j in CELLS])))


def prf_per_class(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    m = classification_metrics(scored, by)
    return m.select(*by, F.inline(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(f"precision_{o}").alias("precision"),
                 F.col(f"recall_{o}").alias("recall"), F.col(f"f1_{o}").alias("f1"),
                 F.col(f"support_{o}").alias("support")) for o in OUTCOMES])))


def outcome_accuracy(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Share correct per predicted class, 0 where a class was never predicted."""
    m = classification_metrics(scored, by)
    return m.select(*by, F.inline(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(f"precision_{o}").alias("accuracy")) for o in OUTCOMES])))


# --- betting -----------------------------------------------------------------------------

def bets(scored: DataFrame, *, stake: float = 1.0, min_edge: float = 0.0,
         kelly_fraction: float = KELLY_FRACTION) -> DataFrame:
    """One row per placed bet. Matches without all three odds place none."""
    b, p = F.col("odds") - 1, F.col("prob")
    kelly = F.when(b > 0, F.greatest(F.lit(0.0), (b * p - (1 - p)) / b) * kelly_fraction).otherwise(F.lit(0.0))
    won = F.col("label") == F.col("cls")
    return (
        outcome_unpivot(scored.filter(has_odds()))
        .filter(p - 1 / F.col("odds") > min_edge)
        .withColumn("kelly", kelly)
        .withColumn("stake", F.when(F.col("kelly") > 0, F.lit(stake) * F.col("kelly")).otherwise(F.lit(stake)))
        .withColumn("won", won)
        .withColumn("returned", F.when(won, F.col("stake") * F.col("odds")).otherwise(F.lit(0.0)))
        .withColumn("profit", F.col("returned") - F.col("stake")))


def betting_sim(placed: DataFrame, by: Sequence[str] = MODEL, extra: Sequence[Column] = ()) -> DataFrame:
    """Totals, rates and the Sharpe ratio of placed bets; ``extra`` aggregates ride on the same pass."""
    won = F.col("won")
    sums = placed.groupBy(*by).agg(
        F.count("*").alias("total_bets"), F.count_if(won).alias("winning_bets"), F.count_if(~won).alias("losing_bets"),
        F.sum("stake").alias("total_stake"), F.sum("returned").alias("total_return"),
        F.coalesce(F.avg(F.when(won, F.col("odds"))), F.lit(0.0)).alias("average_winning_odds"),
        F.coalesce(F.avg(F.when(~won, F.col("odds"))), F.lit(0.0)).alias("average_losing_odds"),
        F.coalesce(F.avg("kelly"), F.lit(0.0)).alias("average_kelly_fraction"),
        F.coalesce(F.avg("profit") / (F.stddev_pop("profit") + 1e-10), F.lit(0.0)).alias("sharpe_ratio"), *extra)
    profit = F.col("total_return") - F.col("total_stake")
    return sums.withColumns({
        "profit_loss": profit,
        "roi_percent": F.when(F.col("total_stake") > 0, profit / F.col("total_stake") * 100).otherwise(F.lit(0.0)),
        "yield_percent": F.when(F.col("total_stake") > 0, profit / F.col("total_stake") * 100).otherwise(F.lit(0.0)),
        "win_rate": _safe(F.col("winning_bets"), F.col("total_bets")),
        "optimal_kelly_fraction": F.when(F.col("average_kelly_fraction") > 0, F.col("average_kelly_fraction") * 4).otherwise(F.lit(0.25))})


def equity_curve(placed: DataFrame, by: Sequence[str] = MODEL, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running profit and its peak in (date, match, class) order, starting from 0."""
    return prefix_sums(placed, by, ["us", "match_id", "cls"], "profit", out="equity", peak="peak", few=True, block_rows=block_rows)


def worst_fall() -> Column:
    """Largest relative fall below the running peak, over an equity curve."""
    fall = F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / (F.col("peak") + 1e-10)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.max(fall)).alias("max_drawdown")


def max_drawdown(placed: DataFrame, by: Sequence[str] = MODEL, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return equity_curve(placed, by, block_rows=block_rows).groupBy(*by).agg(worst_fall())


def betting_metrics(scored: DataFrame, by: Sequence[str] = MODEL, *, min_edge: float = 0.0,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All betting metrics in one aggregation over the equity curve; only what they read is moved."""
    placed = bets(scored, min_edge=min_edge).select(*by, "us", "match_id", "cls", *MONEY)
    return betting_sim(equity_curve(placed, by, block_rows=block_rows), by, [worst_fall()])


# --- bundles and comparisons -------------------------------------------------------------

def evaluate_predictions(scored: DataFrame, by: Sequence[str] = MODEL, *, min_edge: float = 0.0,
                         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Classification, calibration and betting metrics with the date range, one row per group.

    The frame is read several times, so it is written once, with the columns needed: else the join behind it runs again each time.
    """
    from touchline.operators.calibration import ece_mce_sum

    by = list(by)
    needed = ["match_id", "label", "pred", "match_date", "us", *PROBS, *ODDS]
    scored = materialize(scored.select(*by, *[c for c in needed if c not in by]), "scored")
    span = [F.min("match_date").alias("date_from"), F.max("match_date").alias("date_to")]
    return (
        classification_metrics(scored, by, span).join(ece_mce_sum(scored, by), by)
        .join(betting_metrics(scored, by, min_edge=min_edge, block_rows=block_rows), by, "left"))


COMPARED = {"accuracy": "max", "log_loss": "min", "f1_macro": "max", "roi_percent": "max"}


def compare_models(evaluated: DataFrame, key: str = "model_version_id") -> DataFrame:
    """Best model per metric; the first model wins ties, missing betting counts as 0, any other missing metric as the worst."""
    def best(metric: str, how: str) -> Column:
        missing = 0.0 if metric == "roi_percent" else float("inf") if how == "min" else float("-inf")
        value = F.coalesce(F.col(metric).cast("double"), F.lit(missing))
        return F.min(F.struct((value if how == "min" else -value).alias("score"), F.col(key).alias("key")))["key"]

    return evaluated.agg(*[best(m, how).alias(f"best_{m}") for m, how in COMPARED.items()])


# Pass thresholds and their direction.
METRIC_TARGETS = [
    ("accuracy", 0.53, True), ("log_loss", 0.95, False), ("brier_score", 0.20, False), ("f1_macro", 0.45, True),
    ("f1_weighted", 0.50, True), ("top_2_accuracy", 0.76, True), ("cohen_kappa", 0.30, True)]


def metric_targets(metrics: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("target"),
                     (F.col(m) >= t if up else F.col(m) <= t).alias("passed")) for m, t, up in METRIC_TARGETS]
    return metrics.select(*by, F.inline(F.array(*rows)))


def recommendations(evaluated: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """One row per advice code; ``satisfactory`` when nothing is wrong."""
    rules = [
        (F.col("accuracy") < 0.5, "low_accuracy"), (F.col("f1_macro") < 0.4, "low_f1"),
        (F.col("f1_D") < 0.25, "weak_draws"), (F.col("expected_calibration_error") > 0.10, "poor_calibration"),
        (F.col("roi_percent") < 0, "losing_bets"), (F.col("max_drawdown") > 0.3, "deep_drawdown")]
    found = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))
    return evaluated.select(*by, F.explode(
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("satisfactory")))).alias("advice"))


def roc_auc(scored: DataFrame, by: Sequence[str] = MODEL, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One-vs-rest AUC per class from distinct scores; tied scores count half."""
    cases = [F.struct(F.lit(i).alias("cls"), F.col(p).alias("prob"), (F.col("label") == i).cast("long").alias("pos"))
             for i, p in enumerate(PROBS)]
    levels = scored.select(*by, F.inline(F.array(*cases))).groupBy(*by, "cls", "prob").agg(
        F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).cast("double").alias("neg"))
    below = prefix_sums(levels, [*by, "cls"], ["prob"], "neg", out="upto", block_rows=block_rows)
    return below.groupBy(*by, "cls").agg(
        (F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def ndcg_home(scored: DataFrame, by: Sequence[str] = MODEL, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """NDCG of ranking home wins by home probability; tied scores share their mean gain."""
    rows = scored.select(*by, "match_id", (-F.col("prob_home")).alias("score"), (F.col("label") == 0).cast("int").alias("gain"))
    placed = with_rank(rows, ["score", "match_id"], by=by, out="place", block_rows=block_rows)
    placed = placed.withColumn("discount", F.lit(1.0) / F.log2(F.col("place") + 2))
    wins = rows.groupBy(*by).agg(F.sum("gain").alias("wins"))
    placed = placed.join(wins, list(by)) if by else placed.withColumn("wins", wins.select("wins").scalar())
    levels = placed.groupBy(*by, "score").agg(
        (F.avg("gain") * F.sum("discount")).alias("dcg"),
        F.sum(F.when(F.col("place") < F.col("wins"), F.col("discount")).otherwise(F.lit(0.0))).alias("ideal"))
    return levels.groupBy(*by).agg((F.sum("dcg") / F.sum("ideal")).alias("ndcg"))


def period_metrics(scored: DataFrame, cut, by: Sequence[str] = MODEL) -> DataFrame:
    """Accuracy, log loss and ROI share of the frame before and from ``cut``."""
    framed = scored.withColumn("period", F.when(F.col("match_date") < ntz(cut), "baseline").otherwise("recent"))
    keys = [*by, "period"]
    money = bets(framed).groupBy(*keys).agg((F.sum("profit") / F.sum("stake")).alias("roi"))
    quality = framed.groupBy(*keys).agg(
        log_loss_clip(prob_of("label")).alias("log_loss"),
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))
    return quality.join(money, keys, "left")


def drift_alerts(periods: DataFrame, by: Sequence[str] = MODEL, threshold: float = 0.1) -> DataFrame:
    """Alert codes where the recent period falls behind the baseline."""
    def side(name: str) -> DataFrame:
        return periods.filter(F.col("period") == name).select(*by, *[
            F.col(m).alias(f"{name}_{m}") for m in ("log_loss", "accuracy", "roi")])

    both = side("baseline").join(side("recent"), list(by))
    alerts = F.array_compact(F.array(
        F.when(F.col("recent_log_loss") > F.col("baseline_log_loss") * (1 + threshold), F.lit("log_loss_drift")),
        F.when(F.col("recent_accuracy") < F.col("baseline_accuracy") * (1 - threshold), F.lit("accuracy_drift")),
        F.when(F.col("recent_roi") < F.col("baseline_roi") - 0.05, F.lit("roi_drift"))))
    return both.select("*", F.explode_outer(alerts).alias("alert"))


# Penalty factors of the confidence score.
PENALTIES = {"is_newly_promoted": 0.85, "is_derby": 0.90, "is_late_season": 0.95}


def confidence_score(completeness: Column, flags: dict[str, Column] | None = None, expected: int = 50) -> Column:
    """Entropy, completeness and edge-case penalties in one score within [0, 1]."""
    p = [F.col(c) for c in PROBS]
    entropy = -(p[0] * F.log2(p[0] + 1e-10) + p[1] * F.log2(p[1] + 1e-10) + p[2] * F.log2(p[2] + 1e-10))
    penalty = F.lit(1.0)
    for name, flag in (flags or {}).items():
        penalty = penalty * F.when(flag, F.lit(PENALTIES[name])).otherwise(F.lit(1.0))
    score = (1 - entropy / math.log2(3)) * 0.5 + completeness / expected * 0.3 + penalty * 0.2
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


# The uniform guess, what playing at home adds, what playing away costs, and the shift for better form.
UNIFORM, AT_HOME, AWAY, BETTER_FORM = 0.33, 0.10, 0.05, 0.05


def rules_probs(home_form: Column | str = "home_points_last_5", away_form: Column | str = "away_points_last_5") -> list[Column]:
    """Home advantage and better form as fixed shifts of a uniform guess, normalised."""
    better = F.col(home_form) > F.col(away_form) if isinstance(home_form, str) else home_form > away_form
    shift = F.when(better, F.lit(BETTER_FORM)).otherwise(F.lit(0.0))
    h, d, a = F.lit(UNIFORM + AT_HOME) + shift, F.lit(UNIFORM), F.lit(UNIFORM - AWAY) - shift
    total = h + d + a
    return [h / total, d / total, a / total]


def with_fallback(df: DataFrame, score: Column) -> DataFrame:
    """Keep, blend (0.7 / 0.3) or replace the probabilities by the rules, by confidence score."""
    rules = rules_probs()
    df = df.withColumn("confidence_score", score)
    s = F.col("confidence_score")
    return df.withColumns({
        p: F.when(s < 0.4, r).when(s < 0.6, 0.7 * F.col(p) + 0.3 * r).otherwise(F.col(p)) for p, r in zip(PROBS, rules)})


def favourite_baseline(matches: DataFrame) -> DataFrame:
    """The bookmaker's favourite as prediction: normalised odds as probabilities."""
    from touchline.functions.odds import favourite, implied_probs

    p = implied_probs()
    norm = [p["norm_home"], p["norm_draw"], p["norm_away"]]
    return matches.filter(is_finished() & has_odds()).select(
        F.col("id").alias("match_id"), "match_date", micros().alias("us"), *ODDS,
        *[c.alias(n) for c, n in zip(norm, PROBS)],
        favourite(*norm).alias("pred"), encode_target(match_result()).alias("label"))


def class_weights(labels: DataFrame, label: str = "label", beta: float | None = None) -> DataFrame:
    """``n / (k * count)`` per class present, or the effective-number weight when ``beta`` is given."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # one row per class
    if beta is not None:
        weight = (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))
    else:
        weight = F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))
    return counts.withColumn("weight", weight)
