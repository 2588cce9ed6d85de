"""Calibration tables and errors: how predicted probabilities match observed shares."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.evaluation import MODEL
from touchline.plans.materialize import materialize
from touchline.plans.ordering import quantile_table
from touchline.schema import OUTCOME_NAMES, OUTCOMES, PROBS

BINS = 10
SERIES_TERMS, FRACTION_LEVELS = 120, 80  # to rounding for up to 50 degrees of freedom


def linspace_edges(n_bins: int = BINS) -> list[float]:
    """Edges as i * (1/n) with an exact last edge, so both engines compare the same doubles."""
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def by_class(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """One row per class: probability and whether the class came true."""
    return scored.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("cls"), F.col(p).alias("prob"), (F.col("label") == i).cast("int").alias("hit"))
        for i, p in enumerate(PROBS)])))


def bin_number(p: Column, edges: Sequence[float | Column], closed_first: bool) -> Column:
    """Left-open bins ``(lo, hi]``; the first is ``[lo, hi]`` on request. NULL outside."""
    inner = sum(((p > F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    low = p >= F.lit(edges[0]) if closed_first else p > F.lit(edges[0])
    return F.when(low & (p <= F.lit(edges[-1])), inner)


def _binned(scored: DataFrame, by: Sequence[str], n_bins: int, closed_first: bool) -> DataFrame:
    """Counts and means per class and bin; ``rows`` is the size of the group, also of rows in no bin."""
    edges = linspace_edges(n_bins)
    return (
        by_class(scored, by).withColumn("bin", bin_number(F.col("prob"), edges, closed_first))
        .groupBy(*by, "cls", "bin")
        .agg(F.count("*").alias("n"), F.avg("prob").alias("mean_predicted"), F.avg("hit").alias("mean_actual"))
        .withColumn("rows", F.sum("n").over(Window.partitionBy(*by, "cls")))  # at most n_bins + 1 rows per class
        .filter("bin IS NOT NULL"))


def ece_mce_sum(scored: DataFrame, by: Sequence[str] = MODEL, n_bins: int = BINS) -> DataFrame:
    """ECE summed over classes and left-open bins (up to 3), and the largest bin error."""
    bins = _binned(scored, by, n_bins, closed_first=False)
    gap = F.abs(F.col("mean_predicted") - F.col("mean_actual"))
    return bins.groupBy(*by).agg(
        F.sum(gap * F.col("n") / F.col("rows")).alias("expected_calibration_error"),
        F.max(gap).alias("maximum_calibration_error"))


def calibration_curve(scored: DataFrame, by: Sequence[str] = MODEL, n_bins: int = BINS) -> DataFrame:
    """Mean predicted and actual share of non-empty left-open bins, per class."""
    return _binned(scored, by, n_bins, closed_first=False).select(*by, "cls", "bin", "mean_predicted", "mean_actual")


def calibration_bins(scored: DataFrame, by: Sequence[str] = MODEL, n_bins: int = BINS) -> DataFrame:
    """Uniform bins with a closed first bin; empty bins show their midpoint and 0."""
    keys, found = [*by, "cls"], _binned(scored, by, n_bins, closed_first=True)
    groups = found.select(*keys).distinct().withColumn("edges", F.array(*[F.lit(e) for e in linspace_edges(n_bins)]))
    return _all_bins(groups, found, keys, n_bins)


def _all_bins(groups: DataFrame, found: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """Every bin of every group (keys, edges)."""
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    low, high = F.get("edges", F.col("bin")), F.get("edges", F.col("bin") + 1)
    return grid.join(found, [*keys, "bin"], "left").select(
        *keys, "bin", low.alias("bin_lower"), high.alias("bin_upper"),
        F.coalesce("mean_predicted", (low + high) / 2).alias("mean_predicted"),
        F.coalesce("mean_actual", F.lit(0.0)).alias("mean_actual"), F.coalesce("n", F.lit(0)).alias("count"))


def quantile_bins(scored: DataFrame, by: Sequence[str] = MODEL, n_bins: int = BINS) -> DataFrame:
    """Equal-count bins per class; edges are exact quantiles of each model's own probabilities."""
    keys, rows = [*by, "cls"], by_class(scored, by)
    groups = materialize(quantile_table(rows, keys, "prob", [i / n_bins for i in range(n_bins + 1)]), "edges")
    edges = [F.get("edges", F.lit(i)) for i in range(n_bins + 1)]
    found = rows.join(groups, keys).withColumn("bin", bin_number(F.col("prob"), edges, closed_first=True)).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg("prob").alias("mean_predicted"), F.avg("hit").alias("mean_actual"))
    return _all_bins(groups, found, keys, n_bins)


def calibration_errors(bins: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Count-weighted ECE, MCE, RMSE and the correlation of bin means, per class."""
    gap = F.abs(F.col("mean_predicted") - F.col("mean_actual"))
    n = F.col("count")
    return bins.filter(n > 0).groupBy(*by, "cls").agg(
        (F.sum(gap * n) / F.sum(n)).alias("ece"), F.max(gap).alias("mce"),
        F.sqrt(F.sum(gap * gap * n) / F.sum(n)).alias("rmse"),
        F.when(F.count("*") > 1, F.corr("mean_predicted", "mean_actual")).otherwise(F.lit(1.0)).alias("correlation"))


def calibration_overall(errors: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return errors.groupBy(*by).agg(F.avg("ece").alias("overall_ece")).withColumn(
        "reliability_score", 1.0 - F.least(F.col("overall_ece"), F.lit(1.0)))


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom: the regularised incomplete gamma function.

    With ``a = df / 2`` and ``h = x / 2``: below ``a + 1`` one less the power series, above it the continued fraction from its end;
    both are folds over a fixed sequence. The gamma function of a half or whole number is a product.
    """
    a, h = df / 2, x / 2
    whole = df % 2 == 0
    first = F.when(whole, F.lit(1.0)).otherwise(F.lit(math.sqrt(math.pi)))
    factors = F.sequence(F.lit(1), F.greatest(F.ceil(a) - 1, F.lit(0)).cast("int"))
    step = F.when(whole, F.lit(0.0)).otherwise(F.lit(0.5))
    gamma = F.when(df <= 2, first).otherwise(F.aggregate(factors, first, lambda g, i: g * (i - step)))
    scale = F.exp(a * F.log(h) - h) / gamma
    # Sum of h ** n / (a (a + 1) .. (a + n)), the last term beside it.
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
    terms = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    series = F.aggregate(terms, start, lambda s, n: F.struct((s["term"] * h / (a + n)).alias("term"), (s["total"] + s["term"] * h / (a + n)).alias("total")))
    levels = F.sequence(F.lit(FRACTION_LEVELS), F.lit(1))
    below = F.aggregate(levels, F.lit(0.0), lambda t, n: n * (a - n) / (h + 2 * n + 1 - a + t))
    return F.when(x <= 0, F.lit(1.0)).when(h < a + 1, 1 - scale * series["total"]).otherwise(scale / (h + 1 - a + below))


def hosmer_lemeshow(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Chi-square of observed against expected hits in decile bins, with its p-value, per model and class."""
    bins = quantile_bins(scored, by, BINS).filter(F.col("count") > 0)
    o, e = F.col("mean_actual") * F.col("count"), F.col("mean_predicted") * F.col("count")
    sums = bins.groupBy(*by, "cls").agg(F.sum((o - e) * (o - e) / (e + 1e-10)).alias("chi2"), F.count("*").alias("bins"))
    enough = F.col("bins") > 2
    return sums.select(
        *by, "cls", F.when(enough, F.col("chi2")).otherwise(F.lit(0.0)).alias("chi2"),
        F.when(enough, chi2_sf(F.col("chi2"), (F.col("bins") - 1).cast("double"))).otherwise(F.lit(1.0)).alias("p_value"))


def calibration_large(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Brier score and calibration in the large per class."""
    gap = F.col("prob") - F.col("hit")
    return by_class(scored, by).groupBy(*by, "cls").agg(
        F.avg(gap * gap).alias("brier_score"), (F.avg("hit") - F.avg("prob")).alias("calibration_intercept"))


def reliability_data(bins: DataFrame, errors: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Lists of non-empty bins in order (at most the number of bins), with ECE and MCE."""
    keys = [*by, "cls"]
    packed = F.array_sort(F.collect_list(F.struct("bin", "mean_predicted", "mean_actual", "count")))
    lists = bins.filter(F.col("count") > 0).groupBy(*keys).agg(packed.alias("b"))
    return lists.join(errors, keys).select(
        *keys, F.get(F.array(*[F.lit(n) for n in OUTCOME_NAMES]), F.col("cls")).alias("name"),
        F.col("b.mean_predicted").alias("predicted"), F.col("b.mean_actual").alias("actual"),
        F.col("b.count").alias("counts"), "ece", "mce")


def grade(ece: Column) -> Column:
    return F.when(ece < 0.05, "Excellent").when(ece < 0.10, "Good").when(ece < 0.15, "Acceptable").otherwise("Poor")


def calibration_grade(errors: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Grade per class and overall."""
    each = errors.select(*by, F.get(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("cls")).alias("scope"), "ece")
    whole = calibration_overall(errors, by).select(*by, F.lit("overall").alias("scope"), F.col("overall_ece").alias("ece"))
    return each.unionByName(whole).withColumn("grade", grade(F.col("ece")))


def calibration_issues(bins: DataFrame, errors: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Over- and underconfidence by class, and a poorly calibrated draw class."""
    keys = [*by, "cls"]
    high, low = F.col("mean_predicted") > 0.7, F.col("mean_predicted") < 0.3
    gap = F.col("mean_predicted") - F.col("mean_actual")
    per_class = bins.filter(F.col("count") > 0).groupBy(*keys).agg(
        F.avg(F.when(high, gap)).alias("over"), F.avg(F.when(low, -gap)).alias("under"))
    rows = per_class.join(errors.select(*keys, "ece"), keys)
    found = F.array_compact(F.array(
        F.when(F.col("over") > 0.1, F.struct(F.lit("overconfidence").alias("type"), F.col("over").alias("size"))),
        F.when(F.col("under") > 0.1, F.struct(F.lit("underconfidence").alias("type"), F.col("under").alias("size"))),
        F.when((F.col("cls") == 1) & (F.col("ece") > 0.15),
               F.struct(F.lit("draw_calibration").alias("type"), F.col("ece").alias("size")))))
    return rows.select(*keys, F.inline(found))


DELTA_METRICS = {"expected_calibration_error": False, "brier_score": False, "log_loss": False}


def calibration_delta(before: DataFrame, after: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Metric before and after calibration; improvement is before minus after."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*by, F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in DELTA_METRICS])))

    change = F.col("before") - F.col("after")
    return side(before, "before").join(side(after, "after"), [*by, "metric"]).select(
        *by, "metric", "before", "after", change.alias("improvement"), (change > 0).alias("improved"))


def probability_metrics(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """The four calibration-service metrics: summed ECE, MCE, Brier and log loss."""
    from touchline.operators.evaluation import brier, log_loss_eps, prob_of

    sums = scored.groupBy(*by).agg(brier().alias("brier_score"), log_loss_eps(prob_of("label")).alias("log_loss"))
    return sums.join(ece_mce_sum(scored, by), list(by)) if by else sums.withColumn("_k", F.lit(0)).join(
        ece_mce_sum(scored, by).withColumn("_k", F.lit(0)), "_k").drop("_k")
