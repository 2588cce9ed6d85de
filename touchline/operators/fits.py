"""Small models fitted by aggregation: isotonic steps, logistic curves on one score, Poisson regressions.

Each step of a fit is one aggregation over the rows; what comes to the driver is a handful of sums (a matrix of features by features
for the Poisson fit). Isotonic steps stay a table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.plans.materialize import materialize

NEWTON_STEPS, NEWTON_TOLERANCE = 50, 1e-12
POOL_ROWS = 500_000  # levels that one task pools
LOOKUP_POINTS = 10_000  # isotonic steps that are looked up as a literal; more are joined
_POOLS = "cls int, low double, high double, total double, weight double"


# --- isotonic steps ------------------------------------------------------------------------


def pooled(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """First rows of the pools of one ordered piece: the corners of the greatest convex minorant of its running sums."""
    starts: list[int] = []
    sums: list[float] = []
    weights: list[float] = []
    for i, (s, w) in enumerate(zip(total.tolist(), weight.tolist(), strict=True)):
        first = i
        while sums and sums[-1] * w >= s * weights[-1]:  # the pool before has a mean at least as high
            s, w, first = s + sums.pop(), w + weights.pop(), starts.pop()
        starts.append(first)
        sums.append(s)
        weights.append(w)
    return np.array(starts, np.int64)


def _pool(key, rows):
    rows = rows.sort_by("low")
    low, high, total, weight = (rows.column(c).to_numpy() for c in ("low", "high", "total", "weight"))
    first = pooled(total, weight)
    last = np.append(first[1:], len(low)) - 1
    return pa.table({"cls": pa.array([key[0].as_py()] * len(first), pa.int32()), "low": low[first], "high": high[last],
                     "total": np.add.reduceat(total, first), "weight": np.add.reduceat(weight, first)})


def isotonic_steps(rows: DataFrame, *, pool_rows: int = POOL_ROWS) -> DataFrame:
    """(cls, low, high, value): the non-decreasing steps nearest to ``hit`` (cls, score, hit) in least squares.

    Equal scores are folded to a level first. The levels of a class are cut into ranges, and each range is reduced to the corners of
    the convex minorant of its running sums, its pools. A corner of the whole minorant is one of its range's, so the pools stand
    for the range, and pooling goes on over them with other cuts until no two neighbours violate the order. What is left gets
    fewer each time: a run of pools across many ranges is a few rows after one round.
    """
    levels = rows.where("score IS NOT NULL AND hit IS NOT NULL").groupBy(F.col("cls").cast("int").alias("cls"), "score").agg(
        F.sum("hit").cast("double").alias("total"), F.count("*").cast("double").alias("weight"))
    pools = materialize(levels.select("cls", F.col("score").alias("low"), F.col("score").alias("high"), "total", "weight"), "levels")
    turn = 0
    while True:
        n = pools.count()
        pieces = max(1, -(-n // pool_rows)) + (turn % 2 if n > pool_rows else 0)  # cuts lie elsewhere every other time
        ranged = pools.repartitionByRange(pieces, "cls", "low").withColumn("piece", F.spark_partition_id())
        pools = materialize(materialize(ranged, "ranges").groupBy("cls", "piece").applyInArrow(_pool, _POOLS), "pools")
        if pieces == 1 or not _violations(pools):
            return pools.select("cls", "low", "high", (F.col("total") / F.col("weight")).alias("value"))
        turn += 1


def _violations(pools: DataFrame) -> bool:
    """Whether a pool's mean is not above that of the pool before it; pieces are ordered, so only their ends can violate."""
    cut = materialize(pools.repartitionByRange("cls", "low").withColumn("piece", F.spark_partition_id()), "order")
    mean = F.col("total") / F.col("weight")
    within = Window.partitionBy("cls", "piece").orderBy("low")
    inside = cut.withColumn("before", F.lag(mean).over(within)).where(mean <= F.col("before"))
    ends = cut.groupBy("cls", "piece").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))  # a row per range
    across = ends.withColumn("before", F.lag("last").over(Window.partitionBy("cls").orderBy("piece"))).where("first <= before")
    return not (inside.isEmpty() and across.isEmpty())


def isotonic_values(steps: DataFrame, scores: DataFrame) -> DataFrame:
    """(cls, score, value) of distinct scores (cls, score): on the steps, linear between them, and constant beyond the ends."""
    points = steps.select("cls", F.inline(F.array_distinct(F.array(F.struct(F.col("low").alias("score"), "value"), F.struct(F.col("high").alias("score"), "value")))))
    both = points.withColumn("asked", F.lit(False)).unionByName(
        scores.select(F.col("cls").cast("int").alias("cls"), "score", F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked")).where("score IS NOT NULL").distinct())
    ranged = materialize(both.repartitionByRange("cls", "score").withColumn("piece", F.spark_partition_id()), "ranges")
    point = F.when(~F.col("asked"), F.struct("score", "value"))
    # The nearest points within the range of rows, else the last one of the ranges before and the first of those after.
    ends = ranged.groupBy("cls", "piece").agg(F.max(point).alias("last"), F.min(point).alias("first"))  # a row per range
    up, down = (Window.partitionBy("cls").orderBy(o) for o in (F.asc("piece"), F.desc("piece")))
    carried = ends.select("cls", "piece", F.last("last", True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
                          F.last("first", True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    # Both frames grow from the start of their order; one that reaches to the end would be walked again for each row.
    up, down = (Window.partitionBy("cls", "piece").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("score"), F.desc("score")))
    near = ranged.withColumns({"below": F.last(point, True).over(up), "above": F.last(point, True).over(down)}).where("asked")
    near = near.join(carried, ["cls", "piece"]).withColumns({"below": F.coalesce("below", "earlier"), "above": F.coalesce("above", "later")})
    share = (F.col("score") - F.col("below.score")) / (F.col("above.score") - F.col("below.score"))
    between = F.col("below.value") + share * (F.col("above.value") - F.col("below.value"))
    value = F.when(F.col("below").isNull(), F.col("above.value")).when(F.col("above").isNull(), F.col("below.value")).when(
        F.col("below.value") == F.col("above.value"), F.col("below.value")).when(F.col("above.score") == F.col("below.score"), F.col("above.value")).otherwise(between)
    return near.select("cls", "score", value.alias("value"))


def step_points(steps: DataFrame, *, most: int = LOOKUP_POINTS) -> dict[int, list[tuple[float, float]]] | None:
    """(score, value) ends of the steps of each class in order, or nothing where they are more than ``most``."""
    found = steps.select("cls", "low", "high", "value").limit(most + 1).collect()
    if len(found) > most:
        return None
    points: dict[int, set] = {}
    for r in found:
        points.setdefault(r["cls"], set()).update([(r["low"], r["value"]), (r["high"], r["value"])])
    return {cls: sorted(p) for cls, p in points.items()}


def point_values(points: Sequence[tuple[float, float]], score: Column) -> Column:
    """As :func:`isotonic_values`, a score at a time: a binary search among the points of its class, which are a literal."""
    if not points:
        return F.lit(None).cast("double")
    scores, values = (F.from_json(F.lit(json.dumps(list(v))), "array<double>") for v in zip(*points, strict=True))
    n = len(points)
    top = 1 << (n.bit_length() - 1)
    steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])
    upto = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(scores, low + step - 1) <= score, low + step).otherwise(low))

    def value(i: Column) -> Column:
        x, a, b = F.get(scores, i - 1), F.get(values, i - 1), F.get(values, i)
        between = a + (score - x) / (F.get(scores, i) - x) * (b - a)
        return F.when(i == 0, b).when((i == n) | (score == x) | (a == b), a).otherwise(between)

    # A fold of one element gives the place a name, so that it is searched once.
    return F.when(score.isNotNull(), F.get(F.transform(F.array(upto), value), F.lit(0)))


# --- logistic curve on one score -------------------------------------------------------------


def sigmoid_curves(rows: DataFrame, *, c: float = 1.0) -> dict[int, tuple[float, float]]:
    """Slope and intercept of each class's logistic curve over (cls, score, hit), the slope under an L2 penalty of inverse strength ``c``.

    Newton's method on sums: equal scores are folded to a level once, then each step is one aggregation of gradient and Hessian of all
    classes. A step that does not lower the loss is halved.
    """
    folded = rows.where("score IS NOT NULL AND hit IS NOT NULL").groupBy("cls", "score").agg(F.sum("hit").cast("double").alias("hits"), F.count("*").cast("double").alias("n"))
    levels = materialize(folded, "levels")
    at = {r["cls"]: (0.0, 0.0) for r in levels.select("cls").distinct().collect()}  # three classes
    step = dict.fromkeys(at, (0.0, 0.0))
    best = dict.fromkeys(at, float("inf"))
    open_ = set(at)
    for _ in range(NEWTON_STEPS):
        if not open_:
            break
        trial = {k: (at[k][0] + step[k][0], at[k][1] + step[k][1]) for k in open_}
        a, b = (_by_class({k: v[i] for k, v in trial.items()}) for i in (0, 1))
        z = a * F.col("score") + b
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        off, curve, x = F.col("n") * p - F.col("hits"), F.col("n") * p * (1 - p), F.col("score")
        sums = {"loss": F.col("n") * loss - F.col("hits") * z, "ga": off * x, "gb": off, "haa": curve * x * x, "hab": curve * x, "hbb": curve}
        for r in levels.where(F.col("cls").isin(list(open_))).groupBy("cls").agg(*[F.sum(v).alias(k) for k, v in sums.items()]).collect():
            k = r["cls"]
            slope = trial[k][0]
            value = r["loss"] + slope * slope / (2 * c)
            if value > best[k] + 1e-9 * abs(best[k]):
                step[k] = (step[k][0] / 2, step[k][1] / 2)
                continue
            at[k], best[k] = trial[k], value
            hessian = np.array([[r["haa"] + 1 / c, r["hab"]], [r["hab"], r["hbb"]]])
            change = np.linalg.lstsq(hessian, -np.array([r["ga"] + slope / c, r["gb"]]), rcond=None)[0]
            step[k] = (float(change[0]), float(change[1]))
            if np.abs(change).max() < NEWTON_TOLERANCE * (1 + max(map(abs, at[k]))):
                open_.discard(k)
    return at


def _by_class(values: dict[int, float]) -> Column:
    column = F.lit(0.0)
    for k, v in values.items():
        column = F.when(F.col("cls") == k, F.lit(v)).otherwise(column)
    return column


# --- Poisson regression ----------------------------------------------------------------------


@dataclass
class PoissonRates:
    """Log-linear rates: an intercept and a coefficient per entry of the feature vector, for each output column."""

    features: str
    rates: dict[str, tuple[float, list[float]]]

    def transform(self, df: DataFrame) -> DataFrame:
        values = vector_to_array(self.features)

        def rate(intercept: float, weights: list[float]) -> Column:
            return F.exp(F.lit(intercept) + F.aggregate(F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v))

        return df.withColumns({name: rate(*fit) for name, fit in self.rates.items()})


def poisson_rates(rows: DataFrame, targets: dict[str, str], *, features: str = "features", alpha: float = 0.1) -> PoissonRates:
    """Poisson regressions of several counts (output name: count column) on one vector: mean half deviance + ``alpha / 2`` |weights|^2.

    Iteratively reweighted least squares: each round every task adds up X'WX and X'Wz of its rows for all targets, these are summed
    entry by entry in one aggregation, and the driver solves systems of the number of features.
    """
    names = list(targets)
    columns = [F.col(targets[n]).cast("double").alias(f"y{i}") for i, n in enumerate(names)]
    table = materialize(rows.select(vector_to_array(features).alias("x"), *columns).dropna(), "poisson")  # read once for each step
    first = table.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), *[F.avg(f"y{i}").alias(f"m{i}") for i in range(len(names))]).first()
    n, d = first["n"], (first["d"] or 0) + 1
    if not n:
        raise ValueError("no rows to fit")
    beta = np.zeros((len(names), d))
    beta[:, 0] = [np.log(max(first[f"m{i}"], 1e-10)) for i in range(len(names))]
    penalty = np.diag([0.0] + [alpha] * (d - 1))
    for _ in range(NEWTON_STEPS):
        sums = _normal_equations(table, beta)
        new = np.array([np.linalg.solve(gram / n + penalty, right / n) for gram, right in sums])
        change = np.abs(new - beta).max()
        beta = new
        if change < 1e-11 * (1 + np.abs(beta).max()):
            break
    return PoissonRates(features, {name: (float(b[0]), [float(w) for w in b[1:]]) for name, b in zip(names, beta, strict=True)})


def _normal_equations(table: DataFrame, beta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(X'WX, X'Wz) of each target at ``beta``: weights are the rates, ``z`` the working response."""
    targets, d = beta.shape

    def add(batches):
        total = np.zeros((targets, d, d + 1))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.hstack([np.ones((len(x), 1)), x])
            for i in range(targets):
                eta = x @ beta[i]
                rate = np.exp(eta)
                weighted = x * rate[:, None]
                response = eta + (batch.column(f"y{i}").to_numpy() - rate) / rate
                total[i, :, :d] += weighted.T @ x
                total[i, :, d] += weighted.T @ response
        at = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*[pa.array(a.astype(np.int32)) for a in at], pa.array(total.ravel())], ["i", "j", "k", "v"])

    out = np.zeros((targets, d, d + 1))
    for r in table.mapInArrow(add, "i int, j int, k int, v double").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"], r["k"]] = r["v"]
    return [(m[:, :d], m[:, d]) for m in out]


def labelled_scores(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cls, score, hit): a row per class of each scored row."""
    return scored.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("cls"), F.col(p).cast("double").alias("score"), (F.col("label") == i).cast("double").alias("hit")) for i, p in enumerate(columns)])))
