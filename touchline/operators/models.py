"""Training, calibration and scoring of outcome models with Spark ML.

Probabilities travel as the columns ``prob_home``, ``prob_draw``, ``prob_away`` keyed by
``match_id``; no positional alignment anywhere.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.match import encode_target, is_finished, match_result, micros
from touchline.functions.odds import favourite, goal_markets, has_odds
from touchline.operators import calibration as K
from touchline.operators import evaluation as E
from touchline.operators import fits
from touchline.operators.features import feature_columns, feature_matrix
from touchline.operators.prep import feature_pipeline
from touchline.operators.splits import backtest_split, calibration_split, split_members, temporal_split
from touchline.operators.value_bets import with_pick
from touchline.plans.materialize import materialize
from touchline.plans.ordering import BLOCK_ROWS
from touchline.schema import ODDS, PROBS

SEED = 42
Fit = Callable[[DataFrame], Any]   # training rows -> object with transform(df) adding PROBS


def latest_n(matches: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` finished matches with odds."""
    return matches.filter(is_finished() & has_odds()).orderBy(F.col("match_date").desc(), F.col("id").desc()).limit(n)


# --- training data -------------------------------------------------------------------------

def labelled_features(matches: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Features of finished matches with label, scores, odds and date."""
    keep = ["match_date", "home_score", "away_score", *ODDS]
    done = matches.filter(is_finished())
    raw = feature_matrix(done.withColumn("_label", encode_target(match_result())), keep=[*keep, "_label"], block_rows=block_rows)
    return raw.withColumnRenamed("_label", "label").withColumn("us", micros())


def build_training_data(labelled: DataFrame, columns: Sequence[str] | None = None, *, train: float = 0.7, val: float = 0.15,
                        test: float = 0.15) -> tuple[PipelineModel, DataFrame]:
    """Split by time, fit the preparation on training rows only, transform all rows."""
    columns = list(columns or feature_columns())
    split = temporal_split(labelled, train, val, test).filter("split IS NOT NULL")
    prepared = feature_pipeline(columns).fit(split.filter("split = 'train'"))
    return prepared, prepared.transform(split)


def with_class_weights(rows: DataFrame) -> DataFrame:
    """Inverse-frequency weight of the label, measured on the training rows."""
    weights = {r["label"]: r["weight"] for r in E.class_weights(rows.filter("split = 'train'")).collect()}  # three classes
    column = F.lit(1.0)
    for label, weight in weights.items():
        column = F.when(F.col("label") == label, F.lit(weight)).otherwise(column)
    return rows.withColumn("weight", column)


# --- classifiers ---------------------------------------------------------------------------

def _from_vector(df: DataFrame, vector: str) -> DataFrame:
    values = vector_to_array(vector)
    return df.withColumns({p: F.coalesce(F.get(values, F.lit(i)), F.lit(0.0)) for i, p in enumerate(PROBS)})


@dataclass
class VectorModel:
    """A Spark classifier whose probability vector becomes the three columns."""

    model: Any

    def classifier(self) -> Any:
        """The classifier itself, also where it was loaded as a pipeline of one stage."""
        return self.model.stages[-1] if isinstance(self.model, PipelineModel) else self.model

    def transform(self, df: DataFrame) -> DataFrame:
        return _from_vector(self.model.transform(df), "probability").drop("rawPrediction", "probability", "prediction")

    def importances(self) -> list[float]:
        model = self.classifier()
        if isinstance(model, LogisticRegressionModel):  # mean size over the coefficient rows
            return [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
        return [float(v) for v in model.featureImportances.toArray()]


def rf_classifier(rows: DataFrame, *, trees: int = 500, depth: int = 10, min_leaf: int = 2, weight: str | None = "weight",
                  features: str = "features", seed: int = SEED) -> VectorModel:
    rf = RandomForestClassifier(featuresCol=features, labelCol="label", numTrees=trees, maxDepth=depth,
                                minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    return VectorModel(rf.fit(rows))


@dataclass
class GbtMulticlass:
    """One boosted binary model per class, probabilities renormalised."""

    models: list[GBTClassificationModel]

    def transform(self, df: DataFrame) -> DataFrame:
        for i, m in enumerate(self.models):
            df = m.copy({m.probabilityCol: f"_p{i}", m.rawPredictionCol: f"_r{i}", m.predictionCol: f"_y{i}"}).transform(df)
        hit = [F.get(vector_to_array(f"_p{i}"), F.lit(1)) for i in range(len(self.models))]
        total = F.greatest(hit[0] + hit[1] + hit[2], F.lit(1e-10))
        df = df.withColumns({p: h / total for p, h in zip(PROBS, hit)})
        return df.drop(*[f"_{k}{i}" for i in range(len(self.models)) for k in "pry"])

    def importances(self) -> list[float]:
        parts = [m.featureImportances.toArray() for m in self.models]
        return [float(v) for v in sum(parts) / len(parts)]

    def save(self, path: str) -> None:
        for i, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/class_{i}")

    @staticmethod
    def load(path: str) -> GbtMulticlass:
        return GbtMulticlass([GBTClassificationModel.load(f"{path}/class_{i}") for i in range(3)])


def gbt_multiclass(rows: DataFrame, *, rounds: int = 500, depth: int = 6, step: float = 0.1, subsample: float = 0.8,
                   validation: str | None = None, weight: str | None = "weight", features: str = "features",
                   seed: int = SEED) -> GbtMulticlass:
    """Boosting per class; ``validation`` names a boolean column of rows that stop it early."""
    models = []
    for cls in range(3):
        gbt = GBTClassifier(featuresCol=features, labelCol="_hit", maxIter=rounds, maxDepth=depth, stepSize=step,
                            subsamplingRate=subsample, minInstancesPerNode=3, seed=seed)
        if weight:
            gbt = gbt.setWeightCol(weight)
        if validation:
            gbt = gbt.setValidationIndicatorCol(validation)
        models.append(gbt.fit(rows.withColumn("_hit", (F.col("label") == cls).cast("double"))))
    return GbtMulticlass(models)


def logistic(rows: DataFrame, *, c: float = 1.0, features: str = "features", max_iter: int = 100) -> VectorModel:
    """Multinomial logistic regression; ``1 / (n c)`` matches an L2 penalty with inverse strength ``c``."""
    n = rows.count()
    lr = LogisticRegression(featuresCol=features, labelCol="label", family="multinomial", regParam=1 / (n * c),
                            standardization=False, maxIter=max_iter)
    return VectorModel(lr.fit(rows))


def feature_importance(model: Any, names: Sequence[str], like: DataFrame) -> DataFrame:
    """(feature, importance) rows; one per feature name."""
    return like.sparkSession.createDataFrame(list(zip(names, model.importances())), "feature string, importance double")


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def ensemble_average(scored: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean of the probabilities of several models, joined on the match."""
    weights = list(weights or [1.0] * len(scored))
    share = [w / sum(weights) for w in weights]
    parts = [df.select("match_id", *[(F.col(p) * s).alias(p) for p in PROBS]) for df, s in zip(scored, share)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    # A match must be scored by every model; sums over the union avoid a chain of joins.
    return both.groupBy("match_id").agg(*[F.sum(p).alias(p) for p in PROBS], F.count("*").alias("_n")).filter(
        F.col("_n") == len(parts)).drop("_n")


# --- calibration ---------------------------------------------------------------------------

@dataclass
class Calibrator:
    """Per-class maps fitted one-vs-rest, then rows normalised to sum 1: a table of isotonic steps, or logistic curves by class."""

    method: str
    maps: Any

    def calibrate(self, df: DataFrame) -> DataFrame:
        points = fits.step_points(self.maps) if self.method == "isotonic" else None
        if points is not None:  # few steps: no row is moved, nor scored twice
            df = df.withColumns({f"_c{i}": fits.point_values(points.get(i, []), F.col(p).cast("double")) for i, p in enumerate(PROBS)})
        elif self.method == "isotonic":
            asked = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("cls"), F.col(p).cast("double").alias("score")) for i, p in enumerate(PROBS)])))
            values = materialize(fits.isotonic_values(self.maps, asked), "calibrated")
            for i, p in enumerate(PROBS):
                own = values.filter(F.col("cls") == i).select(F.col("score").alias(f"_s{i}"), F.col("value").alias(f"_c{i}"))
                df = df.join(own, F.col(p) == F.col(f"_s{i}"), "left").drop(f"_s{i}")
        else:
            df = df.withColumns({f"_c{i}": 1 / (1 + F.exp(-(F.lit(a) * F.col(p) + F.lit(b))))
                                 for i, p in enumerate(PROBS) for a, b in [self.maps[i]]})
        total = F.greatest(F.col("_c0") + F.col("_c1") + F.col("_c2"), F.lit(1e-10))
        return df.withColumns({p: F.col(f"_c{i}") / total for i, p in enumerate(PROBS)}).drop("_c0", "_c1", "_c2")


def fit_calibrator(scored: DataFrame, method: str = "isotonic") -> Calibrator:
    """Isotonic steps, or a logistic curve on the score with an L2 penalty of strength 1, for each class against the others."""
    rows = fits.labelled_scores(scored, PROBS)
    return Calibrator(method, fits.isotonic_steps(rows) if method == "isotonic" else fits.sigmoid_curves(rows))


@dataclass
class CalibratedModel:
    """Model and calibrator as one scorer."""

    model: Any
    calibrator: Calibrator | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df)
        return self.calibrator.calibrate(scored) if self.calibrator else scored


# --- search, runs --------------------------------------------------------------------------

def with_pred(scored: DataFrame) -> DataFrame:
    return scored.withColumn("pred", favourite(*[F.col(p) for p in PROBS]))


def log_loss(scored: DataFrame) -> float:
    return scored.agg(E.log_loss_clip(E.prob_of("label")).alias("v")).first()["v"]


def grid(**choices: Iterable[Any]) -> list[dict[str, Any]]:
    """All combinations of the choices."""
    return [dict(zip(choices, values)) for values in itertools.product(*choices.values())]


def grid_search(fit: Callable[..., Any], rows: DataFrame, combinations: Sequence[dict[str, Any]]) -> tuple[dict, DataFrame]:
    """Fit every combination on the training rows, score it on the validation rows; smallest log loss wins."""
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    trials = [(i, json.dumps(c, sort_keys=True), float(log_loss(fit(train, **c).transform(val)))) for i, c in enumerate(combinations)]
    best = min(trials, key=lambda trial: trial[2])
    table = rows.sparkSession.createDataFrame(trials, "trial int, params string, log_loss double")
    return combinations[best[0]], table.withColumn("best", F.col("trial") == best[0])


def expanding_plan(n: int) -> list[tuple[int, int, int]]:
    """(train, validation, test) end positions of the expanding cross-validation: at most six splits."""
    train, step = max(100, n // 4), max(50, n // 8)
    plan = []
    while train + 2 * step <= n:
        plan.append((train, train + step, train + 2 * step))
        train += step
    return plan


def cv_log_loss(fit: Fit, rows: DataFrame) -> DataFrame:
    """Log loss of every expanding split; average it for the score."""
    plan = expanding_plan(rows.count())
    scores = []
    for i, ends in enumerate(plan):
        part = split_members(rows.drop("split"), *ends)
        model = fit(part.filter("split = 'train'"))
        scores.append((i, ends[0], float(log_loss(model.transform(part.filter("split = 'val'"))))))
    return rows.sparkSession.createDataFrame(scores, "split_no int, train_rows int, log_loss double")


@dataclass
class TrainingRun:
    prepared: PipelineModel
    model: CalibratedModel
    metrics: DataFrame            # one row per split
    columns: list[str] = field(default_factory=list)

    def registry_metrics(self) -> dict[str, float]:
        """Metrics by split prefix, as the registry stores them."""
        out: dict[str, float] = {}
        for row in self.metrics.collect():  # three splits
            out |= {f"{row['split']}_{k}": float(v) for k, v in row.asDict().items() if k != "split" and v is not None}
        return out


REPORTED = ["n", "accuracy", "log_loss", "precision_macro", "recall_macro", "f1_macro", "brier_score",
            "expected_calibration_error", "maximum_calibration_error"]


def train_run(labelled: DataFrame, fit: Fit, *, calibration: str | None = "isotonic", columns: Sequence[str] | None = None) -> TrainingRun:
    """Split, prepare, weight, fit, calibrate on validation rows, measure all three splits in one pass.

    The prepared rows are written once, with the features as the vector; the fit's scans and all that follows read that table.
    """
    columns = list(columns or feature_columns())
    prepared, rows = build_training_data(labelled, columns)
    rows = materialize(with_class_weights(rows).drop(*columns), "prepared", wide=True)
    model = fit(rows.filter("split = 'train'"))
    calibrator = fit_calibrator(model.transform(rows.filter("split = 'val'")), calibration) if calibration else None
    scorer = CalibratedModel(model, calibrator)
    scored = with_pred(scorer.transform(rows)).select("match_id", "split", "label", "pred", *PROBS)
    metrics = E.classification_metrics(scored, ["split"]).join(K.ece_mce_sum(scored, ["split"]), "split").select("split", *REPORTED)
    return TrainingRun(prepared, scorer, metrics, columns)


def predict(features: DataFrame, run: TrainingRun, *, min_confidence: float = 0.0) -> DataFrame:
    """Probabilities, outcome and confidence of every feature row at once."""
    scored = with_pick(run.model.transform(run.prepared.transform(features)))
    return scored.filter(F.col("confidence") >= min_confidence).select("match_id", *PROBS, "predicted_outcome", "confidence")


def predictions_to_store(predicted: DataFrame, existing: DataFrame, model_version_id: int | Column, predicted_at: Column) -> DataFrame:
    """New rows for the prediction table; pairs already stored are left out."""
    fresh = predicted.select(
        "match_id", F.lit(model_version_id).cast("long").alias("model_version_id"), *PROBS,
        F.substring("predicted_outcome", 1, 1).alias("predicted_outcome"), "confidence", predicted_at.alias("predicted_at"))
    key = ["match_id", "model_version_id"]
    return fresh.join(existing.select("match_id", F.col("model_version_id").cast("long").alias("model_version_id")), key, "left_anti")


# --- backtest and calibration service --------------------------------------------------------

def backtest(scored: DataFrame, *, share: float = 0.3, start=None, end=None, min_rows: int = 50, min_edge: float = 0.0) -> DataFrame:
    """Evaluate the later ``share`` of finished, priced rows of one model."""
    rows = scored.filter(has_odds())
    if start is not None:
        rows = rows.filter(F.col("match_date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("match_date") <= F.lit(end).cast("timestamp_ntz"))
    if rows.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} matches")
    part = backtest_split(rows, share).filter("split = 'score'")
    return E.evaluate_predictions(part, ["model_version_id"], min_edge=min_edge)


def calibrate_latest(scored: DataFrame, *, newest: int = 2000, share: float = 0.2, method: str = "isotonic",
                     min_rows: int = 100) -> DataFrame:
    """Fit a calibrator on the validation part of the newest rows and compare before with after on it.

    ``newest`` bounds the labelled rows by rule: older ones take no part in the fit nor in the comparison.
    """
    rows = scored.orderBy(F.col("match_date").desc(), F.col("match_id").desc()).limit(newest)
    if rows.count() < min_rows:
        raise ValueError(f"fewer than {min_rows} matches")
    val = calibration_split(rows, share).filter("split = 'val'")
    after = fit_calibrator(val, method).calibrate(val)
    return K.calibration_delta(K.probability_metrics(val), K.probability_metrics(after))


# --- stacking and goals ----------------------------------------------------------------------

def stacking(rows: DataFrame, bases: Sequence[Fit], *, c: float = 1.0) -> tuple[VectorModel, DataFrame]:
    """Logistic meta model over out-of-fold base probabilities from the expanding splits."""
    rows = rows.drop("split")
    names = [f"base{b}_{p}" for b in range(len(bases)) for p in PROBS]
    folds = None
    for train_end, val_end, _ in expanding_plan(rows.count()):
        part = split_members(rows, train_end, val_end, val_end)
        fold = part.filter("split = 'val'")
        for b, fit in enumerate(bases):
            scored = fit(part.filter("split = 'train'")).transform(fold)
            fold = scored.withColumnsRenamed({p: f"base{b}_{p}" for p in PROBS})
        fold = fold.select("match_id", "label", *names)
        folds = fold if folds is None else folds.unionByName(fold)
    out_of_fold = VectorAssembler(inputCols=names, outputCol="meta").transform(folds)
    meta = logistic(out_of_fold, c=c, features="meta", max_iter=1000)
    return meta, meta.transform(out_of_fold).select("match_id", "label", *PROBS)


def poisson_goals(rows: DataFrame, *, features: str = "features", alpha: float = 0.1) -> Callable[[DataFrame], DataFrame]:
    """Two Poisson regressions, fitted together; gives a scorer that adds rates and the goal markets."""
    model = fits.poisson_rates(rows, {f"{side}_rate": f"{side}_score" for side in ("home", "away")}, features=features, alpha=alpha)
    return lambda df: model.transform(df).withColumns(goal_markets("home_rate", "away_rate"))
