"""The feature matrix, training, calibration and scoring queries."""

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from touchline.catalog.base import AS_OF, query
from touchline.catalog.evaluation import EPS, P_LABEL, r9, scored
from touchline.catalog.history import FORM_COLS, H2H, VENUE_COLS, wide
from touchline.catalog.values import CALENDAR, ODDS_FEATURES
from touchline.functions.match import is_finished, ntz
from touchline.operators import evaluation as E
from touchline.operators import features as X
from touchline.operators import listing as L
from touchline.operators import models as M
from touchline.plans.materialize import fresh_path, materialize
from touchline.schema import PROBS
from touchline.sources import registry as R

ALL_SIDE = [*FORM_COLS, *VENUE_COLS, "form_trend", "rest_days", "matches_last_14_days"]
MATRIX_COLS = X.feature_columns()
MATRIX = f"""SELECT w.match_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MATRIX_COLS)}
    FROM (SELECT *, home_points_last_5 - away_points_last_5 AS form_diff, home_rest_days - away_rest_days AS rest_days_diff FROM ({wide(ALL_SIDE)})) w
    JOIN ({H2H}) x ON x.match_id = w.match_id JOIN ({ODDS_FEATURES}) o ON o.match_id = w.match_id
    JOIN (SELECT id AS match_id, {CALENDAR} FROM matches) c ON c.match_id = w.match_id"""
query("C1_feature_matrix", MATRIX)(lambda t: X.feature_matrix(t.matches))

_TABLES: dict[tuple, object] = {}


def labelled(t):
    """The labelled feature table, written once per session and data folder."""
    key = (t.spark.sparkContext.applicationId, t.path)
    if key not in _TABLES:
        _TABLES[key] = materialize(M.labelled_features(t.matches), "labelled", wide=True)
    return _TABLES[key]


def rows(t):
    """Prepared rows with split, weight and label; the features are written once, as the vector."""
    key = (t.spark.sparkContext.applicationId, t.path, "rows")
    if key not in _TABLES:
        prepared, data = M.build_training_data(labelled(t))
        _TABLES[key] = prepared, materialize(M.with_class_weights(data).drop(*MATRIX_COLS), "prepared", wide=True)
    return _TABLES[key]


def small_rf(df, **kw):
    return M.rf_classifier(df, **{"trees": 20, "depth": 6, **kw})


def small_gbt(df, **kw):
    return M.gbt_multiclass(df, **{"rounds": 10, "depth": 3, **kw})


def part(t, name):
    return rows(t)[1].filter(F.col("split") == name)


def scored_rows(model, df):
    return model.transform(df).select("match_id", "split", *PROBS)


DONE = "status = 'FINISHED' AND home_score IS NOT NULL AND away_score IS NOT NULL"
query("M12_build_training_data", f"""SELECT match_id, split, CAST(label AS INT) AS label FROM (SELECT id AS match_id,
    CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS label,
    CASE WHEN r < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train' WHEN r < CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY match_date, id) - 1 AS r, count(*) OVER () AS n FROM matches WHERE {DONE}))""")(
    lambda t: rows(t)[1].select("match_id", "split", "label"))
query("M13_rf_classifier")(lambda t: scored_rows(small_rf(part(t, "train")), rows(t)[1]))
query("M14_gbt_multiclass")(lambda t: scored_rows(small_gbt(
    rows(t)[1].filter("split <> 'test'").withColumn("is_val", F.col("split") == "val"), validation="is_val"), rows(t)[1]))
query("M15_ensemble_average", """SELECT match_id, round(0.75::DOUBLE * a.prob_home + 0.25::DOUBLE * b.prob_home, 9) AS prob_home,
    round(0.75::DOUBLE * a.prob_draw + 0.25::DOUBLE * b.prob_draw, 9) AS prob_draw, round(0.75::DOUBLE * a.prob_away + 0.25::DOUBLE * b.prob_away, 9) AS prob_away
    FROM (SELECT * FROM predictions WHERE model_version_id = 1) a JOIN (SELECT * FROM predictions WHERE model_version_id = 2) b USING (match_id)""")(
    lambda t: r9(M.ensemble_average([t.predictions.filter(f"model_version_id = {v}") for v in (1, 2)], [3.0, 1.0]), *PROBS))
query("M16_feature_importance")(lambda t: M.feature_importance(small_rf(part(t, "train")), MATRIX_COLS, t.matches))
query("L6_top_features")(lambda t: M.top_features(M.feature_importance(small_rf(part(t, "train")), MATRIX_COLS, t.matches), 20))


def calibrated(t, method):
    df = scored(t)
    return M.fit_calibrator(df, method).calibrate(df).select("match_id", "model_version_id", *PROBS)


def calibrated_sql(values: str) -> str:
    """Rows of ``scored`` with the class values (cls, prob, value) of ``values``, normalised."""
    joins = " ".join(f"JOIN v {k} ON {k}.cls = {i} AND {k}.prob = s.{p}" for i, (k, p) in enumerate(zip("abc", PROBS)))
    shares = ", ".join(f"round({k} / greatest(a + b + c, 1e-10::DOUBLE), 9) AS {p}" for k, p in zip("abc", PROBS))
    return f"""SELECT match_id, model_version_id, {shares} FROM (WITH v AS MATERIALIZED ({values})
        SELECT s.match_id, s.model_version_id, a.value AS a, b.value AS b, c.value AS c FROM scored s {joins})"""


# A level's value is the largest, over levels up to it, of the smallest mean from there to a level from it on.
ISOTONIC = """WITH lv AS (SELECT cls, prob, sum(hit) AS s, count(*) AS w FROM by_class GROUP BY cls, prob),
      cum AS (SELECT *, row_number() OVER o AS i, sum(s) OVER o AS cs, sum(w) OVER o AS cw FROM lv WINDOW o AS (PARTITION BY cls ORDER BY prob)),
      means AS (SELECT a.cls, a.i AS j, b.i, (b.cs - a.cs + a.s) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS m FROM cum a JOIN cum b ON a.cls = b.cls AND b.i >= a.i),
      least_mean AS (SELECT cls, i, min(m) OVER (PARTITION BY cls, j ORDER BY i DESC) AS m FROM means)
    SELECT cum.cls, cum.prob, max(m) AS value FROM least_mean JOIN cum ON cum.cls = least_mean.cls AND cum.i = least_mean.i GROUP BY cum.cls, cum.prob"""


def sigmoid_sql(steps: int = 12) -> str:
    """Newton steps one after the other, from 0."""
    p = "(1 / (1 + exp(-(a * x + b))))"
    sums = f"sum(n * {p} - h) AS gb, sum((n * {p} - h) * x) + any_value(a) AS ga, sum(n * {p} * (1 - {p})) AS hbb, sum(n * {p} * (1 - {p}) * x) AS hab, sum(n * {p} * (1 - {p}) * x * x) + 1 AS haa"
    parts = ["lv AS MATERIALIZED (SELECT cls, prob AS x, sum(hit) AS h, count(*) AS n FROM by_class GROUP BY cls, prob)",
             "it0 AS MATERIALIZED (SELECT DISTINCT cls, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM lv)"]
    parts += [f"""it{i + 1} AS MATERIALIZED (SELECT cls, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b
        FROM (SELECT cls, any_value(a) AS a, any_value(b) AS b, {sums} FROM lv JOIN it{i} USING (cls) GROUP BY cls))""" for i in range(steps)]
    return f"WITH {', '.join(parts)} SELECT cls, x AS prob, {p} AS value FROM lv JOIN it{steps} USING (cls)"


query("M17_isotonic_calibrate", calibrated_sql(ISOTONIC))(lambda t: r9(calibrated(t, "isotonic"), *PROBS))
query("M18_sigmoid_calibrate", calibrated_sql(sigmoid_sql()))(lambda t: r9(calibrated(t, "sigmoid"), *PROBS))


@query("M19_calibrated_predict")
def calibrated_predict(t):
    model = small_rf(part(t, "train"))
    scorer = M.CalibratedModel(model, M.fit_calibrator(model.transform(part(t, "val"))))
    return scored_rows(scorer, rows(t)[1])


query("M20_grid_search")(lambda t: M.grid_search(M.rf_classifier, rows(t)[1], M.grid(trees=[5, 10], depth=[3, 5]))[1])
query("M21_cv_log_loss")(lambda t: M.cv_log_loss(lambda df: small_rf(df, trees=5, depth=4, weight=None), rows(t)[1]))
query("M22_train_run")(lambda t: M.train_run(labelled(t), small_rf).metrics)
query("M25_stacking")(lambda t: M.stacking(rows(t)[1], [lambda d: small_rf(d, trees=5, depth=4, weight=None), lambda d: M.logistic(d, max_iter=20)])[1])
query("M26_poisson_goals")(lambda t: M.poisson_goals(part(t, "train"))(rows(t)[1]).select(
    "match_id", "split", "home_rate", "away_rate", "btts_prob", "over_2_5_prob"))


def two_prices(t):
    """Finished matches with the raw implied probabilities of both sides as their features."""
    rows = t.matches.filter(is_finished() & F.col("odds_home").isNotNull() & F.col("odds_away").isNotNull())
    return rows.select(F.col("id").alias("match_id"), "home_score", "away_score", array_to_vector(F.array(1 / F.col("odds_home"), 1 / F.col("odds_away"))).alias("features"))


def poisson_sql(side: str, steps: int = 12) -> str:
    """Newton steps for two features and an intercept, each a 3 by 3 system by Cramer's rule."""
    mu = "exp(b0 + b1 * x1 + b2 * x2)"
    parts = [f"d AS MATERIALIZED (SELECT id AS match_id, 1 / odds_home AS x1, 1 / odds_away AS x2, {side}_score AS y FROM matches WHERE {DONE} AND odds_home IS NOT NULL AND odds_away IS NOT NULL)",
             "it0 AS MATERIALIZED (SELECT ln(avg(y)) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM d)"]
    sums = ", ".join(f"avg({mu}{f}) AS {n}" for n, f in (("s00", ""), ("s01", " * x1"), ("s02", " * x2"), ("s12", " * x1 * x2"))) + \
        f", avg({mu} * x1 * x1) + 0.1 AS s11, avg({mu} * x2 * x2) + 0.1 AS s22, avg(y - {mu}) AS g0, avg((y - {mu}) * x1) - 0.1 * any_value(b1) AS g1, avg((y - {mu}) * x2) - 0.1 * any_value(b2) AS g2"
    det = "(s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02))"
    by = ["(g0 * (s11 * s22 - s12 * s12) - s01 * (g1 * s22 - s12 * g2) + s02 * (g1 * s12 - s11 * g2))",
          "(s00 * (g1 * s22 - s12 * g2) - g0 * (s01 * s22 - s12 * s02) + s02 * (s01 * g2 - g1 * s02))",
          "(s00 * (s11 * g2 - g1 * s12) - s01 * (s01 * g2 - g1 * s02) + g0 * (s01 * s12 - s11 * s02))"]
    parts += [f"""it{i + 1} AS MATERIALIZED (SELECT {", ".join(f"b{k} + {by[k]} / {det} AS b{k}" for k in range(3))}
        FROM (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {sums} FROM d CROSS JOIN it{i}))""" for i in range(steps)]
    return f"WITH {', '.join(parts)} SELECT match_id, {mu} AS rate FROM d CROSS JOIN it{steps}"


query("M26_poisson_two_features", f"""SELECT h.match_id, round(h.rate, 9) AS home_rate, round(a.rate, 9) AS away_rate, round((1 - exp(-h.rate)) * (1 - exp(-a.rate)), 9) AS btts_prob
    FROM ({poisson_sql("home")}) h JOIN ({poisson_sql("away")}) a ON a.match_id = h.match_id""")(
    lambda t: r9(M.poisson_goals(two_prices(t))(two_prices(t)), "home_rate", "away_rate", "btts_prob").select("match_id", "home_rate", "away_rate", "btts_prob"))
query("F17_goal_markets")(lambda t: M.poisson_goals(part(t, "train"))(rows(t)[1]).groupBy("split").agg(
    F.avg("btts_prob").alias("btts_prob"), F.avg("over_2_5_prob").alias("over_2_5_prob")))


@query("S10_model_save_load")
def model_roundtrip(t):
    root, at = fresh_path(t.spark, "registry"), datetime(2001, 1, 1, 12, 30)
    version = R.version_name("random_forest", at)
    forest = small_rf(part(t, "train"))
    metrics = E.classification_metrics(M.with_pred(forest.transform(part(t, "test"))), []).select("accuracy").first().asDict()
    row = R.model_row(t.spark, id=4, algorithm="random_forest", at=at, metrics={f"test_{k}": v for k, v in metrics.items()},
                      hyperparameters={"feature_names": MATRIX_COLS})
    R.save_model(PipelineModel([forest.model]), row, root, version)
    loaded = M.VectorModel(R.load_model(root, version))
    return scored_rows(loaded, rows(t)[1])


@query("S10_run_save_load")
def run_roundtrip(t):
    """A whole run saved and loaded: the loaded one prepares, scores and calibrates raw features."""
    root, at = fresh_path(t.spark, "registry"), datetime(2001, 1, 1, 12, 30)
    version = R.version_name("random_forest", at)
    run = M.train_run(labelled(t), small_rf)
    run.metrics = materialize(run.metrics, "metrics")  # of all rows, and read twice
    row = R.model_row(t.spark, id=5, algorithm="random_forest", at=at, metrics=run.registry_metrics(), hyperparameters={"feature_names": run.columns})
    R.save_run(run, row, root, version)
    return M.predict(labelled(t), R.load_run(t.spark, root, version))


BACKTEST = f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY match_date, match_id) - 1 AS r, count(*) OVER () AS n FROM scored
    WHERE model_version_id = 2 AND odds_home IS NOT NULL AND odds_draw IS NOT NULL AND odds_away IS NOT NULL) WHERE r >= CAST(floor(n * (1 - 0.3::DOUBLE)) AS BIGINT)"""
query("C4_backtest", f"""SELECT b.model_version_id, count(*) AS n, round(avg(CAST(label = pred AS DOUBLE)), 9) AS accuracy, round(avg(-ln(greatest(least({P_LABEL}, 1 - {EPS}), {EPS}))), 9) AS log_loss,
    (SELECT count(*) FROM bets x WHERE x.model_version_id = 2 AND x.match_id IN (SELECT match_id FROM ({BACKTEST}))) AS total_bets,
    (SELECT round(sum(profit) / sum(stake) * 100, 6) FROM bets x WHERE x.model_version_id = 2 AND x.match_id IN (SELECT match_id FROM ({BACKTEST}))) AS roi_percent
    FROM ({BACKTEST}) b GROUP BY b.model_version_id""")(
    lambda t: r9(r9(M.backtest(scored(t).filter("model_version_id = 2")), "accuracy", "log_loss"), "roi_percent", digits=6)
    .select("model_version_id", "n", "accuracy", "log_loss", "total_bets", "roi_percent"))
query("C5_calibrate")(lambda t: M.calibrate_latest(scored(t).filter("model_version_id = 2")))


def upcoming_features(t):
    upcoming = L.query_matches(t.matches, t.tournaments, days_ahead=60, as_of=AS_OF)
    finished = t.matches.filter(is_finished()).withColumn("asked", F.lit(False))
    relevant = materialize(finished.unionByName(upcoming.withColumn("asked", F.lit(True))), "relevant")
    return X.feature_matrix(relevant, asked="asked")


query("C6_predict_upcoming")(lambda t: M.predict(upcoming_features(t), M.train_run(labelled(t), small_rf), min_confidence=0.4))
query("C7_save_predictions", """SELECT id AS match_id, CAST(2 AS BIGINT) AS model_version_id, 'H' AS predicted_outcome, 0.5::DOUBLE AS confidence FROM matches
    WHERE id NOT IN (SELECT match_id FROM predictions WHERE model_version_id = 2)""")(
    lambda t: M.predictions_to_store(t.matches.select(
        F.col("id").alias("match_id"), F.lit(0.5).alias("prob_home"), F.lit(0.25).alias("prob_draw"), F.lit(0.25).alias("prob_away"),
        F.lit("HOME").alias("predicted_outcome"), F.lit(0.5).alias("confidence")), t.predictions, 2, ntz(AS_OF))
    .select("match_id", "model_version_id", "predicted_outcome", "confidence"))
