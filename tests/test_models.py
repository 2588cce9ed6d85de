"""Learning stages: probabilities, weights, persistence and the split discipline."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from touchline.operators import models as M
from touchline.operators import prep as P
from touchline.plans.materialize import materialize
from touchline.schema import PROBS

COLUMNS = ["home_points_last_5", "away_points_last_5", "implied_prob_home", "implied_prob_away", "home_rest_days"]


@pytest.fixture(scope="module")
def rows(tables):
    labelled = materialize(M.labelled_features(tables.matches))
    _, data = M.build_training_data(labelled, COLUMNS)
    return materialize(M.with_class_weights(data))


def part(rows, name):
    return rows.filter(F.col("split") == name)


def sums_to_one(df):
    r = df.agg(F.max(F.abs(sum((F.col(p) for p in PROBS), F.lit(0.0)) - 1)), F.min(F.least(*PROBS))).first()
    return r[0] < 1e-6 and r[1] >= 0


def test_preparation_is_fitted_on_training_rows_only(rows):
    r = part(rows, "train").agg(*[F.avg(c).alias(c) for c in COLUMNS], *[F.stddev_pop(c).alias(f"s_{c}") for c in COLUMNS]).first()
    for c in COLUMNS:
        assert r[c] == pytest.approx(0, abs=1e-9) and r[f"s_{c}"] == pytest.approx(1)
    ends = rows.groupBy("split").agg(F.min("match_date").alias("a"), F.max("match_date").alias("b")).collect()
    ends = {r["split"]: r for r in ends}
    assert ends["train"]["b"] <= ends["val"]["a"] <= ends["val"]["b"] <= ends["test"]["a"]


def test_every_model_gives_probabilities(rows):
    train = part(rows, "train")
    forest = M.rf_classifier(train, trees=5, depth=3)
    boosted = M.gbt_multiclass(train, rounds=3, depth=2)
    linear = M.logistic(train, max_iter=10)
    scored = [m.transform(rows).select("match_id", "label", *PROBS) for m in (forest, boosted, linear)]
    for df in scored:
        assert sums_to_one(df) and df.count() == rows.count()
    mixed = M.ensemble_average(scored, [2, 1, 1])
    assert sums_to_one(mixed) and mixed.count() == rows.count()
    for m in (forest, boosted, linear):
        assert len(m.importances()) == len(COLUMNS)
    top = M.top_features(M.feature_importance(forest, COLUMNS, rows), 2).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"]


def test_boosted_model_saves_and_loads(rows, tmp_path):
    model = M.gbt_multiclass(part(rows, "train"), rounds=2, depth=2)
    model.save(str(tmp_path / "gbt"))
    again = M.GbtMulticlass.load(str(tmp_path / "gbt"))
    a, b = (m.transform(rows).select("match_id", *PROBS).orderBy("match_id").collect() for m in (model, again))
    assert a == b


@pytest.mark.parametrize("calibration", ["isotonic", "sigmoid", None])
def test_whole_run_saves_and_loads(spark, tables, tmp_path, calibration):
    from datetime import datetime

    from touchline.sources import registry as R

    labelled = materialize(M.labelled_features(tables.matches))
    fit = (lambda d: M.gbt_multiclass(d, rounds=2, depth=2)) if calibration == "sigmoid" else (lambda d: M.rf_classifier(d, trees=3, depth=3))
    run = M.train_run(labelled, fit, calibration=calibration, columns=COLUMNS)
    at = datetime(2001, 1, 1)
    for version in ("a", "b"):  # the second is a loaded run, saved again
        row = R.model_row(spark, id=1, algorithm="forest", at=at, metrics=run.registry_metrics(), hyperparameters={}, version=version)
        R.save_run(run, row, str(tmp_path), version)
        again = R.load_run(spark, str(tmp_path), version)
        a, b = (M.predict(labelled, r).orderBy("match_id").collect() for r in (run, again))
        assert a == b and len(a) == labelled.count()
        assert again.columns == COLUMNS and again.registry_metrics() == run.registry_metrics()
        assert again.model.model.importances() == run.model.model.importances()
        run = again
    assert spark.read.parquet(f"{tmp_path}/model_versions").count() == 2


def test_grid_search_takes_the_smallest_log_loss(rows):
    best, trials = M.grid_search(M.rf_classifier, rows, M.grid(trees=[2, 4], depth=[2]))
    table = trials.collect()
    assert len(table) == 2 and [t for t in table if t["best"]][0]["log_loss"] == min(t["log_loss"] for t in table)
    assert best in M.grid(trees=[2, 4], depth=[2])


def test_imputer_drops_empty_columns_flags_gaps_and_survives_saving(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, None), (4, 3.0, None)], "match_id long, a double, b double")
    for how, fill in (("mean", 7 / 3), ("median", 3.0), ("most_frequent", 3.0), ("constant", 9.0)):
        model = P.ExactImputer(columns=["a", "b"], strategy=how, fillValue=9.0, indicators=True).fit(df)
        out = model.transform(df)
        assert out.columns == ["match_id", "a", "a_missing"]
        assert out.filter("match_id = 2").first()["a"] == pytest.approx(fill)
    pipe = P.feature_pipeline(["a"], vector=None).fit(df)
    pipe.write().overwrite().save(str(tmp_path / "p"))
    assert PipelineModel.load(str(tmp_path / "p")).transform(df).collect() == pipe.transform(df).collect()


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    model = P.PopulationScaler(columns=["a"]).fit(df)
    assert [r["a"] for r in model.transform(df).collect()] == [0.0, 0.0]
    assert [r["a"] for r in model.inverse(model.transform(df)).collect()] == [5.0, 5.0]
    assert P.variance_select(df, ["a"]) == []


def test_goal_markets(spark):
    from touchline.functions.odds import goal_markets
    import math
    r = spark.createDataFrame([(1.5, 1.0)], "h double, a double").select(*[c.alias(n) for n, c in goal_markets("h", "a").items()]).first()
    assert r["btts_prob"] == pytest.approx((1 - math.exp(-1.5)) * (1 - math.exp(-1)))
    assert r["over_2_5_prob"] == pytest.approx(1 - sum(math.exp(-2.5) * 2.5 ** k / math.factorial(k) for k in range(3)))
