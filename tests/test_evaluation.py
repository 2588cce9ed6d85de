"""Metrics on literal frames: edge probabilities, absent classes, equity against a plain loop."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from touchline.operators import calibration as K
from touchline.operators import evaluation as E
from touchline.operators import models as M
from touchline.operators.fits import isotonic_values
from touchline.schema import PROBS


def frame(spark, rows):
    """(label, pred, pH, pD, pA[, odds...]) rows of model 1."""
    full = [(i, 1, r[0], r[1], *map(float, r[2:5]), *(map(float, r[5:8]) if len(r) > 5 else (None,) * 3), datetime(2025, 1, 1), i)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "match_id long, model_version_id int, label int, pred int, prob_home double, prob_draw double, "
                                 "prob_away double, odds_home double, odds_draw double, odds_away double, match_date timestamp_ntz, us long")


def test_class_never_predicted_and_absent_label(spark):
    df = frame(spark, [(0, 0, .6, .3, .1), (0, 2, .3, .1, .6), (2, 2, .2, .1, .7)])
    r = E.classification_metrics(df).first()
    assert r["accuracy"] == pytest.approx(2 / 3)
    assert r["precision_D"] == r["recall_D"] == r["f1_D"] == 0.0
    assert r["f1_macro"] == pytest.approx((2 / 3 + 2 / 3) / 2)  # draws occur nowhere
    assert E.confusion(df).count() == 9


def test_single_class_labels(spark):
    r = E.classification_metrics(frame(spark, [(1, 1, .2, .6, .2), (1, 0, .5, .3, .2)])).first()
    assert r["accuracy"] == 0.5 and r["recall_D"] == 0.5


def test_top2_ties_prefer_the_higher_class(spark):
    rows = [(0, 0, .3, .3, .4), (1, 1, .3, .3, .4), (2, 2, .3, .3, .4)]
    assert [r["ok"] for r in frame(spark, rows).orderBy("match_id").select(E.in_top2().alias("ok")).collect()] == [0.0, 1.0, 1.0]


def test_log_loss_of_a_certain_miss_is_finite(spark):
    r = E.classification_metrics(frame(spark, [(0, 1, 0, 1, 0)])).first()
    assert r["log_loss"] == pytest.approx(-math.log(E.EPS)) and r["log_loss_eps"] == pytest.approx(-math.log(1e-10))


def test_bins_are_left_open(spark):
    edges = K.linspace_edges()
    df = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.1000001, 0.3, 1.0)], "p double")
    opened = [r[0] for r in df.select(K.bin_number(F.col("p"), edges, False)).collect()]
    closed = [r[0] for r in df.select(K.bin_number(F.col("p"), edges, True)).collect()]
    assert opened == [None, 0, 1, 2, 9] and closed == [0, 0, 1, 2, 9]


def test_equity_drawdown_and_totals_equal_a_loop(spark):
    import random
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        w = [rng.random() + .1 for _ in range(3)]
        rows.append((rng.randrange(3), 0, *[x / sum(w) for x in w], *[1.5 + 4 * rng.random() for _ in range(3)]))
    df = frame(spark, rows)
    equity, peak, worst, staked, steps = 0.0, 0.0, 0.0, 0.0, []
    for label, _, *vals in rows:
        for c in range(3):
            p, odds = vals[c], vals[3 + c]
            if p - 1 / odds > 0:
                kelly = max(0, ((odds - 1) * p - (1 - p)) / (odds - 1)) * .25
                stake = kelly if kelly > 0 else 1.0
                staked += stake
                steps.append(stake * odds - stake if c == label else -stake)
                equity += steps[-1]
                peak = max(peak, equity)
                worst = max(worst, (peak - equity) / (peak + 1e-10) if peak > 0 else 0)
    mean = sum(steps) / len(steps)
    std = math.sqrt(sum((s - mean) ** 2 for s in steps) / len(steps))
    for block_rows in (50, 10_000_000):
        r = E.betting_metrics(df, block_rows=block_rows).first()
        assert r["total_bets"] == len(steps) and r["total_stake"] == pytest.approx(staked)
        assert r["profit_loss"] == pytest.approx(equity) and r["max_drawdown"] == pytest.approx(worst)
        assert r["sharpe_ratio"] == pytest.approx(mean / (std + 1e-10))


def test_matches_without_all_odds_place_no_bets(spark):
    df = frame(spark, [(0, 0, .9, .05, .05, 2, 3, 4)]).withColumn("odds_draw", F.lit(None).cast("double"))
    assert E.bets(df).count() == 0


@pytest.mark.parametrize("x, k, p", [(3.841458820694124, 1, .05), (16.918977604620448, 9, .05), (15.50731305586545, 8, .05), (0.0, 9, 1.0)])
def test_chi_square_tail(spark, x, k, p):
    got = spark.range(1).select(K.chi2_sf(F.lit(x), F.lit(float(k))).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=1e-9)


def pav(points):
    """Reference pool-adjacent-violators on (x, y, w) sorted by x."""
    blocks = []
    for x, y, w in points:
        blocks.append([y * w, w, [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w2, xs = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][2] += xs
    return {x: s / w for s, w, xs in blocks for x in xs}


def test_isotonic_is_monotone_and_equals_pool_adjacent_violators(spark, tables):
    scored = E.scored_frame(tables.predictions, tables.matches)
    calibrator = M.fit_calibrator(scored, "isotonic")
    pdf = scored.select("prob_home", (F.col("label") == 0).cast("double").alias("y")).toPandas()
    levels = pdf.groupby("prob_home").y.agg(["mean", "count"]).reset_index()
    want = pav(levels.itertuples(index=False, name=None))
    got = isotonic_values(calibrator.maps, scored.select(F.lit(0).alias("cls"), F.col("prob_home").alias("score"))).toPandas()
    assert len(got) == len(want)
    for r in got.itertuples():
        assert r.value == pytest.approx(want[r.score], abs=1e-9)


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_sums_to_one_and_does_not_worsen_brier(tables, method):
    scored = E.scored_frame(tables.predictions, tables.matches)
    after = M.fit_calibrator(scored, method).calibrate(scored)
    total = after.select(F.max(F.abs(sum((F.col(p) for p in PROBS), F.lit(0.0)) - 1))).first()[0]
    assert total < 1e-9
    brier = [df.agg(E.brier()).first()[0] for df in (scored, after)]
    assert brier[1] <= brier[0] + 1e-9


def test_compare_models_first_wins_ties(spark):
    rows = [(1, .5, 1.0, .4, None), (2, .5, .9, .4, -3.0)]
    df = spark.createDataFrame(rows, "model_version_id int, accuracy double, log_loss double, f1_macro double, roi_percent double")
    assert tuple(E.compare_models(df).first()) == (1, 2, 1, 1)


def test_compare_models_missing_metrics_lose(spark):
    rows = [(1, None, None, None, None), (2, .5, .9, .4, -3.0)]
    df = spark.createDataFrame(rows, "model_version_id int, accuracy double, log_loss double, f1_macro double, roi_percent double")
    assert tuple(E.compare_models(df).first()) == (2, 2, 2, 1)


def test_quantiles_of_each_group_with_ties_and_nulls(spark):
    import numpy as np

    from touchline.plans.ordering import quantile_table

    rng = np.random.default_rng(3)
    data = {1: np.repeat([0.0, 1.0], 500), 2: rng.random(777), 3: np.array([0.25])}
    rows = [(g, float(v)) for g, values in data.items() for v in values] + [(1, None), (4, None), (None, 0.5)]
    got = {r["g"]: r["edges"] for r in quantile_table(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    assert set(got) == set(data)
    for g, values in data.items():
        np.testing.assert_allclose(got[g], np.quantile(values, [0.0, 0.1, 0.5, 1.0]), atol=1e-12)
    assert not quantile_table(spark.createDataFrame([], "g long, v double"), ["g"], "v", [0.5]).collect()


def test_evaluation_writes_its_frame_once(spark):
    found = E.evaluate_predictions(frame(spark, [(0, 0, .6, .3, .1, 2, 3, 4), (2, 2, .2, .1, .7, 2, 3, 4)]))
    assert found.inputFiles() and all("/scored-" in f for f in found.inputFiles())  # the join does not run for each metric
