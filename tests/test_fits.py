"""Fits by aggregation, dominance counts and bracketed quantiles against numpy and brute force."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from touchline.operators import fits
from touchline.operators import history as H
from touchline.operators.calibration import chi2_sf
from touchline.plans.ordering import exact_quantiles
from touchline.schema import MATCH


def pav(score, hit):
    blocks = []
    for x in sorted(set(score)):
        own = [h for s, h in zip(score, hit, strict=True) if s == x]
        blocks.append([sum(own), len(own), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + xs]
    return {x: s / w for s, w, xs in blocks for x in xs}


SHAPES = {
    "noise": lambda rng, x: float(rng.random() < x),
    "falling": lambda rng, x: 1.0 - x,
    "rising": lambda rng, x: x,
    "steps": lambda rng, x: math.floor(x * 5) / 5 - 0.01 * x,
    "valley": lambda rng, x: abs(x - 0.5),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("pool_rows", [7, 1000])
def test_isotonic_steps(spark, shape, pool_rows):
    rng = random.Random(7)
    score = [rng.randint(0, 60) / 60 for _ in range(150)]
    hit = [SHAPES[shape](rng, x) for x in score]
    rows = spark.createDataFrame([(0, x, h) for x, h in zip(score, hit, strict=True)] + [(1, 0.5, 1.0), (2, None, 1.0), (0, 0.3, None)], "cls int, score double, hit double")
    steps = fits.isotonic_steps(rows, pool_rows=pool_rows)
    want = pav(score, hit)
    got = {r["score"]: r["value"] for r in fits.isotonic_values(steps, rows.where("cls = 0 AND hit IS NOT NULL").select("cls", "score")).collect()}
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)
    values = [r["value"] for r in steps.where("cls = 0").orderBy("low").collect()]
    assert values == sorted(set(values))


def test_isotonic_values_frames_grow_from_the_start(spark):
    steps = spark.createDataFrame([(0, 0.25, 0.5, 0.1)], "cls int, low double, high double, value double")
    values = fits.isotonic_values(steps, spark.createDataFrame([(0, 0.1), (0, 0.6)], "cls int, score double"))
    assert "unboundedfollowing" not in values._jdf.queryExecution().optimizedPlan().toString().lower()  # quadratic in a range's rows
    assert {r["score"]: r["value"] for r in values.collect()} == {0.1: 0.1, 0.6: 0.1}


def test_isotonic_values_between_and_beyond_the_steps(spark):
    steps = spark.createDataFrame([(0, 0.2, 0.4, 0.1), (0, 0.6, 0.6, 0.5), (1, 0.5, 0.5, 0.3)], "cls int, low double, high double, value double")
    asked = [(0, x) for x in (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 1.0, 1.0, None)] + [(1, 0.1), (1, 0.9)]
    got = {(r["cls"], r["score"]): r["value"] for r in fits.isotonic_values(steps, spark.createDataFrame(asked, "cls int, score double").repartition(5)).collect()}
    assert got == pytest.approx({(0, 0.0): 0.1, (0, 0.2): 0.1, (0, 0.3): 0.1, (0, 0.4): 0.1, (0, 0.5): 0.3, (0, 0.6): 0.5, (0, 1.0): 0.5, (1, 0.1): 0.3, (1, 0.9): 0.3})


def test_sigmoid_curves(spark):
    rng = np.random.default_rng(2)
    x = rng.random(400).round(2)
    data = [(k, float(v), float(rng.random() < 1 / (1 + np.exp(-(3 * k * v - 1))))) for k in (0, 1, 2) for v in x] + [(1, None, 1.0), (1, 0.5, None)]
    data += [(3, 0.2, 0.0), (3, 0.8, 1.0)]  # separable: the penalty keeps the slope finite
    got = fits.sigmoid_curves(spark.createDataFrame(data, "cls int, score double, hit double"))
    for k in range(4):
        own = np.array([(s, h) for c, s, h in data if c == k and s is not None and h is not None])
        a, b = got[k]
        p = 1 / (1 + np.exp(-(a * own[:, 0] + b)))
        assert np.abs([((p - own[:, 1]) * own[:, 0]).sum() + a, (p - own[:, 1]).sum()]).max() < 1e-8  # the gradient is zero there
    assert fits.sigmoid_curves(spark.createDataFrame([], "cls int, score double, hit double")) == {}


@pytest.mark.parametrize("d", [1, 65])
def test_poisson_rates(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(600, d))
    y = rng.poisson(np.exp(0.3 + x[:, :1].sum(axis=1) * 0.4), size=(2, 600))
    rows = spark.createDataFrame([(x[i].tolist(), int(y[0, i]), int(y[1, i])) for i in range(600)] + [([0.0] * d, None, 1)], "x array<double>, a int, b int")
    model = fits.poisson_rates(rows.withColumn("features", array_to_vector("x")), {"ra": "a", "rb": "b"}, alpha=0.1)
    for name, own in zip(("ra", "rb"), y, strict=True):
        intercept, weights = model.rates[name]
        rate = np.exp(intercept + x @ np.array(weights))
        assert abs((own - rate).mean()) < 1e-9  # gradients of the intercept and of the weights
        assert np.abs(x.T @ (own - rate) / len(x) - 0.1 * np.array(weights)).max() < 1e-9
    got = model.transform(rows.limit(600).withColumn("features", array_to_vector("x"))).select("ra").toPandas().ra
    np.testing.assert_allclose(sorted(got), sorted(np.exp(model.rates["ra"][0] + x @ np.array(model.rates["ra"][1]))), rtol=1e-12)
    with pytest.raises(ValueError, match="no rows"):
        fits.poisson_rates(rows.limit(0).withColumn("features", array_to_vector("x")), {"ra": "a"})


def test_poisson_steps_read_a_written_table(spark, monkeypatch):
    written = []
    monkeypatch.setattr(fits, "materialize", lambda df, name: written.append((name, df.columns)) or df)
    rows = spark.createDataFrame([([float(i % 5)], i % 3) for i in range(60)], "x array<double>, a int").withColumn("features", array_to_vector("x"))
    fits.poisson_rates(rows, {"ra": "a"})
    assert written == [("poisson", ["x", "y0"])]


def test_chi_square_tail(spark):
    def tail(x, k):
        if x <= 0:
            return 1.0
        h, total, order = x / 2, *((math.erfc(math.sqrt(x / 2)), 0.5) if k % 2 else (math.exp(-x / 2), 1.0))
        while order < k / 2:
            total += math.exp(order * math.log(h) - h - math.lgamma(order + 1))
            order += 1
        return total

    data = [(x, float(k)) for x in (-1.0, 0.0, 1e-9, 0.3, 2.0, 7.7, 20.0, 60.0, 900.0) for k in (1, 2, 3, 8, 9, 30)]
    for r in spark.createDataFrame(data, "x double, k double").withColumn("p", chi2_sf(F.col("x"), F.col("k"))).collect():
        assert r["p"] == pytest.approx(tail(r["x"], int(r["k"])), abs=1e-12, rel=1e-9)


# --- standings -------------------------------------------------------------------------------


def standings(rows):
    """(match, side) -> (position, points) by replaying every day of a season over all of its teams."""
    out = {}
    for season in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == season]
        teams = {t for r in own for t in r[3:5]}
        for day in {r[5].date() for r in own}:
            table = {t: [0, 0] for t in teams}
            for r in own:
                if r[5].date() < day and r[6] == "FINISHED" and r[7] is not None:
                    for team, gf, ga in ((r[3], r[7], r[8]), (r[4], r[8], r[7])):
                        table[team][0] += 3 if gf > ga else int(gf == ga)
                        table[team][1] += gf - ga
            for r in own:
                if r[5].date() == day:
                    for side, team in (("home", r[3]), ("away", r[4])):
                        out[r[0], side] = (1 + sum(tuple(v) > tuple(table[team]) for v in table.values()), table[team][0])
    return out


@pytest.mark.parametrize("block_rows", [40, 10_000_000])
def test_tournament_context_with_hot_and_null_seasons(spark, block_rows):
    rng, rows = random.Random(11), []
    for i in range(1, 241):
        season = rng.choice([None, None, 7, 7, 7, 8, 9])  # a third without a season, a hot one, some days with several matches
        home, away = rng.sample(range(1, 9), 2)
        done = rng.random() < 0.85
        rows.append((i, 1, season, home, away, datetime(2024, 2, 20) + timedelta(hours=6 * rng.randint(0, 200)), "FINISHED" if done else "SCHEDULED",
                     rng.randint(0, 3) if done else None, rng.randint(0, 3) if done else None, None, None, None, None))
    got = H.tournament_context(spark.createDataFrame(rows, MATCH).repartition(4), block_rows=block_rows).collect()
    assert len(got) == len(rows)
    want = standings(rows)
    for r in got:
        for side in ("home", "away"):
            assert (r[f"{side}_league_position"], r[f"{side}_points_total"]) == want[r["match_id"], side]


def test_tournament_context_of_nothing(spark):
    assert H.tournament_context(spark.createDataFrame([], MATCH)).count() == 0


# --- bracketed quantiles -----------------------------------------------------------------------


def test_bracketed_quantiles(spark):
    rng = np.random.default_rng(9)
    n = 30_000
    columns = {"u": rng.random(n), "skew": rng.lognormal(0, 8, n), "tied": np.repeat([0.0, 1.0], n // 2), "few": rng.integers(0, 3, n).astype(float), "sorted": np.arange(n, dtype=float)}
    df = spark.createDataFrame([tuple(float(columns[c][i]) for c in columns) + (None, 1.5 if i == 5 else None) for i in range(n)],
                               ", ".join(f"{c} double" for c in [*columns, "none", "one"]))
    probs = [0.0, 0.013, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, dict.fromkeys([*columns, "none", "one"], probs))
    for c, values in columns.items():
        np.testing.assert_allclose(got[c], np.quantile(values, probs), rtol=1e-12)
    assert got["none"] == [None] * 5 and got["one"] == [1.5] * 5


def test_brackets_that_miss_are_opened(spark, monkeypatch):
    """A sketch so coarse that a wanted rank lies outside its bracket."""
    from touchline.plans import ordering

    monkeypatch.setattr(ordering, "BRACKET", 0.0)
    monkeypatch.setattr(ordering, "SKETCH_ACCURACY", 2)
    values = np.random.default_rng(1).random(20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    np.testing.assert_allclose(exact_quantiles(df, {"v": [0.1, 0.5, 0.9]})["v"], np.quantile(values, [0.1, 0.5, 0.9]), rtol=1e-12)


def test_few_steps_are_looked_up_as_they_are_joined(spark):
    from touchline.operators import fits
    from touchline.operators.models import Calibrator
    steps = [(c, 0.1 * i + 0.01 * c, 0.1 * i + 0.01 * c + (0.05 if i % 2 else 0.0), i / 9 + c / 100) for c in (0, 1) for i in range(1, 9)]
    maps = spark.createDataFrame(steps, "cls int, low double, high double, value double")
    scores = [(i, *[x if k else (None if i == 5 else x)for k, x in enumerate(((i % 101) / 100, (i % 77) / 76, 0.1 * (i % 9)))]) for i in range(300)]
    df = spark.createDataFrame(scores, "match_id int, prob_home double, prob_draw double, prob_away double")
    asked = df.selectExpr("inline(array(struct(0 AS cls, prob_home AS score), struct(1 AS cls, prob_draw AS score)))")
    want = {(r["cls"], r["score"]): r["value"] for r in fits.isotonic_values(maps, asked).collect()}
    points = fits.step_points(maps)
    for cls, name in ((0, "prob_home"), (1, "prob_draw")):
        got = df.select(name, fits.point_values(points[cls], F.col(name)).alias("v")).collect()
        assert all(r["v"] == want[cls, r[name]] for r in got if r[name] is not None) and all(r["v"] is None for r in got if r[name] is None)
    assert fits.step_points(maps, most=3) is None and df.select(fits.point_values([], F.col("prob_away"))).first()[0] is None
    plan = Calibrator("isotonic", maps).calibrate(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # rows to calibrate are neither moved nor scored twice
