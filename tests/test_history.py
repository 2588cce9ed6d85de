"""Hand values of form and head-to-head, and block-wise runs of the whole operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from touchline.operators import evaluation as E
from touchline.operators import history as H
from touchline.operators import splits as S
from touchline.operators.features import feature_columns, feature_matrix

REF = "2025-06-01 00:00:00"


def breakdown(spark, matches, team=1):
    teams = spark.createDataFrame([(i, f"t{i}") for i in range(1, 5)], "id long, name string")
    return H.form_breakdown(matches, teams, REF).filter(F.col("team_id") == team).first()


@pytest.mark.parametrize("rows, points", [
    ([(1, 2, 2, 0), (1, 3, 2, 0), (4, 1, 0, 1)], 3.0),
    ([(1, 2, 0, 2), (3, 1, 3, 0)], 0.0),
    ([(1, 2, 1, 1), (3, 1, 0, 0)], 1.0),
    ([(1, 2, 3, 1), (1, 3, 1, 1), (4, 1, 2, 0)], 4 / 3),
])
def test_average_points(spark, make_matches, rows, points):
    assert breakdown(spark, make_matches(rows))["avg_points"] == pytest.approx(points)


def test_breakdown(spark, make_matches):
    r = breakdown(spark, make_matches([(1, 2, 2, 0), (1, 3, 1, 1), (4, 1, 3, 0)]))
    assert r["avg_points"] == pytest.approx(4 / 3) and r["avg_goals_for"] == 1 and r["avg_goals_against"] == pytest.approx(4 / 3)
    assert [r[c] for c in ("win_rate", "draw_rate", "loss_rate")] == pytest.approx([1 / 3] * 3)


def test_no_history_is_zero(spark, make_matches):
    r = breakdown(spark, make_matches([(2, 3, 1, 0)]))
    assert all(r[c] == 0.0 for c in r.asDict() if c != "team_id")


def test_same_timestamp_does_not_see_each_other(spark, make_matches):
    day = datetime(2025, 1, 1)
    m = make_matches([(1, 2, 3, 0, day), (1, 3, 0, 1, day), (1, 4, None, None, day + timedelta(days=1))])
    got = {r["match_id"]: r for r in H.team_form(m).collect()}
    assert got[1]["home_points_last_5"] == 0 and got[2]["home_points_last_5"] == 0
    assert got[3]["home_points_last_5"] == 1.5


def test_density_counts_the_days_of_its_window(spark, make_matches):
    day = datetime(2025, 1, 1)
    rows = [(1, 2, 1, 0, day + timedelta(days=d)) for d in (0, 1, 2, 3, 4, 30, 32)]  # five and more long ago, two of late
    rows += [(1, 3, None, None, day + timedelta(days=40)), (1, 3, None, None, day + timedelta(days=44)), (1, None, 2, 0, day)]
    m = make_matches(rows)
    got = {r["match_id"]: tuple(r)[1:] for r in H.density_by_match(m).collect()}
    assert [got[i] for i in (1, 5, 6, 8, 9)] == [(0, 0), (5, 4), (0, 0), (2, 0), (2, 0)]
    assert got[10] == (0, 0)
    twice = [tuple(r) for r in H.density_by_match(m.union(m.filter("id = 8"))).filter("match_id = 8").collect()]
    assert twice == [(8, 2, 0)] * 2


@pytest.mark.parametrize("block_rows", [60, 10_000_000])
def test_density_equals_brute_force(spark, make_matches, block_rows):
    import random
    rng, day = random.Random(3), datetime(2025, 1, 1)
    rows = [(1 if rng.random() < 0.4 else rng.choice([2, 3, 4, None]), rng.randint(5, 8), *((1, 0) if rng.random() < 0.8 else (None, None)),
             day + timedelta(days=rng.randint(0, 60))) for _ in range(150)]
    m = make_matches(rows)
    done = [(r.home_team_id, r.away_team_id, r.match_date) for r in m.filter("status = 'FINISHED'").collect()]

    def brute(team, at):
        return sum(team in (h, a) and at - timedelta(days=14) <= d < at for h, a, d in done if team is not None)

    got = {r["match_id"]: tuple(r)[1:] for r in H.density_by_match(m, block_rows=block_rows).collect()}
    assert got == {r.id: (brute(r.home_team_id, r.match_date), brute(r.away_team_id, r.match_date)) for r in m.collect()}


def test_h2h_turns_to_the_current_home_side(spark, make_matches):
    d = datetime(2024, 12, 1)
    m = make_matches([(2, 1, 1, 1, d), (2, 1, 3, 0, d + timedelta(days=1)), (1, 2, None, None, d + timedelta(days=31))])
    r = H.h2h_stats(m).filter("match_id = 3").first()
    assert (r["h2h_matches_count"], r["h2h_home_wins"], r["h2h_draws"], r["h2h_away_wins"]) == (2, 0, 1, 1)
    assert r["h2h_recent_home_form"] == 0.5 and r["h2h_home_avg_goals"] == 0.5
    last = H.h2h_asof(m).filter("match_id = 3 AND rn = 2").first()
    assert last["hist_id"] == 1 and last["result"] == "D"


def test_trend_divides_by_the_older_matches_there_are(spark, make_matches):
    d = datetime(2025, 1, 1)
    m = make_matches([(1, 2, 1, 0, d + timedelta(days=i)) for i in range(4)] + [(1, 2, None, None, d + timedelta(days=9))])
    assert H.team_form(m).filter("match_id = 5").first()["home_form_trend"] == 0.0  # 3.0 over three, 3.0 over one
    assert H.team_form(m).filter("match_id = 4").first()["home_form_trend"] == 0.0  # only three earlier


def same(a, b):
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert a.columns == b.columns
    assert key(a.collect()) == key(b.collect())


@pytest.mark.parametrize("op", [
    lambda m, n: feature_matrix(m, block_rows=n), lambda m, n: H.h2h_asof(m, block_rows=n),
    lambda m, n: H.team_history_asof(m, 5, block_rows=n), lambda m, n: H.match_count_before(m, block_rows=n),
    lambda m, n: H.fixture_density(m, block_rows=n), lambda m, n: H.rolling_form(m, block_rows=n),
    lambda m, n: H.training_rows(m, block_rows=n)])
def test_blocks_do_not_change_answers(tables, op):
    """With a third of all matches on one team and few rows per block."""
    hot = tables.matches.withColumn("home_team_id", F.when(F.col("num_bookmakers") < 5, F.lit(1)).otherwise(F.col("home_team_id"))).filter(
        "home_team_id <> away_team_id")
    same(op(hot, 10_000_000), op(hot, 150))


def test_block_splits_and_curves(tables):
    scored = E.scored_frame(tables.predictions, tables.matches)
    placed = E.bets(scored)
    a = E.max_drawdown(placed).orderBy("model_version_id").collect()
    b = E.max_drawdown(placed, block_rows=100).orderBy("model_version_id").collect()
    for x, y in zip(a, b):
        assert x["max_drawdown"] == pytest.approx(y["max_drawdown"], abs=1e-9)
    for op in (E.roc_auc, E.ndcg_home):
        x = {tuple(r)[:-1]: r[-1] for r in op(scored).collect()}
        y = {tuple(r)[:-1]: r[-1] for r in op(scored, block_rows=100).collect()}
        assert x == pytest.approx(y, abs=1e-9)
    m = tables.matches.filter("status = 'FINISHED'").withColumnRenamed("id", "match_id")
    same(S.temporal_split(m).select("match_id", "split"), S.temporal_split(m, block_rows=90).select("match_id", "split"))
    same(S.expanding_split(m), S.expanding_split(m, block_rows=90))


def test_sixty_five_features(tables):
    assert len(feature_columns()) == len(set(feature_columns())) == 65
    assert feature_matrix(tables.matches).columns == ["match_id", *feature_columns()]
