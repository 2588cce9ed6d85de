"""Arrival-order merges, page parsing and the stream equal to the batch."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from touchline.operators import ingest as I
from touchline.operators import quality as Q
from touchline.schema import MATCH
from touchline.sources import pages as G
from touchline.streaming import jobs as S

D = datetime(2025, 3, 1, 15, 0)
RESOLVED = ("seq long, tournament_id long, home_team_id long, away_team_id long, match_date timestamp_ntz, home_score int, away_score int, "
            "odds_home double, odds_draw double, odds_away double, num_bookmakers int")


def stored(spark, *rows):
    return spark.createDataFrame(list(rows), MATCH)


def test_upcoming_rows_fold_in_arrival_order(spark):
    m = stored(spark, (1, None, None, 10, 20, D, "SCHEDULED", None, None, 2.0, 3.0, 4.0, 5))
    batch = spark.createDataFrame([
        (1, 7, 10, 20, D, None, None, 2.5, None, 4.5, 9),     # priced: replaces all three, draw by NULL
        (2, 8, 10, 20, D, None, None, None, 9.9, 9.9, 9),     # not priced: leaves the odds alone
        (3, None, 30, 40, D, None, None, 0.0, 1.1, 1.2, 9),   # new, zero odds do not count but its first row inserts them
        (4, 6, 30, 40, D, None, None, None, None, None, 9),   # fills the tournament
    ], RESOLVED)
    got = {r["home_team_id"]: r for r in I.upsert_upcoming(m, batch).collect()}
    assert [got[10][c] for c in ("id", "tournament_id", "odds_home", "odds_draw", "odds_away", "num_bookmakers")] == [1, 7, 2.5, None, 4.5, 5]
    assert [got[30][c] for c in ("id", "tournament_id", "status", "odds_home", "odds_draw", "num_bookmakers")] == [2, 6, "SCHEDULED", 0.0, 1.1, None]


def test_open_row_blocks_its_result_unless_asked(spark):
    m = stored(spark, (1, 7, None, 10, 20, D, "SCHEDULED", None, None, 2.0, 3.0, 4.0, 5))
    batch = spark.createDataFrame([(1, 7, 10, 20, D, 2, 1, None, None, None, None), (2, 8, 10, 20, D, 3, 3, 2.0, 3.0, 4.0, 6),
                                   (3, 8, 10, 20, D, 0, 0, 2.0, 3.0, 4.0, 6)], RESOLVED)
    got = I.insert_results(m, batch).orderBy("id").collect()
    assert [(r["id"], r["tournament_id"], r["status"], r["home_score"]) for r in got] == [(1, 7, "SCHEDULED", None), (2, 8, "FINISHED", 3)]
    done = I.insert_results(m, batch, update_existing=True).filter("id = 1").first()
    assert (done["status"], done["home_score"], done["odds_home"]) == ("FINISHED", 2, 2.0)


def test_dimension_ids_follow_arrival(spark):
    teams = spark.createDataFrame([(4, "a")], "id long, name string")
    raw = spark.createDataFrame([(1, "c", "a"), (2, "b", "c")], "seq long, home_team string, away_team string")
    assert {r["name"]: r["id"] for r in I.get_or_create_dim(teams, I.team_names(raw), "name").collect()} == {"a": 4, "c": 5, "b": 6}


def game(time, home, away, tail):
    clock = f'<div data-testid="time-item">{time}</div>' if time else ""
    return f'<div data-testid="game-row">{clock}<a title="{home}" href="#">{home}</a><a title="{away}">{away}</a>{tail}</div>'


def test_results_page(spark):
    html = ('<nav><a title="x">menu</a></nav><div class="eventRow"><div data-testid="date-header"><b>08 Jan 2026</b></div>'
            + game("15:00", "A", "B", "<p>2 – 1</p><p>2.10</p><p>3.40</p><p>3.20</p><p>12</p>")
            + game(None, "C", "D", "<p>postp.</p><p>2.10</p>")                                          # no score
            + '<div data-testid="date-header">Next round</div>'                                          # no date: the old one stays
            + game(None, "E", "F", "<p>0-0</p><p>1.50</p><p>120</p>")                                    # one price only
            + '<div data-testid="date-header">9 Feb 2026</div>'
            + game("20:45", "G", "H", "<p>3-3</p><p>1.5</p><p>2.5</p><p>3.5</p><p>100</p>")              # too many bookmakers
            + '</div><footer>55 9.99</footer>')
    got = G.pages_to_results(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r["home_team"], r["match_date"], r["home_score"], r["odds_home"], r["odds_away"], r["num_bookmakers"]) for r in got] == [
        ("A", datetime(2026, 1, 8, 15, 0), 2, 2.10, 3.20, 12), ("E", datetime(2026, 1, 8), 0, 1.50, None, None),
        ("G", datetime(2026, 2, 9, 20, 45), 3, 1.5, 3.5, None)]


def test_upcoming_page(spark):
    html = (game("12:00", "A", "B", "<p>2.10</p>")
            + '<div data-testid="sport-country-league-item"><a data-testid="header-country-item" href="/f/">new zealand</a>'
              '<a data-testid="header-tournament-item" href="/football/new-zealand/cup/">Cup</a></div>'
            + '<div data-testid="secondary-header"><div class="text-black-main">Today, 15 Jan</div></div>'
            + game("18:30", "C", "D", "<p>2.10</p><p>3.30</p><p>3.10</p><p>140</p>")
            + '<div data-testid="secondary-header">16 Jan 2027</div>' + game("18:30", "E", "F", "")).replace("</body>", "")
    got = G.pages_to_upcoming(spark.createDataFrame([(1, html)], "page_id long, html string"), as_of="2026-01-10 00:00:00").orderBy("pos").collect()
    assert [(r["tournament_name"], r["country"], r["tournament_slug"]) for r in got] == [
        ("Unknown Tournament", "World", None), ("Cup", "New Zealand", "cup"), ("Cup", "New Zealand", "cup")]
    # A year other than the current one gets the current one appended and is no date.
    assert [r["match_date"] for r in got] == [datetime(2026, 1, 10), datetime(2026, 1, 15, 18, 30), datetime(2026, 1, 10)]
    assert got[1]["num_bookmakers"] == 140


def test_season_links_and_page_count(spark):
    html = ('<a href="/x/cup/results/">2025/2026</a><a href="/x/cup-2023-2024/results/">2023/2024</a><a href="/x/">About</a>'
            '<a class="pagination-link" href="#">9</a><a class="pagination-link" href="#">11</a><a class="pagination-link">Next</a>')
    pages = spark.createDataFrame([(1, html), (2, "<p/>")], "page_id long, html string")
    assert {tuple(r)[1:] for r in G.season_links(pages).collect()} == {("2025/2026", None, True), ("2023/2024", "2023-2024", False)}
    assert {tuple(r) for r in G.page_count(pages).collect()} == {(1, 11), (2, 1)}


@pytest.mark.parametrize("row, broken", [
    ((.5, .3, .2, "H", .5), []), ((1.2, .3, .2, "H", .5), ["prob_home_range"]), ((.5, -.1, .2, "Z", .5), ["prob_draw_range", "outcome_domain"]),
    ((.5, .3, .2, "A", 1.5), ["confidence_range"])])
def test_prediction_rules(spark, row, broken):
    df = spark.createDataFrame([row], "prob_home double, prob_draw double, prob_away double, predicted_outcome string, confidence double")
    assert Q.validate(df, Q.prediction_rules()).first()["violations"] == broken


def test_other_rules(spark):
    df = spark.createDataFrame([("POSTPONED", 1.5, 101.0)], "status string, accuracy double, expected_value double")
    rules = {**Q.match_domain_rules(), **Q.model_rules(), **Q.value_bet_rules()}
    assert Q.validate(df, rules).first()["violations"] == ["status_domain", "accuracy_range", "expected_value_range"]


def test_stream_merges_in_order_and_survives_a_replay(spark, tmp_path):
    table = S.MatchTable(spark, str(tmp_path / "m"))
    table.create(stored(spark, (1, 7, None, 10, 20, D, "SCHEDULED", None, None, 2.0, 3.0, 4.0, 5)))
    schema = spark.createDataFrame([], RESOLVED).schema
    for i, (home, price) in enumerate([(10, 2.5), (30, 1.7)]):
        spark.createDataFrame([(i, 7, home, 20, D, None, None, price, 3.0, 4.0, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.read_files(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    S.stream_upsert(stream, table, str(tmp_path / "ck")).awaitTermination()
    rows = lambda: sorted((r["id"], r["home_team_id"], r["odds_home"]) for r in table.read().collect())
    assert rows() == [(1, 10, 2.5), (2, 30, 1.7)]
    replay = spark.createDataFrame([(1, 7, 30, 20, D, None, None, 1.7, 3.0, 4.0, 1)], schema)
    table.merge(replay, 1, I.upsert_upcoming)
    assert rows() == [(1, 10, 2.5), (2, 30, 1.7)]


def test_late_rows_beyond_the_watermark_drop(spark, tmp_path):
    schema = "id long, status string, started_at timestamp_ntz, duration_seconds double, matches_scraped int"
    for i, day in enumerate((10, 11, 1)):  # the watermark of one batch filters the batch after the next
        spark.createDataFrame([(i, "completed", datetime(2025, 1, day), 1.0, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    stats = S.stream_job_stats(S.read_files(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1), lateness="1 hour")
    S.write_append(stats, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.schema(stats.schema).parquet(str(tmp_path / "out")).filter(F.col("window_start") < "2025-01-05").count() == 0


def test_replay_after_a_part_committed_batch_keeps_ids(spark, tmp_path):
    table = S.MatchTable(spark, str(tmp_path / "m"))
    table.create(stored(spark, (1, 7, None, 10, 20, D, "SCHEDULED", None, None, 2.0, 3.0, 4.0, 5)))
    april = datetime(2025, 4, 1, 15, 0)
    rows = [(1, 7, 30, 20, D, None, None, 1.5, 3.0, 4.0, 1), (2, 7, 31, 20, april, None, None, 1.6, 3.0, 4.0, 1)]
    batch = spark.createDataFrame(rows, RESOLVED)
    # A first try that numbered the batch and committed April only.
    before = table.read().drop("month")
    ids = table._batch_ids(before.filter(F.lit(False)), batch, 0, I.UPCOMING_KEY)
    part = table.with_month(I.upsert_upcoming(before, batch, ids=ids)).filter("month = '2025-04'")
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(table.rows)
    for _ in range(2):
        table.merge(batch, 0, I.upsert_upcoming)
        assert sorted((r["id"], r["home_team_id"]) for r in table.read().collect()) == [(1, 10), (2, 30), (3, 31)]
    assert table.next_id(1) == 4


def test_batches_out_of_order_end_as_one_batch(spark, tmp_path):
    start = stored(spark, (1, None, None, 10, 20, D, "SCHEDULED", None, None, 2.0, 3.0, 4.0, 5))
    rows = [(3, 9, 10, 20, D, None, None, 9.0, 3.0, 4.0, 1), (2, 8, 10, 20, D, None, None, 1.5, 3.0, 4.0, 1), (8, 6, 30, 20, D, None, None, None, 8.0, 8.0, 1),
            (7, 5, 30, 20, D, None, None, 0.0, 7.0, 7.0, 1), (9, None, 40, 20, D, None, None, 2.2, 3.0, 4.0, 1), (6, 4, 40, 20, D, None, None, None, 1.0, 1.0, 1)]
    table = S.MatchTable(spark, str(tmp_path / "m"))
    table.create(start)
    for i, row in enumerate(rows):
        table.merge(spark.createDataFrame([row], RESOLVED), i, I.upsert_upcoming)
    columns = ["home_team_id", "tournament_id", "status", "odds_home", "odds_draw", "odds_away"]
    expected = I.upsert_upcoming(start, spark.createDataFrame(rows, RESOLVED)).select(*columns)
    assert sorted(map(tuple, table.read().select(*columns).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_results_without_tournament_are_inserted_once(spark, tmp_path):
    table = S.MatchTable(spark, str(tmp_path / "m"))
    table.create(stored(spark))
    batch = spark.createDataFrame([(1, None, 10, 20, D, 2, 1, None, None, None, None), (2, None, 10, 20, D, 3, 3, None, None, None, None)], RESOLVED)
    for turn in (0, 0, 1):
        table.merge(batch, turn, I.insert_results)
        assert [(r["id"], r["home_score"]) for r in table.read().collect()] == [(1, 2)]
