"""Streaming queries drained over the whole tables, checked against the batch answer."""

from pyspark.sql import functions as F

from touchline.catalog.base import AS_OF, ORACLES, query
from touchline.catalog.ingest import MERGED_COLS, resolved
from touchline.operators.ingest import ODDS
from touchline.plans.materialize import fresh_path, materialize
from touchline.streaming import jobs as S

PARTS = 3


def landings(t, df, part, name):
    """For each part in turn: writes its rows to a landing folder and gives the folder as a stream, so each part is one micro-batch."""
    path = fresh_path(t.spark, name)
    df = materialize(df.withColumn("part", part), name)
    for i in range(PARTS):
        rows = df.filter(F.col("part") == i).drop("part")
        rows.write.mode("append").parquet(path)
        yield S.read_files(t.spark, path, rows.schema)


# A window is final, and written, once the watermark (a day behind the latest start) has passed its end.
@query("X2_stream_job_stats", """SELECT CAST(date_trunc('hour', started_at) AS TIMESTAMP) AS window_start, status, count(*) AS jobs, CAST(sum(matches_scraped) AS BIGINT) AS matches_scraped,
    round(sum(duration_seconds), 6) AS total_duration FROM task_executions GROUP BY 1, 2
    HAVING date_trunc('hour', any_value(started_at)) + INTERVAL '1' HOUR <= (SELECT max(started_at) FROM task_executions) - INTERVAL '1' DAY""")
def job_stats(t):
    out, mark = fresh_path(t.spark, "stats"), fresh_path(t.spark, "mark")
    us = F.unix_micros(F.col("started_at").cast("timestamp"))
    ends = t.task_executions.agg(F.min(us).alias("low"), F.max(us).alias("high")).first()
    low, width = ends["low"] or 0, (ends["high"] or 0) - (ends["low"] or 0) + 1
    part = F.coalesce(F.floor((us - low) * PARTS / width), F.lit(0))  # runs come in order of time
    for runs in landings(t, t.task_executions, part, "runs"):
        stats = S.stream_job_stats(runs, lateness="1 day")
        S.write_append(stats, out, mark).awaitTermination()
    return t.spark.read.schema(stats.schema).parquet(out).withColumns({
        "window_start": F.col("window_start").cast("timestamp_ntz"), "total_duration": F.round("total_duration", 6)})


PICK_ODDS = "CASE p.predicted_outcome WHEN 'H' THEN m.odds_home WHEN 'D' THEN m.odds_draw ELSE m.odds_away END"


@query("X3_stream_value_bets", f"""SELECT m.id AS match_id, p.id AS prediction_id, p.model_version_id, p.predicted_outcome, {PICK_ODDS} AS market_odds, p.confidence * ({PICK_ODDS}) - 1 AS expected_value
    FROM predictions p JOIN matches m ON m.id = p.match_id WHERE p.model_version_id = 2 AND m.status = 'SCHEDULED'
    AND m.match_date >= TIMESTAMP '{AS_OF}' AND m.match_date <= TIMESTAMP '{AS_OF}' + INTERVAL '30' DAY
    AND m.odds_home IS NOT NULL AND {PICK_ODDS} <= 10 AND p.confidence * ({PICK_ODDS}) - 1 >= 0.05::DOUBLE""")
def value_bets(t):
    out, mark = fresh_path(t.spark, "alerts"), fresh_path(t.spark, "mark")
    games = S.open_predictions(t.predictions, t.matches, 2, AS_OF, ahead=30)
    rows = t.matches.select(F.col("id").alias("match_id"), *ODDS)
    for updates in landings(t, rows, F.pmod("match_id", F.lit(PARTS)), "updates"):
        alerts = S.stream_value_bets(updates, games)
        S.write_append(alerts, out, mark).awaitTermination()
    return t.spark.read.schema(alerts.schema).parquet(out).drop("kelly_fraction")


# Updates of a match come half a day to ten days before it, predictions a day before: some before, some after, some too far apart.
UPDATED = "m.match_date - INTERVAL '12' HOUR * (1 + m.id % 20)"


@query("X3_live_value_bets", f"""SELECT m.id AS match_id, p.id AS prediction_id, p.model_version_id, p.predicted_outcome, {PICK_ODDS} AS market_odds, p.confidence * ({PICK_ODDS}) - 1 AS expected_value,
    greatest(CAST({UPDATED} AS TIMESTAMP), CAST(p.predicted_at AS TIMESTAMP)) AS alerted_at
    FROM predictions p JOIN matches m ON m.id = p.match_id WHERE p.model_version_id = 2 AND p.predicted_at < m.match_date
    AND p.predicted_at BETWEEN {UPDATED} - INTERVAL '7' DAY AND {UPDATED} + INTERVAL '7' DAY
    AND m.odds_home IS NOT NULL AND {PICK_ODDS} <= 10 AND p.confidence * ({PICK_ODDS}) - 1 >= 0.05::DOUBLE""")
def live_value_bets(t):
    """Both streams come in order of time, in as many parts; the two parts of a batch are cut at the same times."""
    out, mark = fresh_path(t.spark, "alerts"), fresh_path(t.spark, "mark")
    half_days = (F.col("id") % 20 + 1).cast("int")
    updated = F.col("match_date") - F.make_dt_interval(hours=half_days * 12)
    odds = materialize(t.matches.filter("match_date IS NOT NULL").select(F.col("id").alias("match_id"), "match_date", updated.alias("updated_at"), *ODDS), "odds")
    made = t.predictions.filter("predicted_at IS NOT NULL")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ends = odds.agg(F.min(us("updated_at")).alias("low"), F.max(us("updated_at")).alias("high")).first()
    low, width = ends["low"] or 0, (ends["high"] or 0) - (ends["low"] or 0) + 1

    def turn(c):
        return F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor((us(c) - low) * PARTS / width)))

    for updates, predicted in zip(landings(t, odds, turn("updated_at"), "updates"), landings(t, made, turn("predicted_at"), "made")):
        alerts = S.stream_live_value_bets(updates, predicted, 2)
        S.write_append(alerts, out, mark).awaitTermination()
    return t.spark.read.schema(alerts.schema).parquet(out).drop("kelly_fraction").withColumn("alerted_at", F.col("alerted_at").cast("timestamp_ntz"))


def upsert(t):
    """Second scrapes arrive before first ones; new keys come last, so the answer is that of one batch, ids included."""
    table = S.MatchTable(t.spark, fresh_path(t.spark, "matches"))
    table.create(t.matches)
    mark, turn = fresh_path(t.spark, "mark"), F.pmod("seq", F.lit(4))
    part = F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2)
    for scraped in landings(t, resolved(t), part, "scraped"):
        S.stream_upsert(scraped, table, mark).awaitTermination()
    return table.read().select(*MERGED_COLS)


query("X1_stream_upsert")(upsert)
ORACLES["X1_stream_upsert"] = ORACLES["J17_upsert_upcoming"]
