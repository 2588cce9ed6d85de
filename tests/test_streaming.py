"""Streams joined to streams: who comes first does not matter, and state expires."""

import datetime as dt

from pyspark.sql import functions as F

from touchline.schema import PREDICTION
from touchline.streaming import jobs as S

ODDS_UPDATE = "match_id long, match_date timestamp_ntz, updated_at timestamp_ntz, odds_home double, odds_draw double, odds_away double"
DAY = dt.timedelta(days=1)
START = dt.datetime(2025, 3, 1)


def odds(match, day, kick_off=8, price=3.0):
    return match, START + kick_off * DAY, START + day * DAY, price, 3.0, 3.0


def made(id_, match, day, version=2, outcome="H"):
    return id_, match, version, 0.5, 0.25, 0.25, outcome, 0.5, day is not None and START + day * DAY or None


def test_late_predictions_alert_and_state_expires(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("odds", "made", "out", "mark")]
    steps = [
        ([odds(1, 1), odds(2, 1), odds(3, 1, price=None), odds(4, 1), odds(None, 1)], [made(10, 2, 1.5)]),
        # Of match 1 after its odds; of 2 another model's; of 4 after kick-off.
        ([odds(2, 2, price=1.1)], [made(11, 1, 2), made(12, 2, 2, version=3), made(13, 4, 8.5), made(14, 5, 2), made(15, None, 2), made(16, 1, None)]),
        ([odds(5, 40, kick_off=60), odds(9, 40, kick_off=60)], [made(17, 9, 41, outcome="A")]),
        ([odds(9, 42, kick_off=60)], [made(18, 9, 42)]),
    ]
    kept = []
    for updates, predictions in steps:
        spark.createDataFrame(updates, ODDS_UPDATE).coalesce(1).write.mode("append").parquet(paths[0])
        spark.createDataFrame(predictions, PREDICTION).coalesce(1).write.mode("append").parquet(paths[1])
        streams = [S.read_files(spark, p, spark.read.parquet(p).schema) for p in paths[:2]]
        alerts = S.stream_live_value_bets(*streams, 2)
        running = S.write_append(alerts, paths[2], paths[3])
        running.awaitTermination()
        kept.append(running.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {(r["match_id"], r["prediction_id"], r["alerted_at"]) for r in spark.read.parquet(paths[2]).withColumn("alerted_at", F.col("alerted_at").cast("timestamp_ntz")).collect()}
    assert got == {(2, 10, START + 1.5 * DAY), (1, 11, START + 2 * DAY), (9, 18, START + 42 * DAY)}  # 17 picks an outcome of little value
    assert kept[1] >= 8 and kept[-1] <= 6  # all rows of March's first days are gone
