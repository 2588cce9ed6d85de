"""Structured Streaming jobs over the same tables and rules as the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from touchline.functions.odds import expected_value, has_odds, kelly
from touchline.operators.ingest import RESULT_KEY, SEQS, UPCOMING_KEY, fresh_ids, insert_results, upsert_upcoming
from touchline.operators.value_bets import upcoming
from touchline.plans.materialize import materialize
from touchline.schema import MATCH, ODDS, PROBS

SPREAD = 4  # files of a month at most in one write of a match table


def read_files(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_job_stats(runs: DataFrame, *, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Job counts, matches and total duration per time window and status; late rows beyond the watermark drop."""
    return (
        runs.withColumn("started", F.col("started_at").cast("timestamp"))
        .withWatermark("started", lateness)
        .groupBy(F.window("started", window).alias("w"), "status")
        .agg(F.count("*").alias("jobs"), F.sum("matches_scraped").alias("matches_scraped"),
             F.sum("duration_seconds").alias("total_duration"))
        .select(F.col("w.start").alias("window_start"), "status", "jobs", "matches_scraped", "total_duration"))


def open_predictions(predictions: DataFrame, matches: DataFrame, model_version_id: int, as_of, *, ahead: int = 7) -> DataFrame:
    """One model's predictions of matches scheduled within ``ahead`` days, written once: what each micro-batch is joined to."""
    games = upcoming(matches, as_of, ahead).select(F.col("id").alias("match_id"))
    chosen = predictions.filter(F.col("model_version_id") == model_version_id).withColumnRenamed("id", "prediction_id")
    return materialize(chosen.join(games, "match_id", "left_semi"), "open-predictions")


def stream_value_bets(odds_updates: DataFrame, open_: DataFrame, *, min_ev: float = 0.05, max_odds: float = 10.0) -> DataFrame:
    """Odds updates (match_id and three odds) joined to :func:`open_predictions`: alerts on the predicted outcome."""
    return _alerts(odds_updates.filter(has_odds()).join(open_, "match_id"), min_ev, max_odds)


def stream_live_value_bets(odds_updates: DataFrame, predictions: DataFrame, model_version_id: int, *, keep: str = "7 days",
                           lateness: str = "1 day", min_ev: float = 0.05, max_odds: float = 10.0) -> DataFrame:
    """Two streams: odds updates (match_id, match_date, updated_at and three odds) and predictions, whichever comes first.

    An update meets every prediction of its match made at most ``keep`` before or after it, both before kick-off. Watermarks of
    ``lateness`` on both sides and that bound let a row's state expire; rows later than the watermark drop. ``alerted_at`` is the later
    of the two times. Rows without match or time take no part.
    """
    odds = odds_updates.filter(has_odds()).withColumn("updated", F.col("updated_at").cast("timestamp")).withWatermark("updated", lateness)
    chosen = predictions.filter(F.col("model_version_id") == model_version_id).withColumn("made", F.col("predicted_at").cast("timestamp"))
    made = chosen.withWatermark("made", lateness).withColumnsRenamed({"id": "prediction_id", "match_id": "_match"})
    near = F.expr(f"made BETWEEN updated - INTERVAL {keep} AND updated + INTERVAL {keep}")
    later = F.greatest("updated", "made")
    joined = odds.join(made, (F.col("match_id") == F.col("_match")) & near).filter(later < F.col("match_date").cast("timestamp"))
    return _alerts(joined, min_ev, max_odds, later.alias("alerted_at"))


def _alerts(joined: DataFrame, min_ev: float, max_odds: float, *more: Column) -> DataFrame:
    pick = F.col("predicted_outcome")

    def of_pick(cols):
        return F.when(pick == "H", F.col(cols[0])).when(pick == "D", F.col(cols[1])).otherwise(F.col(cols[2]))

    return (
        joined.withColumn("market_odds", of_pick(ODDS)).withColumn("probability", of_pick(PROBS))
        .filter(F.col("market_odds") <= max_odds)
        .withColumn("expected_value", expected_value("probability", "market_odds"))
        .filter(F.col("expected_value") >= min_ev)
        .select("match_id", "prediction_id", "model_version_id", "predicted_outcome", "market_odds", "expected_value",
                kelly("probability", "market_odds").alias("kelly_fraction"), *more))


class MatchTable:
    """A match table partitioned by month, so a batch reads and rewrites only the months it touches.

    Ids of new keys are numbered over the whole batch and written as a small table before the months are. A batch that runs again,
    also after some months were committed, reads them back, so a match never gets another one's id; the next batch starts after
    them. Rows carry the ``seq`` that priced and named them (see :func:`upsert_upcoming`), so the order of batches does not decide
    between two prices. Results are inserted once: the first batch that brings a key wins. Rows without
    teams or date are left out, as they have no place in the table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.rows, self.ids, self.first = f"{self.root}/matches", f"{self.root}/ids", f"{self.root}/next_id"

    @staticmethod
    def with_month(df: DataFrame) -> DataFrame:
        return df.withColumn("month", F.date_format("match_date", "yyyy-MM"))

    def create(self, matches: DataFrame) -> None:
        # Each month goes to a few tasks, so that neither one task nor the number of files grows out of hand.
        rows = self.with_month(matches.withColumns({c: F.lit(None).cast("long") for c in SEQS}))
        rows = rows.repartition("month", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
        rows.write.mode("overwrite").partitionBy("month").parquet(self.rows)
        self._set_next_id(0, matches.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"] + 1)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(self.rows)

    def _schema(self) -> T.StructType:
        seqs = [T.StructField(c, T.LongType()) for c in SEQS]
        return T.StructType([*MATCH.fields, *seqs, T.StructField("month", T.StringType())])

    def _set_next_id(self, batch: int, value: int) -> None:
        self.spark.createDataFrame([(value,)], "next_id long").write.mode("overwrite").parquet(f"{self.first}/{batch}")

    def next_id(self, batch: int) -> int | None:
        """The first id of a batch; None until the batch before it has numbered its keys."""
        try:
            row = self.spark.read.schema("next_id long").parquet(f"{self.first}/{batch}").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return row and row["next_id"]

    def _batch_ids(self, stored: DataFrame, batch: DataFrame, batch_id: int, key: list[str]) -> DataFrame:
        """The batch's ids, numbered the first time only: the next batch's first id is written after them and before any month."""
        types = {f.name: f.dataType for f in MATCH.fields}
        schema = T.StructType([*[T.StructField(c, types[c]) for c in key], T.StructField("new_id", T.LongType())])
        path = f"{self.ids}/{batch_id}"
        numbered = self.next_id(batch_id + 1) is not None
        if not numbered:
            fresh_ids(stored, batch, key, self.next_id(batch_id)).write.mode("overwrite").parquet(path)
        ids = self.spark.read.schema(schema).parquet(path)
        if not numbered:
            self._set_next_id(batch_id + 1, self.next_id(batch_id) + ids.count())
        return ids

    def merge(self, batch: DataFrame, batch_id: int, rule: Callable[..., DataFrame]) -> None:
        batch = batch.filter(" AND ".join(f"{c} IS NOT NULL" for c in UPCOMING_KEY))
        months = [r["month"] for r in self.with_month(batch).select("month").distinct().collect()]  # calendar months
        stored = self.read().filter(F.col("month").isin(months)).drop("month")
        ids = self._batch_ids(stored, batch, batch_id, KEYS[rule])
        merged = self.with_month(rule(stored, batch, ids=ids)).repartition("month", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(self.rows)


RULES = {"upcoming": upsert_upcoming, "results": insert_results}
KEYS = {upsert_upcoming: UPCOMING_KEY, insert_results: RESULT_KEY}


def merge_batch(table: MatchTable, kind: str) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: rows with resolved ids merge by the batch rules."""
    return lambda batch, batch_id: table.merge(batch, batch_id, RULES[kind])


def stream_upsert(resolved: DataFrame, table: MatchTable, checkpoint: str, kind: str = "upcoming") -> StreamingQuery:
    """Continuous ingest: drain what is available, one merge per micro-batch."""
    return (
        resolved.writeStream.foreachBatch(merge_batch(table, kind))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once file sink over everything available."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
