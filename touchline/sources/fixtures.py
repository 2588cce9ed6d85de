"""Match tables derived by Spark from the generic star-schema test tables.

``derive(spark, dir)`` gives a :class:`Tables` whose members are lazy DataFrames; the
same definitions exist as plain SQL in ``touchline.catalog.base`` for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import configure


@dataclass
class Tables:
    """Lazily built match tables over one test-data folder."""

    spark: SparkSession
    path: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def teams(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    @cached_property
    def tournaments(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_regionkey").cast("long").alias("id"),
            F.concat(F.lit("League "), "r_name").alias("name"),
            F.col("r_name").alias("country"),
            F.concat(F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))), F.lit("-league")).alias("url_slug"),
        )

    @cached_property
    def matches(self) -> DataFrame:
        per_t = self.raw("supplier").agg(F.floor(F.count("*") / 5).cast("long")).scalar()
        c, oid = F.col("c"), F.col("id")
        base = (
            self.raw("orders")
            .select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"),
                    F.col("o_orderdate").alias("match_date"), per_t.alias("per_t"))
            .withColumn("t", c % 5)
            .withColumn("hi", (oid * 7 + c) % F.col("per_t"))
            .withColumn("ai", (F.col("hi") + 1 + (oid * 3 + c) % (F.col("per_t") - 1)) % F.col("per_t"))
            .withColumn("status", F.when(oid % 97 == 0, "LIVE")
                        .when(F.col("match_date") >= F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00'"), "SCHEDULED")
                        .otherwise("FINISHED"))
            .withColumn("wh", 20 + (oid * 37 + c) % 40)
            .withColumn("wd", 20 + (oid * 11 + c) % 11)
            .withColumn("wa", 15 + (oid * 29 + c) % 35)
            .withColumn("sy", F.year("match_date") - F.when(F.month("match_date") < 8, 1).otherwise(0))
        )
        finished, priced = F.col("status") == "FINISHED", oid % 11 != 0
        total = (10000 * (F.col("wh") + F.col("wd") + F.col("wa"))).cast("double")

        def odds(weight: str):
            return F.when(priced, F.floor(total / (105 * F.col(weight))).cast("double") / 100)

        return base.select(
            "id",
            F.col("t").alias("tournament_id"),
            (F.col("sy").cast("long") * 10 + F.col("t")).alias("season_id"),
            (F.col("hi") * 5 + F.col("t")).alias("home_team_id"),
            (F.col("ai") * 5 + F.col("t")).alias("away_team_id"),
            "match_date",
            "status",
            F.when(finished, ((oid * 31 + c * 17) % 5).cast("int")).alias("home_score"),
            F.when(finished, ((oid * 13 + c * 7 + 3) % 4).cast("int")).alias("away_score"),
            odds("wh").alias("odds_home"),
            odds("wd").alias("odds_draw"),
            odds("wa").alias("odds_away"),
            F.when(oid % 17 != 0, (oid % 13).cast("int")).alias("num_bookmakers"),
        )

    @cached_property
    def seasons(self) -> DataFrame:
        sy = ((F.col("season_id") - F.col("tournament_id")) / 10).cast("int")
        return (
            self.matches.select("season_id", "tournament_id").distinct()
            .select(F.col("season_id").alias("id"), "tournament_id",
                    F.concat(sy.cast("string"), F.lit("/"), (sy + 1).cast("string")).alias("name"),
                    sy.alias("start_year"), (sy + 1).alias("end_year"))
        )

    @cached_property
    def model_versions(self) -> DataFrame:
        v = F.col("id")
        return self.spark.range(1, 4).select(
            v, F.concat(F.lit("model_v"), v.cast("string")).alias("version"),
            F.when(v == 3, "random_forest").otherwise("gbt").alias("algorithm"),
            (v == 2).alias("is_active"),
            F.when(v < 3, F.lit(0.5) + v.cast("double") / 100).alias("accuracy"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        # Two of three models predict each match; the one left out gives anti joins work to do.
        left_out = (F.col("m_id") % 3 + 1).cast("int")
        w = (
            self.matches.select(F.col("id").alias("m_id"), "match_date")
            .withColumn("v", F.explode(F.array_remove(F.array(F.lit(1), F.lit(2), F.lit(3)), left_out)))
            .withColumn("a", 20 + (F.col("m_id") * 37 + F.col("v") * 5) % 40)
            .withColumn("b", 20 + (F.col("m_id") * 11 + F.col("v") * 3) % 11)
            .withColumn("c", 15 + (F.col("m_id") * 29 + F.col("v") * 7) % 35)
        )
        total = F.col("a") + F.col("b") + F.col("c")
        q = w.select("m_id", "v", "match_date", *[
            (F.col(x).cast("double") / total).alias(p)
            for x, p in (("a", "prob_home"), ("b", "prob_draw"), ("c", "prob_away"))])
        h, d, a = F.col("prob_home"), F.col("prob_draw"), F.col("prob_away")
        return q.select(
            (F.col("m_id") * 10 + F.col("v")).alias("id"), F.col("m_id").alias("match_id"),
            F.col("v").alias("model_version_id"), h, d, a,
            F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A").alias("predicted_outcome"),
            F.greatest(h, d, a).alias("confidence"),
            (F.col("match_date") - F.expr("INTERVAL '1' DAY")).alias("predicted_at"),
        )

    @cached_property
    def task_executions(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("task_id"),
            F.when(kind == "error", "failed").when(kind == "signup", "running").otherwise("completed").alias("status"),
            F.col("ts").alias("started_at"),
            F.when(kind != "signup", F.col("value")).alias("duration_seconds"),
            F.when(kind == "purchase", F.col("event_id") % 50).otherwise(0).cast("int").alias("matches_scraped"),
        )


def derive(spark: SparkSession, path: str) -> Tables:
    return Tables(configure(spark), path)
