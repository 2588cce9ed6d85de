"""Feature store: one feature map per (match, schema version), latest write wins.

Stored as parquet partitioned by ``feature_schema_version``, so reads, counts and deletes
of one version touch that partition only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.match import ntz
from touchline.schema import MODEL_FEATURES

KEY = ["match_id", "feature_schema_version"]


def to_feature_rows(features: DataFrame, version: str, computed_at) -> DataFrame:
    """Feature columns to one map per match; every value becomes a double."""
    names = [c for c in features.columns if c != "match_id"]
    packed = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    return features.select("match_id", F.lit(version).alias("feature_schema_version"), packed.alias("features"),
                           ntz(computed_at).alias("computed_at"))


def merge_features(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert on (match, version): a fresh row replaces the stored one, the newest fresh row wins; of equally new rows the one whose
    features come last as JSON."""
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    newest = Window.partitionBy(*KEY).orderBy(F.col("_fresh").desc(), F.col("computed_at").desc(), F.to_json("features").desc())
    return both.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "_fresh")


def write_features(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).partitionBy("feature_schema_version").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_FEATURES).parquet(path)


def unpack(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Feature map to columns; a missing name is NULL."""
    return rows.select("match_id", *[F.try_element_at("features", F.lit(n)).alias(n) for n in names])


def features_by_date(stored: DataFrame, matches: DataFrame, version: str, names: Sequence[str], *, start, end) -> DataFrame:
    games = matches.filter(F.col("match_date").between(ntz(start), ntz(end))).select(F.col("id").alias("match_id"), "match_date")
    rows = stored.filter(F.col("feature_schema_version") == version)
    return unpack(rows.join(games, "match_id"), names).join(games, "match_id")


def missing_features(ids: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    return ids.join(stored.filter(F.col("feature_schema_version") == version), "match_id", "left_anti")


def is_cached(ids: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """Each id with a flag."""
    have = stored.filter(F.col("feature_schema_version") == version).select("match_id", F.lit(True).alias("cached"))
    return ids.join(have, "match_id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def lookup(ids: DataFrame, stored: DataFrame, version: str, names: Sequence[str]) -> DataFrame:
    rows = stored.filter(F.col("feature_schema_version") == version).join(ids, "match_id", "left_semi")
    return unpack(rows, names)


def schema_stats(stored: DataFrame) -> DataFrame:
    """Rows, sorted feature names and the span of computation per version."""
    rows = stored.groupBy("feature_schema_version").agg(
        F.count("*").alias("rows"), F.min("computed_at").alias("first_computed"), F.max("computed_at").alias("last_computed"))
    names = (
        stored.select("feature_schema_version", F.explode(F.map_keys("features")).alias("name")).distinct()
        .groupBy("feature_schema_version").agg(F.array_sort(F.collect_list("name")).alias("feature_names")))
    return rows.join(names, "feature_schema_version", "left")


def delete_features(stored: DataFrame, version: str, ids: DataFrame | None = None) -> DataFrame:
    """The store without a version, or without the given matches of it."""
    hit = F.col("feature_schema_version") == version
    if ids is None:
        return stored.filter(~hit)
    return stored.join(ids.withColumn("feature_schema_version", F.lit(version)), KEY, "left_anti")


def deleted_count(stored: DataFrame, kept: DataFrame) -> DataFrame:
    return stored.join(kept, KEY, "left_anti").agg(F.count("*").alias("deleted"))


def computed_at(stored: DataFrame, match_id: int, version: str) -> DataFrame:
    return stored.filter((F.col("match_id") == match_id) & (F.col("feature_schema_version") == version)).select("computed_at")


def feature_value(rows: DataFrame, name: str, default: float | None = None) -> DataFrame:
    """One named feature per row."""
    value = F.try_element_at("features", F.lit(name))
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return rows.select(*KEY, value.alias("value"))
