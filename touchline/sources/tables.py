"""Readers for stored tables: parquet with a declared schema, or a partitioned JDBC scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.schema import MATCH, MATCH_FEATURE_COLUMNS, TASK_EXECUTION


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def scan_matches(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, MATCH)


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str = "id", lower: int, upper: int,
              partitions: int = 64, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """Range-partitioned JDBC scan: each task reads one slice of ``key``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper,
                 numPartitions=partitions, fetchsize=fetch_size, **options)
        .load()
    )


def match_frame(matches: DataFrame) -> DataFrame:
    """The typed projection the feature jobs read."""
    return matches.select(*[F.col(c).cast(MATCH[c].dataType).alias(c) for c in MATCH_FEATURE_COLUMNS])


def jobs_scan(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TASK_EXECUTION)


def write_parquet(df: DataFrame, path: str, *, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
