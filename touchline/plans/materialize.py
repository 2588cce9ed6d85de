"""Write an intermediate table once and read it back: cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

from touchline.session import checkpoint_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the cluster names; a local folder only where none is named."""
    root = checkpoint_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="touchline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", *, wide: bool = False) -> DataFrame:
    """Write and read back; ``wide`` says that rows have dozens of computed columns."""
    path = fresh_path(df.sparkSession, name)
    with short_methods(df.sparkSession) if wide else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WHOLE_STAGE = "spark.sql.codegen.wholeStage"


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Within it, code is generated operator by operator, in small methods: a whole stage of dozens of columns is one method, too
    long for the JVM to compile, which then interprets it."""
    before = spark.conf.get(_WHOLE_STAGE)
    spark.conf.set(_WHOLE_STAGE, "false")
    try:
        yield
    finally:
        spark.conf.set(_WHOLE_STAGE, before)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the action that wrote them ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
