"""Tables written to the folder that all executors share, to cut lineage in loops and after updates."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEARED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a default only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found, app = "/tmp/checkpoints", spark.sparkContext.applicationId
        if app not in _CLEARED:  # what a test leaves goes when it ends
            _CLEARED.add(app)
            atexit.register(shutil.rmtree, f"{found}/graph-{app}", ignore_errors=True)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
