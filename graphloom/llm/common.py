"""What several operators share: staged tables, joins chosen by a checked size, distributed prefix sums."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A side is broadcast only if its counted rows times its width stay below this.
BROADCAST_BYTES = 24 << 20
_CLEARED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a default is set only where the session names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "/tmp/checkpoints"
        if spark.sparkContext.applicationId not in _CLEARED:  # what a test leaves goes when it ends
            _CLEARED.add(spark.sparkContext.applicationId)
            atexit.register(shutil.rmtree, f"{found}/graphloom-{spark.sparkContext.applicationId}", ignore_errors=True)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows of a narrow table that one file may hold.
ROWS_A_FILE = 200_000


def staged(df: DataFrame, name: str, rows: int | None = None, heavy: bool = False) -> DataFrame:
    """df written once to the shared folder and read from there: cuts lineage and survives lost executors. rows: how many narrow
    rows there are at most, where that was counted; they then go to as few files as hold them. heavy: making them takes wide rows,
    so that the tasks that do it stay as many as they are."""
    spark, path = df.sparkSession, staged_path(df.sparkSession, name)
    if rows is not None:
        n = 1 + rows // ROWS_A_FILE
        df = df.repartition(n) if heavy else df.coalesce(n)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes this application's staged tables. Results that still read them must be written first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(large: DataFrame, small: DataFrame, on: list[str] | str, how: str, rows: int, width: int = 64) -> DataFrame:
    """Joins a small side: broadcast if its rows times width were counted to fit, else a shuffled join, whose hot keys adaptive execution splits."""
    return large.join(F.broadcast(small) if rows * width <= BROADCAST_BYTES else small.hint("shuffle_merge"), on, how)


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Adds, for each name in sums, the sum of its column over all rows that come before in the given total order.

    Rows are dealt out by range, summed by partition, and only one row for each partition meets in one task.
    """
    dealt = df.withColumns({f"__v_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("__pid", F.spark_partition_id())
    dealt = staged(dealt, name)
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__pid").agg(*(F.sum(f"__v_{k}").alias(f"__p_{k}") for k in sums))
    parts = parts.select("__pid", *(F.coalesce(F.sum(f"__p_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums))
    inner = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(parts), "__pid")  # a row for each partition
    out = out.withColumns({k: F.coalesce(F.sum(f"__v_{k}").over(inner), F.lit(0)) + F.col(f"__o_{k}") for k in sums})
    return out.drop("__pid", *(f"__{x}_{k}" for x in "vo" for k in sums))


def sampled(df: DataFrame, key: list[Column], n: int) -> DataFrame:
    """At most n rows, the first by hash of the key, one for each hash. A share of the hashes that holds a few times n rows is cut
    off first, so that no partition sends more than its part of those."""
    share = min(1.0, (3.0 * n + 50) / max(1, df.count()))
    out = df.withColumn("__h", F.xxhash64(*key)).filter(F.shiftrightunsigned("__h", 11) < int(share * (1 << 53)))
    return out.dropDuplicates(["__h"]).orderBy("__h").limit(n).drop("__h")


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows, whose values in the column have at most about so many bytes, or of one row."""
    col, at = batch.column(column), 0
    if not batch.num_rows:
        return
    ends = np.cumsum(np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.float64)))
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0.0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, "right")) - at))
        yield batch.slice(at, n)
        at += n


def texts_in(batches: Iterator, columns: list[str], rows: int = 256) -> Iterator[tuple[list, ...]]:
    """Lists of the named columns' values, a few hundred rows at a time, fewer where the last column's texts are long."""
    for batch in batches:
        for part in slices(batch, batch.schema.get_field_index(columns[-1]), rows):
            yield tuple(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
