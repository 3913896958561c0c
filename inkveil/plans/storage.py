"""Results that several steps read are written once, in the folder that all executors share; small inputs are spread out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of input for each task beyond which an input has splits enough of its own.
SPREAD_BYTES = 64 << 20
#: Bytes of input, as the plan estimates them, that a task which sorts or groups is dealt.
TASK_BYTES = 4 << 20
#: Rows, and bytes of them, that a Python worker takes at a time.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
#: Beyond this an estimate is none: plans without statistics say they may be of any size, and joins multiply.
NO_ESTIMATE = 1 << 40


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. Without either, only a local session may go on, with a
    folder under its warehouse; a cluster must name one."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/inkveil-checkpoints"
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again, so nothing is computed twice and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/inkveil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from fewer files than there are cores and is small: one file's single row group is
    one task otherwise. Large inputs have splits enough and are never shuffled for this."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, in the session's number of partitions or as many more as the input needs for TASK_BYTES each: what a task
    sorts or groups then stays the same while the input grows. Spark's own choice goes by compressed bytes, of which rows of
    a few numbers have so few that a task gets millions of them; it is left alone where all of the
    input is one task's or nothing is known of it."""
    if df.isStreaming:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if not TASK_BYTES // 4 <= size < NO_ESTIMATE:
        return df.repartition(*keys)
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES), *keys)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows each, so that what a worker makes of them as objects is never more than a slice's."""
    for batch in batches:
        step = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
