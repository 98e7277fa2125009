"""What the operators of this subpackage share: reading, stored intermediate tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortry.session import ensure_checkpoint_dir, tune

#: Rows and bytes handed to Python at a time; texts are long, so batches are small.
BATCH_ROWS = "500"
BATCH_BYTES = "16m"

#: ASCII white space, the bytes between words.
WHITE = b" \t\n\r\x0b\x0c"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage, and every reader sees the same rows."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty, without decoding."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def fields(df: DataFrame, *names: str) -> str:
    """Schema text of some columns of a frame."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
