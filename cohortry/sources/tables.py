"""Scans, sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, path_or_name: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet path (anything with a slash) or a catalogue name; all columns, pruned by the plan."""
    if "/" in path_or_name:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path_or_name)
    return spark.table(path_or_name)


def run_sql(spark: SparkSession, sql: str, args: Mapping | None = None) -> DataFrame:
    """Run SQL text over the catalogue and temp views; ``args`` fill ``:name`` markers."""
    return spark.sql(sql, args=dict(args)) if args else spark.sql(sql)


def run_sql_file(spark: SparkSession, path: str, args: Mapping | None = None) -> DataFrame:
    """As :func:`run_sql`, with the text read from a file any Hadoop file system can serve."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return run_sql(spark, text.rstrip().rstrip(";"), args)


def sql_over(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Query frames by name: each ``{name}`` in the text stands for the frame passed as ``name``."""
    return spark.sql(sql, **frames)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` holds a finished Spark write."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], path: str) -> DataFrame:
    """Return the table stored under ``path``; build and store it first if it is not there.

    Types survive, unlike with a text cache. A write that did not finish leaves no
    ``_SUCCESS`` marker and is done again.
    """
    if not path_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back; for loops that feed on their own result.

    A checkpoint keeps the size estimate of the plan it cuts. Joins multiply estimates, so
    round after round the number gets longer until planning takes longer than the work; a
    stored table has the size of its files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row and a declared schema (no inference pass over the data)."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row, one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, target: str, mode: str = "overwrite") -> None:
    """``overwrite`` replaces the target, ``append`` adds to it; a path or a table name."""
    writer = df.write.mode(mode)
    if "/" in target:
        writer.parquet(target)
    else:
        writer.saveAsTable(target)


def seed_relation(
    spark: SparkSession,
    lists: Mapping[str, Sequence[int]],
    label: str = "drug_class",
    value: str = "concept_id",
) -> DataFrame:
    """Labelled literal id lists as a relation; a repeated id appears once per label."""
    rows = [(name, int(i)) for name, ids in lists.items() for i in dict.fromkeys(ids)]
    schema = T.StructType([T.StructField(label, T.StringType()), T.StructField(value, T.LongType())])
    return spark.createDataFrame(rows, schema)


def concept_sets(
    mapping: DataFrame,
    category: str,
    concept: str = "concept_id",
    wanted: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(label, concept_id)`` rows from a mapping file.

    ``wanted`` maps an output label to the category value it stands for; without it
    every category keeps its own name. The result stays a DataFrame, so it is joined
    instead of being pasted into a query as a list.
    """
    rows = mapping.where(F.col(category).isNotNull())
    if wanted is None:
        return rows.select(F.col(category).alias("label"), F.col(concept).alias("concept_id")).distinct()
    picked = F.coalesce(*[F.when(F.col(category) == v, F.lit(k)) for k, v in wanted.items()])
    return (
        rows.select(picked.alias("label"), F.col(concept).alias("concept_id"))
        .where(F.col("label").isNotNull())
        .distinct()
    )
