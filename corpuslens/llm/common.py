"""What the training-data operators share: scans, Arrow maps, intermediate tables and files in the shared folder."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from corpuslens.session import fresh_path

#: Rows that Spark hands to Python at once; texts can be long, so few rows.
BATCH_ROWS = 1000
#: For tables whose rows are megabytes. A row group is held whole by the task that writes it and by each that reads it,
#: and its size is looked at after a hundred rows at first, however large they are.
WIDE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over small batches."""
    batch_rows(df.sparkSession, BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Spark reads this when a plan runs, so a map that needs another size has to be stored at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """The stored result of mapInArrow over batches of another size."""
    batch_rows(df.sparkSession, rows)
    try:
        return stored(df.mapInArrow(fn, schema), label, options=options)
    finally:
        batch_rows(df.sparkSession, BATCH_ROWS)


def stored(df: DataFrame, label: str, *partition_by: str, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """The rows after a round trip through a table in the shared folder, which cuts the lineage."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.options(**(options or {})).partitionBy(*partition_by).parquet(path)
    schema = df.schema
    del df
    gc.collect()  # frames that are no longer referenced let Spark delete their shuffle files
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more: what was made of it is stored."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over all shuffle partitions; small rows that stand for much work must not be put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def file_at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a place in the shared folder: local, HDFS or an object store."""
    return fs.FileSystem.from_uri(uri)


def output(fields: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in fields.values()], names=list(fields))


def unused_name(wanted: str, taken: list[str]) -> str:
    """A column name that clashes with none of those taken (Spark compares without case)."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted
