"""Scans of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.session import use_utc


# Tables whose rows carry long text: the work per row is heavy, so the number of scan tasks matters.
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the input has fewer scan tasks than the cluster has cores.

    A few small files would otherwise keep all text work in one task. Large inputs have tasks enough and are
    left alone, so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; zone-less timestamps become session (UTC) timestamps so range frames accept them."""
    use_utc(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df
