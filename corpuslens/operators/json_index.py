"""A stored index of the paths and scalars in a JSON column, for containment searches."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.json import contains, kind_of, leaves_of, scalar_text
from corpuslens.session import fresh_path
from corpuslens.sources.readers import write_table

#: Folders that paths and scalars are hashed to.
BUCKETS = 64


def _bucket(path: Column, leaf: Column) -> Column:
    return F.pmod(F.xxhash64(path, leaf), F.lit(BUCKETS)).cast("int")


def json_leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, leaf) of every scalar in the JSON texts of a column, arrays level by level; equal ones once.

    A level is one explode of variants; the number of rounds is the depth of the deepest value.
    """
    spark = rows.sparkSession
    level = rows.select(key, F.lit("$").alias("path"), F.try_parse_json(F.col(column)).alias("v")).filter("v is not null")
    found = []
    while True:
        level = write_table(level, fresh_path(spark, "json-level"))
        found.append(level.select(key, "path", scalar_text(F.col("v")).alias("leaf")).filter("leaf is not null"))
        nested = level.filter(kind_of(F.col("v")).startswith("OBJECT") | kind_of(F.col("v")).startswith("ARRAY"))
        if not nested.take(1):
            break
        step = F.when(F.col("_key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.lit("."), F.col("_key")))
        inner = nested.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        level = inner.select(key, step.alias("path"), F.col("_value").alias("v"))
    leaves = found[0]
    for more in found[1:]:
        leaves = leaves.unionByName(more)
    return leaves.distinct()


def build_json_index(rows: DataFrame, path: str, key: str, column: str) -> None:
    leaves = json_leaves(rows, key, column).withColumn("bucket", _bucket(F.col("path"), F.col("leaf")))
    leaves.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_json_index(spark: SparkSession, path: str, rows: DataFrame, key: str, column: str, pattern: Any) -> DataFrame:
    """The rows whose JSON contains the pattern (an object or array).

    Rows that hold every leaf of the pattern somewhere under its path come from the folders of those leaves; the
    predicate then decides, since leaves may lie in different elements of an array. A pattern without leaves is
    decided on all rows.
    """
    verdict = contains(F.try_parse_json(F.col(column)), pattern)
    leaves = list({json.dumps(leaf) for leaf in leaves_of(pattern)})
    if not leaves:
        return rows.filter(verdict)
    wanted = _wanted(spark, [tuple(json.loads(leaf)) for leaf in leaves])
    buckets = sorted({r["bucket"] for r in wanted.select("bucket").collect()})  # one row a leaf of the pattern
    held = spark.read.parquet(path).filter(F.col("bucket").isin(buckets)).join(F.broadcast(wanted.drop("bucket")), ["path", "leaf"])
    all_held = held.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(leaves)).select(key)
    return rows.join(all_held, key, "left_semi").filter(verdict)


def _wanted(spark: SparkSession, leaves: Sequence[tuple[str, Any]]) -> DataFrame:
    texts = spark.createDataFrame([(p, json.dumps(v)) for p, v in leaves], "path string, value string")
    texts = texts.select("path", scalar_text(F.try_parse_json(F.col("value"))).alias("leaf"))
    return texts.withColumn("bucket", _bucket(F.col("path"), F.col("leaf")))
