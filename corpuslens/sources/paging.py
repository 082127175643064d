"""Scroll paging over a chunk listing written in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Cols = Sequence[str]
ORDER = ("doc_id", "chunk_index")


def write_listing(chunks: DataFrame, path: str, order: Cols = ORDER, files: int | None = None) -> None:
    """`rows`, range-sorted into one folder a range, and `ranges`, first and last key and size of each."""
    spread = chunks.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    spread.withColumn("range", F.spark_partition_id()).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    key = F.struct(*order)
    stored = chunks.sparkSession.read.parquet(f"{path}/rows").groupBy("range")
    stored.agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def _after(order: Cols, token: Sequence) -> Column:
    """Rows behind the token; the first key's own bound is stated too, since statistics can prune by it."""
    later, same = F.lit(False), F.lit(True)
    for name, value in zip(order, token, strict=True):
        later = later | (same & (F.col(name) > F.lit(value)))
        same = same & (F.col(name) == F.lit(value))
    return (F.col(order[0]) >= F.lit(token[0])) & later


def page(spark: SparkSession, path: str, limit: int, token: Sequence | None = None, where: Column | None = None, order: Cols = ORDER) -> tuple[DataFrame, tuple | None]:
    """The next `limit` rows behind the token that fulfil `where`, in order, and the token of the page behind it or None.

    The table of ranges names the folders that hold the next rows, and only those are scanned. If a condition leaves
    too few, more folders are taken, twice as many each time, until the page is full or none is left. A page passes a
    top-k of its folders, never a sort of the table.
    """
    order = list(order)
    ahead = spark.read.parquet(f"{path}/ranges")
    if token is not None:
        kinds = ahead.schema["last"].dataType
        ahead = ahead.filter(F.col("last") > F.struct(*[F.lit(t).cast(kinds[n].dataType).alias(n) for t, n in zip(token, order, strict=True)]))
    stored, many = spark.read.parquet(f"{path}/rows"), 2
    while True:
        head = ahead.orderBy("first").limit(many).collect()
        rows = stored.filter(F.col("range").isin([r["range"] for r in head])).drop("range")
        rows = rows.filter(_after(order, token)) if token is not None else rows
        rows = (rows.filter(where) if where is not None else rows).orderBy(*order).limit(limit)
        if where is not None or sum(r["n"] for r in head[1:]) >= limit or len(head) < many:
            found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("last")).first()
            if found["n"] >= limit or len(head) < many:
                return rows, tuple(found["last"]) if found["n"] >= limit > 0 else None
        many *= 2
