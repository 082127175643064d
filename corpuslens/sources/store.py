"""One table kept up to date in hash buckets: an update rewrites the buckets it touches and nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Cols = Sequence[str]
#: Folders that keys are hashed to; a store keeps the number it was begun with.
BUCKETS = 64
POINTER = "bucket int, written long, buckets int, version long"


def _bucket(keys: Cols, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, written, buckets, version): which version of a bucket each version of the store reads."""
    try:
        return spark.read.schema(POINTER).parquet(f"{path}/pointer")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of the store, ascending."""
    return sorted(r["version"] for r in _pointers(spark, path).select("version").distinct().collect())


def _layout(spark: SparkSession, path: str, version: int | None) -> tuple[dict[int, int], int | None]:
    """Bucket to the version that wrote it, and the number of buckets; at most one row a bucket comes to the driver."""
    rows = _pointers(spark, path).filter(F.col("version") == version).collect() if version is not None else []
    return {r["bucket"]: r["written"] for r in rows if r["bucket"] >= 0}, rows[0]["buckets"] if rows else None


def _read(spark: SparkSession, path: str, schema: StructType, layout: dict[int, int]) -> DataFrame:
    folders = [f"{path}/data/bucket={b}/written={w}" for b, w in sorted(layout.items())]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_store(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """The rows of a finished version, the newest by default; an update under way is not seen."""
    done = versions(spark, path)
    schema = spark.createDataFrame([], schema).schema
    return _read(spark, path, schema, _layout(spark, path, version if version is not None else max(done, default=None))[0])


def upsert(rows: DataFrame, touched: DataFrame, path: str, keys: Cols, version: int, buckets: int = BUCKETS) -> None:
    """Version `version`: of every key in `touched` exactly the rows in `rows`, of all others what was there.

    A touched key without rows is gone. The buckets of touched keys are written anew beside the old ones, others keep
    their files. The pointer, one small file, comes last, and only then readers follow; an update that ends half-way
    leaves no trace for them, and repeating it overwrites what it left. A version that is finished is not written again.
    """
    spark, keys = rows.sparkSession, list(keys)
    done = versions(spark, path)
    if version in done:
        return
    layout, known = _layout(spark, path, max((v for v in done if v < version), default=None))
    buckets = known or buckets
    hit = {r["bucket"] for r in touched.select(_bucket(keys, buckets)).distinct().collect()}
    held = _read(spark, path, rows.schema, {b: w for b, w in layout.items() if b in hit})
    gone = touched.select(*keys).distinct()
    matches = [held[k].eqNullSafe(gone[k]) for k in keys]
    kept = held.join(gone, matches, "left_anti")
    fresh = kept.unionByName(rows).withColumns({"bucket": _bucket(keys, buckets), "written": F.lit(version).cast("long")})
    out = fresh.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("bucket", "written").parquet(f"{path}/data")
    stored = spark.read.schema("bucket int, written long").parquet(f"{path}/data").filter(F.col("written") == version)
    full = {r["bucket"] for r in stored.select("bucket").distinct().collect()}
    now = {b: w for b, w in layout.items() if b not in hit} | dict.fromkeys(full, version)
    pointer = [(b, w, buckets, version) for b, w in sorted(now.items())] or [(-1, version, buckets, version)]
    table = spark.createDataFrame(pointer, POINTER).coalesce(1)
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{path}/pointer")


def forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete what only versions older than the newest `keep` read. Readers of those versions must have ended.

    Which folders these are follows from the pointers. Folders go before pointers, so a run that ends half-way is
    completed by the next.
    """
    old = versions(spark, path)[:-keep]
    if not old:
        return
    pointers = _pointers(spark, path).filter("bucket >= 0").select("bucket", "written", "version")
    read = pointers.filter(~F.col("version").isin(old)).select("bucket", "written")
    idle = pointers.filter(F.col("version").isin(old)).select("bucket", "written").distinct().join(read, ["bucket", "written"], "left_anti").collect()
    folders = [f"{path}/data/bucket={r['bucket']}/written={r['written']}" for r in idle] + [f"{path}/pointer/version={v}" for v in old]
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        files(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(files(folder), True)


# ---------------------------------------------------------------------------------------------------
# several outputs of one run

COMMITTED = "tables int, run long"


def last_run(spark: SparkSession, path: str) -> int | None:
    """The newest run that is finished as a whole."""
    try:
        return spark.read.schema(COMMITTED).parquet(f"{path}/committed").agg(F.max("run")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_together(tables: dict[str, DataFrame], touched: DataFrame, path: str, keys: Cols, run: int, buckets: int = BUCKETS) -> None:
    """Put the rows of several tables in the place of those that they had of the touched keys, all or none of them.

    Each table is a store of its own; the run is committed by one small file when all have been written, and readers
    take every table as of the last committed run. A run that ends half-way is not seen and can be repeated.
    """
    for name, rows in tables.items():
        upsert(rows, touched, f"{path}/{name}", keys, run, buckets)
    mark = touched.sparkSession.createDataFrame([(len(tables), run)], COMMITTED).coalesce(1)
    mark.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/committed")


def read_together(spark: SparkSession, path: str, name: str, schema: StructType | str) -> DataFrame:
    run = last_run(spark, path)
    return read_store(spark, f"{path}/{name}", schema, run) if run is not None else spark.createDataFrame([], schema)


NORMALIZED = "doc_id long, owner string, text string, metadata string"
DOCUMENT_MAP = "doc_id long, owner string, document_map string"


def write_documents(docs: DataFrame, units: DataFrame, path: str, run: int, buckets: int = BUCKETS) -> None:
    """Per document its normalised text with a metadata object, and beside it a map of its units, committed together.

    ``docs``: (doc_id, owner, text) and further columns, which go into the metadata with the text's digest and length;
    ``units``: (doc_id, unit_no) and further columns, the entries of the map in order.
    """
    extra = [c for c in docs.columns if c not in ("doc_id", "owner", "text")]
    facts = F.struct("doc_id", *extra, F.length("text").alias("char_count"), F.sha2("text", 256).alias("sha256"))
    normalized = docs.select("doc_id", "owner", "text", F.to_json(facts).alias("metadata"))
    entry = F.struct("unit_no", *[c for c in units.columns if c not in ("doc_id", "unit_no")])
    listed = units.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("units"))).alias("document_map"))
    maps = docs.select("doc_id", "owner").join(listed, "doc_id", "left").withColumn("document_map", F.coalesce("document_map", F.lit('{"units":[]}')))
    write_together({"normalized": normalized, "document_map": maps}, docs.select("doc_id"), path, ["doc_id"], run, buckets)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, owner, text, metadata, document_map of the last whole run."""
    normalized = read_together(spark, path, "normalized", NORMALIZED)
    return normalized.join(read_together(spark, path, "document_map", DOCUMENT_MAP).drop("owner"), "doc_id")
