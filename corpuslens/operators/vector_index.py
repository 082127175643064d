"""Approximate vector search: a stored coarse quantiser, inverted lists by cell, exact scores inside the probed lists."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import vector as V
from corpuslens.operators.ordering import topk_scored
from corpuslens.operators.retrieval import PAIRS, dense_topk, nearest_of_blocks
from corpuslens.session import fresh_path
from corpuslens.sources.readers import write_table

#: Rows, about and at most, that the cells are fitted on; every row is assigned and stored.
SAMPLE_ROWS = 100_000
#: Cells at most: their centres pass through the driver.
MAX_CELLS = 4096
#: Vectors of a list, and queries of a cell, that meet in one task; larger ones are cut into slices.
LIST_ROWS, ASK_ROWS = 20_000, 2048


def _comparable(df: DataFrame, dim: int) -> DataFrame:
    return df.filter((F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))


def build_vector_index(vectors: DataFrame, path: str, dim: int, cells: int | None = None, seed: int = 17, sample_rows: int = SAMPLE_ROWS) -> None:
    """Write `lists`, every vector of length `dim` in the folder of its cell, and `cells`, their centres and sizes.

    Cells are k-means centres of unit vectors of a sample chosen by id, the square root of the number of rows by
    default. A large cell is split over several files. Vectors of another length or with nulls cannot be compared and
    stay out.
    """
    rows = _comparable(vectors.select(F.col("vec_id").cast("long"), "embedding"), dim)
    n = rows.count()
    cells = max(1, min(cells or round(math.sqrt(n)), MAX_CELLS))
    features = rows.withColumn("features", array_to_vector(V.l2_normalize(F.col("embedding"))))
    million = 1_000_000
    share = min(million, math.ceil(million * sample_rows / max(n, 1)))
    chosen = features.filter(F.pmod(F.xxhash64("vec_id"), F.lit(million)) < share) if n > sample_rows else features
    model = KMeans(k=max(cells, 2), seed=seed, maxIter=10, initSteps=2).fit(chosen) if n > cells > 1 else None
    placed = model.transform(features).withColumnRenamed("prediction", "cell") if model else features.withColumn("cell", F.lit(0))
    lists = placed.select("vec_id", "embedding", "cell")
    lists.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
    spark = vectors.sparkSession
    centres = [[float(x) for x in c] for c in model.clusterCenters()] if model else [[1.0] + [0.0] * (dim - 1)]
    table = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    sizes = spark.read.schema(lists.schema).parquet(f"{path}/lists").groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"))
    table.join(sizes, "cell").write.mode("overwrite").parquet(f"{path}/cells")


def indexed_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One row: vectors and cells of the index."""
    return spark.read.parquet(f"{path}/cells").agg(F.sum("n_rows").alias("n_vectors"), F.count(F.lit(1)).alias("n_cells"))


def probes_for(spark: SparkSession, path: str, k: int, recall: float, sample_rows: int = 256) -> int:
    """Cells to probe so that stored vectors find `recall` of their k nearest others, measured on a sample chosen by id.

    The exact neighbours of the sample say how far down each query's list of cells the cell of a neighbour stands, so
    one pass gives the recall of every number of probes.
    """
    lists, cells = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/cells").select(F.col("cell").alias("vec_id"), F.col("centre").alias("embedding"))
    n_cells = cells.count()
    asks = lists.select(F.col("vec_id").alias("query_id"), "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows)
    exact = dense_topk(asks, lists, k, skip_self=True).select("query_id", "vec_id").join(lists.select("vec_id", "cell"), "vec_id")
    order = dense_topk(asks, cells, n_cells).select("query_id", F.col("vec_id").cast("int").alias("cell"), F.col("rank").alias("probes"))
    depth = exact.join(order, ["query_id", "cell"]).groupBy("probes").agg(F.count(F.lit(1)).alias("n")).orderBy("probes").collect()
    total, found = sum(r["n"] for r in depth), 0
    for r in depth:  # one row for each cell at most
        found += r["n"]
        if found >= recall * total:
            return r["probes"]
    return n_cells


def search_vector_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, skip_self: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: cosine top k among the vectors of each query's `probes` nearest cells.

    Only folders of probed cells are read: their numbers, at most MAX_CELLS, go into the scan as a partition filter.
    Lists and the queries that probe them meet in slices of bounded size, so neither a crowded cell nor one that many
    queries ask makes a large task. Probing all cells gives the exact result; an empty
    index gives no rows.
    """
    cells = spark.read.parquet(f"{path}/cells")
    head = cells.select(F.size("centre")).first()
    if head is None:
        return spark.createDataFrame([], f"{PAIRS}, rank int")
    dim = head[0]
    asks = _comparable(queries.select(F.col("query_id").cast("long"), "embedding"), dim)
    nearest = dense_topk(asks, cells.select(F.col("cell").alias("vec_id"), F.col("centre").alias("embedding")), probes)
    probed = write_table(nearest.select("query_id", F.col("vec_id").cast("int").alias("cell")), fresh_path(spark, "probes"))
    asked = probed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASK_ROWS).cast("int").alias("ask_slices"))
    plan = asked.join(cells.select("cell", F.ceil(F.col("n_rows") / LIST_ROWS).cast("int").alias("list_slices")), "cell")
    wanted = [r["cell"] for r in asked.select("cell").collect()]
    number = lambda name, key: F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    lists = spark.read.parquet(f"{path}/lists").filter(F.col("cell").isin(wanted)).join(F.broadcast(plan), "cell")
    lists = lists.select("cell", "vec_id", "embedding", number("list_slices", "vec_id").alias("ls"), each("ask_slices").alias("qs"))
    blocks = probed.join(asks, "query_id").join(F.broadcast(plan), "cell")
    blocks = blocks.select("cell", "query_id", F.col("embedding").alias("asked"), number("ask_slices", "query_id").alias("qs"), each("list_slices").alias("ls"))
    keys = ["cell", "ls", "qs"]
    pairs = lambda asked, found: nearest_of_blocks(asked, found, k, skip_self)
    local = blocks.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInArrow(pairs, PAIRS)
    return topk_scored(local, ["query_id"], "score", ["vec_id"], k)
