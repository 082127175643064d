"""Stored vector and lexical indexes against the exact searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import lexical_index as L
from corpuslens.operators import retrieval as R
from corpuslens.operators import vector_index as X
from corpuslens.session import fresh_path, ship

KEYS = ["doc_id", "chunk_index"]


@pytest.fixture(scope="module")
def clustered(spark):
    """Twenty clusters, one with a third of all rows, equal rows, and rows that cannot be compared."""
    ship(spark)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[0 if i % 3 == 0 else i % 20] + 0.2 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(900 + i, [1.0] * 8) for i in range(60)] + [(1000, None), (1001, [1.0, None] * 4), (1002, [1.0] * 4), (1003, [0.0] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)


def pairs(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


def test_every_comparable_vector_is_in_one_list(spark, clustered):
    path = fresh_path(spark, "vectors")
    X.build_vector_index(clustered, path, dim=8)
    lists = spark.read.parquet(f"{path}/lists")
    assert sorted(r["vec_id"] for r in lists.collect()) == [*range(960), 1003]
    row = X.indexed_vectors(spark, path).first()
    assert row["n_vectors"] == 961 and 20 <= row["n_cells"] <= 31


def test_probed_lists_are_pruned_and_all_probes_are_exact(spark, clustered, monkeypatch):
    path = fresh_path(spark, "vectors")
    X.build_vector_index(clustered, path, dim=8, cells=20)
    asks = clustered.filter("vec_id % 45 = 1").withColumnRenamed("vec_id", "query_id")
    exact = pairs(R.dense_topk(asks, clustered.filter("size(embedding) = 8"), 5, skip_self=True))
    few = X.search_vector_index(spark, path, asks.limit(1), 5, 1, skip_self=True)
    assert "PartitionFilters: [isnotnull(cell" in few._jdf.queryExecution().toString() or "cell#" in few._jdf.queryExecution().toString().split("PartitionFilters: [")[1][:40]
    monkeypatch.setattr(X, "LIST_ROWS", 50)  # crowded cells and much-asked ones are cut
    monkeypatch.setattr(X, "ASK_ROWS", 3)
    cells = X.indexed_vectors(spark, path).first()["n_cells"]
    assert pairs(X.search_vector_index(spark, path, asks, 5, cells, skip_self=True)) == exact
    probes = X.probes_for(spark, path, 5, 0.95)
    near = pairs(X.search_vector_index(spark, path, asks, 5, probes, skip_self=True))
    assert probes < cells and len(near & exact) >= 0.9 * len(exact)


def test_tiny_and_unusable_tables(spark, clustered):
    for rows, n in ((clustered.filter("vec_id = 1"), 1), (clustered.filter("vec_id >= 1000 and vec_id < 1003"), 0)):
        path = fresh_path(spark, "vectors")
        X.build_vector_index(rows, path, dim=8)
        asks = clustered.filter("vec_id in (1, 2, 1000)").withColumnRenamed("vec_id", "query_id")
        assert X.search_vector_index(spark, path, asks, 5, 3).count() == 2 * n


def corpus(spark, n=600):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, i % 3, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 60))), "en" if i % 4 else "fa") for i in range(n)]
    rows += [(n + i, 0, "w0 " * 30, "en") for i in range(40)] + [(n + 50, 0, None, "en"), (n + 51, 0, "", "fa")]
    return spark.createDataFrame(rows, "doc_id long, chunk_index int, text string, lang string")


QUERIES = [(1, "w0 w1 w250"), (2, "w7 w7 w290 nowhere"), (3, "w0"), (4, ""), (5, "w120 w121 w122 w3")]


def near_rows(df, *scope):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("block", [10, 10_000])
def test_indexed_search_equals_the_scan(spark, block):
    chunks, asks = corpus(spark), spark.createDataFrame(QUERIES, "query_id long, query_text string")
    path = fresh_path(spark, "lexical")
    L.build_lexical_index(chunks, path, KEYS, block_chunks=block)
    best, report = L.search_lexical_index(spark, path, asks, KEYS, 7)
    assert near_rows(best) == near_rows(R.bm25_topk(asks, chunks, KEYS, 7))
    seen = {r["query_id"]: (r["n_blocks"], r["n_scored"]) for r in report.collect()}
    assert all(scored <= blocks for blocks, scored in seen.values())
    if block == 10:
        assert seen[2][1] < seen[2][0] and seen[5][1] < seen[5][0]  # blocks without the rare terms are never read


def test_indexed_search_by_scope_with_repeated_terms(spark):
    chunks = corpus(spark)
    asks = spark.createDataFrame([(i, t, lang) for i, t in QUERIES for lang in ("en", "fa")], "query_id long, query_text string, lang string")
    asks = asks.withColumn("query_id", F.concat_ws("|", "query_id", "lang"))
    options = {"k1": 1.2, "floor_average": False, "scope": ["lang"]}
    path = fresh_path(spark, "lexical")
    L.build_lexical_index(chunks, path, KEYS, block_chunks=20, **options)
    best, _ = L.search_lexical_index(spark, path, asks, KEYS, 5, scope=["lang"], dedupe_query_terms=False)
    assert near_rows(best) == near_rows(R.bm25_topk(asks, chunks, KEYS, 5, dedupe_query_terms=False, **options))


def test_chunks_without_terms(spark):
    asks = spark.createDataFrame(QUERIES, "query_id long, query_text string")
    for chunks in (corpus(spark).limit(0), corpus(spark).filter("doc_id >= 650")):
        path = fresh_path(spark, "lexical")
        L.build_lexical_index(chunks, path, KEYS)
        best, report = L.search_lexical_index(spark, path, asks, KEYS, 3)
        assert best.columns == ["query_id", *KEYS, "score", "rank"] and best.count() == 0 and report.count() == 0


def test_search_reads_neither_texts_nor_other_folders(spark):
    path = fresh_path(spark, "lexical")
    L.build_lexical_index(corpus(spark), path, KEYS, block_chunks=10)
    best, _ = L.search_lexical_index(spark, path, spark.createDataFrame([(1, "w5")], "query_id long, query_text string"), KEYS, 3)
    plan = best._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "regexp_extract_all" not in plan
