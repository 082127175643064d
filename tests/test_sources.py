"""Paging and outputs that are committed together."""

import json
import re

from pyspark.sql import functions as F

from corpuslens.session import fresh_path
from corpuslens.sources import paging as P
from corpuslens.sources import store as S


def listing(spark):
    ids = spark.range(500).select((F.col("id") * 7919 % 211 - 20).alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), (F.col("id") % 3).alias("kind"))
    return ids.repartition(3)


def all_pages(spark, path, limit, where=None):
    pages, token = [], None
    while True:
        rows, token = P.page(spark, path, limit, token, where)
        pages.append([tuple(r) for r in rows.collect()])
        if token is None:
            return pages


def test_pages_are_the_listing(spark):
    path = fresh_path(spark, "listing")
    P.write_listing(listing(spark), path, files=9)
    whole = [tuple(r) for r in listing(spark).orderBy("doc_id", "chunk_index").collect()]
    for limit in (1000, 500, 77):
        pages = all_pages(spark, path, limit)
        assert [r for p in pages for r in p] == whole and all(len(p) == limit for p in pages[:-1])
    rare = all_pages(spark, path, 40, F.col("kind") == 1)
    assert [r for p in rare for r in p] == [r for r in whole if r[2] == 1]
    assert [r for p in all_pages(spark, path, 5, F.col("doc_id") == 10_000) for r in p] == []


def test_a_page_scans_the_ranges_it_needs(spark):
    path = fresh_path(spark, "listing")
    P.write_listing(listing(spark), path, files=10)
    for token in (None, (30, 100), (150, 3)):
        rows, _ = P.page(spark, path, 20, token)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 20 and "TakeOrderedAndProject" in plan
        assert len(re.search(r"PartitionFilters: \[[^]]*range#\d+ IN \(([^)]*)\)", plan)[1].split(",")) == 2
        assert token is None or "GreaterThanOrEqual(doc_id" in plan


def test_an_unfinished_run_is_not_seen(spark):
    path = fresh_path(spark, "documents")
    docs = spark.createDataFrame([(1, "a", "one", "en"), (2, "a", "two", None), (3, None, "", "fa")], "doc_id long, owner string, text string, lang string")
    units = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "doc_id long, unit_no int, title string")
    assert S.read_documents(spark, path).count() == 0
    S.write_documents(docs, units, path, 0, buckets=4)

    def state():
        return {r["doc_id"]: (r["text"], json.loads(r["metadata"]), json.loads(r["document_map"])) for r in S.read_documents(spark, path).collect()}

    before = state()
    assert before[1][1]["char_count"] == 3 and before[1][1]["lang"] == "en" and [u["title"] for u in before[1][2]["units"]] == ["a", "b"] and before[3][2] == {"units": []}
    changed = docs.filter("doc_id = 1").withColumn("text", F.lit("changed"))
    normalized = changed.select("doc_id", "owner", "text", F.lit("{}").alias("metadata"))
    S.upsert(normalized, changed.select("doc_id"), f"{path}/normalized", ["doc_id"], 1)  # the run ends before its second table
    assert state() == before and S.last_run(spark, path) == 0
    S.write_documents(changed, units.limit(0), path, 2, buckets=4)
    after = state()
    assert after[1][0] == "changed" and after[1][2] == {"units": []} and after[2] == before[2]
