"""Derived frames over the given tables, in the column contracts of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.corpus import chunk_fixed
from corpuslens.sources.tables import table


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line, 0-based line_no."""
    return docs(spark, sf).select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Five lines to a page."""
    d = docs(spark, sf).select("doc_id", "lang", F.split("text", "\n").alias("a"))
    n = F.ceil(F.size("a") / 5).cast("int")
    texts = F.transform(F.sequence(F.lit(1), n), lambda p: F.array_join(F.slice("a", (p - 1) * 5 + 1, 5), "\n"))
    return d.select("doc_id", "lang", F.posexplode(texts).alias("_p", "text")).select(
        "doc_id", "lang", (F.col("_p") + 1).alias("page"), "text"
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_fixed(docs(spark, sf))


def markdown_column(text: Column) -> Column:
    """Markdown made from plain lines: a page marker every 5 lines, a chapter every 20, a section half-way."""
    arr = F.split(text, "\n")

    def element(line: Column, i: Column) -> Column:
        marker = F.when(i % 5 == 0, F.concat(F.lit("<!-- page:"), (F.floor(i / 5) + 1).cast("string"), F.lit(" -->")))
        chapter = F.when(i % 20 == 0, F.concat(F.lit("# Chapter "), (F.floor(i / 20) + 1).cast("string")))
        section = F.when(i % 20 == 10, F.concat(F.lit("## "), F.substring(line, 1, 40)))
        return F.concat_ws("\n\n", marker, chapter, section, line)

    return F.array_join(F.transform(arr, element), "\n\n")


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", "lang", "source", markdown_column(F.col("text")).alias("text"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def shingles(words: Column, n: int = 8) -> Column:
    """Runs of n words."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def word_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run) for every run of eight words, a run as its hash: the exchange ahead of a join on runs moves no text."""
    words = df.select(key, F.split(F.lower(T.strip(F.col(text))), r"\s+").alias("w"))
    return words.select(key, F.explode(F.transform(shingles(F.col("w")), lambda run: F.xxhash64(run))).alias("run"))


MAX_BROADCAST_RUNS = 1_000_000  # (query, run) rows of 16 bytes that may be shipped to every task


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Query and document pairs sharing a run of eight words, grade 2."""
    q = word_runs(queries(spark, sf), "query_id", "query_text")
    d = word_runs(docs(spark, sf), "doc_id", "text")
    if q.limit(MAX_BROADCAST_RUNS + 1).count() <= MAX_BROADCAST_RUNS:
        q = F.broadcast(q)  # other runs of the documents end where they arise
    return q.join(d, "run").groupBy("query_id", F.col("doc_id").alias("item")).agg(F.lit(2).alias("grade"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks for its neighbours among all."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return usage_of(table(spark, sf, "events"))


def usage_of(e: DataFrame) -> DataFrame:
    """Events read as usage telemetry: three events to a request, tokens from the JSON side column."""
    k = F.from_json("props", "k long")["k"]
    return e.select(
        "event_id",
        F.floor(F.col("event_id") / 3).cast("long").alias("request_id"),
        "user_id",
        F.col("event_type").alias("feature"),
        F.when(F.col("event_type").isin("view", "click"), "embedding").otherwise("chat_completion").alias("operation_type"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.concat(F.lit("vendor/m"), (F.col("event_id") % 4).cast("string"), F.lit("-large")).alias("model"),
        k.alias("input_tokens"),
        F.floor(k / 3).cast("long").alias("output_tokens"),
        F.round(F.col("value"), 2).cast("decimal(18,8)").alias("cost_usd"),
        F.round(F.col("value") * 10, 1).alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("ts").alias("created_at"),
    )


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as thirty-day subscriptions of their customer."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("interval_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("starts_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("cancelled").alias("status"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def eval_records(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents read as evaluation records: every flag is a rule on label, length and text."""
    j = table(spark, sf, "labels").join(docs(spark, sf), "doc_id")
    n, q, tox = F.col("n_chars"), F.col("quality"), F.col("toxic")
    policy = F.when(n % 3 == 0, "required").when(n % 3 == 1, "forbidden").otherwise("allowed")
    return j.select(
        F.col("doc_id").alias("case_id"),
        F.col("source"),
        F.col("lang").alias("expected_route"),
        F.when(n % 11 == 0, F.lit("xx")).otherwise(F.col("lang")).alias("actual_route"),
        F.when(n % 5 == 0, F.lit(None)).otherwise(F.col("lang")).alias("expected_intent"),
        F.when(n % 7 == 0, F.lit("xx")).otherwise(F.col("lang")).alias("actual_intent"),
        policy.alias("retrieval_policy"),
        (n % 2 == 0).alias("retrieval_called"),
        F.when(n % 4 == 0, F.lit(None)).otherwise(n % 4 == 1).alias("rewrite_expected"),
        (q == 1).alias("rewrite_correct"),
        F.when(n % 6 == 0, F.lit(None)).otherwise(n % 6 == 1).alias("reranker_expected"),
        (n % 6 < 3).alias("reranker_called"),
        F.when(n % 10 == 0, F.lit(None)).otherwise(n % 10 < 7).alias("citation_required"),
        (q == 1).alias("citation_valid"),
        ((q == 1) & (n % 2 == 0)).alias("citation_document_correct"),
        ((q == 1) & (tox == 0)).alias("citation_page_correct"),
        (tox == 0).alias("all_required_claims_cited"),
        (n % 3 == 0).alias("contains_numeric_claim"),
        ((n % 3 == 0) & (tox == 1)).alias("unsupported_numeric_citation_failure"),
        (tox == 1).alias("metadata_only_citation_failure"),
        (q == 1).alias("followup_resolved"),
        (tox == 0).alias("history_used_correctly"),
        (n % 9 != 0).alias("selected_asset_persisted"),
        (n % 8 != 0).alias("conversation_id_persisted"),
        (n % 11 != 0).alias("route_correct"),
        F.when(n % 13 == 0, F.lit(None)).otherwise(F.lit(True)).alias("evidence_available"),
        (q == 1).alias("answer_correct"),
        (n % 2 == 0).alias("required_concepts_covered"),
        (tox == 0).alias("grounded"),
        (n % 5 != 0).alias("citations_correct"),
        F.lit(True).alias("output_complete"),
        F.lit(True).alias("no_internal_message_exposed"),
        (q == 1).alias("acceptable_answer_match"),
        F.when(n % 2 == 0, 1.0).otherwise(0.5).alias("required_concept_coverage"),
        (n % 29 == 0).alias("normalized_answer_match"),
        (tox == 1).alias("forbidden_claim"),
        (n % 17 == 0).alias("false_refusal"),
        (n % 4 != 3).alias("answerable"),
        (n % 19 == 0).alias("truncation"),
        (n % 23 == 0).alias("generic_failure"),
        n.cast("double").alias("latency_ms"),
    )


def judge_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Human label against a length rule, two labels."""
    j = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "n_chars"), "doc_id")
    rows = F.array(
        F.struct(F.lit("quality").alias("label"), (F.col("quality") == 1).alias("expected"),
                 (F.col("n_chars") >= 400).alias("predicted")),
        F.struct(F.lit("toxic").alias("label"), (F.col("toxic") == 1).alias("expected"),
                 (F.col("n_chars") < 300).alias("predicted")),
    )
    return j.select("doc_id", F.inline(rows))

