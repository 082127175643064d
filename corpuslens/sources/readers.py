"""Readers and writers: corpora by format, gold sets in JSON lines, chunk output, content manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.operators.relational import PROCESSABLE, category_of


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Documents with their category; only text is kept for processing."""
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True).select(
            F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text")
        )
    elif fmt == "json":
        raw = spark.read.schema("doc_id long, filename string, text string").json(path)
    else:
        raw = spark.read.format(fmt).load(path)
    return with_category(raw)


def with_category(docs: DataFrame) -> DataFrame:
    return docs.withColumn("category", category_of(F.col("filename"))).filter(F.col("category") == PROCESSABLE)


CITATION = "struct<required:boolean,expected_pages:array<int>,minimum_citations:int,allow_document_only:boolean>"
GOLD_SCHEMAS = {
    "manifest": "filename string, sha256 string, page_count int, primary_language string, secondary_languages array<string>, "
    "document_type string, title string, known_test_roles array<string>, known_limitations array<string>, "
    "trusted_or_limited_slice struct<status:string,description:string>, tables_present boolean, "
    "ocr_degradation_exists boolean, text_layer_degradation_exists boolean, repeated_headers_exist boolean",
    "tasks": "query_id string, filename string, document_sha256 string, language string, query string, task_type string, "
    "expected_intent string, expected_route string, answerability string, acceptable_answers array<string>, "
    "required_concepts array<string>, forbidden_claims array<string>, relevant_pages array<int>, "
    "evidence_descriptions array<struct<page:int,description:string>>, graded_relevance map<string,int>, "
    f"retrieval_policy string, citation_expectation {CITATION}, human_review_notes string, trusted_for_release_comparison boolean, "
    "required_sections array<string>, required_key_claims array<string>, conclusion_required boolean, argument_structure_items array<string>, "
    "contamination_blacklist array<string>, minimum_page_diversity int, administrative_sections_to_exclude array<string>, "
    "table_identifier string, table_page int, expected_row string, expected_column string, expected_value string, "
    "acceptable_numeric_formats array<string>",
    "conversations": "conversation_id string, filename string, document_sha256 string, turns array<struct<turn_id:string,query:string,"
    "antecedent:string,must_use_history:boolean,expected_interpretation:string,expected_route:string,retrieval_policy:string,"
    "selected_document_persistence_required:boolean,acceptable_response_behavior:string,unacceptable_response_behavior:string>>",
    "judge_cases": "case_id string, query string, reference_answer string, actual_answer string, evidence array<string>, "
    "citation_pages array<int>, expected_pages array<int>, human_labels struct<answer_correctness:boolean,faithfulness:boolean,"
    "relevance:boolean,citation_support:boolean,refusal_correctness:boolean>",
}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped, a bad line is kept in ``_corrupt_record``."""
    declared = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else schema
    with_bad = declared.add("_corrupt_record", T.StringType()) if isinstance(declared, T.StructType) else f"{schema}, _corrupt_record string"
    return (
        spark.read.schema(with_bad)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def read_goldset(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return read_jsonl(spark, f"{directory}/{name}.jsonl", GOLD_SCHEMAS[name])


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of lines that are not JSON objects, blank ones aside.

    Files are read line by line in splits. The lines of each split are counted, and the counts of a file's earlier
    splits give each line its number, so no file has to fit a task.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = read.select(F.col("value").alias("line"), *place, F.monotonically_increasing_id().alias("at"))
    held = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift")
    bad = lines.filter((F.trim("line") != "") & F.try_parse_json(F.col("line")).isNull())
    return bad.join(held.select("file", "start", shift), ["file", "start"]).select((F.col("at") + F.col("shift")).alias("line_no"), "line")


def write_chunks(chunks: DataFrame, path: str, owner: str = "source") -> None:
    """Chunks partitioned by owner; the rebalance hint splits an owner holding most rows over several files."""
    chunks.hint("rebalance", owner).write.mode("overwrite").partitionBy(owner).parquet(path)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: cuts the lineage in the shared folder and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def manifest_create(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
