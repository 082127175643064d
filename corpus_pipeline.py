"""From raw documents to packed training sequences: rules, classifier, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.common import scan, stored
from corpuslens.llm.packing import pack
from corpuslens.llm.quality_model import good_documents, measured, training_rows
from corpuslens.llm.quality_rules import cascade
from corpuslens.llm.simhash import one_of_each_group
from corpuslens.llm.substrings import without_repeats
from corpuslens.session import ship

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    ship(spark)
    return cascade(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant of the labelled documents finds good; held-out labels are not used."""
    ship(spark)
    examples = training_rows(measured(scan(spark, sf_dir, "documents", "doc_id", "text")), scan(spark, sf_dir, "labels", "doc_id", "quality"))
    return good_documents(docs, examples)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles, similarity 0.8."""
    ship(spark)
    return one_of_each_group(docs, size=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated strings of 200 bytes cover."""
    ship(spark)
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with lexical neighbours."""
    ship(spark)
    return pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: SQL has neither the tokenizer nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before is written as Parquet in the shared folder and read again."""
    docs = scan(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
