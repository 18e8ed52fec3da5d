"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import stage
from quarry.llm.mixing import mixed_corpus
from quarry.llm.ngram_join import keep_one
from quarry.llm.packing import pack_documents
from quarry.llm.quality_rules import keep_good
from quarry.llm.secret_scan import redact_secrets


#: Documents for each file that a stage writes: many small input files needn't become as many small ones of each stage, and in a plain
#: folder Spark's writers start processes for each.
FILE_ROWS = 8000


def _in_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out in as many files as the number of the stage's documents asks for, or fewer."""
    return out.coalesce(docs.count() // FILE_ROWS + 12)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _in_files(keep_good(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return _in_files(keep_one(docs), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked."""
    return _in_files(redact_secrets(docs), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, repeats included."""
    return _in_files(mixed_corpus(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL has neither zstandard nor the draws nor the tokenizer; tests compare the stages with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", arrow=True)
    return STAGES[-1][1](spark, docs, sf_dir)
