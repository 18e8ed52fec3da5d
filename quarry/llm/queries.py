"""The contract queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import chat_format, ngram_join, substring_dedup
from quarry.llm.chat_format import format_chats, tool_conversations
from quarry.llm.fingerprints import fingerprint_documents
from quarry.llm.mixing import mix_documents
from quarry.llm.ngram_join import jaccard_components
from quarry.llm.packing import pack_documents
from quarry.llm.quality_model import classify_quality
from quarry.llm.quality_rules import quality_report
from quarry.llm.secret_scan import secret_report
from quarry.llm.sharding import shard_documents
from quarry.llm.substring_dedup import repeat_report


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lambda s, d: repeat_report(_documents(s, d)),
        "op2_jump_sharding": lambda s, d: shard_documents(_documents(s, d)),
        "op3_ngram_join": lambda s, d: jaccard_components(_documents(s, d)),
        "op4_simhash": lambda s, d: fingerprint_documents(_documents(s, d)),
        "op5_chat_format": lambda s, d: format_chats(tool_conversations(s.read.parquet(f"{d}/conversations.parquet"))),
        "op6_mixing": lambda s, d: mix_documents(_documents(s, d)),
        "op7_quality_rules": lambda s, d: quality_report(_documents(s, d)),
        "op8_weak_labels": lambda s, d: classify_quality(_documents(s, d)),
        "op9_secret_scan": lambda s, d: secret_report(_documents(s, d)),
        "op10_retrieval_packing": lambda s, d: pack_documents(_documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that it can express: no tokenizer, compressor, fitted model or pseudorandom draw in them."""
    return {"op1_line_dedup": substring_dedup.SQL, "op3_ngram_join": ngram_join.SQL, "op5_chat_format": chat_format.SQL}
