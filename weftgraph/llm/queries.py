"""The queries of the operators, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import oracles
from weftgraph.llm.chat import chat_digests, format_chats
from weftgraph.llm.decontaminate import contaminated
from weftgraph.llm.divergence import source_divergence
from weftgraph.llm.language_id import languages
from weftgraph.llm.licenses import license_scan
from weftgraph.llm.lm_scoring import lm_scores
from weftgraph.llm.near_duplicates import near_duplicates
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.prefix_trie import conversation_trie
from weftgraph.llm.quality_classifier import quality_scores
from weftgraph.llm.quality_rules import judged
from weftgraph.llm.suffix_dedup import suffix_dedup
from weftgraph.llm.toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: every fourth document is called LICENSE, in the folder of its source or of its source and language."""
    n = F.col("doc_id") % 8
    name = F.when(n == 0, F.concat_ws("/", "source", F.lit("LICENSE"))).when(n == 4, F.concat_ws("/", "source", "lang", F.lit("LICENSE"))).otherwise(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    docs = _table(spark, sf_dir, "documents").withColumn("path", name)
    return license_scan(docs).select("doc_id", "path", "license", "score", "line_no", "basis")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", clash), (-1, 1, "assistant", clash)], "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(turns.unionByName(planted)))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_decontaminate,
        op3_near_duplicates,
        op4_lm_score,
        op5_chat_format,
        op6_suffix_dedup,
        op7_quality_rules,
        op8_quality_classifier,
        op9_toxicity,
        op10_pack,
        op11_language_id,
        op12_prefix_trie,
        op13_source_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": oracles.LICENSES,
    "op3_near_duplicates": oracles.NEAR_DUPLICATES,
    "op5_chat_format": oracles.CHATS,
    "op6_suffix_dedup": oracles.SUFFIXES,
    "op7_quality_rules": oracles.QUALITY,
    "op12_prefix_trie": oracles.TRIE,
    "op13_source_divergence": oracles.DIVERGENCE,
}
