"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, decontaminate, line_dedup, lm_score, oracles, packing, quality, simhash_dedup, spelling, token_store, toxicity, warc_index
from .shared import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], conversations.schema)
    return chat_format.digests(chat_format.format_chats(conversations.unionByName(more)))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_store.encode_corpus(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc_index.archive(spark, table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams: longer n-grams go beyond the disk budget (README)."""
    return lm_score.score(table(spark, sf_dir, "documents"), order=2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.assess(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_token_store": op2_token_store,
    "op3_warc_index": op3_warc_index,
    "op4_lm_score": op4_lm_score,
    "op5_toxicity": op5_toxicity,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}

ORACLE_SQL: dict[str, str] = {"op11_phrase_collocations": oracles.COLLOCATIONS, "op12_spelling_variants": oracles.SPELLING}
