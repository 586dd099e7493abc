"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from souk.llm import op01_chat, op02_quality, op03_suffix_dedup, op04_simhash, op05_mixing, op06_decontaminate, op07_lines, op08_tokens, op09_rules
from souk.llm import op10_substrings as op10_substrings_operator
from souk.llm import op11_audit as op11_audit_operator
from souk.llm import op12_vector_codes as op12_vector_codes_operator
from souk.llm import op13_byte_bpe as op13_byte_bpe_operator


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the installed file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_chat.format_chats(_table(spark, sf_dir, "conversations"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op02_quality.score(docs, op02_quality.train(docs, _table(spark, sf_dir, "labels")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op03_suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op06_decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_lines.line_report(_table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op09_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *op09_rules.COUNTS, "base_failed", "boilerplate_words", "kept")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op10_substrings_operator.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_audit_operator.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_vector_codes_operator.compress(_table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = op13_byte_bpe_operator.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    return op13_byte_bpe_operator.round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_lines": op7_lines,
    "op8_tokens": op8_tokens,
    "op9_rules": op9_rules,
    "op10_substrings": op10_substrings,
    "op11_audit": op11_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES: dict[str, str] = {
    "op1_chat": op01_chat.oracle(),
    "op5_mixing": op05_mixing.oracle(),
    "op7_lines": op07_lines.oracle(),
    "op11_audit": op11_audit_operator.oracle(),
    "op12_vector_codes": op12_vector_codes_operator.oracle(),
}
