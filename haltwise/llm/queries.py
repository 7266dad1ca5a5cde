"""The queries of the text operators, one for each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haltwise.llm import chat_format, decontamination, language_id, maxent_lm, near_duplicates, personal_data, piece_codec, prefix_trie, quality, sharding, simhash_trees, spelling, token_counts


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.op1_sentencepiece(_t(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2_quality(_t(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.op3_near_duplicates(_t(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op4_decontamination(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op5_language_id(_t(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.op6_token_counts(_t(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op7_chat_format(_t(spark, sf_dir, "conversations"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.op8_personal_data(_t(spark, sf_dir, "documents"))


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.op9_maxent_lm(_t(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op10_sharding(_t(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op11_prefix_trie(_t(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trees.op12_simhash(_t(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op13_spelling_variants(_t(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_quality,
        op3_near_duplicates,
        op4_decontamination,
        op5_language_id,
        op6_token_counts,
        op7_chat_format,
        op8_personal_data,
        op9_maxent_lm,
        op10_sharding,
        op11_prefix_trie,
        op12_simhash,
        op13_spelling_variants,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_quality": quality.ORACLE, "op4_decontamination": decontamination.ORACLE, "op7_chat_format": chat_format.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op13_spelling_variants": spelling.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
