"""The corpus pipeline: quality, near duplicates, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. `run` removes the tables that a stage has made on its way
as soon as its result is written, and that result when the next one is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltwise.llm import decontamination, near_duplicates, personal_data, piece_codec, quality
from haltwise.llm.common import Tables, stashed_for


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fences of their language and source."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.drop_near_duplicates(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers and what reveals them taken out of the texts."""
    clean = personal_data.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids, and whether decoding gives the text back."""
    coded = piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.withColumn("round_trip", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("personal_data", sanitise),
    ("sentencepiece", encode),
]

#: Near duplicates and pieces can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark)
    for name, stage in STAGES[:-1]:
        with stashed_for(spark):
            written = tables.write(stage(spark, docs, sf_dir), name)
        tables.drop(docs)
        docs = written
    tables.leave()
    return STAGES[-1][1](spark, docs, sf_dir)
