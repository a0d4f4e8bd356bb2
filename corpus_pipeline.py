"""The corpus pipeline: documents without toxic, unidentified, near-duplicate and contaminated rows, packed into sequences.

Every stage judges each row by its own text. Defined results: null and empty texts are no language and go with the second stage; rows
that repeat an id, or have none, stand for themselves; of equal or near-equal texts one row stays, whatever their ids; an empty table
gives no row; texts of any length are read whole; other columns, whatever their names, are kept until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, language, near_dup, packing, toxicity
from cairn.llm.common import staged

#: Documents that share so many percent of their five-word shingles are near duplicates here.
LEAST_SIMILARITY = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(score(F.col("text")) < toxicity.THRESHOLD)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts whose best language is hardly likelier than any other."""
    identifier = language.learned(docs)
    found = identifier(F.col("text"))
    return docs.filter((found["lang_pred"] != "und") & (found["score"] >= identifier.least_score()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least id."""
    return near_dup.one_of_each(docs, percent=LEAST_SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Stages that learn, or search at random, have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
