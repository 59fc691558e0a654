"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again for the next.

Each stage takes (spark, docs, sf_dir). The first four return rows of docs with their columns; the last returns
every remaining document with its SentencePiece ids. SQL cannot express the trained stages, so ORACLE_SQL is None
and tests hold the stages against brute-force versions.

Odd input: null, empty and blank texts have no letter, so the language stage rejects them unless the quality stage has;
without labels of both kinds, the quality stage keeps all, without any language, the language stage keeps none; null
ids are kept like others, and of equal texts the least id stays, a null one only if there is no other; repeated rows
leave one; empty tables give an empty result; further columns go through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import decontamination, language_id, quality, sentencepiece_wfst, simhash
from quarrylens.llm.common import scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the Bradley-Terry ranker, fitted on the labels of these documents, predicts as good."""
    return quality.keep_good(docs, quality.train_on_tables(spark, docs, sf_dir))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that language identification, trained on these documents, does not reject."""
    return language_id.keep_identified(docs, language_id.train_on_documents(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: texts with a similarity of 0.8 or more on shingles of five words, as estimated by SimHash."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark, as it is or re-parameterised."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by its SentencePiece ids, and says whether they decode to it."""
    return sentencepiece_wfst.with_pieces(docs, sentencepiece_wfst.default_model())


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
