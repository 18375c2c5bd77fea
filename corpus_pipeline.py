"""A training corpus in five stages, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and rereads as the next one's docs. The first four keep the
columns of ``documents``; the last returns the placed pieces.

Every stage takes null, empty and very long texts whole, null ids, repeated
rows, further columns, and empty tables. Rows of one id are judged by their own
texts, except that near duplicates go by id: of a group the rows with the least
id stay. The first stage drops null and empty texts, since they have no letter;
a tie between languages goes to the first by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countygeo.llm import decontamination, jaccard_join, language, packing, secrets
from countygeo.llm.model import fold
from countygeo.llm.text import free_name
from countygeo.runtime import broadcast_if_small, checkpoint


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter, or too uncertain, go.

    The model learns from the ``lang`` labels of the same folds as the query.
    """
    model = language.fit_model(docs.where(fold("doc_id", 4) != 2))
    gone_id, gone_key = free_name(docs, "gone_id"), free_name(docs, "gone_key")
    gone = (language.predict_language(docs, model).where("rejected")
            .select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_key))
    return docs.join(broadcast_if_small(gone), same, "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id."""
    return jaccard_join.first_of_groups(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs, "text", "n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Models and tokenisers cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs
