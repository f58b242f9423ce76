"""The corpus pipeline: language, toxicity, near copies, personal data, packing.

Every stage reads all that the one before kept, written as Parquet; all but
the last return the columns of ``documents``, and other columns that are
there. In all of them null texts count as empty, rows without doc_id and rows
that repeat one are rows like others, repeated rows go or stay together but
for near copies, of which one row stays, texts of any length count whole, and
no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import language, toxicity
from codeloom.llm._shared import discard, materialize
from codeloom.llm.jaccard_join import first_of_each_class
from codeloom.llm.packing import pack
from codeloom.llm.private_data import sanitise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with calibrated confidence."""
    return language.recognised(docs, language.learn(docs))


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not predict to be toxic."""
    return toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies."""
    return first_of_each_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and n_chars counted anew."""
    return sanitise(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_texts),
    ("ngram_jaccard_join", near_copies),
    ("disclosure_control", personal_data),
    ("best_fit_packing", packed),
]
#: Learned stages and packing have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table goes once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
