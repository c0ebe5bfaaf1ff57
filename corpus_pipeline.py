"""From raw documents to packed sequences, in four stages.

Each stage takes all rows that the one before it kept. All but the last return the columns of
``documents``, unchanged but for the lines that the quality rules take out of ``text``. Stages are written as Parquet in the shared folder and read again, so
a lost executor costs no more than one stage's work.

Null or empty texts are rejected by the quality rules; the stages define their other
cases themselves. Columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerscan.llm import near_dedup, quality_rules, toxicity
from layerscan.llm.queries import packed_documents, prepared
from layerscan.session import shared_folder


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learned from the labels of these, lets pass."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep(docs, toxicity.fit(docs, labels))


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the rule on repeated lines let pass, less such lines."""
    prepared(spark)
    kept = quality_rules.keep(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    prepared(spark)
    return near_dedup.keep(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    prepared(spark)
    return packed_documents(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("quality_rules", pass_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Classifier, hashes and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            folder = shared_folder(spark, name)
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
