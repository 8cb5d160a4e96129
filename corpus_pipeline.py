"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet to the shared folder and reread as the next stage's documents. All
stages but the last return the columns of documents.

Defined results: a document whose text is null or empty is scored by the classifier like any other, and falls to the
rules, which ask for words; rows without an id take part, and are never kept in favour of a row with one; repeated rows
are judged each, of a group of near copies the row of the smallest id stays, and of rows that share it one; texts of any
length go through every stage whole; an empty table gives an empty table of pieces, and without
labels the classifier keeps all; further columns are carried to the
last stage, whatever their names, which leaves them out. What a stage does with ties is said in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import ngram_join, packing, quality_model, quality_rules
from tideline.llm.common import Scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier takes for good text; it learns from the labels of the documents that it is given."""
    return quality_model.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the threshold table."""
    return quality_rules.keep_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group that the n-gram join links."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens along the curve."""
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("n-gram Jaccard join", drop_near_copies), ("packing", pack)]

#: SQL cannot express the network of the first stage; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
