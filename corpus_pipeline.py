"""Cleaning of a training corpus, from documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the columns
of ``documents`` (the last one returns pieces of sequences).  ``run`` writes every
stage's result as Parquet in the shared folder and hands on what it reads back.

Defined results: documents with a null or empty text have no language and go in the
first stage; an empty table gives an empty one at every stage, and without labels, or
with labels of one kind, nothing is toxic; an empty benchmark leaks nothing.  Rows of one
``doc_id`` are rows of their own until the near duplicates, where of rows with the same
key and words one stays; rows without a ``doc_id`` are judged like others, but teach no
toxicity and stay as near duplicates.  Columns beside those of ``documents`` are handed
on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import _store, decontamination, jaccard_join, language, packing, toxicity
from leafmill.llm.queries import tokenizer_path

LEAST_LANGUAGE_SCORE = 0.3
TOXIC_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined, scored below LEAST_LANGUAGE_SCORE or unlike all that is learned."""
    found = language.predict(docs, language.train(docs), pred="__lang", score_name="__lang_score", like_name="__like")
    return found.where((F.col("__lang") != language.UNDETERMINED) & (F.col("__lang_score") >= LEAST_LANGUAGE_SCORE) & F.col("__like")).select(*docs.columns)


def filter_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; none if the labels are of one kind and tell no text from another."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.tells():
        return docs
    return toxicity.score(docs, model, score_name="__toxicity").where(F.col("__toxicity") < TOXIC_SCORE).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left, a row for each piece."""
    return packing.pack(docs, tokenizer=tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("toxicity", filter_toxicity),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

ORACLE_SQL = None  # models, components and a tokenizer are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _store.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
