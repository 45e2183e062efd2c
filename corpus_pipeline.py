"""Corpus pipeline: the training-data operators applied to `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir) and decides on every row that the one before kept. The
filters pass whole rows through one Arrow pass; only near-duplicates need a join, with the keys of
rows that go. What a stage keeps is written as Parquet in the cluster's shared folder and read again,
so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, decontam, langid, onecopy, toxicity
from postmill.llm.catalog import WORD_BPE, table
from postmill.llm.learning import held_out
from postmill.session import shared_folder

#: Similarity of word shingles in percent from which documents are near-duplicates.
NEAR = 80


def clean_tone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labelled rows of four folds of five.

    Null and empty texts score the bias alone and stay where that is below 0.5; repeated rows go or stay alike.
    """
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs.filter(~out), table(spark, sf_dir, "labels").filter(~out))
    return toxicity.drop_toxic(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one learned language; those without a letter, null and empty ones too, or between two languages go.

    Repeated rows go or stay alike; without a learned language no row stays.
    """
    return langid.keep_known(docs, langid.train(docs.filter(~held_out(F.col("doc_id"), 3, 1))))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, and one only where that is repeated."""
    return onecopy.one_of_each(docs, NEAR)


def unseen_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts hold none and stay, repeated rows go or stay alike."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its id, its number of tokens and their ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
    return bpe.encode(docs, WORD_BPE)


STAGES = [
    ("toxicity", clean_tone),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", unseen_items),
    ("tokens", tokens),
]

#: Models, sketches and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
