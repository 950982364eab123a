"""From raw documents to mixed, tokenised training data, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, read from Parquet;
all but the last return the columns of ``documents``, whatever further ones there are. Null, empty and blank texts have no good line, so
they go in the first stage; of rows that repeat an id and a text one stays; ties go by id. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import crf_quality, exact_dedup, mixing, ngram_join, sp_unigram
from plumbline.llm.common import discard, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field finds good; it is fitted on those of them that are labelled. Without labels all lines are as likely good, and documents with a line stay."""
    return crf_quality.keep_good(docs, crf_quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one of the smallest id."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that n-gram Jaccard pairs connect: the one of the smallest id. Texts without a word are in no class and stay."""
    return ngram_join.one_per_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fair queueing admits before the token budget is used up, in its order. A null source is a source of its own."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return sp_unigram.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", tokens),
]

#: The field and the piece lattice can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            discard(f"{base}/{k - 1}", spark=spark)
    return docs
