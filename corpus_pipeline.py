"""The corpus pipeline: five stages from raw documents to piece ids, each written as Parquet before the next.

1. language ID: documents without a letter, or in no known language, go.
2. quality classifier: documents that score below the threshold go.
3. n-gram Jaccard join: one document of each near-duplicate group stays (five words, similarity 0.8).
4. mixing: the rest is put into the order of the Pfair schedule of its sources.
5. SentencePiece: the piece ids of every whole text are added, and each document's place in the mix (``mix_position``), as
   files that are read again keep no order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import jaccard, language, mixing, pieces, quality
from tablewright.llm.common import fresh_name
from tablewright.session import settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learnt from the documents' own labels; the columns are those of ``docs``."""
    return language.keep_identified(docs, language.fit(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from ``labels``, takes for good; the columns are those of ``docs``."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; the columns are those of ``docs``."""
    return jaccard.keep_one(docs, n=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the mixed order of their sources; the columns are those of ``docs``."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix, ``piece_ids`` and whether they decode to the text."""
    docs = mixing.placed(docs, fresh_name(docs, "mix_position"))
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Learning, components and Viterbi are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
