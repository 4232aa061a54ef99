"""The corpus pipeline: from raw documents to a deduplicated, mixed and encoded corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from genomill.llm import exact_dedup, jaccard, language, mixing, pieces, shared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text gets its predicted language as ``lang``; texts without one go.

    Null and empty texts and those without a letter have none. Without any ``lang`` to learn from all texts with a
    letter stay and keep their null. Repeated rows all stay; an empty table stays empty; other columns pass through.
    """
    return language.with_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one of the smallest doc_id.

    Null and empty texts are one group. A null doc_id gives way to any other; of rows that repeat one document one stays.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the one of the smallest doc_id.

    Texts without words, and rows of a null doc_id, are similar to nothing and stay.
    """
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, each at most twice.

    A null source is a source of its own. Null texts and those without words are taken 0 times. Ties in size are
    decided by hashes of doc_id, so that reruns agree.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left, and what they decode to, as digests: one row for each time it is taken.

    A null text counts as empty: a begin and an end. An empty table gives an empty table.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(docs, model, columns=("doc_id", "lang", "source"), keep_text=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Language models, similarity joins, sampling and tokenizers are beyond SQL; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.keep(docs, name)
    return docs
