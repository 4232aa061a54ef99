"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard, kdtree, kneser_ney, language, licenses, mixing, personal, pieces, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.train(docs, order=3))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(table(spark, sf_dir, "documents"), model, keep_ids=False, keep_text=False)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"))


def op7_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents"), personal.train())


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_licenses": op3_licenses,
        "op4_language": op4_language,
        "op5_mixing": op5_mixing,
        "op6_top_k": op6_top_k,
        "op7_personal": op7_personal,
        "op8_html": op8_html,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_jaccard": op10_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licenses.oracle(), "op6_top_k": kdtree.ORACLE, "op8_html": wrappers.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
