"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodegraph.llm import bpe, classifier, decontaminate, htmltext, jaccard, langid, lm, oracles, quality, substring, suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = {"op1_suffix_dedup": oracles.REPEATED_BYTES, "op4_quality_rules": oracles.QUALITY, "op6_jaccard_join": oracles.JACCARD, "op7_substring_dedup": oracles.REPEATED_WORDS}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int, doc_id: str = "doc_id") -> Column:
    """Remainder of crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % of


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), fold(7) != 2, ranks_path())


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.byte_bpe(table(spark, sf_dir, "documents"), ranks_path())


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeated_words(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where("lang is not null and text is not null").where(fold(4) != 2))
    return langid.identify(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "langs", "shares")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forest = classifier.train(docs, labels.where(fold(5) != 0))
    return classifier.classify(docs, forest).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")
