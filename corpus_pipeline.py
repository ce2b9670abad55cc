"""From raw documents to token ids: five stages, each on what the one before kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
empty tables and extra columns of any names, and hands on all columns but for the
last one. Texts are read whole; one has to fit a worker's memory some fifty times
over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodegraph.llm import bpe, decontaminate, jaccard, quality, suffix
from lodegraph.llm.queries import ranks_path, table
from lodegraph.operators.checkpoints import ensure_dir

#: Near-duplicate documents: five-word shingles, Jaccard similarity of at least 0.8.
NEAR = jaccard.Measure(words=5, percent=80)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, rows are judged one by one, a share equal to its ceiling passes."""
    return quality.passing(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates.

    Of rows with one id and one text one stays, of several texts of one id each;
    rows with a null id all stay.
    """
    return jaccard.first_of_groups(docs, NEAR)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document holds.

    Bytes of a character cut in two go too; documents of which no word is left
    go; n_chars follows the text, other columns stay as they are. Rows of one id
    are one document, those of a null id the last one.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = suffix.drop_repeated_bytes(docs, with_spans=True, carry=tuple(rest))
    columns = [F.length("kept_text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"carry_{rest.index(c)}").alias(c) if c in rest else (F.col("kept_text").alias(c) if c == "text" else F.col(c)) for c in docs.columns]
    return cut.select(*columns).where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null texts and items match nothing, equal rows go or stay together."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of them and of what they decode to; a null or empty text has none, equal rows give equal rows."""
    return bpe.byte_bpe(docs, ranks_path(), with_ids=True).drop("token_ends")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_documents),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("byte_bpe", token_ids),
]

#: Suffix arrays, groups and byte pairs have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    A result goes once the next one is written; the last one stays for the caller to read.
    """
    ensure_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, done = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done is not None:
            gone = spark._jvm.org.apache.hadoop.fs.Path(done)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        done = path
    return docs
