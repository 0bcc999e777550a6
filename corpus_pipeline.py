"""From raw documents to a mix: STAGES in order, each over all rows that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoset.llm import decontaminate, language, mixture, ngram_join, secrets
from chronoset.llm.common import bound_batches, cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language of the corpus; learnt from the rows that name theirs.

    A null text, one without a letter, and any text if no row names its language, are rejected. Repeated rows and a null doc_id are
    judged by their texts; of two equally similar languages the one first by name wins. An empty table stays empty.
    """
    bound_batches(spark)
    return language.keep_known(docs, F.col("lang").isNotNull())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more.

    The least doc_id of a group stays. Texts that are null, empty or without words are linked with nothing; with fewer than five words
    the whole sequence is the set. Of rows with one doc_id one stays, by a hash of all its columns; rows without a doc_id all stay.
    """
    bound_batches(spark)
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those of whose words a twentieth or more are in windows of the benchmark.

    A text that is null or has no words is clean. Items that are null or have no words find nothing, repeated ones count once;
    repeated documents and those without a doc_id are judged by their texts.
    """
    bound_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars as it is then; null and empty texts stay, repeated rows are masked alike."""
    bound_batches(spark)
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: (doc_id, size, source_size, target, taken, offset).

    A null text has size 0 and gives nothing; null is a source of its own, the last. Documents are ordered by md5 of their doc_id (null
    as an empty one), so ties are of one doc_id, whose equal rows share what they take. Columns beyond those of documents don't
    matter; whatever they are called, the stages before keep them.
    """
    return mixture.mix(docs).drop("source")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
]
#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
