"""The corpus pipeline: stages over documents, each of which calls one operator of wavespark.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark.llm import exact_dedup, langid, near_copies, packing, tiling
from wavespark.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no language of the corpus go: those without letters, and those whose n-grams no language's filter
    accounts for."""
    return langid.identified(docs, langid.fit(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked at a similarity of 0.8 of five-word shingles, the row with the smallest doc_id stays."""
    return near_copies.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go. Null and empty texts cover none, repeated rows share their fate; without items,
    or documents, nothing happens."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, dealt to sequences by its tokens and one for each document's end: a row for each piece of a document.
    Null and empty texts, and repeated rows, are as in packing.pack; an empty table gives no rows."""
    return packing.pack(packing.token_counts(docs), tokens=F.col("n") + 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", packed),
]

#: SQL has neither the fingerprints nor the trained filters of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each result but the last is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, stored(docs) if k else docs, sf_dir)
    return docs
