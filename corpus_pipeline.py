"""A corpus pipeline of five stages, each one operator: quality classifier, exact dedup, MinHash near-dedup,
benchmark decontamination, best-fit packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phrasemill.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from phrasemill.llm._store import table, written
from phrasemill.llm.entries import BYTE_BPE

#: Tokens of a packed sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3, those at exactly 0.3 too; the model learns from the labelled ones outside the
    held-out fold. Null texts are scored as empty ones, repeated rows alike, texts of any length whole. Without documents
    there are none; without labels the untrained model decides. Other columns, whatever their names, come along."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space, whatever their ids: the longest, then that of
    the smallest id; of repeated rows one. Null and empty texts are one group; texts of any length are compared by their
    digests; an empty table stays empty. Other columns, whatever their names, come along."""
    return exact_dedup.without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null ids last), of each group linked at a similarity of 0.8 of five-word
    shingles; of repeated rows one. Documents without words, or text, stay; texts of any length are compared whole; an empty
    table stays empty. Other columns, whatever their names, come along."""
    return near_dedup.without_near_copies(docs, percent=80, size=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of ten words, or a whole shorter item, of the benchmark; documents without words, or
    text, stay, and so do all where the benchmark is empty. Repeated rows are decided alike, texts of any length whole; an
    empty table stays empty. Other columns, whatever their names, come along."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), width=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of ``CAPACITY`` tokens; a null or empty text is one token,
    a longer one than a sequence is cut; without documents there are no rows."""
    return packing.pack_documents(docs, BYTE_BPE, capacity=CAPACITY, end_id=END_ID)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("packing", best_fit_packing),
]

#: SQL can't express the classifier, the candidate search and the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
