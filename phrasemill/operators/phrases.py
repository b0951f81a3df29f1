"""Phrase tables: tokens of documents with vectors and filter scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assemble(windows: DataFrame) -> DataFrame:
    """Documents from their windows: ``doc_idx, par_idx, span_idx, tokens`` in order, tokens flattened."""
    ordered = F.array_sort(F.collect_list(F.struct("par_idx", "span_idx", "tokens")))
    return windows.groupBy("doc_idx").agg(F.flatten(F.transform(ordered, lambda w: w["tokens"])).alias("tokens"))


def filtered(tokens: DataFrame, threshold: float, doc: str = "doc_idx", word: str = "word_idx", start: str = "fs", end: str = "fe") -> DataFrame:
    """Tokens whose start or end score is over the threshold, or a document's first token if none is;
    ``idx`` counts the kept ones and ``f2o`` is the place among all tokens."""
    passes = (F.col(start) > threshold) | (F.col(end) > threshold)
    per = Window.partitionBy(doc)
    flagged = tokens.withColumn("_pass", passes).withColumn("_any", F.max("_pass").over(per)).withColumn("_first", F.min(word).over(per))
    kept = flagged.where(F.col("_pass") | (~F.col("_any") & (F.col(word) == F.col("_first")))).drop("_pass", "_any", "_first")
    return kept.withColumn("f2o", F.col(word)).withColumn("idx", (F.row_number().over(per.orderBy(word)) - 1).cast("bigint"))


def start_to_end(kept: DataFrame, threshold: float, length: int, doc: str = "doc_idx") -> DataFrame:
    """For every kept token the short places of the tokens that may end a phrase of at most ``length``
    tokens from it, -1 where the token didn't pass the end filter."""
    offsets = kept.select(doc, "idx", "f2o", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("o"))
    ends = kept.select(F.col(doc).alias("_d"), F.col("f2o").alias("_f"), F.when(F.col("fe") > threshold, F.col("idx")).otherwise(-1).alias("end_idx"))
    joined = offsets.join(ends, (F.col(doc) == F.col("_d")) & (F.col("f2o") + F.col("o") == F.col("_f")), "left")
    return joined.select(doc, "idx", "o", F.coalesce("end_idx", F.lit(-1).cast("bigint")).alias("end_idx"))


def first_passage(tokens: DataFrame, lengths: DataFrame, doc: str = "doc_idx") -> DataFrame:
    """Tokens of each document's first paragraph; ``lengths``: ``doc_idx, first_len``."""
    return tokens.join(lengths, doc).where("f2o < first_len").drop("first_len")


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_idx") -> DataFrame:
    """A dump in which the new documents replace the old ones of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def paragraph_offsets(paragraphs: DataFrame, doc: str = "doc_idx", order: str = "par_idx", text: str = "text", gap: int = 7) -> DataFrame:
    """Where each paragraph begins in the joined context; ``gap`` is the delimiter's length."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("offset", F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)).cast("bigint"))


def survival(tokens: DataFrame, thresholds: list[float], start: str = "fs", end: str = "fe") -> DataFrame:
    """How many tokens pass each threshold, in one pass."""
    sums = [F.sum(((F.col(start) > t) | (F.col(end) > t)).cast("bigint")).alias(f"t{i}") for i, t in enumerate(thresholds)]
    wide = tokens.agg(F.count("*").alias("total"), *sums)
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("kept")) for i, t in enumerate(thresholds)))).alias("r")
    return wide.select("total", rows).select("r.threshold", "r.kept", "total")


def chain_breaks(files: DataFrame) -> DataFrame:
    """Dump files (``first_doc``, ``last_doc`` exclusive) that don't go on where the one before ended."""
    before = F.lag("last_doc").over(Window.orderBy("first_doc"))
    return files.withColumn("expected", before).where("expected IS NOT NULL AND expected <> first_doc")
