"""Views of the generated tables as the engine's own: phrases, queries, documents, answers, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import corpus, phrases

#: Tokens of a document, scale of vector codes, filter threshold, hits of a query, tokens of a span.
WIDTH, SCALE, THRESHOLD, K, LENGTH = 25, 200.0, 0.1, 10, 3
#: Every so manieth vector of the whole table is a query.
EVERY = 50


def asked(id_col: Column) -> Column:
    """Whether a vector is a query."""
    return id_col % EVERY == 0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """id, label and vectors as 8-bit codes, whose sums of products are exact."""
    codes = F.transform(V.to_int8(F.col("embedding"), 0.0, SCALE), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", codes.alias("vec"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """doc_idx, word_idx, filter scores and codes of every token."""
    e = F.col("embedding")
    codes = F.transform(V.to_int8(e, 0.0, SCALE), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select(F.expr(f"vec_id div {WIDTH}").alias("doc_idx"), (F.col("vec_id") % WIDTH).alias("word_idx"), F.get(e, F.lit(0)).cast("double").alias("fs"), F.get(e, F.lit(1)).cast("double").alias("fe"), codes.alias("vec"))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.filtered(tokens(spark, sf), THRESHOLD)


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """qid and codes for starts and ends: a vector and the one after it."""
    rows = coded(spark, sf)
    nxt = rows.select((F.col("id") - 1).alias("id"), F.col("vec").alias("q_end"))
    return rows.where(asked(F.col("id"))).join(nxt, "id").select(F.col("id").alias("qid"), F.col("vec").alias("q_start"), "q_end")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.contexts(table(spark, sf, "documents"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """qid, predictions, golds from the whole texts of benchmark items: without their first word, whole, without the first three; and whole
    and without the first and last two words as gold answers."""
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text", F.split("text", " ").alias("w")).withColumn("n", F.size("w"))
    part = lambda at, less: F.array_join(F.slice("w", F.lit(at), F.greatest(F.col("n") - less, F.lit(0))), " ")
    return rows.select("qid", F.array(part(2, 1), part(1, 0), part(4, 3)).alias("predictions"), F.array(part(1, 0), part(2, 3)).alias("golds"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """qid, place, hit, lang: documents of one residue of forty by place; a hit has a length divisible by 7."""
    return table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("qid"), F.expr("doc_id div 40").alias("place"), (F.col("n_chars") % 7 == 0).alias("hit"), "lang")


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """qid, guess ids, two gold sets of ids, from the neighbourhood of labelled documents."""
    d = table(spark, sf, "labels")
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    return d.select(i.alias("qid"), F.array(s(i % 7), s(i % 5), s(i % 3), s(i % 11)).alias("guess"), F.array(F.array(s(i % 5), s(F.lit(1))), F.array(s(i % 11))).alias("golds"), "quality", "toxic")
