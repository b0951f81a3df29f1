"""Sinks: tables and files of every output format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.phrases import upsert


def phrase_dump(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By thousands of documents, so that a range of them reads its folders only."""
    rows.withColumn("doc_shard", F.floor(F.col("doc_idx") / 1000).cast("int")).write.partitionBy("doc_shard").mode(mode).parquet(path)


def replace_documents(old: DataFrame, new: DataFrame, path: str) -> None:
    """The dump with the new documents in place of the old ones, at a new path."""
    phrase_dump(upsert(old, new), path, "errorifexists")


def predictions(rows: DataFrame, path: str) -> None:
    """One JSON object for each question."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def shards(rows: DataFrame, path: str, size: int = 1000, key: str = "doc_idx") -> None:
    """Files of ``size`` documents each by their number."""
    rows.withColumn("shard", F.floor(F.col(key) / size).cast("int")).repartition("shard").write.partitionBy("shard").mode("overwrite").json(path)


def first_key_wins(rows: DataFrame, path: str, key: str = "id", order: str = "ordinal") -> None:
    """A table with one row for each key, the first in order."""
    from ..operators.corpus import first_wins

    first_wins(rows, key, [order]).write.mode("overwrite").parquet(path)


def bucketed_passages(rows: DataFrame, path: str, width: int = 1_000_000) -> None:
    numbered = rows.withColumn("id", F.col("id").cast("bigint"))
    numbered.withColumn("bucket", F.floor((F.col("id") - 1) / width).cast("int")).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def ranges(rows: DataFrame, path: str, parts: int = 2, key: str = "doc_idx") -> None:
    """As many files as parts, each a range of documents."""
    rows.repartitionByRange(parts, key).write.mode("overwrite").parquet(path)


def compressed(rows: DataFrame, path: str, codec: str = "zstd") -> None:
    rows.write.mode("overwrite").option("compression", codec).parquet(path)


def question_table(rows: DataFrame, path: str, kind: str = "csv") -> None:
    out = rows.select("id", "question").write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
