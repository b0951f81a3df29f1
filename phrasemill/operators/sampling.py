"""Seeded orders and samples that don't depend on how rows are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(*keys: str | Column, seed: int = 29) -> Column:
    """A seeded hash as a string; its order is a shuffle that any engine can repeat."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys)))


def shuffled(rows: DataFrame, key: str, seed: int = 29) -> DataFrame:
    return rows.orderBy(draw(key, seed=seed))


def _first_of(rows: DataFrame, by: str, key: str, quota: DataFrame, seed: int) -> DataFrame:
    """The first rows in a seeded order of each value of ``by``, as many as ``quota`` (by, _quota) says.

    Counts by the first digits of the order come first, so only the groups of rows that are needed are
    ordered, each on its own: a value of ``by`` that most rows have is never sorted in one task."""
    drawn = rows.withColumn("_d", draw(key, seed=seed)).withColumn("_g", F.substring("_d", 1, 4))
    groups = drawn.groupBy(by, "_g").agg(F.count("*").alias("_k"))
    before = groups.select(by, "_g", (F.sum("_k").over(Window.partitionBy(by).orderBy("_g")) - F.col("_k")).alias("_before"))
    needed = before.join(quota, by).where("_before < _quota")
    order = Window.partitionBy(by, "_g").orderBy("_d")
    chosen = drawn.join(needed, [by, "_g"]).withColumn("_n", F.col("_before") + F.row_number().over(order))
    return chosen.where("_n <= _quota").select(*rows.columns)


def quota_sample(rows: DataFrame, by: str, key: str, quota: int, seed: int = 29) -> DataFrame:
    """At most ``quota`` rows of each value of ``by``."""
    return _first_of(rows, by, key, rows.groupBy(by).agg(F.lit(quota).cast("bigint").alias("_quota")), seed)


def proportional_sample(rows: DataFrame, by: str, key: str, total: int, seed: int = 29) -> DataFrame:
    """A share of ``total`` for each value of ``by`` as large as its share of the rows."""
    all_ = rows.groupBy().agg(F.count("*").alias("_all"))
    quota = rows.groupBy(by).agg(F.count("*").alias("_rows")).crossJoin(F.broadcast(all_)).select(by, F.floor(F.lit(total) * F.col("_rows") / F.col("_all")).alias("_quota"))
    return _first_of(rows, by, key, quota, seed)


def word_budget_sample(rows: DataFrame, key: str, words: str, budget: int, seed: int = 29) -> DataFrame:
    """Rows in a seeded order as long as their words add up to ``budget`` at most.

    Counts of words by the first digits of the order come first, so only one group of rows that the
    budget ends in is ever ordered row by row.
    """
    drawn = rows.withColumn("_d", draw(key, seed=seed)).withColumn("_g", F.substring("_d", 1, 4))
    groups = drawn.groupBy("_g").agg(F.sum(words).alias("_w"))
    before = groups.select("_g", (F.sum("_w").over(Window.orderBy("_g")) - F.col("_w")).alias("_before"))
    per = Window.partitionBy("_g").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    summed = drawn.join(F.broadcast(before), "_g").where(F.col("_before") < budget).withColumn("_sum", F.col("_before") + F.sum(words).over(per))
    return summed.where(F.col("_sum") <= budget).drop("_d", "_g", "_before", "_sum")
