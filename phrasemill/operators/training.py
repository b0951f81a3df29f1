"""Values of the training objectives over stored scores, and what is counted beside them.

Nothing is trained here: the formulas are plain aggregates over tables of scores, so that a model's outputs
can be judged by the objective it was trained for. Every one is numerically stable: exponents are taken of
differences to the largest score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot


def log_mass(rows: DataFrame, by: list[str], score: str, target: Column | None = None) -> DataFrame:
    """``by`` and ``log_mass``: the log of the sum of ``exp(score)``, of all rows or of the target ones (null
    without any)."""
    chosen = F.col(score) if target is None else F.when(target, F.col(score))
    top = rows.groupBy(*by).agg(F.max(score).alias("_top"))
    joined = rows.join(top, by).groupBy(*by, "_top").agg(F.sum(F.exp(chosen - F.col("_top"))).alias("_sum"))
    return joined.select(*by, (F.log("_sum") + F.col("_top")).alias("log_mass"))


def marginal_loss(rows: DataFrame, by: list[str], score: str, target: Column) -> DataFrame:
    """``loss`` of each group: minus the log of the targets' share of the softmax; null without targets. With
    one target it is the cross-entropy."""
    everything, mine = log_mass(rows, by, score), log_mass(rows, by, score, target).withColumnRenamed("log_mass", "_mine")
    return everything.join(mine, by).select(*by, (F.col("log_mass") - F.col("_mine")).alias("loss"))


def span_loss(tokens: DataFrame, gold_start: Column, gold_end: Column, start: str, end: str, by: list[str]) -> DataFrame:
    """``loss`` of each group of tokens: mean cross-entropy of the gold start and the gold end."""
    a = marginal_loss(tokens.withColumn("_g", gold_start), by, start, F.col("_g")).withColumnRenamed("loss", "_a")
    b = marginal_loss(tokens.withColumn("_g", gold_end), by, end, F.col("_g")).withColumnRenamed("loss", "_b")
    return a.join(b, by).select(*by, ((F.col("_a") + F.col("_b")) / 2).alias("loss"))


def divergence(rows: DataFrame, by: list[str], teacher: str, student: str) -> DataFrame:
    """``loss`` of each group: the Kullback-Leibler divergence of the student's softmax from the teacher's."""
    t = log_mass(rows, by, teacher).withColumnRenamed("log_mass", "_t")
    s = log_mass(rows, by, student).withColumnRenamed("log_mass", "_s")
    log_t, log_s = F.col(teacher) - F.col("_t"), F.col(student) - F.col("_s")
    return rows.join(t, by).join(s, by).groupBy(*by).agg(F.sum(F.exp(log_t) * (log_t - log_s)).alias("loss"))


def binary_loss(logit: Column, label: Column) -> Column:
    """Cross-entropy of a logit and a true or false label."""
    return F.greatest(logit, F.lit(0.0)) - F.when(label, logit).otherwise(0.0) + F.log1p(F.exp(-F.abs(logit)))


def batch_scores(queries: DataFrame, passages: DataFrame, before: int = 0) -> DataFrame:
    """``qid, pid, own, score`` of each query with the passages of its batch and of the ``before`` batches
    before it. ``queries``: qid, batch, pid, qvec; ``passages``: pid, batch, pvec. Batches are bounded by
    design: what a step of training holds at once."""
    asked = queries.withColumnRenamed("pid", "_own").withColumn("_at", F.explode(F.sequence(F.col("batch") - before, F.col("batch"))))
    joined = asked.drop("batch").join(passages.withColumnRenamed("batch", "_at"), "_at")
    return joined.select("qid", "pid", (F.col("pid") == F.col("_own")).alias("own"), dot(F.col("qvec"), F.col("pvec")).alias("score"))


def accuracy(hits: DataFrame, target: Column, k: int, by: str = "qid") -> DataFrame:
    """``acc1, acck``: shares of the questions with a target among the first, and the first ``k``, hits."""
    per = hits.groupBy(by).agg(F.min(F.when(target, F.col("rank"))).alias("first"))
    return per.agg(*(F.avg(F.coalesce(F.col("first") <= n, F.lit(False)).cast("double")).alias(c) for n, c in ((1, "acc1"), (k, "acck"))))


def equal_lengths(rows: DataFrame, rank: str, order: str) -> DataFrame:
    """Rows of each rank cut to the number that the shortest rank has, the first in order."""
    shortest = rows.groupBy(rank).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(rank).orderBy(order)))
    return placed.crossJoin(F.broadcast(shortest)).where("_n <= _least").drop("_n", "_least")


def questions_per_second(batches: DataFrame, warm: int = 5) -> DataFrame:
    """``questions, seconds, rate`` without the first ``warm`` batches. ``batches``: batch (from 0), questions,
    seconds."""
    total = batches.where(F.col("batch") >= warm).agg(F.sum("questions").alias("questions"), F.sum("seconds").alias("seconds"))
    return total.withColumn("rate", F.col("questions") / F.col("seconds"))
