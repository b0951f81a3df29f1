"""Exact duplicates with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's frequent-items sketch) of the text digests names those that may be
frequent. Their winners come from a map-side aggregate over all of their rows, and as there are at most
``TRACKED`` of them they are broadcast: the rows of large groups meet no shuffle by digest. All other
digests are rare by the summary's guarantee (under ``rows / (0.75 * TRACKED)`` each) and go through an
ordinary shuffle and a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import free_name
from ._store import numbered, written

#: Counters of the summary: bounds what is broadcast and how large an unnamed group can be.
TRACKED = 1024
#: Summaries that are merged side by side before the last merge.
MERGES = 64
_WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in _WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def frequent(rows: DataFrame, column: str, tracked: int = TRACKED) -> DataFrame:
    """One row for each value that may be frequent, at most ``tracked``: all those with over
    ``rows / (0.75 * tracked)`` occurrences are among them."""
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part")).agg(F.expr(f"approx_top_k_accumulate({column}, {tracked})").alias("sketch"))
    # by a constant key: a combine over a partition without rows would fail
    top = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {tracked})").alias("top"))
    return top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias(column))


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; the row with the most code points in
    its original text stays, then the smallest id (null ids last). A null text counts as empty, so null,
    empty and white-space texts are one group. Of repeated rows with the same id all are ``kept`` when
    that id wins, as nothing tells them apart; ``without_copies`` keeps one of them. An empty table gives
    no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"), F.char_length(text).alias("size"))
    rows = written(rows, "digests")
    hot = F.broadcast(frequent(rows, "digest"))
    # larger first, then the smaller id, null ids last
    best = F.min_by("id", F.struct(-F.col("size"), F.col("id").isNull(), F.col("id")))
    winners = rows.join(hot, "digest", "left_semi").groupBy("digest").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    heavy = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("size").desc(), F.col("id").asc_nulls_last())
    light = rows.join(hot, "digest", "left_anti").withColumns({"keep_id": F.first("id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "group_size": F.count("*").over(group)})
    names = ["id", "keep_id", "group_size", "digest"]
    both = heavy.select(*names).unionByName(light.select(*names))
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged.

    Null, empty and white-space texts are one group; an empty table stays empty; columns may have any names. The row that
    stays is the one of ``label_copies``; of repeated rows with the winning id, one. Rows are told apart by a key of
    their own, so repeated and null ids are decided like any others. Very long texts are compared by their digests.

    Winners of digests that may be frequent are broadcast, and their rows never shuffled; the others' come from an
    ordinary shuffle of short rows.
    """
    row, digest, size = (free_name(docs, x) for x in ("_row", "_digest", "_size"))
    whole = docs.withColumns({digest: F.sha2(normalised(F.col(text_col)), 256), size: F.char_length(F.coalesce(F.col(text_col), F.lit("")))})
    rows = numbered(whole, "rows", row)
    short = rows.select(F.col(row).alias("row"), F.col(digest).alias("digest"), F.col(size).alias("size"), F.col(id_col).alias("id"))
    hot = F.broadcast(written(frequent(short, "digest"), "frequent"))
    # larger first, then the smaller id, null ids last; minima are aggregated map-side
    best = F.min(F.struct(-F.col("size"), F.col("id").isNull(), F.col("id"), F.col("row").alias("row"))).alias("best")

    def winners(of: DataFrame) -> DataFrame:
        return of.groupBy("digest").agg(best).select(F.col("best.row").alias(row))

    named = hot.withColumnRenamed("digest", digest)
    heavy = rows.join(named, digest, "left_semi").join(F.broadcast(winners(short.join(hot, "digest", "left_semi"))), row, "left_semi")
    light = rows.join(named, digest, "left_anti").join(winners(short.join(hot, "digest", "left_anti")), row, "left_semi")
    return heavy.unionByName(light).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       text_sha256
FROM d
"""
