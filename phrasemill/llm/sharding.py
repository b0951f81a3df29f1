"""Proportional stratified interleaving: shards that each match the mixture of sources.

Rows are shuffled by a seeded hash and ranked within their source; the rank less an offset of the source,
as a fraction of the source, puts all sources on one scale, and equal cuts of the rows in that order give
every shard its share of each source. Offsets of the sources, taken by size in a seeded order, are multiples of the
golden ratio without their whole part: they spread evenly, so that many small sources together match the
mixture as one large source does. All orders are found per bucket (of a hash, or of the fraction) with
counts of the buckets before, so neither a hot source nor the whole table is ever sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import shuffle_partitions, written

#: Rows that a bucket holds about, at most.
BUCKET_ROWS = 200_000
_GOLDEN = (math.sqrt(5) - 1) / 2


def _offsets(sources: DataFrame, seed: int, total: int) -> DataFrame:
    """``source`` and its ``offset`` in (0, 1), from its number in an order of all sources by size, then
    seeded. ``sources`` has source and n."""
    buckets = max(1, math.ceil(total / BUCKET_ROWS))
    at = sources.select("source", "n", F.xxhash64(F.lit(seed), "source").alias("h"))
    at = at.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    # distinct sizes are few, as their sum is the number of rows
    before = at.groupBy("n", "bucket").agg(F.count("*").alias("k"))
    before = before.select("n", "bucket", (F.sum("k").over(Window.orderBy("n", "bucket")) - F.col("k")).alias("before"))
    number = F.row_number().over(Window.partitionBy("n", "bucket").orderBy("h", "source"))
    at = at.withColumn("rank", number).join(before, ["n", "bucket"])
    number = F.col("rank") + F.col("before")
    turn = at.withColumn("turn", number * F.lit(_GOLDEN))
    return turn.select("source", (F.col("turn") - F.floor("turn")).alias("offset"))


def interleave(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, size, text_crc32, law ('rows'), shard, slot, grown_shard.

    Law 'rows': counts of any two shards differ by one at most, so ``grown_shard`` is null. Each source
    is spread so that its rows in a shard differ from its share by few, and so are all small sources
    together. Null sources are one source; a null text has size 8 and the checksum of no bytes; a very long
    text counts as one row; repeated rows are placed each (ties are broken by the checksum and then
    arbitrary, between rows that are equal in all that counts). Copies are not kept together: a group of a
    third of all rows would break the law. An empty table gives no rows; other columns are ignored whatever
    their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null")).alias("source"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    # rows without an id are told apart by a key of their own, so that they don't share a bucket
    rows = rows.withColumn("row", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    rows = written(rows.withColumn("draw", F.xxhash64(F.lit(seed), "id", "text_crc32", "row")).drop("row"), "shard-rows")
    total = rows.count()
    buckets = max(4 * shuffle_partitions(spark), math.ceil(total / BUCKET_ROWS))
    # a bucket is a range of the hash, so ranks go on from one bucket to the next
    drawn = rows.withColumn("bucket", F.least(F.floor((F.col("draw").cast("double") / 2.0**64 + 0.5) * buckets), F.lit(buckets - 1)).cast("int"))
    per = drawn.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    of_source = Window.partitionBy("source")
    offsets = _offsets(per.groupBy("source").agg(F.sum("n").alias("n")), seed, total)
    per = per.select("source", "bucket", (F.sum("n").over(of_source.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(of_source).alias("of_source"))
    order = Window.partitionBy("source", "bucket").orderBy("draw", "id", "text_crc32")
    ranked = drawn.withColumn("rank", F.row_number().over(order)).join(per.join(offsets, "source"), ["source", "bucket"])
    share = ranked.withColumn("share", (F.col("rank") + F.col("before") - F.col("offset")) / F.col("of_source"))
    placed = share.select("id", "source", "size", "text_crc32", "draw", "share", F.least(F.floor(F.col("share") * buckets), F.lit(buckets - 1)).cast("int").alias("bucket"))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    # one row per bucket, of which there is one per BUCKET_ROWS rows
    counts = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("bucket").orderBy("share", "source", "draw", "id", "text_crc32")
    at = placed.withColumn("rank", F.row_number().over(order)).join(F.broadcast(counts), "bucket").withColumn("at", F.col("before") + F.col("rank") - 1)
    # shard s begins at place ceil(s * total / shards)
    return at.withColumn("shard", F.expr(f"cast((at * {shards}L) div {max(total, 1)}L as int)")).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"at - (cast(shard as bigint) * {total}L + {shards - 1}L) div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.when(F.col("source") != "\x00null", F.col("source")).alias("source"))
