"""Documents' metadata in compressed blocks, so that a hit opens one small block and not a row group.

Records are packed by ranges of their id, some tens to a block, as compressed lines of JSON; a second table says which
block holds an id. A point read joins hits to that table and to the blocks that they name, and only these are
decompressed, each once for all of its hits.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records of a block.
RECORDS = 64


def write(records: DataFrame, path: str, id_col: str = "doc_idx", level: int = 6, block_records: int = RECORDS) -> None:
    """Write records (unique ids from 0, any other columns) as ``{path}/blocks`` and ``{path}/places``; written again, they are replaced.
    Records with a null id are left out."""
    fields = [c for c in records.columns if c != id_col]
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))
    rows = rows.withColumn("block", F.expr(f"id div {block_records}"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        data = zlib.compress("\n".join(table.column("line").to_pylist()).encode(), level)
        ids = table.column("id").combine_chunks()
        return pa.table([table.column("block").slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data])], ["block", "ids", "data"])

    packed = rows.groupBy("block").applyInArrow(pack, "block bigint, ids array<bigint>, data binary")
    # sorted by block within its files, small pages: a reader that wants few blocks skips the rest by their bounds
    packed.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path}/blocks")
    blocks = records.sparkSession.read.parquet(f"{path}/blocks")
    blocks.select("block", F.posexplode("ids").alias("place", "id")).write.mode("overwrite").parquet(f"{path}/places")


def read(spark: SparkSession, path: str, hits: DataFrame, schema: str, id_col: str = "doc_idx") -> DataFrame:
    """``hits`` with the fields of ``schema`` of the record of each hit's id; nulls where there is none."""
    places = spark.read.parquet(f"{path}/places").withColumnRenamed("id", id_col)
    asked = hits.select(id_col).distinct().join(places, id_col).groupBy("block").agg(F.collect_list(F.struct("place", F.col(id_col).alias("id"))).alias("wanted"))
    found = spark.read.parquet(f"{path}/blocks").select("block", "data").join(asked, "block")

    def opened(batches):
        for b in batches:
            ids, lines = [], []
            for data, wanted in zip(b.column("data").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                records = zlib.decompress(data).decode().split("\n")
                ids += [w["id"] for w in wanted]
                lines += [records[w["place"]] for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["id", "line"])

    records = found.mapInArrow(opened, "id bigint, line string").select(F.col("id").alias(id_col), F.from_json("line", schema).alias("_r"))
    return hits.join(records, id_col, "left").select(*hits.columns, "_r.*")


def blocks_read(spark: SparkSession, path: str, hits: DataFrame, id_col: str = "doc_idx") -> DataFrame:
    """The numbers of the blocks that a read of ``hits`` opens."""
    places = spark.read.parquet(f"{path}/places").withColumnRenamed("id", id_col)
    return hits.select(id_col).join(places, id_col).select("block").distinct()

