"""Best-fit packing by minimum bin slack.

Only lengths decide how pieces share sequences, so the counts of each length (at most ``capacity``
numbers, however many documents) are all that the driver sees. For each bin, a dynamic programme over
bitsets of reachable sums finds the fullest combination of lengths that holds the longest piece left; the
combination is taken out as often as the counts allow. The pieces then find their places by their rank
among the pieces of their length, which is found per bucket of rows, so no length gathers in one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _arrow as A
from ._bpe import encoder
from ._store import shuffle_partitions, written

#: Rows that a bucket of the ranking holds about, at most.
BUCKET_ROWS = 200_000


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """Lengths and how often each, of the fullest combination of at most ``room`` from ``counts``."""
    steps, reach, goal = [], 1, 1 << room
    full = (goal << 1) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        before, left, part = reach, min(int(counts[length]), room // length), 1
        while left:  # 1, 2, 4, ... and the rest make every number up to the count
            take = min(part, left)
            reach |= (reach << (take * length)) & full
            left -= take
            part *= 2
        steps.append((length, before))
        if reach & goal:
            break
    at, found = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not (before >> at) & 1:
            at -= length
            found[length] = found.get(length, 0) + 1
    return found


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, each with the number of sequences that hold it."""
    left, found = counts.astype(np.int64).copy(), []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        bin_ = fullest(left, capacity - longest)
        left[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(int(left[n]) // k for n, k in bin_.items())
        for n, k in bin_.items():
            left[n] -= k * times
        found.append((bin_, times))
    return found


def plan(counts: np.ndarray, capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces in a sequence, offset of the first)."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for bin_, times in patterns(counts, capacity):
        offset = 0
        for n in sorted(bin_, reverse=True):
            rows.setdefault(n, []).append((taken.get(n, 0), sequence, bin_[n], offset))
            taken[n] = taken.get(n, 0) + bin_[n] * times
            offset += n * bin_[n]
        sequence += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """Tokenised documents, cut where longer than ``capacity``: the first piece takes the remainder."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        tool = encoder(vocabulary)
        for b in A.chunks(batches, "text"):
            ids, offsets = tool.encode(b.column("text"))
            lengths = np.diff(offsets) + 1
            full = np.full(int(lengths.sum()), end_id, np.uint32)
            keep = np.ones(len(full), bool)
            ends = np.cumsum(lengths)
            keep[ends - 1] = False
            full[keep] = ids
            n = -(-lengths // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            head = lengths - (n - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            size = np.where(piece == 0, head[row], capacity)
            begin = start + (ends - lengths)[row]
            data = memoryview(full.astype("<u4", copy=False).tobytes())
            crc = [zlib.crc32(data[4 * x : 4 * (x + k)]) for x, k in zip(begin.tolist(), size.tolist(), strict=True)]
            arrays = [b.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(full[A.ragged(begin, size)].astype(np.int64))))
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is a piece of the end token alone; a text of more tokens than ``capacity``, however
    long, is cut into pieces of which the first may be shorter. Pieces of one length are interchangeable:
    which of them goes where is arbitrary. Repeated rows are packed each, rows with null ids too. An empty table gives no rows. Other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    # a key for every row, so that repeated rows don't share a bucket
    cut = pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    # at most ``capacity`` rows come to the driver
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        counts[length] = n
    laid = spark.sparkContext.broadcast(plan(counts, capacity))
    buckets = max(4 * shuffle_partitions(spark), math.ceil(int(counts.sum()) / BUCKET_ROWS))
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "row"), F.lit(buckets)).cast("int"))
    per = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = per.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32", "row")
    ranked = bucketed.withColumn("rank", F.row_number().over(order)).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("bucket", "before")
    names = [c for c in cut.columns if c != "row"]
    kind = cut.schema["id"].dataType.simpleString()

    def place(batches):
        rows = laid.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    n = int(length[part[0]])
                    table = rows[n]
                    at = table[np.searchsorted(table[:, 0], rank[part], side="right") - 1]
                    k = rank[part] - at[:, 0]
                    sequence[part] = at[:, 1] + k // at[:, 2]
                    offset[part] = at[:, 3] + k % at[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "rank").mapInArrow(place, schema).withColumnRenamed("id", id_col)
