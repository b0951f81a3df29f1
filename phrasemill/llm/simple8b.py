"""Token-id files: Simple-8b words with escapes and block offsets, written and read back by Spark.

A file is a Parquet part whose rows are frames in ascending document order. A frame is self-contained::

    "S8B1" | n_docs u32 | n_ids u64 | n_blocks u32 | n_words u32 | n_escapes u32
    document lengths u32[n_docs] | words of each block u16[n_blocks] | escapes u64[] | words u64[]

Every word has a selector in its upper 4 bits and equally wide ids in the lower 60; selector 0 points to
a value of over 60 bits among the escapes. Blocks hold ``BLOCK`` ids each and begin at a word of their
own, so encoding and decoding run over all blocks of a frame at once. Parquet is the container because
only Spark's writers reach every store and commit each part once, whatever executors are lost.
"""

from __future__ import annotations

import struct
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _arrow as A
from ._bpe import encoder
from ._store import new_path

BLOCK = 256
#: Ids in a word, and bits of each, by selector.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_LIMITS = np.array([1 << int(b) for b in BITS[1:]], np.uint64)
#: The densest selector of each small value.
_SMALL = (1 + np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right")).astype(np.int8)
_HEAD = struct.Struct("<4sIQIII")


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Simple-8b words of the values, the number of words in each block, and the escapes."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    escapes = values[values >> np.uint64(60) != 0]
    wide = np.zeros((blocks, BLOCK + 60), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    escaped = flat >> np.uint64(60) != 0
    flat[escaped] = np.arange(len(escapes), dtype=np.uint64)
    wide[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # the densest selector that a value allows, and whether it is an escape, which has a word of its own
    need = np.zeros((blocks, stride := BLOCK + 60), np.int8)
    dense = _SMALL[np.minimum(flat, np.uint64(len(_SMALL) - 1))]
    large = np.flatnonzero(flat >= np.uint64(len(_SMALL)))
    dense[large] = 1 + np.searchsorted(_LIMITS, flat[large], side="right")
    need[:, :BLOCK] = dense.reshape(blocks, BLOCK)
    need = need.ravel()
    stop = np.zeros((blocks, stride), bool)
    stop[:, :BLOCK] = escaped.reshape(blocks, BLOCK)
    need[stop.ravel()] = 127
    # for every place the densest selector that what follows allows
    best = np.full(len(need), 14, np.int8)
    reach, most = 1, need.copy()
    for s in range(13, 0, -1):
        while reach < COUNTS[s]:
            step = min(reach, int(COUNTS[s]) - reach)
            most[:-step] = np.maximum(most[:-step], most[step:])
            reach += step
        best[most <= s] = s
    best[stop.ravel()] = 0
    # which places begin a word: one step in all blocks at once
    length = np.full(blocks, BLOCK)
    if blocks:
        length[-1] = n - (blocks - 1) * BLOCK
    at = np.arange(blocks) * stride
    ends = at + length
    begins = np.zeros(len(need), bool)
    while len(at):
        begins[at] = True
        at = at + COUNTS[best[at]]
        live = at < ends
        at, ends = at[live], ends[live]
    place = np.flatnonzero(begins)
    selector = best[place]
    source = wide.ravel()
    out = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        word = out[rows]
        for k in range(int(COUNTS[s])):
            word |= source[place[rows] + k] << np.uint64(k * BITS[s])
        out[rows] = word
    return out, np.bincount(place // stride, minlength=blocks), escapes


def unpack(packed: np.ndarray, words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of the words; the inverse of ``pack``."""
    selector = (packed >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(words)), words)
    first = np.cumsum(words) - words
    begin = block * BLOCK + before - before[first][block] if len(words) else before
    end = np.minimum((block + 1) * BLOCK, n)
    values = np.zeros(n, np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            to = begin[rows] + k
            ok = to < end[rows]
            got = (packed[rows[ok]] >> np.uint64(k * BITS[s])) & mask
            values[to[ok]] = escapes[got.astype(np.int64)] if s == 0 else got
    return values


def frame(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    packed, words, escapes = pack(ids)
    return b"".join([_HEAD.pack(b"S8B1", len(lengths), len(ids), len(words), len(packed), len(escapes)), lengths.astype("<u4").tobytes(), words.astype("<u2").tobytes(), escapes.astype("<u8").tobytes(), packed.astype("<u8").tobytes()])


def unframe(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and document lengths of a frame."""
    magic, docs, n, blocks, words, escapes = _HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a frame of ids")
    at, parts = _HEAD.size, []
    for kind, count in (("<u4", docs), ("<u2", blocks), ("<u8", escapes), ("<u8", words)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    lengths, per_block, escaped, packed = parts
    return unpack(packed, per_block.astype(np.int64), escaped, n), lengths.astype(np.int64)


#: Text of a part, about.
PART_BYTES = 256 << 20
SCHEMA = "part int, frame int, before bigint, n_ids bigint, docs array<{}>, payload binary"


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode whole texts, add ``end_id`` to each, and write frames in ascending order of ``id_col``.

    The only shuffle is by ranges of the id and, for repeated ids, of a hash of the text, so that an id that
    many rows share is spread over parts. Null ids come first, rows of one id go by that hash (which leaves
    equal rows alone in any order), null and empty texts have the end id alone, very long texts are a frame
    of their own, an empty table writes no documents, other columns are ignored whatever their names. The
    path must be new.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie")

    def run(batches):
        part, number, before, tool = TaskContext.get().partitionId(), 0, 0, encoder(vocabulary)
        for b in A.chunks(batches, "text"):
            ids, offsets = tool.encode(b.column("text"))
            lengths = np.diff(offsets) + 1
            full = np.full(int(lengths.sum()), end_id, np.uint64)
            keep = np.ones(len(full), bool)
            keep[np.cumsum(lengths) - 1] = False
            full[keep] = ids
            arrays = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(full)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("id")), pa.array([frame(full, lengths)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "frame", "before", "n_ids", "docs", "payload"])
            number, before = number + 1, before + len(full)

    ordered.mapInArrow(run, SCHEMA.format(kind.simpleString())).write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: its id, start (ids before it), n_tokens, ids_crc32, and on
    request the ids. Only the parts' totals are joined in: a row for each part that was written."""
    frames = spark.read.parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    kind = frames.schema["docs"].dataType.elementType
    out = T.StructType([T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        out = out.add("ids", T.ArrayType(T.LongType()))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths = unframe(b.column("payload")[i].as_py())
                begin = np.cumsum(lengths) - lengths
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * x : 4 * (x + n)]) for x, n in zip(begin.tolist(), lengths.tolist(), strict=True)]
                base = b.column("base")[i].as_py() + b.column("before")[i].as_py()
                arrays = [b.column("docs")[i].values, pa.array(begin + base), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, out.names)

    joined = frames.join(F.broadcast(bases), "part").select("base", "before", "docs", "payload")
    return joined.mapInArrow(run, out).withColumnRenamed("id", id_col)


def id_file_digest(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids to the shared folder and describe each document from the files: one row per
    row of ``docs``, with ``id_col``, start, n_tokens, ids_crc32. ``write_ids`` says what becomes of nulls,
    repeated rows, empty tables and clashing names."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, vocabulary, end_id, id_col, text_col)
    return read_ids(docs.sparkSession, path, id_col)
