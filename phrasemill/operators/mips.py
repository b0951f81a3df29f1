"""Maximum inner product search: exact in blocks, and pruned by clusters.

Queries are the small side. They are broadcast in blocks of ``QUERY_BLOCK`` rows, so what is broadcast is
bounded; batches of vectors are multiplied with a block at once, and a task keeps its best ``k`` for every query (a
pruned search: each batch its own), so that only these reach the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.vectors import dot

QUERY_BLOCK = 4096
#: Centroids that are broadcast at once, and rows that are multiplied with them at once.
CENTROID_BLOCK, ROW_BLOCK = 65_536, 256
#: Vectors that are multiplied with a block of queries at once.
VECTOR_BLOCK = 1024
#: Stands for a null among ids, and before all others as a null does.
NO_ID = -(1 << 63)
#: Folders that postings on disk are dealt to by the number of their cluster.
BUCKETS = 256


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def best_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best ``k`` scores of each row, ties to the first columns, without those that are minus
    infinity. Rows are never sorted."""
    good = score > -np.inf
    if score.shape[1] > k:
        bar = np.partition(score, -k, axis=1)[:, -k][:, None]
        above, level = score > bar, score == bar
        good &= above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1)[:, None]))
    # in one dimension this takes a fraction of the time
    return np.divmod(np.flatnonzero(good), score.shape[1])


class Best:
    """The best ``k`` of each row from blocks of scores, ties to the smaller id. It holds at most some ``k`` for each row. With
    ``digits`` scores are compared as rounded to so many."""

    def __init__(self, rows: int, k: int, digits: int | None = None):
        self.k, self.bar, self.digits = k, np.full(rows, -np.inf), digits
        self.row, self.id, self.shown, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.new, self.count = [], 0

    def add(self, rows: int | np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of ``rows``, or of those from a number on, with ``ids``, which ascend."""
        rows = np.arange(rows, rows + len(score)) if isinstance(rows, int) else rows
        bar = self.bar[rows]
        # an equal score may have a smaller id
        good = score >= np.maximum(bar if self.digits is None else bar - 10.0**-self.digits, np.finfo(float).min)[:, None]
        row, column = np.divmod(np.flatnonzero(good), score.shape[1])
        if len(row) > 2 * self.k * len(score):
            row, column = best_of(score if self.digits is None else np.round(score, self.digits), self.k)
        found = score[row, column]
        shown = found if self.digits is None else np.round(found, self.digits)
        good = shown >= bar[row]
        self.new.append((rows[row[good]], ids[column[good]], shown[good], found[good]))
        self.count += int(good.sum())
        if self.count > max(1 << 14, len(self.row)):
            self.settle()

    def settle(self) -> None:
        row, key, shown, score = (np.concatenate(c) for c in zip((self.row, self.id, self.shown, self.score), *self.new, strict=True))
        order = np.lexsort((key, -shown, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order, row = order[place < self.k], row[place < self.k]
        self.row, self.id, self.shown, self.score = row, key[order], shown[order], score[order]
        full = place[place < self.k] == self.k - 1
        self.bar[row[full]] = self.shown[full]
        self.new, self.count = [], 0

    def batches(self, names: pa.Array):
        """``qid``, ``id``, ``score`` of what is left, in batches."""
        self.settle()
        for at in range(0, len(self.row), 1 << 16):
            to = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(self.row[to])), pa.array(self.id[to]), pa.array(self.score[to])], ["qid", "id", "score"])


def query_blocks(queries: DataFrame, qid: str, vec: str, block: int = QUERY_BLOCK):
    """Blocks of (ids, matrix); only one is on the driver at a time."""
    ids, rows = [], []
    for q, v in queries.select(qid, vec).toLocalIterator():
        ids.append(q)
        rows.append(v)
        if len(ids) == block:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def ranked(hits: DataFrame, k: int, by: str = "qid", score: str = "score", ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The best ``k`` rows of each query with their rank from 1."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), *ties)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """``qid``, ``id``, score, rank: the ``k`` largest inner products of each query, ties by id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    kind = queries.schema[qid].dataType.simpleString()
    found = []
    for ids, matrix in query_blocks(queries, qid, qvec):
        shared = spark.sparkContext.broadcast((pa.array(ids), matrix))

        def run(batches, shared=shared):
            names, block = shared.value
            best = Best(len(block), k)
            for whole in batches:
                for low in range(0, whole.num_rows, VECTOR_BLOCK):
                    b = whole.slice(low, VECTOR_BLOCK)
                    key = pc.fill_null(b.column("id"), NO_ID).to_numpy(zero_copy_only=False)
                    by_id = np.argsort(key, kind="stable")
                    key, vectors = key[by_id], _matrix(b.column("vec"))[by_id].T
                    for at in range(0, len(block), ROW_BLOCK):
                        best.add(at, block[at : at + ROW_BLOCK] @ vectors, key)
            yield from best.batches(names)

        found.append(rows.mapInArrow(run, f"qid {kind}, id bigint, score double").withColumn("id", F.nullif("id", F.lit(NO_ID))))
    if not found:
        return vectors.sparkSession.createDataFrame([], f"qid {kind}, id bigint, score double, rank int")
    return ranked(reduce(DataFrame.unionByName, found), k)


def nearest(rows: DataFrame, centroids: DataFrame, n: int, key: list[str], vec: str, cid: str = "cluster_id", cvec: str = "centroid") -> DataFrame:
    """``rows`` with the ``n`` centroids of the largest inner product with each, its ``affinity`` and
    ``nearness`` from 1; ties by the centroid's id.

    Centroids come in blocks of ``CENTROID_BLOCK``, so what is broadcast is bounded whatever their number;
    batches of rows are multiplied with a block at once. One block needs no shuffle; of several, the best of
    each are ranked by ``key``."""
    spark = rows.sparkSession
    names = rows.columns
    kind = centroids.schema[cid].dataType
    schema = T.StructType([*rows.schema.fields]).add(cid, kind).add("affinity", T.DoubleType()).add("nearness", T.IntegerType())
    found = []
    for ids, matrix in query_blocks(centroids.orderBy(cid), cid, cvec, CENTROID_BLOCK):
        shared = spark.sparkContext.broadcast((pa.array(ids, to_arrow_type(kind)), matrix))

        def run(batches, shared=shared):
            ids, block = shared.value
            for b in batches:
                for at in range(0, b.num_rows, ROW_BLOCK):
                    part = b.slice(at, ROW_BLOCK)
                    score = _matrix(part.column(vec)) @ block.T
                    k = min(n, len(ids))
                    if k < len(ids):
                        # the k-th best score and all that tie with it, so that ties go by id
                        bar = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                        score = np.where(score >= bar, score, -np.inf)
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(part.num_rows), k)
                    columns = [c.take(pa.array(row)) for c in part.columns]
                    yield pa.RecordBatch.from_arrays([*columns, ids.take(pa.array(best.ravel())), pa.array(score[row, best.ravel()]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows))], schema.names)

        found.append(rows.mapInArrow(run, schema))
    if len(found) == 1:
        return found[0]
    if not found:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy(*key).orderBy(F.col("affinity").desc(), cid)
    return reduce(DataFrame.unionByName, found).withColumn("nearness", F.row_number().over(order)).where(F.col("nearness") <= n).select(*names, cid, "affinity", "nearness")


def pruned_top_k(postings: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, probes: int, id_col: str = "id", vec_col: str = "vec", qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """Search only the ``probes`` nearest clusters: queries in blocks as in ``exact_top_k``, each batch of
    postings multiplied cluster by cluster with the queries that probe it, so that no pair of query and
    posting becomes a row. What is broadcast is a block of queries and the numbers of their clusters. Where postings
    have a column ``bucket`` (the cluster modulo ``BUCKETS``) by which folders are named, only those of probed clusters
    are read; postings of other clusters never reach Python."""
    spark = postings.sparkSession
    wanted = [F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.col("cluster_id").cast("bigint").alias("cluster_id")]
    kind = queries.schema[qid].dataType.simpleString()
    found = []
    for ids, matrix in query_blocks(queries, qid, qvec):
        # the queries' own clusters: at most a block of queries times ``probes`` numbers
        asked = spark.createDataFrame(pa.table({"q": pa.array(range(len(ids)), pa.int64()), "v": pa.array(matrix.tolist(), pa.list_(pa.float64()))}))
        near = nearest(asked, centroids, probes, ["q"], "v").select("q", "cluster_id").collect()
        names = np.unique(np.array([r[1] for r in near], np.int64))
        probed = np.zeros((len(ids), len(names)), bool)
        probed[[r[0] for r in near], np.searchsorted(names, [r[1] for r in near])] = True
        shared = spark.sparkContext.broadcast((pa.array(ids), matrix, names, probed))
        rows = postings
        if "bucket" in postings.columns:
            rows = rows.where(F.col("bucket").isin(np.unique(names % BUCKETS).tolist()))
        rows = rows.select(*wanted).join(F.broadcast(spark.createDataFrame(pa.table({"cluster_id": pa.array(names)}))), "cluster_id", "left_semi").select("id", "vec", "cluster_id")

        def run(batches, shared=shared):
            qids, block, names, probed = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                key = b.column("id").to_numpy(zero_copy_only=False)
                by_id = np.argsort(key, kind="stable")
                key, vectors = key[by_id], _matrix(b.column("vec"))[by_id]
                cluster = np.searchsorted(names, b.column("cluster_id").to_numpy(zero_copy_only=False)[by_id])
                for first in range(0, len(block), ROW_BLOCK):
                    some = slice(first, first + ROW_BLOCK)
                    score = np.full((len(block[some]), len(key)), -np.inf)
                    for c in np.unique(cluster):
                        at, asked = np.flatnonzero(cluster == c), np.flatnonzero(probed[some, c])
                        score[np.ix_(asked, at)] = block[some][asked] @ vectors[at].T
                    row, column = best_of(score, k)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(row + first)), pa.array(key[column]), pa.array(score[row, column])], ["qid", "id", "score"])

        found.append(rows.mapInArrow(run, f"qid {kind}, id bigint, score double"))
    if not found:
        return spark.createDataFrame([], f"qid {kind}, id bigint, score double, rank int")
    return ranked(reduce(DataFrame.unionByName, found), k)


def rescored(hits: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of approximate hits (``qid``, ``id``) by their exact inner products."""
    pairs = hits.select("qid", "id").join(vectors.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
    return ranked(pairs.select("qid", "id", dot(F.col("vec"), F.col("qvec")).alias("score")), k)
