"""Inverted lists under a quantiser of two levels, with codes of residuals scored from tables of products.

Training draws bounded samples: the upper level is trained on the whole sample, the lower one in each upper cell on its
own task, so that a million centroids are rows of a table and never one list on the driver. A vector belongs to the
nearest lower centroid of its nearest upper cell, and is kept with a byte code of what is left. Lists are files by
bucket of cells; a search finds the cells and then the clusters to probe for blocks of queries, reads the buckets that
hold them and no others, and drops rows of other clusters before they reach Python. A code's score is the product
of query and centroid plus an entry of the query's table for every part: codes are never decoded.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import manifest
from . import index
from .mips import BUCKETS, ROW_BLOCK, Best, _matrix, pruned_top_k, query_blocks, ranked

#: Rows that a cell is trained on for each of its clusters, rows of a block that is assigned at once.
TRAIN_ROWS, ASSIGN_ROWS = 64, 20_000
#: Numbers of the tables of products of a block of queries, and postings that are scored at once.
TABLE_NUMBERS, POSTING_BLOCK = 1 << 24, 4096
#: Vectors that a task reads before it drops those that are no longer among the best.
HELD = 1 << 16

POSTINGS = "id bigint, cell int, cluster_id bigint, code binary, vec array<double>, bucket int"


@dataclass
class Lists:
    """An index on disk: its cells (cell, centroid), clusters (cell, cluster_id, centroid) and codebooks (parts, codes, width)."""

    spark: SparkSession
    path: str

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def clusters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/clusters")

    @property
    def books(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/books").orderBy("part").collect()
        return np.stack([np.array(r["values"], float).reshape(r["codes"], -1) for r in rows])

    @property
    def postings(self) -> DataFrame:
        return manifest.read(self.spark, self.path, POSTINGS)


def arrays(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], np.ascontiguousarray(matrix, dtype=np.float64).ravel())


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row the nearest centre, the first of equal ones, in blocks of rows."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 1024] @ centres.T - half, axis=1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def in_cells(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """Vectors (id, vec) with the ``cell`` of the nearest centroid; cells are at most some thousands."""
    _, matrix = next(query_blocks(cells.orderBy("cell"), "cell", "centroid", 1 << 16))
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(_nearest(_matrix(b.column("vec")), shared.value).astype(np.int32)))

    return vectors.mapInArrow(run, "id bigint, vec array<double>, cell int")


def plain(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.where("id IS NOT NULL AND vec IS NOT NULL")


def train(vectors: DataFrame, path: str, cells: int, clusters: int, parts: int, codes: int = 256, seed: int = 29) -> Lists:
    """Train ``cells`` upper and up to ``clusters`` lower centroids in each, and codebooks of residuals, and write them.

    Samples are bounded: about ``TRAIN_ROWS`` rows for every cell, and for every cluster of a cell, drawn by a hash of the
    id. A cell with fewer rows than clusters has a cluster for each row."""
    if not 1 <= codes <= 256:
        raise ValueError("a code is a byte")
    spark, rows = vectors.sparkSession, plain(vectors)
    total = rows.count()

    def drawn(df, share):
        return df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < (F.lit(1 << 30) * share))

    centres = index.k_means_centres(drawn(rows, min(1.0, TRAIN_ROWS * cells / max(total, 1))), cells, seed)
    upper = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(centres), dtype=np.int32)), "centroid": arrays(centres)}))
    upper.write.mode("overwrite").parquet(f"{path}/cells")
    out = Lists(spark, path)
    dealt = in_cells(rows, out.cells)
    share = F.least(F.lit(1.0), F.lit(float(TRAIN_ROWS * clusters)) / F.col("rows"))
    counts = dealt.groupBy("cell").agg(F.count("*").alias("rows")).select("cell", share.alias("share"))
    sample = drawn(dealt.join(F.broadcast(counts), "cell"), F.col("share")).select("id", "cell", "vec")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _matrix(table.column("vec").combine_chunks())
        k = min(clusters, len(x))
        start = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
        c = index._k_means(x, start, 10)[0]
        cell = table.column("cell")[0].as_py()
        return pa.table({"cell": pa.array(np.full(k, cell, np.int32)), "cluster_id": pa.array(cell * clusters + np.arange(k)), "centroid": arrays(c)})

    sample.groupBy("cell").applyInArrow(one, "cell int, cluster_id bigint, centroid array<double>").write.mode("overwrite").parquet(f"{path}/clusters")
    some = drawn(rows, min(1.0, 50_000 / max(total, 1)))
    left = _assigned(some, out).withColumn("vec", F.zip_with("vec", "centroid", lambda a, b: a - b))
    books, _ = index.train_codebooks(left, parts, min(codes, max(1, total)), seed)
    table = pa.table({"part": pa.array(range(parts)), "codes": pa.array([books.shape[1]] * parts), "values": arrays(books.reshape(parts, -1))})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/books")
    return out


def _assigned(rows: DataFrame, lists: Lists) -> DataFrame:
    """Vectors (id, vec) with ``cell``, ``cluster_id`` and that cluster's ``centroid``: blocks of a cell's rows meet its clusters."""
    dealt = in_cells(rows, lists.cells)
    counts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / ASSIGN_ROWS).cast("int").alias("blocks"))
    # a row for each cell
    dealt = dealt.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    clusters = lists.clusters.join(counts, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("cluster_id")
        names = ["id", "vec", "cell", "cluster_id", "centroid"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int64(), pa.list_(pa.float64()))], names)
        c = _matrix(right.column("centroid").combine_chunks())
        at = _nearest(_matrix(left.column("vec").combine_chunks()), c)
        return pa.table([left.column("id"), left.column("vec"), left.column("cell"), right.column("cluster_id").take(pa.array(at)), arrays(c[at])], names)

    left = dealt.select("id", "vec", "cell", "block").groupBy("cell", "block")
    right = clusters.select("cluster_id", "centroid", "cell", "block").groupBy("cell", "block")
    return left.cogroup(right).applyInArrow(one, "id bigint, vec array<double>, cell int, cluster_id bigint, centroid array<double>")


def add(vectors: DataFrame, lists: Lists, shard: str) -> None:
    """Put vectors of unique ids from 0 into lists as a shard; a shard that is added again replaces itself."""
    shared = lists.spark.sparkContext.broadcast(lists.books)

    def run(batches):
        books = shared.value
        parts, _, width = books.shape
        for b in batches:
            if not b.num_rows:
                continue
            left = _matrix(b.column("vec")) - _matrix(b.column("centroid"))
            code = np.stack([_nearest(left[:, p * width : (p + 1) * width], books[p]) for p in range(parts)], axis=1).astype(np.uint8)
            bucket = pa.array((b.column("cell").to_numpy(zero_copy_only=False) % BUCKETS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cell"), b.column("cluster_id"), pa.array([c.tobytes() for c in code], pa.binary()), b.column("vec"), bucket], ["id", "cell", "cluster_id", "code", "vec", "bucket"])

    manifest.add(lists.spark, lists.path, shard, _assigned(plain(vectors), lists).mapInArrow(run, POSTINGS), "bucket")


def probes(lists: Lists, queries: DataFrame, cells: int, clusters: int) -> DataFrame:
    """``qid``, ``cluster_id``, ``cell`` and ``base`` (its product with the query) of the best clusters of each query's best cells."""
    upper = lists.cells.select(F.col("cell").alias("cluster_id"), "centroid")
    lower = lists.clusters.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vec"), F.col("cell").alias("cluster_id"))
    best = pruned_top_k(lower, upper, queries, clusters, cells)
    return best.select("qid", F.col("id").alias("cluster_id"), F.col("score").alias("base")).join(lists.clusters.select("cluster_id", "cell"), "cluster_id")


def _only(held: list, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks of (ids, vectors) the rows of some ids, in order."""
    key, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
    key, at = np.unique(key, return_index=True)
    some = np.isin(key, ids)
    return key[some], vectors[at[some]]


def search(lists: Lists, queries: DataFrame, k: int, cells: int, clusters: int, rescore: int = 0) -> DataFrame:
    """``qid``, ``id``, ``score``, ``rank``: the best ``k`` by their codes in the probed clusters, ties by id; with ``rescore`` so many
    are ranked by their exact products. ``queries``: qid, qvec."""
    books = lists.books
    parts, codes, width = books.shape
    kind = queries.schema["qid"].dataType.simpleString()
    spark, found = lists.spark, []
    fetch = max(k, rescore)
    for ids, matrix in query_blocks(queries, "qid", "qvec", max(1, min(4096, TABLE_NUMBERS // (parts * codes)))):
        asked = spark.createDataFrame(pa.table({"qid": pa.array(range(len(ids)), pa.int64()), "qvec": arrays(matrix)}))
        # a block of queries times ``clusters`` rows
        near = probes(lists, asked, cells, clusters).toArrow()
        cluster, which = near.column("cluster_id").to_numpy(), near.column("qid").to_numpy()
        names = np.unique(cluster)
        base = np.full((len(ids), len(names)), -np.inf)
        base[which, np.searchsorted(names, cluster)] = near.column("base").to_numpy()
        buckets = sorted({int(c) % BUCKETS for c in np.unique(near.column("cell").to_numpy())})
        wanted = spark.createDataFrame(pa.table({"cluster_id": pa.array(names)}))
        # folders are pruned by the literal buckets, rows by the semi-join; the list is bounded by the block
        rows = lists.postings.where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted), "cluster_id", "left_semi").select("id", "cluster_id", "code", *["vec"] * bool(rescore))
        shared = spark.sparkContext.broadcast((pa.array(ids), matrix, names, base, books))

        def run(batches, shared=shared):
            qids, block, names, base, books = shared.value
            parts, codes, width = books.shape
            best = Best(len(block), fetch)
            # rows that may still be among the best, if their vectors are needed
            held, count = [], 0
            for whole in batches:
                for at in range(0, whole.num_rows, POSTING_BLOCK):
                    b = whole.slice(at, POSTING_BLOCK)
                    key = b.column("id").to_numpy(zero_copy_only=False)
                    by_id = np.argsort(key, kind="stable")
                    key = key[by_id]
                    code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, parts)[by_id].T.astype(np.intp)
                    cluster = np.searchsorted(names, b.column("cluster_id").to_numpy(zero_copy_only=False)[by_id])
                    near = [(c, np.flatnonzero(cluster == c)) for c in np.unique(cluster)]
                    # some queries at a time, so that scores and tables of a task are bounded whatever the block
                    for first in range(0, len(block), ROW_BLOCK):
                        some = slice(first, first + ROW_BLOCK)
                        asked = [(c, mine, np.flatnonzero(base[some, c] > -np.inf)) for c, mine in near]
                        table = [block[some, p * width : (p + 1) * width] @ books[p].T for p in range(parts)] if any(len(who) for *_, who in asked) else []
                        for c, mine, who in asked:
                            if not len(who):
                                continue
                            total = np.repeat(base[some][who, c][:, None], len(mine), 1)
                            for p in range(parts):
                                total += table[p][who].take(code[p, mine], axis=1)
                            best.add(who + first, total, key[mine])
                    if rescore:
                        held.append((key, _matrix(b.column("vec"))[by_id]))
                        count += len(key)
                        if count > HELD:
                            best.settle()
                            held, count = [_only(held, best.id)], 0
            if not rescore:
                yield from best.batches(qids)
                return
            best.settle()
            if held:
                key, vectors = _only(held, best.id)
                at = np.searchsorted(key, best.id)
                for low in range(0, len(at), 1 << 14):
                    to = slice(low, low + (1 << 14))
                    exact = np.einsum("ij,ij->i", vectors[at[to]], block[best.row[to]])
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(best.row[to])), *map(pa.array, (best.id[to], best.score[to], exact))], ["qid", "id", "score", "exact"])

        if rescore:
            # exact products come with the codes' scores from where the vectors are read
            best = ranked(rows.mapInArrow(run, f"qid {kind}, id bigint, score double, exact double"), fetch)
            found.append(ranked(best.select("qid", "id", F.col("exact").alias("score")), k))
        else:
            found.append(ranked(rows.mapInArrow(run, f"qid {kind}, id bigint, score double"), fetch))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"qid {kind}, id bigint, score double, rank int")

