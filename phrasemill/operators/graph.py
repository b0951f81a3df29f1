"""Navigable small-world graphs of vectors, one for each shard, searched best-first for inner products.

Vectors are dealt to shards of at most about ``SHARD_ROWS`` by a hash of their id, so a shard's vectors fit into a
task whatever the table's size. A shard's graph links every vector with near ones in different directions and with
a few drawn at random; it is a table (shard, at, id, vec, links) on disk. A search walks all shards in their tasks,
for blocks of queries at once: every step expands the best vector of each query's list that wasn't expanded yet,
until the ``breadth`` best that are known have all been. Only ``k`` rows for each query and shard reach the shuffle.

Lengths may differ: graphs are built over vectors with one more coordinate that makes all of them equally long, by
which the nearest are those of the largest inner product.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mips import _matrix, query_blocks, ranked

#: Vectors of a shard, queries that walk a shard at once, links to near vectors and to any, where walks begin.
SHARD_ROWS, WALKERS, NEAR, FAR, STARTS = 4096, 256, 8, 1, 8


def even(x: np.ndarray) -> np.ndarray:
    """The vectors, one coordinate wider and all as long as the longest."""
    square = (x**2).sum(1)
    return np.column_stack([x, np.sqrt(np.maximum(square.max() - square, 0))])


def links_of(x: np.ndarray, seed: int) -> np.ndarray:
    """Neighbours of each of some equally long vectors, in columns, -1 for none.

    Of a vector's nearest those are linked that are nearer to it than to all nearer ones that are linked already,
    then the nearest others; links are made both ways as far as there is room, and a few lead anywhere."""
    n = len(x)
    pool, near = min(3 * NEAR, n - 1), min(NEAR, n - 1)
    if n == 1:
        return np.full((1, 1), -1, np.int32)
    nearest, score = np.empty((n, pool), np.int64), np.empty((n, pool))
    for at in range(0, n, 512):
        product = x[at : at + 512] @ x.T
        product[np.arange(len(product)), np.arange(at, at + len(product))] = -np.inf
        part = np.argpartition(-product, pool - 1, axis=1)[:, :pool]
        found = np.take_along_axis(product, part, 1)
        order = np.argsort(-found, axis=1, kind="stable")
        nearest[at : at + 512], score[at : at + 512] = np.take_along_axis(part, order, 1), np.take_along_axis(found, order, 1)
    apart, count = np.zeros((n, pool), bool), np.zeros(n, int)
    for j in range(pool):
        closer = np.full(n, -np.inf)
        for i in range(j):
            rows = np.flatnonzero(apart[:, i])
            closer[rows] = np.maximum(closer[rows], np.einsum("nd,nd->n", x[nearest[rows, i]], x[nearest[rows, j]]))
        apart[:, j] = (closer < score[:, j]) & (count < near)
        count += apart[:, j]
    # those apart first, then by nearness
    first = np.argsort(~apart, axis=1, kind="stable")[:, :near]
    chosen = np.take_along_axis(nearest, first, 1)
    out = np.full((n, 2 * near + FAR), -1, np.int32)
    out[:, :near] = chosen
    source, target = np.repeat(np.arange(n), near), chosen.ravel()
    new = ~(chosen[target] == source[:, None]).any(1)
    source, target = source[new], target[new]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    room = place < near
    out[target[room], near + place[room]] = source[room]
    out[:, 2 * near :] = np.random.default_rng(seed).integers(0, n, (n, FAR))
    return out


def walk(x: np.ndarray, links: np.ndarray, queries: np.ndarray, k: int, breadth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the places and products of the best ``k`` that a walk over the graph finds, and how many
    products it took; -1 where there are fewer."""
    n, q = len(x), len(queries)
    breadth = min(max(breadth, k), n)
    starts = np.unique(np.linspace(0, n - 1, min(STARTS, n)).astype(np.int64))
    seen = np.zeros((q, n), bool)
    seen[:, starts] = True
    place = np.full((q, breadth), -1, np.int64)
    score = np.full((q, breadth), -np.inf)
    done = np.zeros((q, breadth), bool)

    def merge(rows, more, products):
        p, s = np.hstack([place[rows], more]), np.hstack([score[rows], products])
        d = np.hstack([done[rows], np.zeros(more.shape, bool)])
        best = np.argsort(-s, axis=1, kind="stable")[:, :breadth]
        place[rows], score[rows], done[rows] = (np.take_along_axis(v, best, 1) for v in (p, s, d))

    everyone = np.arange(q)
    merge(everyone, np.tile(starts, (q, 1)), queries @ x[starts].T)
    while True:
        open_ = (place >= 0) & ~done & (score > -np.inf)
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            break
        at = open_[rows].argmax(1)  # lists are in order: the first open one is the best
        done[rows, at] = True
        near = links[place[rows, at]].astype(np.int64)
        fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
        # a vector that is linked twice is fresh once
        order = np.argsort(near, axis=1, kind="stable")
        ordered = np.take_along_axis(near, order, 1)
        twice = np.zeros(near.shape, bool)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        fresh &= ~twice
        r, c = np.nonzero(fresh)
        seen[rows[r], near[r, c]] = True
        products = np.full(near.shape, -np.inf)
        products[r, c] = np.einsum("nd,nd->n", x[near[r, c]], queries[rows[r]])
        merge(rows, np.where(fresh, near, -1), products)
    return place[:, :k], score[:, :k], seen.sum(1)


def build(vectors: DataFrame, path: str, shards: int | None = None, seed: int = 29, id_col: str = "id", vec_col: str = "vec") -> None:
    """Write the graphs of vectors of unique ids; rows with a null id or vector are left out."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    shards = shards or max(1, -(-rows.count() // SHARD_ROWS))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _matrix(table.column("vec").combine_chunks())
        links = links_of(even(x), seed)
        lists = pa.ListArray.from_arrays(np.arange(len(links) + 1, dtype=np.int32) * links.shape[1], links.ravel())
        return pa.table([table.column("shard"), pa.array(np.arange(len(x), dtype=np.int32)), table.column("id"), table.column("vec"), lists], ["shard", "at", "id", "vec", "links"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int"))
    dealt.groupBy("shard").applyInArrow(one, "shard int, at int, id bigint, vec array<double>, links array<int>").write.mode("overwrite").parquet(path)


def walked(graphs: DataFrame, queries: DataFrame, k: int, breadth: int = 64, qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """``qid``, ``shard``, ``products`` (how many were computed) and ``hits``, an array of (id, score), for each query and shard."""
    spark = graphs.sparkSession
    kind = queries.schema[qid].dataType.simpleString()
    schema = f"qid {kind}, shard int, products bigint, hits array<struct<id:bigint,score:double>>"
    rows = graphs.select("shard", "at", "id", "vec", "links")

    def walker(shared):
        def one(table: pa.Table) -> pa.Table:
            names, block = shared.value
            table = table.sort_by("at")
            x, key = _matrix(table.column("vec").combine_chunks()), table.column("id").to_numpy()
            links = table.column("links").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            hits, products = [], []
            for at in range(0, len(block), WALKERS):
                place, score, many = walk(x, links, block[at : at + WALKERS], k, breadth)
                products.append(many)
                hits += [[{"id": int(key[p]), "score": float(s)} for p, s in zip(ps, ss, strict=True) if p >= 0] for ps, ss in zip(place, score, strict=True)]
            shard = pa.array(np.full(len(names), table.column("shard")[0].as_py(), np.int32))
            return pa.table([names, shard, pa.array(np.concatenate(products)), pa.array(hits, pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())])))], ["qid", "shard", "products", "hits"])

        return one

    found = [rows.groupBy("shard").applyInArrow(walker(spark.sparkContext.broadcast((pa.array(ids), matrix))), schema) for ids, matrix in query_blocks(queries, qid, qvec)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def graph_top_k(graphs: DataFrame, queries: DataFrame, k: int, breadth: int = 64, qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """``qid``, ``id``, ``score``, ``rank``: the ``k`` largest inner products of each query that walks find, ties by id."""
    hits = walked(graphs, queries, k, breadth, qid, qvec).select("qid", F.explode("hits").alias("h"))
    return ranked(hits.select("qid", "h.id", "h.score"), k)
