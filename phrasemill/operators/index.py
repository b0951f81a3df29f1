"""Building an index: sampling, training, assigning, coding, merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import norm
from .mips import nearest


def sample_vectors(vectors: DataFrame, fraction: float = 0.2, replace: bool = True, seed: int = 29, norm_limit: float | None = None, vec_col: str = "vec") -> DataFrame:
    """Vectors to train on, without those longer than ``norm_limit``."""
    out = vectors.sample(withReplacement=replace, fraction=fraction, seed=seed)
    return out if norm_limit is None else out.where(norm(F.col(vec_col)) <= norm_limit)


def mean_std(vectors: DataFrame, vec_col: str = "vec") -> DataFrame:
    """``dim``, mean and population deviation of every dimension."""
    return vectors.select(F.posexplode(vec_col).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def k_means_centres(vectors: DataFrame, clusters: int, seed: int = 29, vec_col: str = "vec", iterations: int = 20) -> np.ndarray:
    """Centres by Spark's k-means, as a matrix: for numbers of clusters that fit on the driver. More come from
    ``lists.train``, where they are rows of a table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if clusters == 1:
        return np.array([[r["mean"] for r in mean_std(vectors, vec_col).orderBy("dim").collect()]])
    rows = vectors.select(array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"))
    return np.array(KMeans(k=clusters, seed=seed, maxIter=iterations).fit(rows).clusterCenters())


def train_centroids(vectors: DataFrame, clusters: int, seed: int = 29, vec_col: str = "vec", iterations: int = 20) -> DataFrame:
    """``cluster_id`` and ``centroid`` by k-means."""
    centres = k_means_centres(vectors, clusters, seed, vec_col, iterations)
    lists = pa.ListArray.from_arrays(np.arange(len(centres) + 1, dtype=np.int32) * centres.shape[1], centres.ravel())
    return vectors.sparkSession.createDataFrame(pa.table({"cluster_id": pa.array(np.arange(len(centres), dtype=np.int32)), "centroid": lists}))


def assign(vectors: DataFrame, centroids: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Vectors with the cluster of the largest inner product, ties to the smaller cluster."""
    return nearest(vectors, centroids, 1, [id_col], vec_col).drop("affinity", "nearness")


def add_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings of two shards as one index."""
    return old.unionByName(new)


def _k_means(x: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres after some rounds, and the nearest centre of every row."""
    c = start.copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c, np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)


def train_codebooks(vectors: DataFrame, parts: int, codes: int = 256, seed: int = 29, vec_col: str = "vec", sample: int = 50_000, rotate: bool = False, turns: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Product-quantiser codebooks (parts, codes, width) and a rotation, from ``sample`` vectors at most, those
    with the smallest hashes.

    With ``rotate`` the rotation begins with the principal axes, dealt to the parts by turns, and is then
    improved ``turns`` times: it is set to the orthogonal matrix that brings the vectors closest to what their
    codes stand for, and the codebooks are trained on.
    """
    rows = vectors.select(vec_col).orderBy(F.xxhash64(vec_col)).limit(sample).toPandas()[vec_col]
    x = np.array([np.asarray(v, float) for v in rows])
    rotation = np.eye(x.shape[1])
    if rotate:
        axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
        rotation = axes[:, np.argsort(np.arange(x.shape[1]) % parts, kind="stable")]
    width, rng = x.shape[1] // parts, np.random.default_rng(seed)
    first = rng.choice(len(x), codes, replace=len(x) < codes)
    books = np.stack([(x @ rotation)[first, p * width : (p + 1) * width] for p in range(parts)])
    for turn in range(turns + 1 if rotate else 1):
        if turn:
            # the rotation of the least distance to the decoded vectors (orthogonal Procrustes)
            u, _, v = np.linalg.svd(x.T @ decoded)
            rotation = u @ v
        y = x @ rotation
        decoded = np.zeros_like(y)
        for p in range(parts):
            at = slice(p * width, (p + 1) * width)
            books[p], near = _k_means(y[:, at], books[p], 4 if turn else 12)
            decoded[:, at] = books[p][near]
    return books, rotation


def pq_encode(vectors: DataFrame, books: np.ndarray, rotation: np.ndarray | None = None, vec_col: str = "vec", code_col: str = "code") -> DataFrame:
    """Vectors with the nearest code of every part."""
    shared = vectors.sparkSession.sparkContext.broadcast((books, rotation))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def code(v: pd.Series) -> pd.Series:
        b, r = shared.value
        x = np.stack(v.to_numpy()).astype(float)
        x = x if r is None else x @ r
        width = b.shape[2]
        out = np.stack([np.argmin((b[p] ** 2).sum(1) - 2 * x[:, p * width : (p + 1) * width] @ b[p].T, axis=1) for p in range(len(b))], axis=1)
        return pd.Series(list(out.astype(np.int32)))

    return vectors.withColumn(code_col, code(F.col(vec_col)))


def pq_decode(coded: DataFrame, books: np.ndarray, code_col: str = "code", out: str = "vec") -> DataFrame:
    """The vectors that codes stand for; a query's product with one is its score from the codes."""
    shared = coded.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def decode(c: pd.Series) -> pd.Series:
        b = shared.value
        codes = np.stack(c.to_numpy())
        return pd.Series(list(b[np.arange(len(b)), codes].reshape(len(codes), -1)))

    return coded.withColumn(out, decode(F.col(code_col)))


def pq_scores(coded: DataFrame, query: list[float], books: np.ndarray, rotation: np.ndarray | None = None, code_col: str = "code", out: str = "score") -> DataFrame:
    """Inner products with a query from a table of its products with all codes."""
    q = np.asarray(query, float) if rotation is None else np.asarray(query, float) @ rotation
    width = books.shape[2]
    table = np.stack([books[p] @ q[p * width : (p + 1) * width] for p in range(len(books))])
    shared = coded.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(T.DoubleType())
    def score(c: pd.Series) -> pd.Series:
        t = shared.value
        codes = np.stack(c.to_numpy())
        return pd.Series(t[np.arange(len(t)), codes].sum(1))

    return coded.withColumn(out, score(F.col(code_col)))


def rotated(vectors: DataFrame, rotation: np.ndarray, vec_col: str = "vec", out: str = "vec") -> DataFrame:
    """Vectors times an orthogonal matrix."""
    shared = vectors.sparkSession.sparkContext.broadcast(rotation)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def turn(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ shared.value))

    return vectors.withColumn(out, turn(F.col(vec_col)))


def index_name(clusters: int, quantiser: str = "OPQ96", kind: str = "flat", first_passage: bool = False, fine_tuned: str = "") -> str:
    """A folder name that tells how an index was built."""
    return f"{clusters}_{kind}_{quantiser}" + "_first" * first_passage + (f"_ft{fine_tuned}" if fine_tuned else "")


def vectors_by_id(wanted: DataFrame, vectors: DataFrame, width: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Every row of ``wanted`` with the vector of its id, zeros where there is none."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return wanted.join(vectors.select(id_col, vec_col), id_col, "left").withColumn(vec_col, F.coalesce(vec_col, zeros))
