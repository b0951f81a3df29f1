"""The engine's jobs from files to files: writing phrases and filters, building and merging indexes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, lists, mips, phrases
from .options import IndexOptions
from .sources import manifest, writers

#: Turns documents from windows (doc_idx, tokens) into tokens (doc_idx, word_idx, fs, fe, vec).
TokenEncoder = Callable[[DataFrame], DataFrame]


def write_phrases(windows: DataFrame, encode: TokenEncoder, path: str, threshold: float, mode: str = "overwrite") -> None:
    """Put documents together from their windows, encode their tokens, keep those that may begin or end a
    phrase, and write them by document."""
    kept = phrases.filtered(encode(phrases.assemble(windows)), threshold)
    writers.phrase_dump(kept, path, mode)


def write_filter(windows: DataFrame, encode: TokenEncoder, path: str) -> None:
    """Write the filter scores of all tokens alone, so that thresholds can be chosen later."""
    writers.phrase_dump(encode(phrases.assemble(windows)).select("doc_idx", "word_idx", "fs", "fe"), path)


def filtered_dump(tokens: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """A dump of all tokens (doc_idx, word_idx, vec) cut by the scores of another."""
    joined = tokens.join(scores.select("doc_idx", "word_idx", "fs", "fe"), ["doc_idx", "word_idx"])
    return phrases.filtered(joined, threshold)


def light_copy(dump: DataFrame, path: str, without: tuple[str, ...] = ("vec",)) -> None:
    """A dump without its heavy columns."""
    writers.phrase_dump(dump.drop(*without, "doc_shard"), path)


def build_index(vectors: DataFrame, path: str, clusters: int, fraction: float = 1.0, norm_limit: float | None = None, seed: int = 29, shard: str = "all") -> None:
    """Train centroids on a sample, assign all vectors (id, vec; ids from 0), and write postings by bucket of clusters,
    centroids, and the mean and deviation of every dimension. Run again, the index replaces itself."""
    sample = index.sample_vectors(vectors, fraction, replace=False, seed=seed, norm_limit=norm_limit) if fraction < 1 or norm_limit else vectors
    centroids = index.train_centroids(sample, clusters, seed)
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    index.mean_std(vectors).coalesce(1).write.mode("overwrite").parquet(f"{path}/moments")
    add_shard(vectors, path, shard)


def add_shard(vectors: DataFrame, path: str, shard: str) -> None:
    """Assign vectors to an index's centroids and add them as a shard, or in place of the shard of that name."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    postings = index.assign(rows, spark.read.parquet(f"{path}/centroids")).withColumn("bucket", F.col("cluster_id") % mips.BUCKETS)
    manifest.add(spark, path, shard, postings.select("id", "vec", "cluster_id", "bucket"), "bucket")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings (id, vec, cluster_id, bucket, shard) and centroids."""
    return manifest.read(spark, path, "id bigint, vec array<double>, cluster_id int, bucket int"), spark.read.parquet(f"{path}/centroids")


def merge_indexes(spark: SparkSession, paths: list[str], path: str) -> None:
    """Shards over the same centroids as one index: their postings stay where they are, and ids are set apart by as many
    documents as the shards before have. Run again, nothing is doubled."""
    spark.read.parquet(f"{paths[0]}/centroids").write.mode("overwrite").parquet(f"{path}/centroids")
    manifest.merge(spark, paths, path)


def merged_phrases(spark: SparkSession, path: str, phrases_of: dict[str, DataFrame]) -> DataFrame:
    """Phrases (doc_idx, ...) of all shards with the numbers that their documents have in the merged index at ``path``."""
    parts = []
    for s in manifest.shards(spark, path):
        if s.name in phrases_of:
            parts.append(phrases_of[s.name].withColumn("doc_idx", F.col("doc_idx") + F.lit(s.base // manifest.STEP)))
    return reduce(DataFrame.unionByName, parts)


def run_stages(stages: tuple[str, ...], path: str, vectors: DataFrame, options: IndexOptions = IndexOptions(), cells: int = 16, shard: str = "all", shards: tuple[str, ...] = ()) -> lists.Lists:
    """The stages of a two-level index by their names, in this order: ``coarse`` (train centroids and codebooks on a sample), ``add`` (assign and code
    all vectors as a shard), ``merge`` (take the shards of other indexes in), or ``all`` for the first two. A stage that is run
    again replaces what it wrote."""
    known = {"all": ("coarse", "add")}
    asked = [x for s in stages for x in known.get(s, (s,))]
    if unknown := set(asked) - {"coarse", "add", "merge"}:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    spark = vectors.sparkSession
    if "coarse" in asked:
        sample = index.sample_vectors(vectors, options.sample, replace=False, seed=options.seed, norm_limit=options.norm_limit) if options.sample < 1 or options.norm_limit else vectors
        lists.train(sample, path, cells, max(1, options.clusters // cells), options.parts, seed=options.seed)
    out = lists.Lists(spark, path)
    if "add" in asked:
        lists.add(vectors, out, shard)
    if "merge" in asked:
        manifest.merge(spark, list(shards), path)
    return out
