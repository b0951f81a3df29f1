"""The shared folder in which lineage is cut, and a few helpers for columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing needs any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder whose files are dealt by ``column``, so that grouping by it
    later needs no shuffle."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    # the name was only needed to write by buckets: files and the frame that reads them stay
    spark.sql(f"DROP TABLE {table}")
    return out


def numbered(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written with a column ``key`` (bigint) that tells its rows apart, whatever their ids are."""
    return written(df.withColumn(key, F.monotonically_increasing_id()), name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
