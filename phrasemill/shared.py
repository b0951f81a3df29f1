"""Tables in the folder that driver and executors share, by which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the checkpoint folder of the context. Only where neither is
    set and Spark runs in one process (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("phrasemill.shared.dir", None)
    context = spark.sparkContext
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="phrasemill-")
        spark.conf.set("phrasemill.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder: read again it can't change, whatever is lost or re-planned."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, or the first of its variants that no column of ``rows`` has (in any case)."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name
