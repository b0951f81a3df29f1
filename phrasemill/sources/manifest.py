"""What an index consists of: numbered versions of a list of its shards, each version one file committed last.

A shard's rows are written to a folder of their own first; only a version that names the folder makes them part of
the index. A run that is torn leaves a folder that no version names; a shard that is written again replaces its
entry. Readers take the highest version and see that one alone. Versions are written under another name and renamed,
and a name that is taken is never overwritten, so of two writers at once one fails.

Ids of shards may collide. Each entry has a ``base``, a multiple of ``STEP`` that is added to its ids: bases are so far
apart that no two shards share an id, however many documents they have. Ids of the form ``document * 2^20 + place``
keep it, with the documents numbered on.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases are multiples of this: the places of one document.
STEP = 1 << 20


@dataclass(frozen=True)
class Shard:
    name: str
    folder: str
    rows: int
    span: int  # ids are from 0 to less than this
    base: int = 0


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder, jvm


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder, _ = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def shards(spark: SparkSession, path: str) -> list[Shard]:
    """The shards of the highest version; none without any."""
    known = versions(spark, path)
    if not known:
        return []
    text = spark.read.text(f"{path}/manifest/v{known[-1]:08d}.json", wholetext=True).first()[0]
    return [Shard(**x) for x in json.loads(text)]


def commit(spark: SparkSession, path: str, entries: list[Shard]) -> int:
    """Write the next version; its number. Fails if another writer took it."""
    number = (versions(spark, path) or [0])[-1] + 1
    fs, folder, jvm = _files(spark, path)
    fs.mkdirs(folder)
    target = jvm.org.apache.hadoop.fs.Path(folder, f"v{number:08d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps([asdict(x) for x in entries], indent=1), "utf-8"))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {path} was written by another")
    return number


def placed(known: list[Shard], new: Shard) -> list[Shard]:
    """``known`` with ``new``, under the base of the shard of its name if its ids fit there, else behind all others."""
    out, end, base = [], 0, None
    for s in sorted(known, key=lambda s: s.base):
        end = max(end, s.base + s.span)
        if s.name != new.name:
            out.append(s)
        elif new.span <= s.span:
            base = s.base
    if base is None:
        base = -(-end // STEP) * STEP
    return sorted([*out, Shard(new.name, new.folder, new.rows, new.span, base)], key=lambda s: s.base)


def add(spark: SparkSession, path: str, name: str, rows: DataFrame, by: str, id_col: str = "id") -> None:
    """Write ``rows`` as shard ``name``, in a folder for each value of ``by``, and commit. Written again, a shard
    replaces itself. Ids are from 0."""
    folder = f"lists/{uuid.uuid4().hex}"
    # ranges also split values of ``by`` that have very many rows
    rows.repartitionByRange(by, *(c for c in ("cluster_id",) if c in rows.columns), id_col).write.partitionBy(by).parquet(f"{path}/{folder}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
    n, low, high = written.agg(F.count("*"), F.min(id_col), F.max(id_col)).first()
    if n and low < 0:
        raise ValueError("ids are from 0")
    commit(spark, path, placed(shards(spark, path), Shard(name, folder, n, (high + 1) if n else 0)))


def merge(spark: SparkSession, paths: list[str], path: str) -> None:
    """The shards of several indexes as one, without rewriting their rows; merged again, nothing is doubled."""
    known = shards(spark, path)
    for i, p in enumerate(paths):
        for s in shards(spark, p):
            folder = s.folder if "://" in s.folder or s.folder.startswith("/") else f"{p}/{s.folder}"
            known = placed(known, Shard(f"{i}/{s.name}", folder, s.rows, s.span))
    commit(spark, path, known)


def read(spark: SparkSession, path: str, schema, id_col: str = "id") -> DataFrame:
    """Rows of all shards with ``shard`` (name) and ids that are apart. Filters on the column that folders are named by
    prune folders."""
    out = None
    for s in shards(spark, path):
        folder = s.folder if "://" in s.folder or s.folder.startswith("/") else f"{path}/{s.folder}"
        rows = spark.read.schema(schema).parquet(folder) if s.rows else spark.createDataFrame([], schema)
        rows = rows.withColumns({id_col: F.col(id_col) + F.lit(s.base), "shard": F.lit(s.name)})
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], schema).withColumn("shard", F.lit(""))
    return out


def global_id(spark: SparkSession, path: str, shard: Column, id_: Column) -> Column:
    """The id in the merged index of an id of a shard, to join what belongs to it."""
    out = None
    for s in shards(spark, path):
        out = F.when(shard == s.name, id_ + F.lit(s.base)) if out is None else out.when(shard == s.name, id_ + F.lit(s.base))
    return F.lit(None).cast("bigint") if out is None else out
