"""Difference of two snapshots whose rows may have changed their keys, by Merkle trees over hash buckets.

Every row of a snapshot becomes a key, its place among the rows of that key, and a SHA-256 digest of each
compared column. The hash of key and place says which leaf of the tree the row is in; a leaf's digest combines
those of its rows whatever their order, an inner node's those of its ``FAN`` children. Two trees are compared
from the root down: only children of nodes that differ are looked at. Leaves that agree are verified row by row
on the columns' digests and give ``same``; a leaf that fails is diffed like those that differ. In these, rows
are paired by key; what stays alone is paired by content, the i-th smallest key with the i-th smallest.

The trees are tables, one for each level, stored beside the snapshot's rows; nothing but counts and flags
reaches the driver. All joins are on keys that are unique by construction (key and place, content and place),
so neither a repeated key nor a content that a third of the rows have meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rank import ranked
from ._store import discard, written

#: A node has ``2 ** FAN_BITS`` children; trees are so deep that leaves have ``LEAF_ROWS`` rows at most on average.
FAN_BITS, LEAF_ROWS = 6, 4


@dataclass
class Snapshot:
    """Rows (key, nth, place, content, c0, c1, ..., and what is carried) and levels (node, n, low, mix) from
    the leaves to the root."""

    rows: DataFrame
    levels: list[DataFrame]


def _all_same(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names))


def digest(value: Column) -> Column:
    """SHA-256 of a value as text, null for null."""
    return F.unhex(F.sha2(value.cast("string").cast("binary"), 256))


def rows_of(docs: DataFrame, key: str, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """The snapshot's rows with digests, written. ``place`` is a hash of key and ``nth``."""
    cells = [digest(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    found = docs.select(F.col(key).alias("key"), *cells, *(F.col(c).alias(f"x{i}") for i, c in enumerate(carry)))
    # cells have a fixed width, so the text of all of them tells apart whatever differs
    content = F.unhex(F.sha2(F.concat_ws(",", *(F.coalesce(F.hex(f"c{i}"), F.lit("null")) for i in range(len(columns)))).cast("binary"), 256))
    first = written(found.withColumn("content", content), "cells")
    out = ranked(first, ["key"], "content")
    discard(first)
    return out.withColumn("place", F.xxhash64("key", "nth"))


def depth_for(rows: int) -> int:
    """The fewest levels below the root that leave ``LEAF_ROWS`` rows for a leaf on average."""
    depth = 1
    while rows > LEAF_ROWS << (FAN_BITS * depth) and FAN_BITS * (depth + 1) <= 60:
        depth += 1
    return depth


def leaf(depth: int) -> Column:
    return F.shiftrightunsigned("place", 64 - FAN_BITS * depth)


def tree(rows: DataFrame, depth: int) -> Snapshot:
    """``rows`` of ``rows_of`` with the levels of their Merkle tree, each level written."""
    row = F.xxhash64("place", "content")
    # the exclusive or is blind to pairs of equal hashes; counts and sums of halves aren't, and can't overflow
    parts = [F.bit_xor("h").alias("mix"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low")]
    nodes = rows.select(leaf(depth).alias("node"), row.alias("h")).groupBy("node").agg(F.count("*").alias("n"), *parts)
    levels = [written(nodes, "leaves")]
    for _ in range(depth):
        below = levels[-1].select(F.shiftrightunsigned("node", FAN_BITS).alias("node"), "n", F.xxhash64("node", "n", "low", "mix").alias("h"))
        levels.append(written(below.groupBy("node").agg(F.sum("n").alias("n"), *parts), "nodes"))
    return Snapshot(rows, levels)


def differing(a: Snapshot, b: Snapshot) -> DataFrame:
    """``node`` of all leaves that differ, found from the root down; no digest below equal nodes is read twice."""
    found = None
    for x, y in zip(reversed(a.levels), reversed(b.levels), strict=True):
        if found is not None:
            above = found.select(F.col("node").alias("up"))
            x, y = (t.join(above, F.shiftrightunsigned("node", FAN_BITS) == F.col("up"), "left_semi") for t in (x, y))
        both = x.alias("x").join(y.alias("y"), F.col("x.node") == F.col("y.node"), "full_outer")
        odd = both.where(~_all_same("x", "y", ["n", "low", "mix"])).select(F.coalesce("x.node", "y.node").alias("node"))
        deeper = written(odd, "differing")
        if found is not None:
            discard(found)
        found = deeper
    return found


def compare(earlier: DataFrame, later: DataFrame, key: str, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per pair of rows or row without partner: ``key`` (the later row's, else the earlier's), ``old_key``
    (the earlier row's, else null), ``op``, ``changed`` (array of the columns of a pair that differ, in the order of
    ``columns``), and the later row's ``carry`` columns (null for deletes).

    Rows of equal keys pair: ``same`` or ``update``. Of the others, rows of equal ``columns`` pair in the order of
    their keys: ``rekey``. What is left is ``insert`` or ``delete``. Nulls equal nulls only, as keys too; null
    keys are the largest. Rows of one key pair in the order of their digests, the rest of the longer side is left. Values are compared by SHA-256 of their text,
    so long ones are never shuffled; columns can be of any type that casts to text, and keys of any that can be
    ordered. Other columns, whatever their names, are ignored. Empty tables are snapshots like others.
    """
    a, b = rows_of(earlier, key, columns), rows_of(later, key, columns, carry)
    depth = depth_for(max(a.count(), b.count()))
    one, two = tree(a, depth), tree(b, depth)
    odd = differing(one, two)
    cells, extra = [f"c{i}" for i in range(len(columns))], [f"x{i}" for i in range(len(carry))]
    a, b = (t.withColumn("leaf", leaf(depth)) for t in (a, b))
    joined = (F.col("a.place") == F.col("b.place")) & _all_same("a", "b", ["key", "nth"])

    def parted(how: str) -> tuple[DataFrame, DataFrame]:
        at = odd.select(F.col("node").alias("leaf"))
        return a.join(at, "leaf", how).alias("a"), b.join(at, "leaf", how).alias("b")

    x, y = parted("left_anti")
    verified = written(x.join(y, joined & _all_same("a", "b", cells)).select("a.leaf", "a.key", *(f"b.{c}" for c in extra)), "verified")
    seen = verified.groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("found"))
    claimed = one.levels[0].join(odd, "node", "left_anti")
    doubtful = written(claimed.join(seen, "node", "left").where("found IS NULL OR found <> n").select("node"), "doubtful")
    if not doubtful.isEmpty():  # equal sums of unequal rows
        verified = verified.join(doubtful.select(F.col("node").alias("leaf")), "leaf", "left_anti")
        odd = odd.unionByName(doubtful)
    nothing = F.array().cast("array<string>")
    same = verified.select("key", F.col("key").alias("old_key"), F.lit("same").alias("op"), nothing.alias("changed"), *extra)

    x, y = parted("left_semi")
    pairs = x.join(y, joined, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(name)) for c, name in zip(cells, columns, strict=True))))
    # place is never null: it tells which side a row has
    old, new = F.col("a.place").isNotNull(), F.col("b.place").isNotNull()
    diff = pairs.select(
        old.alias("old"), new.alias("new"), F.when(new, F.col("b.key")).otherwise(F.col("a.key")).alias("key"), F.coalesce("b.content", "a.content").alias("content"),
        F.when(old & new, changed).otherwise(nothing).alias("changed"), *(F.col(f"b.{c}").alias(c) for c in extra),
    )
    diff = written(diff, "row_diff")
    kept = diff.where("old AND new").select("key", F.col("key").alias("old_key"), F.when(F.size("changed") > 0, "update").otherwise("same").alias("op"), "changed", *extra)

    gone = ranked(diff.where("old AND NOT new").select("key", "content"), ["content"], "key").alias("a")
    come = ranked(diff.where("new AND NOT old").select("key", "content", *extra), ["content"], "key").alias("b")
    moved = gone.join(come, (F.col("a.content") == F.col("b.content")) & (F.col("a.nth") == F.col("b.nth")), "full_outer")
    old, new = F.col("a.nth").isNotNull(), F.col("b.nth").isNotNull()
    moved = moved.select(
        F.when(new, F.col("b.key")).otherwise(F.col("a.key")).alias("key"), F.col("a.key").alias("old_key"),
        F.when(old & new, "rekey").when(new, "insert").otherwise("delete").alias("op"), nothing.alias("changed"), *(F.col(f"b.{c}").alias(c) for c in extra),
    )
    out = same.unionByName(kept).unionByName(moved)
    return out.select("key", "old_key", "op", "changed", *(F.col(x).alias(c) for x, c in zip(extra, carry, strict=True)))


def next_snapshot(docs: DataFrame) -> DataFrame:
    """The later snapshot of the contract, drawn from ``docs`` by crc32 of the decimal ``doc_id`` modulo 10: 0
    drops the row; 1 appends ``+`` to text; 2 swaps lang and source; 3 makes the key ``-1-key``; 4 does so and sets
    source null; 5 adds a copy under ``-1-key``."""
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    rows = docs.select("doc_id", "text", "lang", "source", draw.alias("draw")).where("draw IS NULL OR draw <> 0")
    # a row of draw 5 stands twice, its copy with the new key
    rows = rows.withColumn("moved", F.explode(F.when(F.col("draw") == 5, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.coalesce(F.col("draw").isin(3, 4), F.lit(False))))))
    swap = F.col("draw") == 2
    return rows.select(
        F.when(F.col("moved"), -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("draw") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(swap, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(swap, F.col("lang")).when(F.col("draw") == 4, F.lit(None)).otherwise(F.col("source")).alias("source"),
    )


def digested(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """``compare`` of documents by ``doc_id``, with ``changed`` comma-joined and the SHA-256 of the later row's
    text, lang and source, a line each, null as ``~`` (null for deletes)."""
    columns = ["text", "lang", "source"]
    row = F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("~")) for c in columns)).cast("binary"), 256)
    found = compare(earlier, later.withColumn("row_sha256", row), "doc_id", columns, ["row_sha256"])
    return found.withColumn("changed", F.concat_ws(",", "changed"))


ORACLE_SQL = r"""
WITH c AS (
  SELECT doc_id, text, lang, source,
         xor(list_reduce(
           list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                          WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 10 AS draw
  FROM documents),
l AS (
  SELECT CASE WHEN draw IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS doc_id,
         CASE WHEN draw = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
         CASE WHEN draw = 2 THEN source ELSE lang END AS lang,
         CASE WHEN draw = 2 THEN lang WHEN draw = 4 THEN NULL ELSE source END AS source
  FROM c WHERE draw <> 0
  UNION ALL
  SELECT -1 - doc_id, text, lang, source FROM c WHERE draw = 5),
h AS (SELECT *, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS row_sha256 FROM l),
p AS (
  SELECT h.doc_id AS key, e.doc_id AS old_key,
         concat_ws(',', CASE WHEN e.text IS DISTINCT FROM h.text THEN 'text' END,
                        CASE WHEN e.lang IS DISTINCT FROM h.lang THEN 'lang' END,
                        CASE WHEN e.source IS DISTINCT FROM h.source THEN 'source' END) AS changed, row_sha256
  FROM documents e JOIN h ON e.doc_id = h.doc_id),
gone AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS nth FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM h)),
come AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS nth FROM h
  WHERE doc_id NOT IN (SELECT doc_id FROM documents))
SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, row_sha256 FROM p
UNION ALL
SELECT coalesce(b.doc_id, a.doc_id), a.doc_id,
       CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'delete' ELSE 'rekey' END, '', b.row_sha256
FROM gone a FULL JOIN come b
  ON a.nth = b.nth AND a.text IS NOT DISTINCT FROM b.text AND a.lang IS NOT DISTINCT FROM b.lang
     AND a.source IS NOT DISTINCT FROM b.source
"""
