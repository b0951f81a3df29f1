"""How filters interact: what each removes in every order, from one pass over the documents.

Every document fails some of the filters: a mask of bits. Per part of the corpus the documents of each mask
are counted, and so are the marked ones among them (good, toxic, ...): these histograms, a row of
``2 ** filters`` counts each, are stacked and multiplied by integer incidence matrices whose columns are all
steps of all orders (32 by 600 for five filters). The products are what every step keeps, removes, would
have removed had an earlier filter not done so, and what only its filter fails. Documents meet one shuffle
by text digest (for the filter of repeated texts) and one by id (for the labels), with short rows; the
histograms are aggregated map-side, and a task multiplies those of the parts that it holds.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import text_or_empty, written

#: More filters than this make too many orders to list (8! = 40,320).
MOST_FILTERS = 8
#: Words are maximal runs of other characters.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def incidence(filters: int) -> dict[str, np.ndarray]:
    """Integer matrices of ``2 ** filters`` masks by all steps of all orders (order by order): what is
    ``kept`` after a step, ``removed`` at it, ``redundant`` (fails, but was removed before), and fails its
    filter only (``unique``); ``order`` and ``filter`` name a column's order and filter."""
    orders = list(permutations(range(filters)))
    mask = np.arange(2**filters)
    out = {k: np.zeros((len(mask), len(orders) * filters), np.int64) for k in ("kept", "removed", "redundant", "unique")}
    for i, order in enumerate(orders):
        before = np.zeros(len(mask), bool)
        for j, f in enumerate(order):
            at, fails = i * filters + j, (mask >> f & 1).astype(bool)
            out["removed"][:, at] = fails & ~before
            out["redundant"][:, at] = fails & before
            out["unique"][:, at] = mask == 1 << f
            before |= fails
            out["kept"][:, at] = ~before
    return out | {"order": np.repeat(np.arange(len(orders)), filters), "filter": np.array(orders).ravel()}


def interactions(rows: DataFrame, part: Column, fails: Mapping[str, Column], marks: Mapping[str, Column]) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step (from 1), kept, removed,
    redundant, unique_fails, ``<mark>_lost`` for every mark, shapley.

    ``fails`` maps one-letter names of filters to what a row fails (null: it doesn't), ``marks`` names to what
    makes a row count as marked (null: it doesn't). Parts are strings; null is the empty string. ``shapley`` is
    what the step's filter removes, summed over all orders. Steps that remove nothing have rows too; a table
    without rows has no parts and gives none.
    """
    names, marked = list(fails), list(marks)
    if not 1 <= len(names) <= MOST_FILTERS or any(len(x) != 1 for x in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter")
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    found = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *(F.when(c, 1).otherwise(0).alias(f"m{i}") for i, c in enumerate(marks.values())))
    counts = found.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(f"m{i}").alias(f"m{i}") for i in range(len(marked))))
    # at most 2 ** filters entries for a part
    stacked = counts.groupBy("part").agg(F.collect_list(F.array(F.col("mask").cast("bigint"), "n", *(f"m{i}" for i in range(len(marked))))).alias("rows"))
    matrices = incidence(len(names))
    orders = ["".join(names[f] for f in order) for order in permutations(range(len(names)))]
    fields = ["kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in marked), "shapley"]

    def run(batches):
        label = pa.array([orders[i] for i in matrices["order"]])
        step = pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders)))
        for b in batches:
            for name, entries in zip(b.column("part").to_pylist(), b.column("rows").to_pylist(), strict=True):
                histograms = np.zeros((1 + len(marked), 2 ** len(names)), np.int64)
                entries = np.array(entries, np.int64)
                histograms[:, entries[:, 0]] = entries[:, 1:].T
                kept, redundant, unique = (histograms[0] @ matrices[k] for k in ("kept", "redundant", "unique"))
                removed, *lost = histograms @ matrices["removed"]
                whole = np.zeros(len(names), np.int64)
                np.add.at(whole, matrices["filter"], removed)
                values = [kept, removed, redundant, unique, *lost, whole[matrices["filter"]]]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(label), pa.string()), label, step, *map(pa.array, values)], ["part", "filter_order", "step", *fields])

    return stacked.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{x} bigint" for x in fields))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id``, ``part`` and what each document fails, ``A`` to ``E``: under 100 words; under 80 distinct words
    in 100; over 10 characters of A-Z in 100; any of ``#$%&*|``; a text that a smaller id has as well.

    A null text is empty. Null ids are larger than all others; rows of one id aren't copies of each other.
    """
    text = text_or_empty(text_col)
    words = F.array_remove(F.split(text, BETWEEN_WORDS), "")
    rows = docs.select(F.col(id_col).alias("id"), F.col(part_col).alias("part"), text.alias("text"), words.alias("words"))
    rows = rows.select(
        "id",
        "part",
        (F.size("words") < 100).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 80 * F.size("words")).alias("B"),
        (100 * (F.char_length("text") - F.char_length(F.translate("text", UPPER, ""))) > 10 * F.char_length("text")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    rows = written(rows, "measured")
    # smallest ids are found map-side; written, so that Spark can split the rows of a frequent text in the join
    first = written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies"), "first")
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return rows.join(first, "digest", "left").select("id", "part", "A", "B", "C", "D", later.alias("E"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``interactions`` of the five filters of ``measured`` in each part (value of ``part_col``), with
    ``good_lost`` (a label of the document has quality 1) and ``toxic_lost`` (toxic 1).

    Repeated rows count as often as they stand; several labels of one id mark it once; a null id has no label.
    An empty table gives no rows; other columns are ignored.
    """
    marks = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = measured(docs, id_col, text_col, part_col).join(marks, "id", "left")
    return interactions(rows, F.col("part"), {x: F.col(x) for x in "ABCDE"}, {"good": F.col("good"), "toxic": F.col("toxic")})


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
d AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w JOIN f USING (text)),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
h AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM d LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
c AS (
  SELECT h.*, s.*, contains(fails, filter) AS hit,
         EXISTS (SELECT 1 FROM (SELECT unnest(string_split(earlier, '')) AS x) WHERE x <> '' AND contains(fails, x)) AS gone
  FROM h, s),
t AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM c GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM t
"""
