"""Repeated passages: seed and extend on winnowed anchors.

Every window of ``width`` words has one anchor: of the runs of ``SEED`` words in it the one of the smallest
hash, the last of several. Equal windows have equal anchors at equal places in them, so every passage that two
documents share over the whole width is seeded. Windows of one document with the same anchor are consecutive:
the words from the first one's start to the last one's end are the anchor's reach, and an anchor with a hash of
its reach is a row of some 40 bytes, one for about 18 words.

Documents are joined on anchors. An occurrence whose reach equals that of the smallest id's is wholly a repeat.
Where reaches differ, the occurrences of an anchor are extended together, both ways and word by word as far as
their reach: two agree so far to the left and so far to the right exactly if they have the same windows, so one
occurrence of each different reach is listed window by window and the smallest id of each window is found
(occurrences are never paired with each other, and what many documents have is aggregated map-side). Windows
that a smaller id has as well are merged to maximal repeats, of ``width`` words at least.

Anchors move twice, in short rows. Of the texts only those move that are listed by windows or lose words; bitmaps
of bounded size tell which can stay where they are.

Words, anchors, reaches and windows are compared by 64-bit hashes; two different windows would have to agree in
the hash of their anchor and in their own (128 bits).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrow as A
from ._bitmap import bitmap, only
from ._store import discard, written

#: Words of an anchor, if the width allows, and text that is handled at once.
SEED, CHUNK_TEXT = 16, 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolled:
    """Hashes of any runs of words, equal for equal runs wherever they stand."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            self.total = np.append(np.uint64(0), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64))
            self.back = _powers(_BACK, len(words) + 1)

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return A.mixed((self.total[start + length] - self.total[start]) * self.back[start] + np.uint64(1))


def last_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its smallest, the last of equal ones."""

    def better(a, b):
        return np.where(values[b] <= values[a], b, a)

    best, have = np.arange(len(values)), 1
    while 2 * have <= width:
        best, have = better(best[:-have], best[have:]), 2 * have
    return best if have == width else better(best[: len(best) - (width - have)], best[width - have :])


def text_keys(texts: pa.Array) -> pa.Array:
    """64-bit digests of the texts: they tell apart texts of one id."""
    found = b"".join(hashlib.blake2b(t or b"", digest_size=8).digest() for t in texts.cast(pa.large_binary()).to_pylist())
    return pa.array(np.frombuffer(found, np.int64))


def _rolled(texts: pa.Array) -> tuple[Rolled, int, np.ndarray]:
    tokens, first = A.words(texts, A.AS_IS)
    index, distinct = A.encoded(tokens)
    return Rolled(A.mixed(A.hashes(distinct))[index]), len(tokens), first


def anchors(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each occurrence of an anchor: id, text_key, anchor (hash), reach (hash of its words and the
    anchor's place in it), first (the first window's start), many (windows)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    seed = max(1, min(SEED, width // 2))

    def run(batches):
        for b in A.chunks(batches, "text", CHUNK_TEXT):
            rolled, total, first = _rolled(b.column("text"))
            # windows that lie in one text
            counts = np.maximum(np.diff(first) - width + 1, 0)
            start = A.ragged(first[:-1], counts)
            if not len(start):
                continue
            seeds = rolled.runs(np.arange(total - seed + 1), seed)
            anchor = last_least(seeds, width - seed + 1)[start]
            text = np.repeat(np.arange(b.num_rows), counts)
            at = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
            many = np.diff(np.append(at, len(start)))
            low, place, owner = start[at], anchor[at], text[at]
            with np.errstate(over="ignore"):
                reach = A.mixed(rolled.runs(low, many - 1 + width) + (place - low).astype(np.uint64) * _BASE + many.astype(np.uint64))
            first_window = (low - first[:-1][owner]).astype(np.int32)
            owner = pa.array(owner)
            columns = [b.column("id").take(owner), text_keys(b.column("text")).take(owner), pa.array(seeds[place].view(np.int64)), pa.array(reach.view(np.int64)), pa.array(first_window), pa.array(many.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "anchor", "reach", "first", "many"])

    return rows.mapInArrow(run, f"id {kind}, text_key bigint, anchor bigint, reach bigint, first int, many int")


def keyed(docs: DataFrame, id_col: str, text_col: str, among) -> DataFrame:
    """id, text, text_key of the texts whose key may be ``among`` those of a bitmap."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in A.chunks(batches, "text", CHUNK_TEXT):
            keys = text_keys(b.column("text"))
            keep = pa.array(among(keys))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), keys], ["id", "text", "text_key"]).filter(keep)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, text_key bigint")


def _same_text(a: str, b: str):
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def _later(than: str):
    """Whether ``id`` is larger than a column; null ids are larger than all others."""
    return F.col(than).isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col(than)))


def _windows(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, width: int) -> DataFrame:
    """``anchor``, ``reach``, ``id``, ``done``, ``alone``, ``at``, ``window``: the windows of one occurrence of each reach, by their place in it."""
    # a text's anchors are fewer than its words
    asked = classes.groupBy("id", "text_key").agg(F.collect_list(F.struct("anchor", "reach", "first", "many", "done", "alone")).alias("asked"))
    texts = keyed(docs, id_col, text_col, bitmap(classes, "text_key"))
    both = texts.alias("t").join(asked.alias("s"), _same_text("t", "s")).select("t.id", "t.text", "s.asked")
    # rows that are wholly repeated give the same windows
    kind = both.schema["id"].dataType.simpleString()

    def run(batches):
        for b in A.chunks(batches, "text", CHUNK_TEXT):
            rolled, _, first = _rolled(b.column("text"))
            lists = b.column("asked")
            owner = pa.array(np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())))
            x = lists.flatten()
            many = x.field("many").to_numpy().astype(np.int64)
            low = x.field("first").to_numpy().astype(np.int64) + first[:-1][owner.to_numpy()]
            start = A.ragged(low, many)
            row = np.repeat(np.arange(len(many)), many)
            take = pa.array(row)
            at = pa.array((start - low[row]).astype(np.int32))
            window = pa.array(rolled.runs(start, width).view(np.int64))
            yield pa.RecordBatch.from_arrays([x.field("anchor").take(take), x.field("reach").take(take), b.column("id").take(owner).take(take), x.field("done").take(take), x.field("alone").take(take), at, window], ["anchor", "reach", "id", "done", "alone", "at", "window"])

    return both.mapInArrow(run, f"anchor bigint, reach bigint, id {kind}, done boolean, alone boolean, at int, window bigint")


def repeated_windows(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_key`` and an array ``starts`` of windows, by the place of their first word, that a smaller id has
    as well; several rows for one text, written."""
    found = written(anchors(docs, width, id_col, text_col), "anchors")
    # found map-side; written, so that Spark can split the rows of frequent anchors in the join, and so that the
    # reach that stands for the smallest id is chosen once
    heads = found.groupBy("anchor").agg(F.min("id").alias("head"), F.max("id").alias("tail"), F.min_by("reach", "id").alias("model"), F.count("*").alias("rows"), F.count("id").alias("named"))
    heads = written(heads.where("head < tail OR head IS NOT NULL AND named < rows").select("anchor", "head", "model"), "heads")
    members = written(only(found, "anchor", bitmap(heads, "anchor")).join(heads, "anchor"), "members")
    whole = members.where((F.col("reach") == F.col("model")) & _later("head"))
    whole = whole.select("id", "text_key", F.sequence("first", F.col("first") + F.col("many") - 1).alias("starts"))

    # one occurrence, of the smallest id, of each reach, found map-side; and of these, anchors that have several
    place = F.min_by(F.struct("text_key", "first", "many"), F.struct(F.col("id").isNull(), F.col("id"), "text_key", "first")).alias("place")
    reaches = members.groupBy("anchor", "reach", "model").agg(F.min("id").alias("id"), place, (F.count("*") == 1).alias("alone"))
    reaches = written(reaches.select("anchor", "reach", "id", "place.*", "alone", (F.col("reach") == F.col("model")).alias("done")), "reaches")
    several = written(reaches.where("NOT done").select("anchor").distinct(), "several")
    classes = written(reaches.join(several, "anchor", "left_semi"), "classes")
    windows = written(_windows(docs, id_col, text_col, classes, width), "windows")
    lowest = windows.groupBy("anchor", "window").agg(F.min("id").alias("lowest"), F.count("*").alias("times")).where("lowest IS NOT NULL")
    # by reach: the windows that others have as well, and the smallest id of each; one row stands for equal rows of a table
    known = windows.where("NOT done").groupBy("anchor", "reach", "at", "window").agg(F.first("alone").alias("alone"))
    known = known.join(lowest, ["anchor", "window"]).where("times > 1 OR NOT alone")
    known = written(known.groupBy("anchor", "reach").agg(F.collect_list(F.struct("at", "lowest")).alias("known")), "extended")
    part = members.where("reach <> model").join(known, ["anchor", "reach"])
    smaller = F.filter("known", lambda w: F.col("id").isNull() | (F.col("id") > w["lowest"]))
    part = part.select("id", "text_key", F.transform(smaller, lambda w: F.col("first") + w["at"]).alias("starts")).where("size(starts) > 0")
    out = written(whole.unionByName(part), "repeated")
    for x in (found, heads, members, reaches, several, classes, windows, known):
        discard(x)
    return out


def repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal repeats: ``id``, ``text_key`` and ``spans``, an array of (start, end) in words, end exclusive, in order
    and apart: the words that windows of ``width`` cover which a smaller id has as well. Texts without any have
    no row. Written."""
    rows = repeated_windows(docs, width, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    # a text's windows are at most its words: a group is never larger than the text itself
    by_text = rows.groupBy("id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def run(batches):
        for b in batches:
            spans = []
            for starts in b.column("starts").to_pylist():
                at = np.unique(np.array(starts, np.int64))
                cut = np.flatnonzero(np.diff(at) > width)
                low, high = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + width
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(low, high, strict=True)])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(spans, kinds)], ["id", "text_key", "spans"])

    out = written(by_text.mapInArrow(run, f"id {kind}, text_key bigint, spans array<struct<start:bigint,end:bigint>>"), "spans")
    discard(rows)
    return out


def _kept(texts: pa.Array, spans: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text, how many are in its spans, and the others joined by a space."""
    tokens, first = A.words(texts, A.AS_IS)
    n = np.diff(first)
    gone = np.zeros(len(tokens) + 1, np.int64)
    for at, found in zip(first[:-1].tolist(), spans, strict=True):
        for s in found or ():
            gone[at + s["start"]] += 1
            gone[at + s["end"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    removed = A.sums((~keep).astype(np.int64), first)
    offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2], np.uint8) if len(tokens) else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)[keep]
    # every kept word and a space after it
    ends = np.cumsum(lengths + 1)
    joined = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    joined[A.ragged(ends - lengths - 1, lengths)] = data[A.ragged(offsets[:-1][keep], lengths)]
    bounds = np.append(0, ends)[np.append(0, np.cumsum(keep))[first]]
    out = [joined[a : max(a, b - 1)].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return n, removed, out


def without_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``n_removed``, ``spans`` (removed, in words) and ``text``: the kept
    words joined by one space.

    Words are maximal ``[^\\x20\\x09-\\x0D]+``, as they stand. A word is removed if a window of ``width`` words that covers
    it starts in a document of a smaller id as well; windows are judged on the input. A null text has no words; a
    text of fewer than ``width`` words keeps all. Null ids are larger than all others; rows of one id remove nothing
    from each other, and repeats within one document stay. An empty table gives no rows; other columns are ignored.
    """
    if width < 2:
        raise ValueError("a window has two words at least")
    spans = repeats(docs, width, id_col, text_col)
    among = bitmap(spans, "text_key")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "n_words", "n_removed", "spans", "text"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, spans {spans.schema['spans'].dataType.simpleString()}, text string"

    def out(b: pa.RecordBatch, found: pa.Array) -> pa.RecordBatch:
        n, removed, kept = _kept(b.column("text"), found.to_pylist())
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(removed), found, pa.array(kept, pa.binary()).cast(pa.string())], names)

    def some(batches):
        for b in A.chunks(batches, "text", CHUNK_TEXT):
            yield out(b, b.column("spans"))

    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def none(batches):
        for b in A.chunks(batches, "text", CHUNK_TEXT):
            b = b.filter(pa.array(~among(text_keys(b.column("text")))))
            yield out(b, pa.nulls(b.num_rows, kinds))

    both = keyed(docs, id_col, text_col, among).alias("t").join(spans.alias("s"), _same_text("t", "s"), "left").select("t.id", "t.text", "s.spans")
    # texts that are surely without repeats stay where they are
    done = both.mapInArrow(some, schema).unionByName(rows.mapInArrow(none, schema))
    return done.withColumnRenamed("id", id_col)


def digested(docs: DataFrame, width: int = 50) -> DataFrame:
    """``without_repeats`` of documents with the SHA-256 of the kept text in its place."""
    out = without_repeats(docs, width)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(words, s, s + 49), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
g AS (SELECT DISTINCT doc_id, s + o AS p FROM w JOIN f USING (h), (SELECT unnest(range(0, 50)) AS o) WHERE doc_id > first),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
