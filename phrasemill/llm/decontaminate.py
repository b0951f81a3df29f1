"""Benchmark decontamination with suffix arrays over the training words.

A shard is a few megabytes of documents. Its suffix array orders the places whose first two words stand
together somewhere in the benchmark (no other suffix can hold a test window) by their next ``width``
words. Every window of the benchmark is binary-searched in the array of every shard, one word deeper at
a time for all windows at once; what is found is extended word by word to the longest verbatim match.
Shards never meet, so documents need no shuffle. A benchmark over ``BLOCK_BYTES`` is searched in blocks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _arrow as A
from ._store import written

#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 16 << 20


@dataclass
class Tests:
    """A block of the benchmark: words as ids of its own vocabulary, and all windows."""

    vocabulary: pa.Array
    words: np.ndarray  # ids of all items, one after the other, -2 after each
    items: list[str]
    start: np.ndarray  # of each window in words
    size: np.ndarray
    item: np.ndarray
    pairs: np.ndarray  # first two words of windows, as first * len(vocabulary) + second
    singles: np.ndarray  # words that are windows by themselves


def tests_of(items: list[str], texts: list[str | None], width: int) -> Tests:
    tokens, first = A.words(pa.array(texts, pa.string()), A.ALNUM)
    index, vocabulary = A.encoded(tokens)
    counts = np.diff(first)
    words = np.full(len(index) + len(items), -2, np.int64)
    begin = first[:-1] + np.arange(len(items))
    words[A.ragged(begin, counts)] = index
    size = np.minimum(counts, width)
    n = np.where(counts > 0, counts - size + 1, 0)
    item = np.repeat(np.arange(len(items)), n)
    start = A.ragged(begin, n).astype(np.int64)
    size = size[item]
    two = size > 1
    v = len(vocabulary)
    return Tests(vocabulary, words, items, start, size, item, np.unique(words[start[two]] * v + words[start[two] + 1]), np.unique(words[start[~two]]))


def _within(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def suffix_array(words: np.ndarray, tests: Tests, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` (-1: not in the benchmark, -2: between documents) in the order of their next
    ``width`` words, and those words."""
    known = np.flatnonzero(words[:-1] >= 0)
    key = words[known] * len(tests.vocabulary) + words[known + 1]
    place = known[((words[known + 1] >= 0) & _within(key, tests.pairs)) | _within(words[known], tests.singles)]
    ahead = np.full((width, len(place)), -2, np.int64)
    live = np.ones(len(place), bool)
    for d in range(width):
        at = np.minimum(place + d, len(words) - 1)
        ahead[d] = np.where(live, words[at], -2)
        live &= ahead[d] >= 0
    order = np.lexsort(ahead[::-1])
    return place[order], ahead[:, order]


def search(ahead: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of the suffix array whose suffixes begin with it."""
    n = ahead.shape[1]
    low, high = np.zeros(len(tests.start), np.int64), np.full(len(tests.start), n)
    for d in range(ahead.shape[0]):
        live = np.flatnonzero((low < high) & (tests.size > d))
        if not len(live):
            break
        wanted, column = tests.words[tests.start[live] + d], ahead[d]
        bounds = []
        for right in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                value = column[np.minimum(mid, n - 1)]
                less = open_ & ((value <= wanted) if right else (value < wanted))
                a = np.where(less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            bounds.append(a)
        low[live], high[live] = bounds
    return low, high


def scan_shard(texts: pa.Array, tests: Tests, width: int) -> dict[str, list]:
    """For each text: n_words, hit word spans, items, and its longest verbatim match."""
    tokens, first = A.words(texts, A.ALNUM)
    index, distinct = A.encoded(tokens)
    ids = pc.fill_null(pc.index_in(distinct, tests.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    docs = len(texts)
    counts = np.diff(first)
    words = np.full(len(index) + docs, -2, np.int64)
    begin = first[:-1] + np.arange(docs)
    words[A.ragged(begin, counts)] = ids[index]
    spans: list[list[int]] = [[] for _ in range(docs)]
    items: list[list[str]] = [[] for _ in range(docs)]
    longest: list[tuple] = [(0, None, None)] * docs
    place, ahead = suffix_array(words, tests, width) if len(words) else (np.zeros(0, np.int64), np.zeros((width, 0), np.int64))
    if len(place):
        low, high = search(ahead, tests)
        found = np.flatnonzero(low < high)
        n = (high - low)[found]
        window = np.repeat(found, n)
        at = place[A.ragged(low[found], n)]
        order = np.argsort(at, kind="stable")
        window, at = window[order], at[order]
        # extend beyond the window while the words agree
        size = tests.size[window].copy()
        live = np.arange(len(at))
        while len(live):
            p, t = at[live] + size[live], tests.start[window[live]] + size[live]
            ok = (p < len(words)) & (t < len(tests.words))
            ok[ok] = (words[p[ok]] >= 0) & (words[p[ok]] == tests.words[t[ok]])
            live = live[ok]
            size[live] += 1
        doc = np.searchsorted(begin, at, side="right") - 1
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1) if len(at) else ():
            d = int(doc[part[0]])
            a = at[part] - begin[d]
            e = a + tests.size[window[part]]
            # places ascend: a new span begins where one lies beyond all ends before it
            reach = np.maximum.accumulate(e)
            new = np.append(True, a[1:] > reach[:-1])
            ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
            spans[d] = np.column_stack([a[new], ends]).ravel().tolist()
            items[d] = sorted({tests.items[i] for i in np.unique(tests.item[window[part]])})
            best = part[np.argmax(size[part])]
            item = tests.item[window[best]]
            longest[d] = (int(size[best]), tests.items[item], int(at[best] - begin[d]))
    return {"n_words": counts.tolist(), "spans": spans, "items": items, "longest": longest}


def _merged(spans: list[int], more: list[int]) -> list[int]:
    """The union of two lists of spans, each flat: from, to, from, to, ..."""
    out: list[int] = []
    pairs = sorted([*zip(spans[::2], spans[1::2], strict=True), *zip(more[::2], more[1::2], strict=True)])
    for a, b in pairs:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(bench: DataFrame, item_col: str, text_col: str, width: int, block_bytes: int):
    """The benchmark, block by block: only one is on the driver at a time."""
    items, texts, size = [], [], 0
    for item, text in bench.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        if text and item is not None:
            items.append(item)
            texts.append(text)
            size += len(text.encode())
            if size >= block_bytes:
                yield tests_of(items, texts, width)
                items, texts, size = [], [], 0
    if items:
        yield tests_of(items, texts, width)


def matches(docs: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None, match_col: str = "match", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (the id alone), and one column ``match_col`` with
    n_words, spans (flat pairs from, to of hit words), items (sorted as strings), and the longest
    verbatim match: longest (words), longest_item, longest_at (word of the document).

    A null text has no words; null items or texts of the benchmark are left out; an empty benchmark hits
    nothing. Repeated rows are judged each.
    """
    spark = docs.sparkSession
    keep = [id_col] if keep is None else keep
    kind = T.StructType.fromDDL("n_words bigint, spans array<bigint>, items array<string>, longest bigint, longest_item string, longest_at bigint")
    # positions name the columns from here on, so that no name can clash
    names = [f"c{i}" for i in range(len(keep))]
    state = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)), F.col(text_col).alias("t"), F.lit(None).cast(kind).alias("m"))

    def step(state: DataFrame, tests: Tests) -> DataFrame:
        shared = spark.sparkContext.broadcast(tests)

        def run(batches):
            for b in A.chunks(batches, "t"):
                found = scan_shard(b.column("t"), shared.value, width)
                rows = []
                for n, spans, items, (size, item, at), old in zip(found["n_words"], found["spans"], found["items"], found["longest"], b.column("m").to_pylist(), strict=True):
                    if old:
                        spans, items = _merged(spans, old["spans"]), sorted({*items, *old["items"]})
                        if old["longest"] >= size:
                            size, item, at = old["longest"], old["longest_item"], old["longest_at"]
                    rows.append({"n_words": n, "spans": spans, "items": items, "longest": size, "longest_item": item, "longest_at": at})
                match = pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), b.column("t"), match], [*names, "t", "m"])

        return state.mapInArrow(run, state.schema)

    passes = 0
    for tests in _blocks(bench, item_col, item_text, width, block_bytes):
        state = step(written(state, "matches") if passes else state, tests)
        passes += 1
    if not passes:
        state = step(state, tests_of([], [], width))
    return state.select(*(F.col(x).alias(c) for c, x in zip(keep, names, strict=True)), F.col("m").alias(match_col))


def report(docs: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", **names) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated, and
    the longest match."""
    m = F.col("match")
    hit = F.expr("aggregate(transform(match.spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return matches(docs, bench, width, id_col, **names).select(
        F.col(id_col), m["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(m["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"), (F.size(m["spans"]) > 0).alias("contaminated"),
        m["longest"].alias("longest"), m["longest_item"].alias("longest_item"), m["longest_at"].alias("longest_at"))


def clean(docs: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", **names) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; columns unchanged, whatever their names.
    Each row is judged by its text alone: a null or empty text holds none and stays, repeated rows go or stay
    alike, very long texts are read whole; with an empty benchmark all rows stay."""
    free = next(x for x in (f"match{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    found = matches(docs, bench, width, id_col, keep=docs.columns, match_col=free, **names)
    return found.where(F.size(F.col(free)["spans"]) == 0).drop(free)
