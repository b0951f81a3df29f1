"""Vectorised text primitives on Arrow buffers, for use inside ``mapInArrow``.

Nothing here loops over characters or words in Python: a batch of texts is one byte buffer, words are
runs in it, and equal words are found by Arrow's dictionary encoding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are handled at once; a single longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def chunks(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` of text each (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none), and where each begins (one more entry than texts)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _byte_table(is_word, lower: bool = True) -> np.ndarray:
    """Byte to byte: A-Z to a-z if ``lower``, bytes outside words to a space."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    for b in range(128):
        if not is_word(int(table[b])):
            table[b] = 32
    return table


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` and ``[^\x20\x09-\x0D]+``, both after lower-casing A-Z.
ALNUM = _byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122)
SPACED = _byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
#: Words ``[^\x20\x09-\x0D]+`` as they stand.
AS_IS = _byte_table(lambda b: not (b == 32 or 9 <= b <= 13), lower=False)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def words(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the index of each text's first word (one more at the end)."""
    data, offsets = text_buffer(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    data = table[data]
    inside = data != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    compact = data[inside]
    # where each word begins among the bytes that are in words
    place = np.flatnonzero(starts)
    before = np.cumsum(inside, dtype=np.int64)
    begin = before[place] - 1
    return binary_array(compact, np.append(begin, len(compact))), np.searchsorted(place, offsets)


def encoded(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each value among the distinct ones, and those."""
    found = array.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashes(values: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes of byte strings."""
    from pandas.util import hash_array

    if not len(values):
        return np.zeros(0, np.uint64)
    return hash_array(np.array(values.to_pylist() + [None], dtype=object)[:-1], categorize=False)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    kind = np.int32 if max(total, int(starts.max()) + int(lengths.max())) < 2**31 - 1 else np.int64
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=kind) + np.repeat((starts - begin).astype(kind), lengths)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over runs [first[i], first[i+1]); empty runs give 0."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
