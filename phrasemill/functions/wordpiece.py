"""Longest-match word pieces over a trie in arrays, for all words of a batch at once.

A vocabulary becomes a trie of two sorted arrays: edges (node and character as one number) and where they lead. All
words of an Arrow batch walk it together, a character a step; at the end of its walk each word takes the longest
piece that it passed and begins again behind it. Places in the text go along, so every piece has its characters.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words longer than this are unknown as a whole. A fixed value that results depend on.
LONGEST = 100
#: Characters are below this.
CHARS = 1 << 21
#: Bytes of text that are cut at once.
SLICE = 1 << 20

#: A word: marks (ASCII signs count as such), single ideographs, or runs of anything else but white space. Fixed ranges of ideographs.
_WORD = regex.compile(r"[!-/:-@\[-`{-~\p{P}]|[一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf豈-﫿\U0002f800-\U0002fa1f]|[^\s!-/:-@\[-`{-~\p{P}一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf豈-﫿\U0002f800-\U0002fa1f]+")


@dataclass
class Trie:
    edges: np.ndarray
    to: np.ndarray
    piece: np.ndarray  # of each node, -1 where no piece ends
    inner: int  # the node where pieces within words begin


def trie(vocabulary: list[str], mark: str = "##") -> Trie:
    """Pieces with ``mark`` stand within words, others begin them; their number is their place."""
    nodes: list[dict[str, int]] = [{}, {}]
    piece = [-1, -1]
    for number, text in enumerate(vocabulary):
        at, rest = (1, text[len(mark) :]) if text.startswith(mark) and text != mark else (0, text)
        for c in rest:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                piece.append(-1)
            at = nodes[at][c]
        if at > 1:
            piece[at] = number
    pairs = sorted((n * CHARS + ord(c), to) for n, edges in enumerate(nodes) for c, to in edges.items())
    return Trie(np.array([p for p, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64), np.array(piece, np.int64), 1)


def pieces(chars: np.ndarray, start: np.ndarray, length: np.ndarray, t: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, piece, begin and end (in ``chars``) of every piece, in order; a word that can't be cut whole, or that is
    longer than ``LONGEST``, is one piece -1."""
    word, number, low, high = ([np.zeros(0, np.int64)] for _ in range(4))
    bad = length > LONGEST
    live = np.flatnonzero(~bad & (length > 0))
    at, node0 = start.copy(), np.zeros(len(start), np.int64)
    while len(live):
        node, best, end = node0[live], np.full(len(live), -1, np.int64), at[live]
        walking, place = np.arange(len(live)), at[live]
        while len(walking):
            edge = node[walking] * CHARS + chars[place[walking]]
            found = np.minimum(np.searchsorted(t.edges, edge), max(len(t.edges) - 1, 0))
            ok = (t.edges[found] == edge) if len(t.edges) else np.zeros(len(edge), bool)
            walking, found = walking[ok], found[ok]
            node[walking] = t.to[found]
            place[walking] += 1
            ends = t.piece[node[walking]] >= 0
            hit = walking[ends]
            best[hit], end[hit] = t.piece[node[hit]], place[hit]
            walking = walking[place[walking] < (start + length)[live[walking]]]
        lost = best < 0
        bad[live[lost]] = True
        kept = live[~lost]
        word.append(kept)
        number.append(best[~lost])
        low.append(at[kept].copy())
        high.append(end[~lost])
        at[kept] = end[~lost]
        node0[kept] = t.inner
        live = kept[at[kept] < (start + length)[kept]]
    word, number, low, high = map(np.concatenate, (word, number, low, high))
    good = ~bad[word]
    lost = np.flatnonzero(bad)
    word = np.concatenate([word[good], lost])
    number = np.concatenate([number[good], np.full(len(lost), -1)])
    low, high = np.concatenate([low[good], start[lost]]), np.concatenate([high[good], (start + length)[lost]])
    order = np.lexsort((low, word))
    return word[order], number[order], low[order], high[order]


class _Plain(dict):
    """What each character becomes, found once."""

    def __init__(self, lower: bool):
        self.lower = lower

    def __missing__(self, c: str) -> str:
        if c in " \t\n\r" or unicodedata.category(c) == "Zs":
            found = " "
        elif c in "\0\ufffd" or unicodedata.category(c)[0] == "C":
            found = ""
        elif self.lower:
            found = "".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x) != "Mn")
        else:
            found = c
        self[c] = found
        return found


_PLAIN = {lower: _Plain(lower) for lower in (False, True)}


def plain(text: str, lower: bool) -> tuple[str, np.ndarray]:
    """The text as it is cut, and for each of its characters the place in ``text`` that it comes from. In lower case accents are
    dropped; control characters are dropped always."""
    if text.isascii() and text.isprintable():
        return (text.lower() if lower else text), np.arange(len(text))
    out = list(map(_PLAIN[lower].__getitem__, text))
    return "".join(out), np.repeat(np.arange(len(text)), np.fromiter(map(len, out), np.int64, len(out)))


def _slices(batches, columns: list[str]):
    """Slices of the batches with at most ``SLICE`` bytes of text each (or one row), so that what a task holds doesn't grow with its batches."""
    for b in batches:
        if not b.num_rows:
            continue
        size = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends, at = np.cumsum(size), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            yield b.slice(at, to - at)
            at = to


def _cut(column: pa.Array, t: Trie, other: int, lower: bool) -> tuple[np.ndarray, ...]:
    """All pieces of some texts: where each text's begin (and the end), and of each piece its number, word, start and end."""
    texts = column.to_pylist()
    chars, places, starts, lengths, counts = [], [], [], [], []
    base = 0
    for text in texts:
        cut, where = plain(text or "", lower)
        found = [m.span() for m in _WORD.finditer(cut)]
        chars.append(np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), np.uint32))
        places.append(where)
        starts += [base + a for a, _ in found]
        lengths += [z - a for a, z in found]
        counts.append(len(found))
        base += len(cut)
    chars = np.concatenate(chars).astype(np.int64) if chars else np.zeros(0, np.int64)
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    word, number, low, high = pieces(chars, np.array(starts, np.int64), np.array(lengths, np.int64), t)
    first = np.append(0, np.cumsum(counts))
    owner = np.searchsorted(first, word, side="right") - 1
    values = [np.where(number < 0, other, number), word - first[owner], places[low], places[high - 1] + 1]
    return np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32), *(v.astype(np.int32) for v in values)


def word_pieces(rows: DataFrame, vocabulary: list[str], text_col: str = "text", lower: bool = True, unknown: str = "[UNK]") -> DataFrame:
    """``rows`` with ``pieces``, an array of (piece, word, start, end): the piece's number, its word's number in the text, and
    its characters in the text, end exclusive. A null text has null, an empty one no pieces.

    The vocabulary, some ten thousand pieces, is broadcast."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((trie(vocabulary), vocabulary.index(unknown)))
    kind = "array<struct<piece:int,word:int,start:int,end:int>>"
    schema = rows.withColumn("pieces", F.lit(None).cast(kind)).schema

    def run(batches):
        t, other = shared.value
        for b in _slices(batches, [text_col]):
            offsets, *values = _cut(b.column(text_col), t, other, lower)
            struct = pa.StructArray.from_arrays([pa.array(v) for v in values], ["piece", "word", "start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(offsets), struct, mask=b.column(text_col).is_null())
            yield pa.RecordBatch.from_arrays([*b.columns, lists], schema.names)

    return rows.mapInArrow(run, schema)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def features(rows: DataFrame, vocabulary: list[str], length: int, stride: int, id_col: str = "id", question_col: str = "question", context_col: str = "context", most_question: int = 64, lower: bool = True) -> DataFrame:
    """Windows of a question and its context: ``id_col``, ``span_idx``, ``input`` (pieces' numbers: class mark, question, separator, the
    window's part of the context, separator), ``segment`` (0 for the question's part, 1 for the context's), ``first`` (of
    the context's pieces in the window) and ``offsets`` (start and end in the context, characters, for each of them).

    A question is cut to ``most_question`` pieces; windows begin every ``stride`` pieces of the context, and the last one reaches its end.
    An empty context gives one window without pieces of it; rows with a null question or context give none."""
    mark, between = vocabulary.index("[CLS]"), vocabulary.index("[SEP]")
    both = rows.where(F.col(question_col).isNotNull() & F.col(context_col).isNotNull()).select(id_col, question_col, context_col)
    shared = rows.sparkSession.sparkContext.broadcast((trie(vocabulary), vocabulary.index("[UNK]")))
    schema = both.select(id_col, *(F.lit(None).cast(t).alias(c) for c, t in (("span_idx", "int"), ("input", "array<int>"), ("segment", "array<int>"), ("first", "int"), ("offsets", "array<struct<start:int,end:int>>")))).schema

    def lists(offsets, values):
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

    def run(batches):
        t, other = shared.value
        for b in _slices(batches, [question_col, context_col]):
            q_at, q, *_ = _cut(b.column(question_col), t, other, lower)
            c_at, c, _, low, high = _cut(b.column(context_col), t, other, lower)
            asked, n = np.minimum(np.diff(q_at), most_question), np.diff(c_at)
            room = np.maximum(length - 3 - asked, 1)
            windows = np.maximum(0, -(-(n - room) // stride)) + 1
            # some windows at a time: where strides are short they hold many times their text
            for rows_ in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(np.cumsum(windows * room) // SLICE)) + 1):
                row = np.repeat(rows_, windows[rows_])
                span = _runs(np.zeros(len(rows_), np.int64), windows[rows_])
                first = span * stride
                size = np.clip(n[row] - first, 0, room[row])
                whole = asked[row] + size + 3
                ends = np.append(0, np.cumsum(whole))
                tokens = np.full(ends[-1], between, np.int32)
                tokens[ends[:-1]] = mark
                tokens[_runs(ends[:-1] + 1, asked[row])] = q[_runs(q_at[row], asked[row])]
                part = _runs(c_at[row] + first, size)
                tokens[_runs(ends[:-1] + asked[row] + 2, size)] = c[part]
                segment = np.zeros(ends[-1], np.int32)
                segment[_runs(ends[:-1] + asked[row] + 2, size + 1)] = 1
                places = pa.StructArray.from_arrays([pa.array(low[part]), pa.array(high[part])], ["start", "end"])
                columns = [b.column(id_col).take(pa.array(row)), pa.array(span.astype(np.int32)), lists(ends, pa.array(tokens)), lists(ends, pa.array(segment)), pa.array(first.astype(np.int32)), lists(np.append(0, np.cumsum(size)), places)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return both.mapInArrow(run, schema)
