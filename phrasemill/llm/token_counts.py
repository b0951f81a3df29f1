"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

Texts are cut into pre-tokens where no piece of the vocabulary can reach across, equal pre-tokens are
found by dictionary encoding, and the distinct ones are merged together: their symbols lie in one ragged
array, and in each round every sequence applies its own lowest-rank pair. What counts is how many symbols
survive; characters outside the vocabulary fall back to their UTF-8 bytes.

A sequence applies all occurrences of its pair at once where the merged piece cannot form a pair of a
lower rank, and otherwise only the leftmost, which is the order the library follows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrow as A

#: Pre-tokens whose counts a worker remembers; beyond them its memory begins anew. It bounds memory only.
REMEMBERED = 400_000
_NONE = np.int64(1) << 40
#: Characters from which a pre-token is merged on its own, its pairs kept by rank.
LONG = 2048
_MARK = "▁"

_loaded: dict[str, "Counter"] = {}


def counter(path: str) -> "Counter":
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


class Counter:
    """Counts tokens as the model's library does, without begin and end tokens."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        piece = {model.id_to_piece(i): i for i in normal}
        if any(model.is_unused(i) for i in normal) or any(_MARK in p.lstrip(_MARK) for p in piece):
            raise NotImplementedError("pieces that are unused, or hold a space after other characters")
        # lower score, higher rank; equal scores share a rank
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rank = {p: rank_of[model.get_score(i)] for p, i in piece.items()}
        shared = np.bincount(list(rank.values()), minlength=len(scores))
        symbol = dict(piece)  # pieces, and the characters in them that aren't pieces
        for p in piece:
            for c in p:
                symbol.setdefault(c, n + len(symbol))
        chars = sorted((ord(c), s) for c, s in symbol.items() if len(c) == 1)
        self.points, self.char_symbol = (np.array(x, np.int64) for x in zip(*chars, strict=True))
        top = max(symbol.values()) + 1
        self.unknown = top  # plus the number of UTF-8 bytes
        self.cost = np.ones(top + 5, np.int64)
        for c, s in symbol.items():
            if c not in piece:
                self.cost[s] = len(c.encode())
        self.cost[top : top + 5] = np.arange(5)
        self.width = top + 5
        keys, ranks, merged, lowest = [], [], [], {}
        for p, i in piece.items():
            for k in range(1, len(p)):
                x, y = p[:k], p[k:]
                if x in symbol and y in symbol:
                    keys.append(symbol[x] * self.width + symbol[y])
                    ranks.append(rank[p])
                    merged.append(i)
                    for part in (x, y):
                        lowest[part] = min(lowest.get(part, 1 << 40), rank[p])
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = (np.array(x, np.int64)[order] for x in (keys, ranks, merged))
        self.safe = np.zeros(self.width, bool)
        for p, i in piece.items():
            self.safe[i] = lowest.get(p, 1 << 40) > rank[p] and shared[rank[p]] == 1
        self.barrier = "\n" not in symbol
        self.known: dict[bytes, int] = {}
        probe = ["", " ", "a  b\n c", "<s> ﬁ日本 ", "ein zwei drei vier"]
        if [len(x) for x in model.encode(probe, num_threads=1)] != self.count(pa.array(probe)).tolist():
            raise NotImplementedError("a model that normalises or splits in other ways")

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def _symbols(self, string: str) -> np.ndarray:
        flat = np.frombuffer(string.encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(flat):
            return flat
        at = np.minimum(np.searchsorted(self.points, flat), len(self.points) - 1)
        bytes_of = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
        return np.where(self.points[at] == flat, self.char_symbol[at], self.unknown + bytes_of)

    def _merge_long(self, string: str) -> int:
        """One long sequence, by the same rounds: places of pairs are kept by rank, so that a round costs as
        much as it merges, not as much as the sequence is long."""
        symbols = self._symbols(string)
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank, merged = np.full(n, _NONE), np.zeros(n, np.int64)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def found(at: np.ndarray) -> None:
            """Look up the pairs that begin at these places and keep them by rank."""
            inner = at[after[at] < n]
            rank[at] = _NONE
            rank[inner], merged[inner] = self._pairs(symbols[inner], symbols[after[inner]])
            inner = inner[rank[inner] != _NONE]
            inner = inner[np.argsort(rank[inner], kind="stable")]
            for part in np.split(inner, np.flatnonzero(np.diff(rank[inner])) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in places:
                        places[r] = []
                        heapq.heappush(ranks, r)
                    places[r].append(part)

        found(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if self.safe[merged[at]].all():
                # of occurrences that overlap, every other one from the left
                joint = np.zeros(len(at), bool)
                joint[1:] = after[at[:-1]] == at[1:]
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(joint, 0, index))) % 2 == 0]
            else:
                places[r] = [at[1:]]
                heapq.heappush(ranks, r)
                at = at[:1]
            gone = after[at]
            symbols[at], alive[gone], after[at] = merged[at], False, after[gone]
            rest = after[at] < n
            before[after[at][rest]] = at[rest]
            found(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return int(self.cost[symbols[alive]].sum())

    def merge(self, strings: list[str]) -> np.ndarray:
        """Symbols that survive in each string."""
        result = np.zeros(len(strings), np.int64)
        for i in [i for i, x in enumerate(strings) if len(x) > LONG]:
            result[i] = self._merge_long(strings[i])
            strings = [*strings[:i], "", *strings[i + 1 :]]
        symbols = self._symbols("".join(strings))
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        if not len(symbols):
            return result
        names = np.flatnonzero(sizes)
        sizes = sizes[names]
        first = np.cumsum(sizes) - sizes
        rank, merged = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        rank[:-1], merged[:-1] = self._pairs(symbols[:-1], symbols[1:])
        rank[first + sizes - 1] = _NONE  # no pair across sequences
        while len(names):
            low = np.minimum.reduceat(rank, first)
            done = low == _NONE
            if done.any():
                result[names[done]] = np.add.reduceat(self.cost[symbols], first)[done]
                keep = np.repeat(~done, sizes)
                symbols, rank, merged = symbols[keep], rank[keep], merged[keep]
                names, sizes, low = names[~done], sizes[~done], low[~done]
                if not len(names):
                    break
                first = np.cumsum(sizes) - sizes
            seq = np.repeat(np.arange(len(names)), sizes)
            place = np.flatnonzero(rank == low[seq])
            leader = np.ones(len(place), bool)
            leader[1:] = seq[place[1:]] != seq[place[:-1]]
            # of occurrences that overlap, every other one from the left
            joint = np.zeros(len(place), bool)
            joint[1:] = (place[1:] == place[:-1] + 1) & ~leader[1:]
            index = np.arange(len(place))
            run = np.maximum.accumulate(np.where(joint, 0, index))
            place = place[leader | (self.safe[merged[place]] & ((index - run) % 2 == 0))]
            symbols[place] = merged[place]
            gone = np.zeros(len(symbols), bool)
            gone[place + 1] = True
            last = rank[place + 1]  # whether a pair followed is found anew below
            rank[place] = last
            sizes = sizes - np.bincount(seq[place], minlength=len(names))
            stay = ~gone
            moved = np.cumsum(stay) - 1
            symbols, rank, merged = symbols[stay], rank[stay], merged[stay]
            first = np.cumsum(sizes) - sizes
            ends = np.zeros(len(symbols), bool)
            ends[first + sizes - 1] = True
            begins = np.zeros(len(symbols), bool)
            begins[first] = True
            new = moved[place]
            again = np.unique(np.concatenate([new, new[~begins[new]] - 1]))
            inner = again[~ends[again]]
            rank[again] = _NONE
            rank[inner], merged[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        return result

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a null text has none."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = pc.replace_substring(texts, _MARK, " ")  # the model sees the same symbol
        data, offsets = A.text_buffer(texts)
        total = np.zeros(len(texts), np.int64)
        if not len(data):
            return total
        space = data == 32
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1]
        if self.barrier:
            line = data == 10
            cut |= line
            cut[1:] |= line[:-1]
        begin = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[begin] = True
        place = np.flatnonzero(cut)
        pieces = A.binary_array(data, np.append(place, len(data)))
        first = np.searchsorted(place, offsets)
        heads = np.zeros(len(place), bool)  # a text's first piece follows a space of the model's own
        heads[np.searchsorted(place, begin)] = True
        led = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), pieces.filter(pa.array(heads)), pa.scalar(b"", pa.large_binary()))
        index, distinct = A.encoded(pa.chunked_array([pieces, led]).combine_chunks())
        names = distinct.to_pylist()
        if len(self.known) + len(names) > REMEMBERED:
            self.known = {}
        new = [p for p in names if p not in self.known]
        if new:
            self.known.update(zip(new, self.merge([p.decode().replace(" ", _MARK) for p in new]).tolist(), strict=True))
        found = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[index]
        each = found[: len(pieces)]
        each[heads] = found[len(pieces) :]
        return A.sums(each, first)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty: no bytes, no tokens. Very long texts are counted whole, an empty table gives
    no rows, there are no ties to decide. Repeated rows and null ids stay as they are; other
    columns of ``docs`` are ignored whatever their names. No shuffle: one pass over the texts.
    """

    def run(batches):
        tool = counter(model_path)
        for b in A.chunks(batches, "text"):
            n = tool.count(b.column("text"))
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), size, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
