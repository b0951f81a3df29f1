"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct piece encoded once.

The library's pattern never lets a token reach from a character that is no white space into white space,
nor from an ASCII letter or digit into ASCII punctuation. Cutting texts there leaves every id as it is,
so that repeated pieces are looked up and the library sees only pieces that a worker has not met lately.
Texts in which that argument may fail (other Unicode white space, rare control characters, the special
token's own string) go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _arrow as A

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces that a worker remembers; beyond them its memory begins anew. This bounds memory, not results.
REMEMBERED = 400_000
#: Pieces that go to the library as one text.
RUN = 512
_ODD = "[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{2064}\\x{3000}\\x{feff}]"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _ALNUM[_a:_b] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:127] = True
_PUNCT &= ~_ALNUM

_loaded: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a vocabulary file; it outlives tasks where workers are reused."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # every character of a byte-level token stands for one byte
        self.bytes_of = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces. Those that begin with white space and end without it keep their ids side by
        side, so they go to the library as long texts, cut again by the byte lengths of the tokens."""
        joined = [p for p in pieces if _SPACE[p[0]] and not _SPACE[p[-1]]]
        alone = [p for p in pieces if not _SPACE[p[0]] or _SPACE[p[-1]]]
        runs = [joined[i : i + RUN] for i in range(0, len(joined), RUN)]
        found = self.library.encode_batch_fast([b"".join(r).decode() for r in runs] + [p.decode() for p in alone], add_special_tokens=False)
        ids = [np.array(e.ids, self.flat.dtype) for e in found]
        flat = np.concatenate(ids)
        size = np.fromiter(map(len, [*joined, *alone]), np.int64, len(pieces))
        ends = np.searchsorted(np.cumsum(self.bytes_of[flat]), np.cumsum(size)) + 1
        lengths = np.diff(ends, prepend=0)
        n, total = len(self.known), len(flat)
        if ends[-1] != total:
            raise ValueError("tokens don't add up to their pieces' bytes")
        while n + len(pieces) > len(self.start):
            self.start, self.length = np.append(self.start, np.zeros_like(self.start)), np.append(self.length, np.zeros_like(self.length))
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.start[n : n + len(pieces)] = self.used + ends - lengths
        self.length[n : n + len(pieces)] = lengths
        self.flat[self.used : self.used + total] = flat
        self.used += total
        self.known.update(zip([*joined, *alone], range(n, n + len(pieces)), strict=True))

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        data, offsets = A.text_buffer(texts)
        if not len(data):
            return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
        space = _SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (_PUNCT[data[1:]] & _ALNUM[data[:-1]])
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        place = np.flatnonzero(cut)
        return A.binary_array(data, np.append(place, len(data))), np.searchsorted(place, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (one more entry)."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", texts) if len(whole) else texts
        pieces, first = self._pieces(plain)
        index, distinct = A.encoded(pieces)
        names = distinct.to_pylist()
        if len(self.known) + len(names) > REMEMBERED:
            self._forget()
        new = [p for p in names if p not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        starts, lengths = self.start[at][index], self.length[at][index]
        ids = self.flat[A.ragged(starts, lengths)]
        counts = A.sums(lengths, first)
        if len(whole):
            slow = self.library.encode_batch_fast([texts[int(i)].as_py() for i in whole], add_special_tokens=False)
            bounds = np.append(0, np.cumsum(counts))
            parts, last = [], 0
            for i, e in zip(whole, slow, strict=True):
                parts += [ids[bounds[last] : bounds[i]], np.array(e.ids, self.flat.dtype)]
                counts[i] = len(e.ids)
                last = i
            ids = np.concatenate([*parts, ids[bounds[last] :]])
        return ids, np.append(0, np.cumsum(counts)).astype(np.int64)
