"""Language-model scores from a probabilistic suffix tree over words.

The model. A context is the last ``d`` words before a token, within its document, ``d`` from 0 (the root) to
``DEPTH``; its parent is the same without its oldest word. ``c(s, x)`` counts training places of token ``x``
behind ``s``, ``N(s)`` is their sum and ``T(s)`` the number of distinct ``x``. A context grows only if it was
seen ``SUPPORT`` times, and is retained if its next symbols diverge from its parent's by ``DIVERGENCE`` nats:

    sum over x of (c(s, x) - 1) * ln((c(s, x) / N(s)) / (c(p, x) / N(p))) >= DIVERGENCE

a likelihood ratio in which the first occurrence of every distinct next symbol is set aside as the price of
naming it, so that a context of single, different symbols shows no divergence. Retained distributions are
smoothed by absolute discounting into the next shorter retained context, down to the add-one distribution
of the root; a token is scored by its longest retained context. No word is exempt from any of this.

Where it is computed. Documents are cut into chunks, tables of numbers in the shared folder. Contexts that
occur so often that one task could not hold them (the crown of the tree: the root and a bounded list) are
counted by next symbol; every other context lies, with all its extensions, in the bucket of its shortest
suffix outside the crown. Chunks send their distinct places (next token and the words before it) with
counts to those buckets, which grow the tree and answer with probabilities. The crown only decides where
something is computed, never what.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrow as A
from ._store import bucketed, shuffle_partitions

DEPTH, SUPPORT = 3, 2
DIVERGENCE, DISCOUNT = 2.0, 0.75
#: Text of a chunk, distinct places of a bucket, and tokens asked of a bucket of the root, about.
CHUNK_TEXT, BUCKET_RECORDS, BUCKET_NAMES = 3 << 20, 400_000, 1_000_000
#: Chunks (of one part of the input) that ask and are answered together, at most.
GROUP = 8
#: Ids whose counts every task knows, and contexts of the crown, at most.
CODES, MAX_CROWN = 1 << 16, 100_000
#: Words that chunks name by a number, and the text (a sample by id) in which they are found to be common.
COMMON, SAMPLE_TEXT = 1 << 18, 128 << 20
#: Text that is cut into words at once.
PIECE_TEXT = 1 << 20
#: Ids of words: none (before a document, or too rare to be in a context) and any never learnt.
_NONE, _UNKNOWN = 0, 1
_END = np.uint64(0x5BD1E995A1B2C3D4)
_M = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 by 7."""
    return F.coalesce(F.crc32(id_.cast("string")) % 7 == 2, F.lit(False))


def _base(width: int) -> int:
    return 1 if width == 1 else 2 if width == 2 else 4 if width <= 4 else 8


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers by planes of their bytes, as many as the largest needs, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    base = _base(width)
    v = np.ascontiguousarray(values, dtype=f"<u{base}")
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, base)[:, :width].T)
    return len(v).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    raw = np.frombuffer(pa.decompress(memoryview(data)[9:], decompressed_size=n * width, codec="zstd"), np.uint8)
    base = _base(width)
    out = np.zeros((n, base), np.uint8)
    for i in range(width):
        out[:, i] = raw[i * n : (i + 1) * n]
    return out.view(f"<u{base}").ravel()


def _all(blobs) -> np.ndarray:
    return np.concatenate([_unpack(x) for x in blobs]).astype(np.int64) if len(blobs) else np.zeros(0, np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, by key, and which of them each key is."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    if not len(values):
        return []
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return list(zip(begin.tolist(), np.append(begin[1:], len(values)).tolist(), strict=True))


def _find(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The place of each value in an ordered list, -1 where it is missing."""
    if not len(ordered):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def _longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts with one more, older word."""
    with np.errstate(over="ignore"):
        return A.mixed(context * _M + word)


def _divergence(count: np.ndarray, of_parent: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The part of each context's divergence that is a sum over its next symbols."""
    again = np.flatnonzero(count > 1)
    k = count[again]
    return np.bincount(group[again], weights=(k - 1) * (np.log(k) - np.log(of_parent[again])), minlength=groups)


def _retained(part: np.ndarray, n: np.ndarray, types: np.ndarray, n_parent: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = part - (n - types) * (np.log(n) - np.log(n_parent))
    return (n >= SUPPORT) & (gain >= DIVERGENCE)


def _smoothed(count: np.ndarray, n: np.ndarray, types: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    return (np.maximum(count - DISCOUNT, 0) + DISCOUNT * types * shorter) / n


# --- chunks ---------------------------------------------------------------------------------------------


def _common(rows: DataFrame, size: int) -> np.ndarray:
    """Hashes of words that are common in a sample of the documents, the most frequent first. They only
    shorten what chunks send: a word is named by its number here, or else by its hash."""

    def run(batches):
        for b in A.chunks(batches, "text", PIECE_TEXT):
            index, distinct = A.encoded(A.words(b.column("text"), A.SPACED)[0])
            count = np.bincount(index, minlength=len(distinct))
            top = np.argsort(-count, kind="stable")[:COMMON]
            yield pa.RecordBatch.from_arrays([pa.array(A.mixed(A.hashes(distinct))[top].view(np.int64)), pa.array(count[top].astype(np.int64))], ["name", "n"])

    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, size // SAMPLE_TEXT))) == 0).select("text")
    seen = sample.mapInArrow(run, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    top = seen.where("n > 1").orderBy(F.col("n").desc(), "name").limit(COMMON - 1).collect()
    return np.append(_END, np.array([r["name"] for r in top], np.int64).view(np.uint64))


def _names(common: np.ndarray, known: bytes, others: bytes) -> np.ndarray:
    return np.concatenate([common[np.cumsum(_unpack(known).astype(np.int64))], np.frombuffer(others, np.uint64)])


def _chunks(rows: DataFrame, chunk_text: int, common: np.ndarray) -> DataFrame:
    """Documents as numbers, a row for each chunk: ids, train flags, tokens of each document, the chunk's
    distinct tokens (common ones, by number, then the others, by hash, the frequent ones first), their
    counts in training documents, and all tokens as places in that list."""
    kind = rows.schema["id"].dataType.simpleString()
    by_hash = np.argsort(common)
    shared = rows.sparkSession.sparkContext.broadcast((common[by_hash], by_hash))

    def encode(key: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sizes, indices, names = [], [], []
        for piece in A.chunks(parts, "text", PIECE_TEXT):
            words, first = A.words(piece.column("text"), A.SPACED)
            index, distinct = A.encoded(words)
            size = np.diff(first) + 1
            at = np.full(len(index) + len(size), len(distinct), np.int32)
            inside = np.ones(len(at), bool)
            inside[np.cumsum(size) - 1] = False
            at[inside] = index
            sizes.append(size)
            indices.append(at)
            names.append(np.append(A.mixed(A.hashes(distinct)), _END))
        pick, inverse = _distinct(np.concatenate(names))
        begin = np.cumsum([0, *map(len, names)])
        tokens = np.concatenate([inverse[a + x].astype(np.int32) for a, x in zip(begin, indices, strict=False)])
        names, size = np.concatenate(names)[pick], np.concatenate(sizes)
        table = pa.Table.from_batches([p.select(["id", "train"]) for p in parts])
        ordered, number = shared.value
        known = _find(names, ordered)
        known = np.where(known >= 0, number[known], len(number))
        order = np.lexsort((-np.bincount(tokens, minlength=len(names)), known))
        known = known[order]
        known = known[known < len(number)]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        tokens = rank[tokens]
        names = names[order]
        train = np.asarray(table.column("train").to_numpy())
        counts = np.bincount(tokens[np.repeat(train, size)], minlength=len(names))
        ids = pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type))
        data = [_pack(train), _pack(size), _pack(np.diff(known, prepend=0)), names[len(known) :].tobytes(), _pack(counts), _pack(tokens)]
        group = (key >> 32 << 32) + (key & 0xFFFFFFFF) // GROUP
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([key], pa.int64()), ids, *(pa.array([x], pa.binary()) for x in data), pa.array([int(counts.sum())], pa.int64()), pa.array([len(names)], pa.int64())], ["group", "chunk", "ids", "train", "size", "known", "names", "counts", "tokens", "n", "distinct"])

    def run(batches):
        key, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for b in A.chunks(batches, "text", chunk_text):
            nbytes = b.column("text").nbytes
            if parts and held + nbytes > chunk_text:
                yield encode(key, parts)
                key, parts, held = key + 1, [], 0
            parts.append(b)
            held += nbytes
        if parts:
            yield encode(key, parts)

    return rows.mapInArrow(run, f"group bigint, chunk bigint, ids array<{kind}>, train binary, size binary, known binary, names binary, counts binary, tokens binary, n bigint, distinct bigint")


class Places:
    """The places of a chunk: the token at each, its place in the document, whether it is learnt."""

    def __init__(self, row: dict):
        self.size, self.tokens = _unpack(row["size"]).astype(np.int64), _unpack(row["tokens"]).astype(np.int32)
        self.doc_train = _unpack(row["train"]).astype(bool)
        self.train = np.repeat(self.doc_train, self.size)
        begin = np.cumsum(self.size) - self.size
        self.before = (np.arange(len(self.tokens)) - np.repeat(begin, self.size)).astype(np.int32)

    def crowned(self, crown: np.ndarray, names: np.ndarray):
        """By depth: places whose context of that depth is in the crown, and which one it is. ``names`` are
        what the hashes of the contexts are made of, by token."""
        # only words in contexts of depth one can begin any
        first = _find(_longer(np.zeros(len(names), np.uint64), names), crown)
        at = np.flatnonzero(self.before >= 1)
        found = first[self.tokens[at - 1]]
        at, found = at[found >= 0], found[found >= 0]
        out = [(at, found)]
        for depth in range(2, DEPTH + 1):
            inside = self.before[at] >= depth
            at, context = at[inside], crown[found[inside]]
            found = _find(_longer(context, names[self.tokens[at - depth]]), crown)
            at, found = at[found >= 0], found[found >= 0]
            out.append((at, found))
        return out


class Contexts:
    """The crown: hashes of contexts in order, the place of each one's parent (-1: the root), depth, and the
    word that the parent lacks."""

    def __init__(self, rows: list):
        found = {}
        for r in sorted(rows, key=lambda r: r["depth"]):
            if r["depth"] == 1 or r["parent"] in found:
                found[r["context"]] = (r["parent"], r["depth"], r["word"])
        self.hashes = np.sort(np.array(list(found), np.int64).view(np.uint64))
        rest = [found[x] for x in self.hashes.view(np.int64).tolist()]
        above, self.depth, words = (np.array([r[i] for r in rest], np.int64) for i in range(3))
        self.word = words.view(np.uint64)
        self.parent = np.where(self.depth > 1, _find(above.view(np.uint64), self.hashes), -1)


def _crown(chunks: DataFrame, common: np.ndarray, total: int, limit: int, least: int) -> Contexts:
    """The contexts that occur about ``limit`` times or more. One is found if it makes up enough of some
    chunks; with each its parent is found."""
    shared = chunks.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p, names, counts = Places(row), _names(shared.value, row["known"], row["names"]), _unpack(row["counts"])
                enough = max(least, limit * row["n"] / max(1, total) / 2)
                # every word but the end is the context of a token as often as it occurs
                often = np.flatnonzero((counts >= enough) & (names != _END))
                first = _longer(np.zeros(len(often), np.uint64), names[often])
                yield _found(first, np.zeros(len(often), np.uint64), 1, counts[often], names[often])
                hot = np.zeros(len(names), bool)
                hot[often] = True
                at = np.flatnonzero(p.train & (p.before >= 1))
                at = at[hot[p.tokens[at - 1]]]
                context = _longer(np.zeros(len(at), np.uint64), names[p.tokens[at - 1]])
                for depth in range(2, DEPTH + 1):
                    inside = p.before[at] >= depth
                    at, parent = at[inside], context[inside]
                    context = _longer(parent, names[p.tokens[at - depth]])
                    pick, inverse = _distinct(context)
                    n = np.bincount(inverse, minlength=len(pick))
                    often = n >= enough
                    pick, n = pick[often], n[often]
                    yield _found(context[pick], parent[pick], depth, n, names[p.tokens[at[pick] - depth]])
                    at, context = at[often[inverse]], context[often[inverse]]

    def _found(context, parent, depth, n, word):
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (context, parent, word)] + [pa.array(np.full(len(context), depth, np.int32)), pa.array(n.astype(np.int64))], ["context", "parent", "word", "depth", "n"])

    seen = chunks.select("known", "names", "counts", "size", "tokens", "train", "n").mapInArrow(run, "context bigint, parent bigint, word bigint, depth int, n bigint")
    most = seen.groupBy("context", "parent", "word", "depth").agg(F.sum("n").alias("n")).where(F.col("n") >= limit)
    return Contexts(most.orderBy(F.col("n").desc(), "depth", "context").limit(MAX_CROWN).collect())


# --- counts of the root and the crown, by next symbol ----------------------------------------------------

def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return (A.mixed(names ^ _M) % np.uint64(buckets)).astype(np.int64)


_ASKED = ["group", "chunk", "bucket", "known", "names", "counts", "place", "context", "next", "pairs"]
_COUNTED = "group bigint, chunk bigint, bucket bigint, place binary, totals binary, ids binary, context binary, next binary, pairs binary, n bigint, v bigint, names array<bigint>, of array<bigint>, counts array<bigint>, contexts array<bigint>, sums array<bigint>, types array<bigint>, part array<double>"


def _counted(chunks: DataFrame, common: np.ndarray, crown: Contexts, buckets: int) -> DataFrame:
    """For each chunk and bucket of next symbols, the totals and ids of the chunk's tokens and the totals of
    its (crown context, next) pairs; and a row for each bucket with its statistics. Ids are dense over all
    buckets, the frequent words' are small."""
    shared = chunks.sparkSession.sparkContext.broadcast((crown, common))

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                crown, common = shared.value
                places, names, counts = Places(row), _names(common, row["known"], row["names"]), _unpack(row["counts"])
                known = np.cumsum(_unpack(row["known"]).astype(np.int64))
                bucket = _bucket(names, buckets)
                order = np.argsort(bucket, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                levels = places.crowned(crown.hashes, names)
                at, context = (np.concatenate([x[i] for x in levels]) for i in (0, 1))
                wide = len(crown.hashes) + 1
                # next symbols by their rank: so pairs are ordered by bucket as well
                key = rank[places.tokens[at]] * wide + context
                pick, inverse = _distinct(key)
                nxt, context = key[pick] // wide, key[pick] % wide
                pairs = np.bincount(inverse, weights=places.train[at], minlength=len(pick)).astype(np.int64)
                out = []
                for a, b in _runs(bucket[order]):
                    x, y = np.searchsorted(nxt, [a, b])
                    mine = order[a:b]
                    out.append((row["group"], row["chunk"], int(bucket[mine[0]]), _pack(np.diff(known[mine[mine < len(known)]], prepend=0)), names[mine[mine >= len(known)]].tobytes(), _pack(counts[mine]), _pack(np.diff(mine[mine >= len(known)], prepend=0)), _pack(context[x:y]), _pack(nxt[x:y] - a), _pack(pairs[x:y])))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], _ASKED)

    def add(group: pa.Table) -> pa.Table:
        crown, common = shared.value
        wide, m = len(crown.hashes) + 1, len(crown.hashes)
        got = group.to_pydict()
        each = [_names(common, x, y) for x, y in zip(got["known"], got["names"], strict=True)]
        every = np.concatenate(each)
        pick, inverse = _distinct(every)
        names = every[pick]
        total = np.bincount(inverse, weights=_all(got["counts"]), minlength=len(names)).astype(np.int64)
        order = np.lexsort((names, -total))
        ids = np.empty(len(names), np.int64)
        ids[order] = 2 + np.arange(len(names)) * buckets + got["bucket"][0]
        ids[total == 0] = _UNKNOWN
        begin = np.cumsum([0, *map(len, each)])
        contexts, nexts = [_unpack(x) for x in got["context"]], [_unpack(x) for x in got["next"]]
        asked = np.concatenate([inverse[a + x] for a, x in zip(begin, nexts, strict=False)]) * wide + np.concatenate(contexts)
        one, place = _distinct(asked)
        key = asked[one]
        count = np.bincount(place, weights=_all(got["pairs"]), minlength=len(key)).astype(np.int64)
        of, context = key // wide, key % wide
        up = crown.parent[context] if m else context
        # the pair of the parent context lies here too, as its next symbol is the same
        above = total[of] if len(of) else of
        deeper = np.flatnonzero(up >= 0)
        above[deeper] = count[_find(of[deeper] * wide + up[deeper], key)]
        part = _divergence(count, above, context, m)
        sums = np.bincount(context, weights=count, minlength=m).astype(np.int64)
        types = np.bincount(context[count > 0], minlength=m)
        there = np.flatnonzero(sums)
        listed = np.flatnonzero((total > 0) & ((ids < CODES) | np.isin(names, crown.word) | np.isin(names, common)))
        stats = [[int(total.sum())], [int((total > 0).sum())], *([x.tolist()] for x in (names[listed].view(np.int64), ids[listed], total[listed], there, sums[there], types[there], part[there]))]
        ends = np.cumsum([0, *map(len, contexts)])
        # all tasks are told of common words, only others are answered here
        spans = [(b - len(x) // 8, b) for b, x in zip(begin[1:], got["names"], strict=True)]
        pairs = list(zip(ends, ends[1:], strict=False))
        blobs = [got["place"], [_pack(total[inverse[a:b]]) for a, b in spans], [_pack(ids[inverse[a:b]]) for a, b in spans], got["context"], got["next"], [_pack(count[place[a:b]]) for a, b in pairs]]
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 6, pa.list_(pa.float64())]
        columns = [pa.array(got["group"] + [None], pa.int64()), pa.array(got["chunk"] + [None], pa.int64()), pa.array(got["bucket"] + [got["bucket"][0]], pa.int64())]
        columns += [pa.array([*x, None], pa.binary()) for x in blobs]
        columns += [pa.array([None] * len(each) + x, k) for x, k in zip(stats, kinds, strict=True)]
        return pa.table(columns, names=[c.split()[0] for c in _COUNTED.split(", ")])

    asked = chunks.mapInArrow(ask, ", ".join(f"{c} {'bigint' if i < 3 else 'binary'}" for i, c in enumerate(_ASKED)))
    return asked.groupBy("bucket").applyInArrow(add, _COUNTED)


class Crown:
    """What every task knows: statistics of the crown's contexts, counts of the smallest ids, counts and ids
    of common words. Contexts are in the order of their hashes over ids."""

    def __init__(self, counted: DataFrame, found: Contexts, common: np.ndarray, buckets: int):
        stats = counted.where("chunk IS NULL")
        row = stats.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        self.n, self.v = row["n"] or 0, row["v"] or 0
        self.counts, ids = np.zeros(CODES, np.int64), {}
        by_hash = np.argsort(common)
        self.common_total, self.common_ids = np.zeros(len(common), np.int64), np.full(len(common), _UNKNOWN)
        self.common_bucket = _bucket(common, buckets)
        for row in stats.select("names", "of", "counts").toLocalIterator():
            names, of, counts = (np.array(x, np.int64) for x in row)
            self.counts[of[of < CODES]] = counts[of < CODES]
            at = _find(names.view(np.uint64), common[by_hash])
            self.common_total[by_hash[at[at >= 0]]], self.common_ids[by_hash[at[at >= 0]]] = counts[at >= 0], of[at >= 0]
            mine = np.flatnonzero(np.isin(names.view(np.uint64), found.word))
            ids |= dict(zip(names[mine].tolist(), of[mine].tolist(), strict=True))
        m = len(found.hashes)
        sums, types, part = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
        each = stats.select(F.explode(F.arrays_zip("contexts", "sums", "types", "part")).alias("t")).groupBy("t.contexts")
        for c, s, t, p in each.agg(F.sum("t.sums"), F.sum("t.types"), F.sum("t.part")).collect():
            sums[c], types[c], part[c] = s, t, p
        kept = _retained(part, sums, types, np.where(found.parent < 0, self.n, sums[found.parent] if m else 0))
        hashes = np.zeros(m + 1, np.uint64)
        for i in np.argsort(found.depth, kind="stable").tolist():
            word = np.array([ids[int(found.word[i : i + 1].view(np.int64)[0])]], np.uint64)
            hashes[i : i + 1] = _longer(hashes[found.parent[i]][None], word)
        order = np.argsort(hashes[:m])
        #: From the order of the words' hashes, in which pairs are counted, to the one used here.
        self.order = order
        self.hashes, self.depth, self.sums, self.types, self.kept = hashes[:m][order], found.depth[order], sums[order], types[order], kept[order]

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.n + self.v + 1)


# --- the rest of the tree, by bucket of contexts ----------------------------------------------------------


class Prepared:
    """A chunk's tokens with all that the crown says of them, and the distinct places to be asked."""

    def __init__(self, row: dict, answers: list[dict], crown: Crown, buckets: int):
        self.places = places = Places(row)
        tokens = places.tokens
        known = np.cumsum(_unpack(row["known"]).astype(np.int64))
        n_names = len(known) + sum(int.from_bytes(x["place"][:8], "little") for x in answers)
        total, ids = np.zeros(n_names, np.int64), np.zeros(n_names, np.int64)
        total[: len(known)], ids[: len(known)] = crown.common_total[known], crown.common_ids[known]
        of_bucket = crown.common_bucket[known]
        nxt, context, pairs = [], [], []
        for x in answers:
            at = np.cumsum(_unpack(x["place"]).astype(np.int64))
            total[at], ids[at] = _unpack(x["totals"]), _unpack(x["ids"])
            nxt.append(np.append(np.flatnonzero(of_bucket == x["bucket"]), at)[_unpack(x["next"])])
            context.append(_unpack(x["context"]))
            pairs.append(_unpack(x["pairs"]))
        names = ids.astype(np.uint64)
        self.seen = total[tokens]
        self.p = crown.root(self.seen)
        count, deep = self.seen.copy(), np.full(len(tokens), -1, np.int32)
        wide = len(crown.hashes) + 1
        key, pairs = np.concatenate(nxt) * wide + np.concatenate(context), np.concatenate(pairs)
        order = np.argsort(key)
        key, pairs = key[order], pairs[order]
        for at, context in places.crowned(crown.hashes, names):
            mine = pairs[np.searchsorted(key, tokens[at] * np.int64(wide) + crown.order[context])] if len(at) else pairs[:0]
            mine = mine.astype(np.int64)
            count[at], deep[at] = mine, context
            kept = crown.kept[context]
            at, context = at[kept], context[kept]
            self.p[at] = _smoothed(mine[kept], crown.sums[context], crown.types[context], self.p[at])
        depth = np.append(crown.depth, 0)[deep]
        # a context occurs no more often than its words: one with too rare a word needs no asking
        rare = total < SUPPORT
        at = np.flatnonzero((depth < DEPTH) & (places.before > depth))
        at = at[~rare[tokens[at - depth[at] - 1]]]
        depth = depth[at]
        # the bucket is that of the shortest suffix outside the crown, a range of its hash
        route = np.append(crown.hashes, np.uint64(0))[deep[at]]
        route = _longer(route, names[tokens[at - depth - 1]])
        # words after one that is too rare are of no use; contexts in the crown never have such
        words, whole = [ids[tokens[at]].astype(np.uint32)], np.ones(len(at), bool)
        for d in range(1, DEPTH + 1):
            whole &= places.before[at] >= d
            before = tokens[np.maximum(at - d, 0)]
            whole &= ~rare[before]
            words.append(np.where(whole, ids[before], _NONE).astype(np.uint32))
        self.at = at
        bucket = ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        self.pick, self.inverse = _places_by_bucket(bucket, words)
        pick = self.pick
        self.learnt = np.bincount(self.inverse, weights=places.train[at], minlength=len(pick)).astype(np.int64)
        self.words, self.bucket = [w[pick] for w in words], bucket[pick]
        picked = at[pick]
        self.deep, self.count, self.p_sent = deep[picked] + 1, count[picked], self.p[picked]

    def blobs(self):
        """For each bucket: words, places learnt, the crown's context, and what it says of the token."""
        for a, b in _runs(self.bucket):
            block = [w[a:b] for w in self.words]
            deep = self.deep[a:b]
            # counts of the root are known to all for the smallest ids
            sent = (deep > 0) | (block[0] >= CODES)
            yield int(self.bucket[a]), [*map(_steps, block[:2]), *map(_pack, block[2:]), _pack(self.learnt[a:b]), _pack(deep), _steps(self.count[a:b][sent]), _pack(np.diff(self.p_sent[a:b][deep > 0].astype("<f4").view("<u4"), prepend=np.uint32(0)))]


def _places_by_bucket(bucket: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One of each set of places that are equal in all words, and which of them each place is. They are in
    the order of their buckets, last words and next tokens, as they compress well then. Places are told
    apart by a hash that is checked, and drawn anew should two different places share it."""
    near = bucket.astype(np.uint64)
    for w in (words[1], words[0]):
        near = _distinct(near << np.uint64(40) | w)[1].astype(np.uint64)
    for salt in range(1, 100):
        with np.errstate(over="ignore"):
            key = np.full(len(bucket), salt, np.uint64)
            for w in words[2:]:
                key = key * _M + w
                key ^= key >> np.uint64(29)
            pick, inverse = _distinct(near << np.uint64(36) | A.mixed(key) >> np.uint64(28))
        if all((w == w[pick][inverse]).all() for w in words):
            return pick, inverse
    raise ValueError("places can't be told apart")


def _steps(values: np.ndarray) -> bytes:
    """Numbers as differences to the one before, signs in the lowest bit."""
    d = np.diff(values.astype(np.int64), prepend=0)
    return _pack((d << 1) ^ (d >> 63))


def _from_steps(data: bytes) -> np.ndarray:
    d = _unpack(data).astype(np.int64)
    return np.cumsum((d >> 1) ^ -(d & 1))


_BLOB = [*(f"w{d}" for d in range(DEPTH + 1)), "learnt", "deep", "count", "p"]


def grown(words: list[np.ndarray], learnt: np.ndarray, deep: np.ndarray, count: np.ndarray, p: np.ndarray, crown: Crown) -> np.ndarray:
    """The probability of each place by its longest retained context. ``words`` are ids (0: none), first of
    the next token, then of the words before it; ``deep`` is the crown's context (-1: the root) from which
    the tree grows here, ``count`` and ``p`` are what that says of the token."""
    p, count = p.copy(), count.copy()
    depth = np.append(crown.depth, 0)[deep]
    n = np.append(crown.sums, crown.n)[deep]
    group = deep + 1
    n_words = int(max(w.max(initial=0) for w in words)) + 1
    alive = np.ones(len(deep), bool)
    for d in range(1, DEPTH + 1):
        alive &= (depth >= d) | (words[d] > 0)
        at = np.flatnonzero(alive & (depth < d))
        if not len(at):
            continue
        first, mine = _distinct(group[at] * n_words + words[d][at])
        pick, pair = _distinct(mine * n_words + words[0][at])
        each = np.bincount(pair, weights=learnt[at])
        of, groups = mine[pick], len(first)
        sums = np.bincount(of, weights=each, minlength=groups)
        types = np.bincount(of[each > 0], minlength=groups)
        part = _divergence(each, count[at][pick], of, groups)
        kept = _retained(part, sums, types, n[at][first])
        each = each[pair]
        count[at], n[at] = each, sums[mine]
        group[at] = len(crown.hashes) + 1 + mine
        alive[at] = (sums >= SUPPORT)[mine]
        use = kept[mine]
        to, use = at[use], mine[use]
        p[to] = _smoothed(each[kept[mine]], sums[use], types[use], p[to])
    return p


def _answered(got: dict, crown: Crown) -> pa.Table:
    """The logarithms of the probabilities of all places that were sent to a bucket, with 16 bits of
    precision, as differences; 0 where no context here was retained."""
    flat = {k: [x for row in got.pop(k) for x in row] for k in _BLOB}
    words = [np.concatenate([_from_steps(x) for x in flat[f"w{d}"]]) for d in (0, 1)] + [_all(flat.pop(f"w{d}")) for d in range(2, DEPTH + 1)]
    ends = np.cumsum([0, *(int.from_bytes(x[:8], "little") for x in flat["w0"])])
    learnt, deep = _all(flat["learnt"]).astype(np.int32), _all(flat["deep"])
    count = crown.counts[np.minimum(words[0], CODES - 1)]
    count[(deep > 0) | (words[0] >= CODES)] = np.concatenate([_from_steps(x) for x in flat["count"]])
    p = crown.root(count)
    p[deep > 0] = np.concatenate([np.cumsum(_unpack(x), dtype="<u4").view("<f4") for x in flat["p"]])
    better = grown(words, learnt, deep - 1, count, p, crown)
    logs = np.where(better == p, 0, np.minimum(np.log10(better), -1e-30)).astype("<f4").view("<u4")
    logs = (logs + np.uint32(128)) >> np.uint32(8)
    found = [_pack(np.diff(logs[a:b], prepend=np.uint32(0)) & np.uint32(0xFFFFFF)) for a, b in zip(ends, ends[1:], strict=False)]
    at = np.cumsum([0, *map(len, got["chunks"])])
    return pa.table({"group": pa.array(got["group"], pa.int64()), "bucket": pa.array(got["bucket"], pa.int64()), "chunks": pa.array(got["chunks"], pa.list_(pa.int64())), "logs": pa.array([found[a:b] for a, b in zip(at, at[1:], strict=False)], pa.list_(pa.binary()))})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_text: int = CHUNK_TEXT, bucket_records: int = BUCKET_RECORDS, bucket_names: int = BUCKET_NAMES, least: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10).

    A null text is empty: its only token is the end, as of a text without words. A null id is not held out;
    repeated rows are learnt and scored each, whatever their ids. With nothing to learn from, all tokens are
    unknown and share one uniform cell. A text longer than ``chunk_text`` is a chunk of its own, read whole.
    There are no ties to decide. An empty table gives no rows; other columns are ignored.

    ``chunk_text``, ``bucket_records``, ``bucket_names`` and ``least`` (occurrences in a chunk from which a
    context may enter the crown) size the tasks and don't change the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held_out(F.col(id_col))).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(shuffle_partitions(spark), math.ceil(size / chunk_text))
    common = _common(rows, size)
    chunks = bucketed(_chunks(rows, chunk_text, common), "chunks", "group", parts)
    found = chunks.agg(F.sum("n").alias("n"), F.sum("distinct").alias("names")).first()
    total, names = found["n"] or 0, found["names"] or 0
    contexts = _crown(chunks, common, total, max(1, bucket_records // 2), least)
    name_buckets = max(1, math.ceil(names / bucket_names))
    counted = bucketed(_counted(chunks, common, contexts, name_buckets).repartition(parts, "group"), "counted", "group", parts)
    crown = Crown(counted, contexts, common, name_buckets)
    shared = spark.sparkContext.broadcast(crown)
    buckets = max(shuffle_partitions(spark), math.ceil(total / bucket_records))
    dealt = chunks.select("group", "chunk", "ids", "train", "size", "known", "tokens")
    known = ["place", "totals", "ids", "context", "next", "pairs"]
    totals = counted.where("chunk IS NOT NULL").select("group", "chunk", "bucket", *known)

    def prepared(left: pa.Table, right: pa.Table):
        """A group's chunks in order, with what is known of them."""
        of = {}
        for x in right.select(["chunk", "bucket", *known]).to_pylist():
            if x["place"] is not None:
                of.setdefault(x["chunk"], []).append(x)
        for row in sorted(left.to_pylist(), key=lambda r: r["chunk"]):
            yield row, Prepared(row, of.pop(row["chunk"]), shared.value, buckets)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {}
        for row, chunk in prepared(left, right):
            for bucket, blob in chunk.blobs():
                mine = out.setdefault(bucket, ([], [[] for _ in _BLOB]))
                mine[0].append(row["chunk"])
                for column, x in zip(mine[1], blob, strict=True):
                    column.append(x)
            del chunk
        name = left.column("group")[0].as_py() if left.num_rows else None
        columns = [pa.array([name] * len(out), pa.int64()), pa.array(list(out), pa.int64()), pa.array([x[0] for x in out.values()], pa.list_(pa.int64()))]
        columns += [pa.array([x[1][i] for x in out.values()], pa.list_(pa.binary())) for i in range(len(_BLOB))]
        return pa.table(columns, names=["group", "bucket", "chunks", *_BLOB])

    def answer(table: pa.Table) -> pa.Table:
        return _answered(table.to_pydict(), shared.value)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        logs = {}
        answers = right.select(["bucket", "chunks", "logs"]).filter(right.column("logs").is_valid())
        for row in sorted(answers.to_pylist(), key=lambda r: r["bucket"]):
            for chunk, x in zip(row["chunks"], row["logs"], strict=True):
                logs.setdefault(chunk, []).append(x)
        out = []
        for row, chunk in prepared(left, right):
            p = np.concatenate([np.cumsum(_unpack(x), dtype="<u4") << np.uint32(8) for x in logs.get(row["chunk"], [])] or [np.zeros(0, "<u4")]).view("<f4")
            if len(p) != len(chunk.pick):
                raise ValueError("answers don't fit what was asked")
            log_p = np.log10(chunk.p)
            p = p[chunk.inverse]
            log_p[chunk.at] = np.where(p == 0, log_p[chunk.at], p)
            begin = np.append(0, np.cumsum(chunk.places.size))
            ids = pa.array(row["ids"], left.schema.field("ids").type.value_type)
            out.append(pa.table({"id": ids, "train": chunk.places.doc_train, "n_tokens": chunk.places.size, "n_known": A.sums((chunk.seen > 0).astype(np.int64), begin), "base_score": A.sums(np.log10(shared.value.root(chunk.seen)), begin), "score": A.sums(log_p, begin)}))
            del chunk, p, log_p
        return pa.concat_tables(out)

    blobs = "group bigint, bucket bigint, chunks array<bigint>, " + ", ".join(f"{c} array<binary>" for c in _BLOB)
    asked = dealt.groupBy("group").cogroup(totals.groupBy("group")).applyInArrow(lambda left, right: ask(left, right), blobs)
    answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "group bigint, bucket bigint, chunks array<bigint>, logs array<binary>")
    both = totals.unionByName(answers, allowMissingColumns=True)
    judged = dealt.groupBy("group").cogroup(both.groupBy("group")).applyInArrow(judge, f"id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return judged.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(crown.n).cast("bigint").alias("train_tokens"), "base_score", "score")
