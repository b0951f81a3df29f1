"""MinHash near-duplicates by tensored banding, every link confirmed on full shingle sets.

A few collections of minhashes are computed for each document, and a table's key is a pair of
collections: ``c`` collections of ``ROWS`` hashes make ``c * (c - 1) / 2`` tables of ``2 * ROWS`` hashes
each, for about the square root of the hashing. A pair of Jaccard similarity J is missed only if fewer
than two collections agree; there are as many collections as keep that to ``MISSED`` at the asked
similarity (12 at 0.85, 16 at 0.80: 2 in 10,000), and fewer are missed above it.

Documents with equal sets are one class and take part once. In each table the members of a bucket are
compared with its smallest, their head, by all their minhashes, a byte of each, and tied to it if they agree as often
as similar ones do: one bar, whatever the size of the bucket. A bucket whose members are all tied is done. Else those
that aren't surely similar to the head begin again with the next one, and after ``TURNS`` turns the few that are
left are compared with each other, in blocks, by the same bar. Where some members left with a head, others might be
similar to them and not to the head: these are tied to it from a lower bar on, at which by the triangle inequality
no such pair is lost but by the chance of the minhashes. Pages that merely share a template are not tied.

What hangs together by ties is a candidate group. Every candidate ships its set to its group once, where all
pairs are decided from exact intersection counts (products of the incidence matrix of shared shingles). In
groups too large for a task all members are first decided against their head; only those not linked to it
are then dealt out, in blocks against all blocks. Only links that join parts are kept, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import free_name
from . import _arrow as A
from ._components import components
from ._store import discard, numbered, shuffle_partitions, written

ROWS = 3
#: The share of pairs at exactly the asked similarity that may be missed.
MISSED = 2.5e-4
#: Members and shingles of a block of a candidate group.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1_000_000
#: Candidates (16 bytes each) up to which their list is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Minhashes besides those of the collections (of 32 bits, as they are only compared), turns of a bucket with a new head,
#: members that are compared with each other at once, and text of a partition.
EXTRA, TURNS, PAIRED, PART_BYTES = 208, 2, 512, 32 << 20
#: Text that is cut into shingles at once.
CHUNK_TEXT = 1 << 20

_WORD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def miss_rate(similarity: float, count: int) -> float:
    """The share of pairs of a similarity for which fewer than two of ``count`` collections agree."""
    agree = similarity**ROWS
    return (1 - agree) ** count + count * agree * (1 - agree) ** (count - 1)


def collections_for(percent: int) -> int:
    """The fewest collections that miss at most ``MISSED`` of the pairs at ``percent``."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    return next(c for c in count(2) if miss_rate(percent / 100, c) <= MISSED)


def agreeing(share: float, hashes: int) -> int:
    """The most minhashes of which two documents of similarity ``share`` agree on at least so many, but for
    ``MISSED`` of such pairs."""
    tail, k = 0.0, 0
    while True:
        tail += math.comb(hashes, k) * share**k * (1 - share) ** (hashes - k)
        if tail > MISSED:
            return k
        k += 1


def multipliers(collections: int) -> np.ndarray:
    """Odd numbers for ``ROWS`` minhashes of each collection."""
    drawn = np.random.default_rng(20240229).integers(0, 2**63, collections * ROWS, dtype=np.uint64)
    return drawn * np.uint64(2) + np.uint64(1)


def more_multipliers() -> np.ndarray:
    """Odd numbers of 32 bits for ``EXTRA`` minhashes."""
    drawn = np.random.default_rng(20240301).integers(0, 2**31, EXTRA, dtype=np.uint64)
    return (drawn * np.uint64(2) + np.uint64(1)).astype(np.uint32)


def shingle_sets(texts: pa.Array, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words, and where each text's begin.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    tokens, first = A.words(texts, A.SPACED)
    index, distinct = A.encoded(tokens)
    word = A.mixed(A.hashes(distinct))[index]
    n = np.diff(first)
    with np.errstate(over="ignore"):
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        at = A.ragged(first[:-1], count)
        out = np.zeros(len(at), np.uint64)
        width = np.repeat(np.minimum(n, size), count)
        for k in range(size):
            has = width > k
            out[has] += word[at[has] + k] * _WORD[k % len(_WORD)] * np.uint64(2 * k + 1)
        out = A.mixed(out + width.astype(np.uint64))
    begin = np.append(0, np.cumsum(count))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[:-1][count > 0]] = True
    return out[keep], np.append(0, np.cumsum(keep))[begin].astype(np.int64)


def signatures(sets: np.ndarray, begin: np.ndarray, collections: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text a hash of ``ROWS`` minhashes of each collection, and a byte of every minhash; texts
    without shingles have zeros."""
    full = np.flatnonzero(begin[:-1] < begin[1:])
    drawn = multipliers(collections)
    out = np.zeros((len(begin) - 1, collections), np.uint64)
    small = np.zeros((len(begin) - 1, len(drawn) + EXTRA), np.uint8)
    if not len(full):
        return out, small
    starts = begin[:-1][full]
    with np.errstate(over="ignore"):
        key = None
        for i, m in enumerate(drawn):
            h = sets * m
            h ^= h >> np.uint64(32)
            least = np.minimum.reduceat(h, starts)
            small[full, i] = A.mixed(least).astype(np.uint8)
            c, k = divmod(i, ROWS)
            key = np.full(len(full), c + 1, np.uint64) if k == 0 else key
            key = A.mixed(key * np.uint64(3) + least)
            out[full, c] = key
        halves = (sets >> np.uint64(32)).astype(np.uint32)
        for i, m in enumerate(more_multipliers()):
            h = halves * m
            h ^= h >> np.uint32(15)
            small[full, len(drawn) + i] = (np.minimum.reduceat(h, starts) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out, small


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str, collections: int) -> DataFrame:
    """id, digest of the set (null without shingles), n (its size), the collections' hashes, and a byte of
    every minhash."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in A.chunks(batches, "text", CHUNK_TEXT):
            sets, begin = shingle_sets(b.column("text"), size)
            data = memoryview(sets.tobytes())
            digest = [hashlib.blake2b(data[8 * x : 8 * y], digest_size=16).digest() if x < y else None for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            keys, small = signatures(sets, begin, collections)
            keys = keys.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * collections, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digest, pa.binary()), pa.array(np.diff(begin)), lists, pa.array([x.tobytes() for x in small], pa.binary())], ["id", "digest", "n", "keys", "small"])

    return rows.mapInArrow(run, f"id {kind}, digest binary, n bigint, keys array<bigint>, small binary")


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of members that join up all members linked directly or by way of others: for every part a
    tree. Two members are linked when ``100 * intersection >= percent * union``."""
    size = np.array([len(s) for s in sets], np.int64)
    alive = np.flatnonzero(size)
    while True:
        # a shingle that no other member has can't be in an intersection: an upper bound for each member
        flat = np.concatenate([sets[i] for i in alive]) if len(alive) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(alive)), size[alive])
        order = np.argsort(flat, kind="stable")
        new = np.append(True, flat[order][1:] != flat[order][:-1]) if len(flat) else np.zeros(0, bool)
        shingle = np.empty(len(flat), np.int64)
        shingle[order] = np.cumsum(new) - 1
        common = np.bincount(shingle)[shingle] > 1 if len(flat) else new
        shared = np.bincount(owner[common], minlength=len(alive))
        keep = 100 * shared >= percent * size[alive]
        if keep.all():
            break
        alive = alive[keep]
    g = len(alive)
    if g < 2:
        return []
    owner, shingle = owner[common], shingle[common]
    names, shingle = np.unique(shingle, return_inverse=True)
    by = np.argsort(shingle, kind="stable")
    owner, shingle = owner[by], shingle[by]
    both = np.zeros((g, g), np.float32)  # counts under 2^24 are exact
    step = max(64, (16 << 20) // (4 * g))
    for at in range(0, len(names), step):
        a, b = np.searchsorted(shingle, [at, at + step])
        part = np.zeros((g, min(step, len(names) - at)), np.float32)
        part[owner[a:b], shingle[a:b] - at] = 1
        both += part @ part.T
    inter = both.astype(np.int64)
    union = size[alive][:, None] + size[alive] - inter
    linked = 100 * inter >= percent * union
    tree, seen = [], np.zeros(g, bool)
    for root in range(g):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            at = stack.pop()
            fresh = np.flatnonzero(linked[at] & ~seen)
            seen[fresh] = True
            stack += fresh.tolist()
            tree += [(int(alive[at]), int(alive[x])) for x in fresh]
    return tree


def _by_group(rows: DataFrame, columns: list[str], decide, result: str) -> DataFrame:
    """What ``decide`` yields from the columns of each group, of rows that lie together by group."""

    def run(batches):
        group, held = None, [[] for _ in columns]
        for batch in batches:
            for g, *values in zip(*(batch.column(c).to_pylist() for c in ("group", *columns)), strict=True):
                if g != group:
                    if held[0]:
                        yield from decide(*held)
                    group, held = g, [[] for _ in columns]
                for column, x in zip(held, values, strict=True):
                    column.append(x)
        if held[0]:
            yield from decide(*held)

    return rows.mapInArrow(run, result)


def _verified(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` from rows (group, id, set) that lie together by group."""

    def decide(ids, sets):
        tree = links_within([np.frombuffer(s, np.uint64) for s in sets], percent)
        if tree:
            yield pa.RecordBatch.from_arrays([pa.array([ids[x[i]] for x in tree], pa.int64()) for i in (0, 1)], ["a", "b"])

    return _by_group(sets, ["id", "set"], decide, "a bigint, b bigint")


def _against_heads(sets: DataFrame, percent: int) -> DataFrame:
    """``id``, its ``root``, whether the two are ``linked``, and the set's size ``n``, from rows (group, id, root, set) that lie
    together by group, the root's among them."""

    def decide(ids, roots, sets):
        head = np.frombuffer(next(s for i, r, s in zip(ids, roots, sets, strict=True) if i == r), np.uint64)
        linked = []
        for s in sets:
            s = np.frombuffer(s, np.uint64)
            both = int((head[np.minimum(np.searchsorted(head, s), len(head) - 1)] == s).sum())
            linked.append(100 * both >= percent * (len(head) + len(s) - both))
        sizes = [len(s) // 8 for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64()), pa.array(linked), pa.array(sizes, pa.int64())], ["id", "root", "linked", "n"])

    return _by_group(sets, ["id", "root", "set"], decide, "id bigint, root bigint, linked boolean, n bigint")


def _agreement(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``head``, ``rep`` and on how many minhashes the two agree."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([b.column("head"), b.column("rep"), pa.array((x == y).sum(1).astype(np.int32))], ["head", "rep", "agree"])

    small = classes.select("rep", F.col("small").alias("y"))
    heads = classes.select(F.col("rep").alias("head"), F.col("small").alias("x"))
    return pairs.join(heads, "head").join(small, "rep").select("head", "rep", "x", "y").mapInArrow(run, "head bigint, rep bigint, agree int")


def tied_pairs(small: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs that join up all rows that agree on ``least`` bytes, directly or by way of others."""
    label, out = np.arange(len(small)), []
    for i in range(len(small) - 1):
        near = i + 1 + np.flatnonzero((small[i + 1 :] == small[i]).sum(1) >= least)
        for other in np.unique(label[near]):
            if other != label[i]:
                out.append((i, int(near[label[near] == other][0])))
                label[label == other] = label[i]
    return out


def _paired(members: DataFrame, classes: DataFrame, least: int, parts: int) -> DataFrame:
    """Ties ``a``, ``b`` among the members (key, rep) of each bucket, blocks of a large one against all its blocks."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    rows = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.join(classes.select("rep", "small"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "rep", "small").repartition(parts, "group").sortWithinPartitions("group", "rep")

    def decide(reps, small):
        found = tied_pairs(np.frombuffer(b"".join(small), np.uint8).reshape(len(small), -1), least)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([reps[x[i]] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return _by_group(rows, ["rep", "small"], decide, "a bigint, b bigint")


def _ties(members: DataFrame, classes: DataFrame, percent: int, hashes: int, parts: int, made: list[DataFrame]) -> DataFrame:
    """Ties ``a``, ``b`` from the written members (key, rep) of buckets, which are deleted as soon as nothing needs them.
    Tables that the ties are read from go to ``made``."""
    share = percent / 100
    bar, far, inner = agreeing(share, hashes), agreeing(max(0.0, 2 * share - 1), hashes), math.ceil(hashes * (1 + share) / 2)
    found, before = [], members
    for _ in range(TURNS):
        heads = members.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("members")).where("members > 1")
        tied = written(members.join(heads, "key").where("rep <> head").select("key", "head", "rep", "members"), "members")
        agree = written(_agreement(tied.select("head", "rep").distinct(), classes), "agreement")
        known = written(tied.join(agree, ["head", "rep"]), "known")
        discard(tied)
        if before is not None:
            discard(before)
        # what a bucket needs: nothing more if all are tied, the lower bar if some leave with the head
        state = known.groupBy("key").agg((F.min("agree") >= bar).alias("done"), (F.max("agree") >= inner).alias("close"))
        state = written(state.where("NOT done"), "state")
        rest = written(known.where(F.col("agree") < inner).join(state, "key").select("key", "head", "rep", "members", "agree", "close"), "rest")
        for x in (known, state):
            discard(x)
        made += [agree, rest]
        found.append(agree.where(F.col("agree") >= bar).select(F.col("head").alias("a"), F.col("rep").alias("b")))
        found.append(rest.where(F.col("close") & (F.col("agree") < bar) & (F.col("agree") >= far)).select(F.col("head").alias("a"), F.col("rep").alias("b")))
        members, before = rest.where("members > 2").select("key", "rep"), None
    found.append(_paired(members, classes, bar, parts))
    return reduce(DataFrame.unionByName, found)


def _links(sets: DataFrame, percent: int, parts: int, made: list[DataFrame]) -> DataFrame:
    """Links ``a``, ``b`` from rows (id, set, root, blocks): candidate groups by their root, in so many blocks.
    Tables written on the way go to ``made``."""

    def together(rows: DataFrame, *key) -> DataFrame:
        rows = rows.withColumn("group", F.xxhash64(*key)).repartition(parts, "group")
        return rows.sortWithinPartitions("group", "id")

    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    one = _verified(together(sets.where("blocks = 1"), "root").select("group", "id", "set"), percent)
    large = sets.where("blocks > 1")
    # every block gets the head's set as well
    own = large.where("id <> root").withColumn("block", block)
    heads = large.where("id = root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    decided = written(_against_heads(together(own.unionByName(heads), "root", "block").select("group", "id", "root", "set"), percent), "decided")
    made.append(decided)
    near = decided.where("linked AND id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    rest = decided.where("NOT linked").groupBy("id", "root").agg(F.max("n").alias("n"))
    if rest.isEmpty():
        return one.unionByName(near)
    size = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    of = large.join(rest.groupBy("root").agg(size.alias("turns")), "root").withColumn("block", block)
    own = rest.select("id", "root", F.lit(True).alias("open"))
    of = of.join(own, ["id", "root"], "left").withColumn("own", F.when(F.col("open"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("turns")).cast("int")))
    mine = of.where("open").withColumn("turn", F.col("own")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = of.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).where("own IS NULL OR own <> turn")
    pairs = mine.select("root", "turn", "block", "id", "set").unionByName(every.select("root", "turn", "block", "id", "set"))
    return one.unionByName(near).unionByName(_verified(together(pairs, "root", "turn", "block").select("group", "id", "set"), percent))


def link_groups(docs: DataFrame, percent: int = 85, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id, kept.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of distinct
    shingles of ``size`` words; ``component_id`` is the smallest id reachable over links. A null text, or
    one without words, is linked with nothing and is its own component. Ids are bigint; rows with a null
    id are reported with a null component and kept, repeated ids share a component. An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() != "bigint":
        raise TypeError("ids must be bigint")
    collections = collections_for(percent)
    rows = written(sketches(docs, size, id_col, text_col, collections), "sketches")
    known = rows.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = written(known.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("small").alias("small")), "classes")
    pairs = ",".join(f"xxhash64({i}, {j}, keys[{i}], keys[{j}])" for i, j in combinations(range(collections), 2))
    keys = classes.select("rep", F.explode(F.expr(f"array({pairs})")).alias("key"))
    # minima are aggregated map-side; members of one are dropped before anything else
    alone = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    members = written(keys.join(alone, "key"), "buckets")
    made = []
    parts = max(4 * shuffle_partitions(spark), math.ceil(8 * (rows.agg(F.sum("n")).first()[0] or 0) / PART_BYTES))
    candidates = components(_ties(members, classes, percent, collections * ROWS + EXTRA, parts, made))
    for x in made:  # the components are written, nothing needs these any more
        discard(x)
    sized = candidates.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    totals = sized.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = totals.select("root", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = written(sized.join(blocks, "root").select(F.col("node").alias("id"), "root", "blocks"), "candidates")
    wanted = placed.select("id")
    if placed.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL").join(wanted, "id", "left_semi")

    def gather(batches):
        for b in A.chunks(batches, "text", CHUNK_TEXT):
            sets, begin = shingle_sets(b.column("text"), size)
            offsets = pa.py_buffer((begin * 8).astype(np.int64))
            full = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, offsets, pa.py_buffer(sets)])
            yield pa.RecordBatch.from_arrays([b.column("id"), full.cast(pa.binary())], ["id", "set"])

    # a repeated id may come with several texts: one class member each, all under the same id
    sets = texts.mapInArrow(gather, "id bigint, set binary").where("length(set) > 0")
    sets = written(sets.join(placed, "id"), "sets")
    made = [sets]
    roots = components(_links(sets, percent, parts, made)).select(F.col("node").alias("rep"), "root")
    for x in made:
        discard(x)
    labelled = classes.select("digest", "rep").join(roots, "rep", "left").select("digest", F.coalesce("root", "rep").alias("component"))
    out = rows.select("id", "digest", "n").join(labelled, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, percent: int = 85, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row, that of the smallest id (null ids last), of each linked group; columns unchanged.

    Rows are linked by a key of their own, so repeated and null ids are decided like any others, and ids may be of any type
    that can be ordered. Rows without words, or text, are linked with nothing and stay. Of equal rows one stays. An
    empty table stays empty; columns may have any names; texts of any length are cut into shingles whole.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, "rows", row)
    groups = link_groups(rows, percent, size, row, text_col).select(F.col(row).alias("row"), "component_id")
    named = groups.join(rows.select(F.col(row).alias("row"), F.col(id_col).alias("id")), "row")
    # minima are aggregated map-side
    best = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row").alias("row")))
    winners = named.groupBy("component_id").agg(best.alias("best")).select(F.col("best.row").alias(row))
    return rows.join(winners, row, "left_semi").select(*docs.columns)
