"""Quality classifier: a factorisation machine over hashed words, structure and size of a text.

The score is a logistic of ``w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2)``: the last term is
the weight of all pairs of features by low-rank factors, in time linear in the features. Features come
from the text alone. The model is fitted on the driver to a bounded sample of labelled rows (``SAMPLE``,
those with the smallest hashes); its size is fixed, so it is broadcast, and scoring is one pass over
whole texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrow as A

#: Buckets of hashed words, and factors of each feature.
BUCKETS, RANK = 1 << 14, 8
#: Text bytes that are scored at once: the factors of all their words are in memory together.
CHUNK_BYTES = 1 << 20
#: Labelled rows that the model is fitted to, at most.
SAMPLE = 6_000
_LETTER = np.zeros((256, 8))
for _i, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 11, 12, 13), (10,), (46, 44, 33, 63, 59, 58, 39, 34, 45), [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,!?;:'\"-"], range(128, 256))):
    _LETTER[list(_set), _i] = 1
STRUCTURE = 8 + 10


def held_out(id_: Column, folds: int = 5) -> Column:
    """Whether the crc32 of the id as text leaves no remainder; such rows are never learnt from."""
    return F.coalesce(F.crc32(id_.cast("string")) % folds == 0, F.lit(False))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of each text as ragged (first, bucket, value), and its structure as a matrix."""
    n = len(texts)
    data, offsets = A.text_buffer(texts)
    size = np.diff(offsets)
    histogram = np.zeros((n, 256))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        histogram[i] = np.bincount(data[a:b], minlength=256)
    share = histogram @ _LETTER / np.maximum(size, 1)[:, None]
    # words
    tokens, first = A.words(texts, A.SPACED)
    index, distinct = A.encoded(tokens)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    bucket = (A.hashes(distinct) % np.uint64(BUCKETS)).astype(np.int64)
    pair, times = np.unique(doc * BUCKETS + bucket[index], return_counts=True)
    row, bucket_of = pair // BUCKETS, pair % BUCKETS
    begin = np.searchsorted(row, np.arange(n + 1))
    value = np.log1p(times)
    norm = np.sqrt(np.maximum(A.sums(value**2, begin), 1e-12))
    value = value / norm[row]
    most = np.zeros(n)
    if len(times):
        full = begin[:-1] < begin[1:]
        most[full] = np.maximum.reduceat(times, begin[:-1][full])
    length = np.diff(np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1]) if len(tokens) else np.zeros(0, np.int64)
    short, long = A.sums((length <= 2).astype(np.int64), first), A.sums((length >= 12).astype(np.int64), first)
    # lines
    cut = data == 10
    lines = np.add.reduceat(np.append(cut, False).astype(np.int64), np.minimum(offsets[:-1], len(data))) if n else np.zeros(0)
    lines = np.where(size > 0, lines, 0) + 1
    start = cut.copy()
    start[1:] = cut[:-1]
    if len(start):
        start[0] = True
    start[offsets[:-1][size > 0]] = True
    place = np.flatnonzero(start)
    line, names = A.encoded(A.binary_array(data, np.append(place, len(data))))
    of = np.searchsorted(offsets, place, side="right") - 1
    different = np.bincount(np.unique(of * max(len(names), 1) + line) // max(len(names), 1), minlength=n)[:n]
    words_ = np.maximum(count, 1)
    more = np.column_stack([np.log1p(size), np.log1p(count), np.where(count > 0, A.sums(length, first) / words_, 0), np.diff(begin) / words_, most / words_, short / words_, long / words_, np.log1p(lines), different / lines, count / lines / 50])
    return begin, bucket_of, value, np.column_stack([share, more])


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # of hashed words, then of structure
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def _inputs(self, begin, bucket, value, dense):
        """All features as ragged (first, index, value)."""
        n = len(dense)
        dense = np.clip((dense - self.mean) / self.scale, -5, 5) * 0.3
        count = np.diff(begin)
        first = begin + np.arange(n + 1) * STRUCTURE
        index, x = np.empty(first[-1], np.int32), np.empty(first[-1], np.float32)
        words = A.ragged(first[:-1], count)
        index[words], x[words] = bucket, value
        rest = (first[1:] - STRUCTURE)[:, None] + np.arange(STRUCTURE)
        index[rest], x[rest] = BUCKETS + np.arange(STRUCTURE), dense
        return first, index, x

    def logits(self, first, index, x):
        if len(first) < 2:
            return np.zeros(0), np.zeros((0, RANK))
        vx = self.factor[index] * x[:, None]
        total = np.add.reduceat(vx, first[:-1])
        pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), first[:-1]))
        return self.bias + np.add.reduceat(self.weight[index] * x, first[:-1]) + pairs, total

    def score(self, texts: pa.Array) -> np.ndarray:
        z, _ = self.logits(*self._inputs(*features(texts)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(parts: list[tuple], labels: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Model:
    """Fit to (begin, bucket, value, dense) parts in the order of ``labels`` by Adam steps."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STRUCTURE
    dense = np.concatenate([p[3] for p in parts]) if parts else np.zeros((0, STRUCTURE))
    share = min(max(float(labels.mean()) if len(labels) else 0.5, 0.01), 0.99)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.01, (size, RANK)), dense.mean(0) if len(dense) else np.zeros(STRUCTURE), dense.std(0) + 1e-6 if len(dense) else np.ones(STRUCTURE))
    if not len(labels):
        return model
    counts = np.concatenate([np.diff(p[0]) for p in parts])
    begin = np.append(0, np.cumsum(counts))
    first, index, x = model._inputs(begin, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), dense)
    used = np.diff(first)
    moments = [np.zeros(size), np.zeros(size), np.zeros((size, RANK)), np.zeros((size, RANK))]
    step, bias = 0, [0.0, 0.0]
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            take = A.ragged(first[rows], used[rows])
            start = np.append(0, np.cumsum(used[rows]))
            i, v = index[take], x[take]
            z, total = model.logits(start, i, v)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            e = np.repeat(error, used[rows])
            # gradients by feature: sum_j v_jf x_j times x_i, less v_if x_i^2
            by = np.argsort(i, kind="stable")
            names, begins = np.unique(i[by], return_index=True)
            gw = np.add.reduceat((e * v)[by], begins) + decay * model.weight[names]
            gv = np.add.reduceat((e[:, None] * (np.repeat(total, used[rows], axis=0) * v[:, None] - model.factor[i] * (v**2)[:, None]))[by], begins) + decay * model.factor[names]
            step += 1
            lr = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) / (1 + epoch)
            for value, grad, m, s in ((model.weight, gw, moments[0], moments[1]), (model.factor, gv, moments[2], moments[3])):
                m[names] = 0.9 * m[names] + 0.1 * grad
                s[names] = 0.99 * s[names] + 0.01 * grad**2
                value[names] -= lr * m[names] / (np.sqrt(s[names]) + 1e-8)
            g = float(error.sum())
            bias = [0.9 * bias[0] + 0.1 * g, 0.99 * bias[1] + 0.01 * g * g]
            model.bias -= lr * bias[0] / (np.sqrt(bias[1]) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model of the labelled rows outside the held-out fold, or of the ``sample`` of them with the
    smallest hashes. Null labels or ids are left out; of an id that has several labels the largest counts, of
    one that has several texts the one with the smallest hash; without any labels the score is one half."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    # at most ``sample`` rows of two numbers: small enough to broadcast
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # one text of each id, found map-side: so no more than ``sample`` rows go to the driver
    rows = rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")).select("id", "text", "y")

    def run(batches):
        for b in A.chunks(batches, "text", CHUNK_BYTES):
            begin, bucket, value, dense = features(b.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(z)) for z in (bucket.astype(np.int32), value.astype(np.float32))]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(dense) + 1) * STRUCTURE, pa.int32()), pa.array(dense.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), *lists, flat], ["id", "y", "bucket", "value", "dense"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, y double, bucket array<int>, value array<float>, dense array<double>").toArrow()
    if not got.num_rows:
        return fit([], np.zeros(0))
    got = got.sort_by("id").combine_chunks()
    bucket, value, dense = (got.column(c).combine_chunks() for c in ("bucket", "value", "dense"))
    begin = np.append(0, np.cumsum(bucket.value_lengths().to_numpy()))
    part = (begin, bucket.flatten().to_numpy(), value.flatten().to_numpy(), dense.flatten().to_numpy().reshape(-1, STRUCTURE))
    return fit([part], got.column("y").to_numpy())


def _apply(docs: DataFrame, model: Model, keep: list[str], text_col: str, score_col: str = "score") -> DataFrame:
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in A.chunks(batches, "t", CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(shared.value.score(b.column("t")))], [*names, "s"])

    schema = rows.drop("t").schema.add("s", "double")
    return rows.mapInArrow(run, schema).select(*(F.col(x).alias(c) for c, x in zip(keep, names, strict=True)), F.col("s").alias(score_col))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, held_out, score, predicted.

    A null text is scored as an empty one, a null id is not held out, repeated rows score alike, an empty
    table gives no rows; other columns are never read.
    """
    model = model or learn(docs, labels, id_col=id_col, text_col=text_col)
    scored = _apply(docs, model, [id_col], text_col)
    return scored.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below the threshold; columns unchanged, whatever their names. Each
    row is judged by its text alone: a null text as an empty one, repeated rows alike, rows without an id
    like others; an empty table stays empty."""
    free = next(x for x in (f"score{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    return _apply(docs, learn(docs, labels, id_col=id_col, text_col=text_col), docs.columns, text_col, free).where(F.col(free) >= threshold).drop(free)
