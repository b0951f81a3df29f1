"""Decoding answer spans from scores of starts and ends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def span_scores(starts: DataFrame, ends: DataFrame, band: int, by: str = "doc_idx") -> DataFrame:
    """All spans ``0 <= e - s < band`` with the sum of both scores. ``starts``: by, s, start; ``ends``: by, e, end."""
    near = starts.withColumn("e", F.explode(F.sequence(F.col("s"), F.col("s") + band - 1)))
    return near.join(ends, [by, "e"]).select(by, "s", "e", (F.col("start") + F.col("end")).alias("score"))


def best_span(scored: DataFrame, by: str = "doc_idx") -> DataFrame:
    return scored.groupBy(by).agg(F.max("score").alias("best"))


def n_best(scored: DataFrame, n: int = 20, by: str = "doc_idx", text: str | None = None) -> DataFrame:
    """The ``n`` best spans of each group with their share of probability; of spans of one text the best."""
    order = [F.col("score").desc(), F.col("s"), F.col("e")]
    if text:
        scored = scored.withColumn("_n", F.row_number().over(Window.partitionBy(by, text).orderBy(*order))).where("_n = 1").drop("_n")
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)
    per = Window.partitionBy(by)
    weight = F.exp(F.col("score") - F.max("score").over(per))
    return top.withColumn("probability", weight / F.sum(weight).over(per))


def n_best_logits(tokens: DataFrame, score: str, n: int, by: str = "doc_idx", place: str = "word_idx") -> DataFrame:
    """The places of the ``n`` largest scores of each group."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), place)
    return tokens.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def two_way_loss(gold, other):
    """``-log softmax`` of the first of two scores; no difference is too large."""
    gap = other - gold
    return F.greatest(gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))


def banded(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, band: int) -> np.ndarray:
    """For every place the largest of its start's score plus an end's, of the ``band`` ends from it on in the same row; rows lie
    one after the other, ``first`` says where each begins (one more at the end)."""
    n = len(starts)
    # ``band`` places of nothing after each row, so that no window reaches into the next
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(n) + row * band
    best = np.full(n + (len(first) - 1) * band + band, -np.inf)
    best[place] = ends
    have = 1
    while have < band:
        step = min(have, band - have)
        best[: len(best) - step] = np.maximum(best[: len(best) - step], best[step:])
        have += step
    return starts + best[place]


def banded_best(passages: DataFrame, band: int = 10, threshold: float | None = None, floor: float = 0.0) -> DataFrame:
    """``passages`` (start, end: arrays of scores; fs, fe: arrays of filter scores if ``threshold`` is given) with ``best``: the largest sum of
    a start and an end that is less than ``band`` places behind it, both above the threshold.

    The first place on its own is no span, and nothing scores less than ``floor``. A sliding maximum takes a few passes over
    each batch; no pair of places becomes a row. Arrays of a passage are equally long; a null array, or an empty one, gives
    ``floor``."""

    def run(batches):
        for b in batches:
            lists = [b.column(c) for c in names]
            lengths = pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.append(0, np.cumsum(lengths))
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in lists]
            start, end = flat[0].copy(), flat[1].copy()
            if threshold is not None:
                start[~(flat[2] > threshold)] = -np.inf
                end[~(flat[3] > threshold)] = -np.inf
            start[np.isnan(start)] = -np.inf
            end[np.isnan(end)] = -np.inf
            total = banded(start, end, first, band)
            head = first[:-1][lengths > 0]
            # the first start with later ends only
            later = np.full((len(head), max(band - 1, 1)), -np.inf)
            for k in range(1, band):
                ok = k < lengths[lengths > 0]
                later[ok, k - 1] = end[head[ok] + k]
            total[head] = start[head] + later.max(1)
            best = np.full(b.num_rows, floor)
            if len(head):
                best[lengths > 0] = np.maximum(np.maximum.reduceat(total, head), floor)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best)], [*b.schema.names, "best"])

    names = ["start", "end", *(["fs", "fe"] if threshold is not None else [])]
    schema = passages.withColumn("best", F.lit(0.0)).schema
    return passages.mapInArrow(run, schema)


def example_scores(scored: DataFrame, by: str, mode: str, modes: tuple[str, ...] = ("gold", "topic", "entailed"), best: str = "best") -> DataFrame:
    """``by`` and the best score of each example among its passages of each mode; examples without a gold passage are left out,
    another mode without passages has -1e9."""
    rows = scored.groupBy(by).agg(*(F.max(F.when(F.col(mode) == m, F.col(best))).alias(m) for m in modes))
    return rows.where(F.col(modes[0]).isNotNull()).select(by, *(F.coalesce(m, F.lit(-1e9)).alias(m) for m in modes))


def contrast(examples: DataFrame, modes: tuple[str, ...] = ("gold", "topic", "entailed")) -> DataFrame:
    """One row: the means of all modes, and the mean loss of the first against each other one."""
    gold, *others = modes
    return examples.agg(*(F.avg(m).alias(f"{m}_mean") for m in modes), *(F.avg(two_way_loss(F.col(gold), F.col(m))).alias(f"{m}_loss") for m in others))


def above(rows: DataFrame, score: str = "score", least: float = -1e5) -> DataFrame:
    """Rows whose score isn't that of a masked one."""
    return rows.where(F.col(score) > least)


def readable(scored: DataFrame, tokens: DataFrame, longest: int, by: str = "doc_idx") -> DataFrame:
    """Spans that a reader may answer with: both ends on tokens of the text, the start in the window that gives
    it the most context, not longer than ``longest``. ``scored``: by, s, e, score; ``tokens``: by, token, best."""
    start = tokens.where("best").select(by, F.col("token").alias("s"))
    end = tokens.select(by, F.col("token").alias("e"))
    return scored.where((F.col("e") >= F.col("s")) & (F.col("e") - F.col("s") < longest)).join(start, [by, "s"], "left_semi").join(end, [by, "e"], "left_semi")


def beam_spans(starts: DataFrame, ends: DataFrame, n: int, by: str = "doc_idx") -> DataFrame:
    """The ``n`` best spans from beams of starts and, for each start, of ends, by the sum of log probabilities.
    ``starts``: by, beam, s, log_p; ``ends``: by, beam, e, log_q."""
    both = starts.join(ends, [by, "beam"]).where("e >= s").select(by, "s", "e", (F.col("log_p") + F.col("log_q")).alias("score"))
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "s", "e")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
