"""Work that remembers: runs of equal tags, and losses against the batches before, on streams.

State is kept for each key in the state store, and is bounded: one open run, or as many batches as a loss looks back on and those
that are not whole yet. Both give, in any micro-batching, what the batch operators give on all rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that keeps state on the executors' disks, needed for typed state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    """Name the state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Runs(StatefulProcessor):
    """The open run of a key: its tag, first and last place, and size."""

    def __init__(self, order: str, tag: str, idle_ms: int):
        self.order, self.tag, self.idle = order, tag, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "tag string, first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        found, run = [], self.open.get()
        # rows without a place come last, as in SQL
        for at, tag in sorted(((r[self.order], r[self.tag]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0)):
            if run is not None and run[0] == tag:
                run = (tag, run[1], run[2] if at is None else at, run[3] + 1)
                found[-1:] = [run]
            else:
                run = (tag, at, at, 1)
                found.append(run)
        self.open.update(run)
        if self.idle:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)
        for tag, first, last, n in found:
            yield Row(key=key[0], tag=tag, first=first, last=last, n=n)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[Row]:
        """Forget a key that was idle: its next row begins a run."""
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def open_runs(rows: DataFrame, by: str, order: str, tag: str, idle_ms: int = 0) -> DataFrame:
    """``by``, ``tag``, ``first``, ``last``, ``n``: the runs of each key as they are after each micro-batch, to be replaced by (``by``, ``first``).
    Rows of a key come in the order of ``order`` from batch to batch, in any order within one. After ``idle_ms`` without
    rows a key is forgotten (0: never)."""
    kind = rows.schema[by].dataType.simpleString()
    named = rows.select(F.col(by), F.col(order).cast("bigint").alias(order), F.col(tag).cast("string").alias(tag))
    out = named.groupBy(by).transformWithState(Runs(order, tag, idle_ms), f"key {kind}, tag string, first bigint, last bigint, n bigint", "Update", "ProcessingTime" if idle_ms else "None")
    return out.select(F.col("key").alias(by), F.col("tag").alias(tag), "first", "last", "n")


def latest_runs(changes: DataFrame, by: str, tag: str) -> DataFrame:
    """The runs that changes add up to."""
    return changes.groupBy(by, tag, "first").agg(F.max("last").alias("last"), F.max("n").alias("n"))


class Losses(StatefulProcessor):
    """Batches of a key by their number: those that aren't whole, and the last ``before`` that were used."""

    def __init__(self, before: int):
        self.before = before

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "batch bigint", "size bigint, ids array<bigint>, q array<array<double>>, p array<array<double>>")
        self.next = handle.getValueState("next", "batch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        for x in rows:
            for batch, part in x.groupby("batch"):
                size, ids, q, p = self.held.getValue((int(batch),)) if self.held.containsKey((int(batch),)) else (0, [], [], [])
                more = [[[float(v) for v in row] for row in part[c]] for c in ("qvec", "pvec")]
                self.held.updateValue((int(batch),), (int(part["size"].iloc[0]), [*ids, *map(int, part["id"])], [*q, *more[0]], [*p, *more[1]]))
        out = [pd.DataFrame({"key": pd.Series(dtype=object), "qid": pd.Series(dtype="int64"), "loss": pd.Series(dtype=float)})]
        while self.held.containsKey((at,)):
            size, ids, q, p = self.held.getValue((at,))
            if len(ids) < size:
                break
            rows_of = [self.held.getValue((b,)) for b in range(max(0, at - self.before), at) if self.held.containsKey((b,))]
            everything = np.array([v for r in rows_of for v in r[3]] + list(p), float)
            own = len(everything) - len(ids) + np.arange(len(ids))
            score = np.array(q, float) @ everything.T
            top = score.max(1)
            loss = np.log(np.exp(score - top[:, None]).sum(1)) + top - score[np.arange(len(ids)), own]
            out.append(pd.DataFrame({"key": key[0], "qid": ids, "loss": loss}))
            if self.held.containsKey((at - self.before,)):
                self.held.removeKey((at - self.before,))
            at += 1
        self.next.update((at,))
        yield pd.concat(out[1:] or out)

    def close(self) -> None:
        pass


def batch_losses(rows: DataFrame, before: int, by: str) -> DataFrame:
    """``by``, ``qid``, ``loss``: each question's cross-entropy against the passages of its batch and of the ``before`` batches before it, as soon
    as these are whole. ``rows``: ``by``, batch (numbered from 0 for each key), size (rows of the batch), id, qvec, pvec; they come in any order."""
    kind = rows.schema[by].dataType.simpleString()
    named = rows.select(by, F.col("batch").cast("bigint").alias("batch"), F.col("size").cast("bigint").alias("size"), F.col("id").cast("bigint").alias("id"), "qvec", "pvec")
    out = named.groupBy(by).transformWithStateInPandas(Losses(before), f"key {kind}, qid bigint, loss double", "Update", "None")
    return out.select(F.col("key").alias(by), "qid", "loss")
