"""Bitmaps of hashes: of bounded size, so that they can be sent to every task. A hash whose bit isn't set is surely
not among those that made the bitmap; one whose bit is set may be. However full, a bitmap only saves work."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 8 MB.
BITS = 26


def bitmap(hashes: DataFrame, column: str) -> Callable[[pa.Array], np.ndarray]:
    """From hashes (bigint) a function that says for each of an array of hashes whether its bit is set. At most
    ``2 ** (BITS - 6)`` rows come to the driver, whatever the number of hashes."""
    low = F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))
    words = hashes.select(F.shiftright(low, 6).alias("at"), F.expr(f"shiftleft(1L, cast({column} & 63L AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(1 << (BITS - 6), np.int64)
    found[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    shared = hashes.sparkSession.sparkContext.broadcast(found.view(np.uint64))

    def among(values: pa.Array) -> np.ndarray:
        v = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & np.uint64((1 << BITS) - 1)
        return (shared.value[(v >> np.uint64(6)).astype(np.int64)] >> (v & np.uint64(63)) & np.uint64(1)).astype(bool)

    return among


def only(rows: DataFrame, column: str, among: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose hash may be among those of a bitmap."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(among(b.column(column))))

    return rows.mapInArrow(run, rows.schema)
