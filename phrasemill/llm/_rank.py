"""Places of rows within groups, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._store import discard, written

#: Rows of a group that are ordered in one task, and parts that larger groups are cut into.
SMALL, PARTS = 128, 128


def number_for(rows: DataFrame, column: str) -> Column:
    """A number that never falls as the column's values rise; null for null."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.hex(F.rpad(F.substring(F.encode(column, "UTF-8"), 1, 6), 6, b"\0")), 16, 10).cast("double")
    if isinstance(kind, T.BinaryType):
        return F.conv(F.hex(F.rpad(F.substring(column, 1, 6), 6, b"\0")), 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def ranked(rows: DataFrame, group: Sequence[str], order: str, name: str = "nth") -> DataFrame:
    """``rows`` with their place (from 1) among the rows of equal ``group`` in ascending ``order``, nulls last,
    written to the shared folder; nulls in ``group`` are equal, ties have any order.

    Groups of over ``SMALL`` rows are cut at quantiles of their own, which a sketch finds map-side and which stay in
    a table: a row's place is its place within its part plus the counts of the parts before. No group is
    ordered in one task, and nothing goes to the driver but whether there are such groups. ``rows`` must be
    cheap to read and always the same (a written table).
    """
    keys = list(group)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())).cast("bigint")
    large = written(rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > SMALL).drop("_rows"), "large")
    if large.isEmpty():
        out = written(rows.withColumn(name, plain), "ranked")
        discard(large)
        return out

    def same(a: str, b: str) -> Column:
        out = F.lit(True)
        for c in keys:
            out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return out

    small = rows.alias("r").join(large.alias("l"), same("r", "l"), "left_anti").withColumn(name, plain)
    hot = rows.withColumn("_at", number_for(rows, order)).alias("r").join(large.alias("l"), same("r", "l"), "left_semi")
    cuts = written(hot.groupBy(*keys).agg(F.percentile_approx("_at", [i / PARTS for i in range(1, PARTS)], 10_000).alias("_cuts")), "cuts")
    part = F.when(F.col("_at").isNull(), PARTS).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_at"))))
    dealt = written(hot.alias("r").join(cuts.alias("c"), same("r", "c")).select("r.*", part.alias("_part")), "parts")
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each part of a large group
    known = written(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "counts")
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.col(order).asc_nulls_last()))
    local = dealt.withColumn("_place", place).alias("r")
    both = local.join(known.alias("k"), same("r", "k") & (F.col("r._part") == F.col("k._part")))
    both = both.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("_place") + F.col("_before")).cast("bigint").alias(name))
    out = written(small.unionByName(both), "ranked")
    for x in (large, cuts, dealt, known):
        discard(x)
    return out
