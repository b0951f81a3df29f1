"""Duplicate stages decide row by row: repeated rows, null ids and ids with several texts."""

from collections import Counter

from phrasemill.llm import exact_dedup, near_dedup

A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")


def left(stage, spark, rows):
    return Counter(tuple(r) for r in stage(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_exact_copies_by_row(spark):
    rows = [(1, A), (1, A), (2, A), (None, A), (2, B), (None, C), (None, C), (3, None), (None, " ")]
    got = left(exact_dedup.without_copies, spark, rows)
    assert got == Counter([(1, A), (2, B), (None, C), (None, " ")])


def test_near_copies_by_row(spark):
    near_a, near_c = A + " end", C + " end"
    rows = [(1, A), (1, A), (2, near_a), (None, near_a), (2, B), (None, C), (None, C), (None, near_c), (3, None), (4, "")]
    got = left(lambda d: near_dedup.without_near_copies(d, 80, 5), spark, rows)
    assert got[1, A] == 1 and got[2, B] == 1 and got[3, None] == 1 and got[4, ""] == 1
    assert sum(n for (i, t), n in got.items() if t in (C, near_c)) == 1
    assert sum(got.values()) == 5


def test_columns_of_any_name_come_back(spark):
    """Columns that a stage could take for its own keep their values and types."""
    from pyspark.sql import functions as F


    rows = [(i, f"text {i // 2} " + "w " * 20, f"r{i}", b"d", 1.5, "s", "c") for i in range(8)] + [(None, None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row string, _digest binary, _size double, _ROW_ string, component_id string").repartition(3)
    for out in (exact_dedup.without_copies(docs), near_dedup.without_near_copies(docs, percent=80, size=5)):
        assert out.dtypes == docs.dtypes
        found = {r.doc_id: r for r in out.collect()}
        assert {r._row for r in found.values() if r.doc_id is not None} <= {f"r{i}" for i in range(0, 8, 2)}
        assert all(bytes(r._digest) == b"d" and r._size == 1.5 and r._ROW_ == "s" and r.component_id == "c" for i, r in found.items() if i is not None)
    kept = exact_dedup.without_copies(docs.withColumn("doc_id", F.col("doc_id").cast("string"))).where("doc_id IS NOT NULL").count()
    assert kept == 4


def test_frequent_and_rare_texts_are_decided_alike(spark):
    from pyspark.sql import functions as F


    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), (F.col("id") % 5000).cast("string"))).alias("text"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    got = {r.doc_id for r in exact_dedup.without_copies(docs).collect()}
    want = {r.doc_id for r in exact_dedup.label_copies(docs).where("kept").collect()}
    assert got == want
