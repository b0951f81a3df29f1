"""Operators of the inventory ids P33, P34, F11, V10, A19 and A32."""

from pyspark.sql import functions as F

from phrasemill.functions import text as X
from phrasemill.operators import corpus, index, metrics


def test_annotations(spark):
    kind = "id int, annotations array<struct<long_answer: struct<start_byte: int>, short_answers: array<struct<start_token: int, end_token: int>>>>"
    rows = [(1, [((-1,), []), ((0,), [(3, 8), (3, 9)])]), (2, [((-1,), [])]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, kind)
    got = df.select("id", corpus.has_long(F.col("annotations")), corpus.has_short(F.col("annotations"))).collect()
    assert sorted(map(tuple, got)) == [(1, True, True), (2, False, False), (3, False, False), (4, False, False)]
    short = df.where("id = 1").select(corpus.short_answers(F.col("annotations")[1]["short_answers"]).alias("s")).first().s
    assert [tuple(s) for s in short] == [(3, 8)]
    flags = spark.createDataFrame([("<P> a",), ("<Table> <P>",)], "c string").select(corpus.is_paragraph(F.col("c"))).collect()
    assert [r[0] for r in flags] == [True, False]


def test_title_match(spark):
    rows = [(" The Cat Sat\u00a0", ["dog", " the CAT "]), ("The Cat", ["cat"]), ("The Cat", []), ("The Cat", [""])]
    got = spark.createDataFrame(rows, "t string, a array<string>").select(X.title_match(F.col("t"), F.col("a"))).collect()
    assert [r[0] for r in got] == [True, False, False, True]


def test_vectors_by_id(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (3, [5.0, 6.0])], "id bigint, vec array<double>")
    wanted = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id bigint")
    got = sorted(((r.id, r.vec) for r in index.vectors_by_id(wanted, vectors, 2).collect()), key=repr)
    assert got == sorted([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (None, [0.0, 0.0])], key=repr)


def test_context_stats(spark):
    rows = [(1, "a", "x y  z"), (1, "a", "x"), (2, "b", " "), (2, None, None), (2, "c", "one two")]
    got = metrics.context_stats(spark.createDataFrame(rows, "qid int, title string, text string")).first()
    assert abs(got.length - (2 + 2 / 3) / 2) < 1e-9 and got.titles == 2.0


def test_save_rate(spark):
    rows = [(["Paris", "x"], ["paris"], 3, 10), (["Rome"], ["Rome"], 1, 10), ([], [], 0, 0)]
    got = metrics.save_rate(spark.createDataFrame(rows, "answers array<string>, candidates array<string>, saved int, total int")).first()
    assert got.save_rate == 0.2 and abs(got.answer_recall - 1 / 3) < 1e-9
