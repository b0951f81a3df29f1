"""Readers of title maps, databases, casings and written lists; occurrences, byte spans, beams and batches."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from phrasemill.operators import records, spans, training
from phrasemill.sources import readers


def test_title_ids(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps({"A b": "12", "É": "7"}))
    assert sorted(map(tuple, readers.title_ids(spark, str(tmp_path / "ids.json")).collect())) == [("A b", "12"), ("É", "7")]


@pytest.mark.parametrize("rows", [0, 1, 1003])
def test_database_texts(spark, tmp_path, rows):
    path = str(tmp_path / "docs.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE documents (id PRIMARY KEY, text)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", [(f"t{i}", f"text {i}" if i % 9 else None) for i in range(rows)])
    got = readers.database_texts(spark, path, partitions=4)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((f"t{i}", f"text {i}" if i % 9 else None) for i in range(rows)), key=str)


def test_adapters_of_lines_and_written_lists(spark):
    lines = readers.adapt(spark.createDataFrame([(" what? ",)], "value string"), "lines").first()
    assert (lines.question, lines.answers) == ("what?", [""])
    rows = [("a", """['one', "it's", 'say \\'hi\\'', 'x, y']"""), ("b", "[]"), ("c", None)]
    got = {r.question: r.answers for r in readers.adapt(spark.createDataFrame(rows, "question string, answers string"), "literal").collect()}
    assert got["a"] == ["one", "it's", "say 'hi'", "x, y"] and got["b"] == [] and got["c"] is None


def test_round_robin_over_splits(spark, tmp_path):
    for name, n in (("a", 2000), ("b", 1500), ("c", 1800)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    paths = [str(tmp_path / x) for x in "abc"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = readers.round_robin(spark, paths).orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.at, r.value) for r in got] == [(3 * i + k, f"{x}{i}") for i in range(1500) for k, x in enumerate("abc")]


def test_occurrences_and_byte_spans(spark):
    df = spark.createDataFrame([("a.b xa.b", "a.b"), ("aaa", "aa"), ("x", ""), ("none", "z"), ("\\E a \\E", "\\E")], "t string, a string")
    got = [r[0] for r in df.select(records.occurrences(F.col("t"), F.col("a"))).collect()]
    assert got == [[0, 5], [0], None, [], [0, 5]]
    text = "é <b>日本</b>"
    row = spark.createDataFrame([(text,)], "t string").select(records.span_bytes(F.col("t"), F.lit(6), F.lit(12)), records.untokenised(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(" "), F.lit(" ")))).first()
    assert tuple(row) == (text.encode()[6:12].decode(), "a b")


def test_beams_readers_and_masks(spark):
    starts = spark.createDataFrame([(1, 1, 3, -0.1), (1, 2, 5, -0.2)], "doc_idx int, beam int, s int, log_p double")
    ends = spark.createDataFrame([(1, 1, 4, -0.3), (1, 1, 2, 0.0), (1, 2, 5, -0.1)], "doc_idx int, beam int, e int, log_q double")
    got = [(r.s, r.e, r.place) for r in spans.beam_spans(starts, ends, 5).orderBy("place").collect()]
    assert got == [(5, 5, 1), (3, 4, 2)]
    scored = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 9, 3.0), (1, 2, 1, 4.0), (1, 2, 3, -1e6)], "doc_idx int, s int, e int, score double")
    tokens = spark.createDataFrame([(1, i, i != 2) for i in range(10)], "doc_idx int, token int, best boolean")
    assert [(r.s, r.e) for r in spans.readable(scored, tokens, 5).collect()] == [(0, 1)]
    assert spans.above(scored).count() == 3


def test_batches_and_losses(spark):
    q = spark.createDataFrame([(i, i // 2, i, [float(i), 1.0]) for i in range(6)], "qid int, batch int, pid int, qvec array<double>")
    p = q.select("pid", "batch", F.col("qvec").alias("pvec"))
    pairs = lambda before: {(r.qid, r.pid) for r in training.batch_scores(q, p, before).collect()}
    assert pairs(0) == {(i, j) for i in range(6) for j in range(6) if i // 2 == j // 2}
    assert pairs(1) == {(i, j) for i in range(6) for j in range(6) if 0 <= i // 2 - j // 2 <= 1}
    far = spark.createDataFrame([(1, 1000.0, True), (1, 0.0, False), (2, -900.0, False)], "g int, s double, t boolean")
    loss = {r.g: r.loss for r in training.marginal_loss(far, ["g"], "s", F.col("t")).collect()}
    assert loss[1] == pytest.approx(0.0) and loss[2] is None
    rate = training.questions_per_second(spark.createDataFrame([(i, 64, 2.0 if i >= 5 else 100.0) for i in range(9)], "batch int, questions int, seconds double")).first()
    assert (rate.questions, rate.seconds, rate.rate) == (256, 8.0, 32.0)
