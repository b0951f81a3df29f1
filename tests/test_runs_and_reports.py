"""Whole runs: joint scores, provenance reports, modes and stages by name, sentences around hits."""

import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemill import jobs
from phrasemill.operators import lists, metrics, records, search
from phrasemill.options import IndexOptions
from phrasemill.sources import manifest


def normal(text):
    words = "".join(c for c in text.lower() if c not in string.punctuation)
    return [w for w in re.sub(r"\b(a|an|the)\b", " ", words).split() if w]


def scores(p, g):
    a, b = normal(p), normal(g)
    both = sum((Counter(a) & Counter(b)).values())
    if a != b and {" ".join(a), " ".join(b)} & {"yes", "no", "noanswer"}:
        both = 0
    precision, recall = (both / len(a) if a else 0.0), (both / len(b) if b else 0.0)
    return float(a == b), (2 * both / (len(a) + len(b)) if a or b else 0.0), precision, recall


def sets(p, g):
    p, g = set(p), set(g)
    precision, recall = (len(p & g) / len(p) if p else 0.0), (len(p & g) / len(g) if g else 0.0)
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return float(f1 == 1), f1, precision, recall


def test_joint_scores_equal_a_loop(spark):
    rng = random.Random(1)
    texts = ["The cat", "cat", "yes", "no", "a", "", "big cat sat.", "sat, big", None]
    gold = [(i, rng.choice(texts), rng.choice([["a", "b"], ["a"], [], ["a", "a", "c"], None])) for i in range(60)]
    guess = [(i, rng.choice(texts), rng.choice([["a"], ["b", "c"], [], ["a", "b"], None])) for i in range(60) if i % 5]
    kind = "id bigint, answer string, facts array<string>"
    r = metrics.file_scores(spark.createDataFrame(gold, kind), spark.createDataFrame(guess, kind)).first().asDict()
    by = {i: (t, f) for i, t, f in guess}
    want = Counter()
    for i, t, f in gold:
        b, s = by.get(i, (None, None))
        x = scores(b, t) if b is not None and t is not None else (0.0,) * 4
        y = sets(s, f) if s is not None and f is not None else (0.0,) * 4
        p, q = x[2] * y[2], x[3] * y[3]
        for name, v in zip(("em", "f1", "precision", "recall"), x, strict=True):
            want[name] += v
        for name, v in zip(("em", "f1", "precision", "recall"), y, strict=True):
            want["sp_" + name] += v
        for name, v in zip(("em", "f1", "precision", "recall"), (x[0] * y[0], 2 * p * q / (p + q) if p + q else 0.0, p, q), strict=True):
            want["joint_" + name] += v
    assert r.pop("missing") == 12
    assert all(abs(v - want[k] / 60) < 1e-9 for k, v in r.items()) and len(r) == 12


def test_provenance_report(spark):
    gold = spark.createDataFrame([(" 1", ["Paris"], [["a", "b"], ["c"]]), ("2", ["x", "the y"], [["d"]]), ("3", ["z"], [["e"]])], "id string, answers array<string>, sets array<array<string>>")
    guess = spark.createDataFrame([("1 ", "paris!", ["c", "a"]), ("2", "y z", ["q", "d"])], "id string, answer string, pages array<string>")
    r = metrics.provenance_report(gold, guess, (1, 2)).first()
    assert r.missing == 1 and abs(r.em - 1 / 3) < 1e-9 and abs(r.f1 - (1 + 2 / 3) / 3) < 1e-9
    assert abs(r.rprec - 1 / 3) < 1e-9 and abs(r.gated_em - 1 / 3) < 1e-9 and abs(r.gated_f1 - 1 / 3) < 1e-9
    assert abs(r.p1 - 1 / 3) < 1e-9 and abs(r.s2 - 2 / 3) < 1e-9 and abs(r.p2 - (2 / 2 + 1 / 2) / 3) < 1e-9


def test_stages_by_name(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(300, 8))
    rows = spark.createDataFrame(pa.table({"id": pa.array(np.arange(300)), "vec": lists.arrays(x)}))
    options = IndexOptions(clusters=16, parts=4, sample=1.0)
    for name in ("a", "b"):
        out = jobs.run_stages(("all",), f"{tmp_path}/{name}", rows, options, cells=4)
        assert out.postings.count() == 300 and out.cells.count() == 4 and out.clusters.count() <= 16
    # shards that share one quantiser are merged without a copy
    jobs.run_stages(("add",), f"{tmp_path}/a", rows.limit(100), options, shard="more")
    merged = jobs.run_stages(("merge",), f"{tmp_path}/a", rows, options, shards=(f"{tmp_path}/b",))
    assert [s.rows for s in manifest.shards(spark, f"{tmp_path}/a")] == [300, 100, 300]
    assert merged.postings.select("id").distinct().count() == 700
    with pytest.raises(ValueError):
        jobs.run_stages(("fine",), f"{tmp_path}/a", rows)


def test_sentences_around_hits_equal_a_loop(spark):
    rng = random.Random(3)
    words = ["one", "two.", "three!", 'four?"', "five", "six."]
    rows = []
    for q in range(80):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 20)))
        start = rng.randrange(len(text))
        rows.append((q, text, start, rng.randint(start, len(text))))
    df = spark.createDataFrame(rows, "qid bigint, context string, start_pos bigint, end_pos bigint")
    for window in (0, 1):
        got = {r.qid: (r.context, r.start_pos, r.end_pos) for r in search.to_sentences(df, window).collect()}
        for q, text, start, end in rows:
            starts = [0, *(m.end() for m in re.finditer(r"[.!?]+[\"')\]]*\s+", text) if m.end() < len(text))]
            at = lambda place: max(i for i, s in enumerate(starts) if s <= place)  # noqa: B023, E731
            first, last = max(at(start) - window, 0), min(at(max(end - 1, 0)) + window, len(starts) - 1)
            high = starts[last + 1] if last + 1 < len(starts) else len(text)
            assert got[q] == (text[starts[first] : high].rstrip(), start - starts[first], end - starts[first])


def test_drawn_occurrences(spark):
    rows = [(i, "abcab" * 7, "ab") for i in range(200)] + [(900, "xyz", "ab"), (901, None, "ab"), (902, "ab", "")]
    df = spark.createDataFrame(rows, "id bigint, t string, a string").withColumn("at", records.drawn_occurrence(F.col("t"), F.col("a"), F.col("id")))
    got = {r.id: r.at for r in df.collect()}
    places = {m.start() for m in re.finditer("ab", "abcab" * 7)}
    assert {got[i] for i in range(200)} == places and got[900] is None and got[901] is None and got[902] is None
    again = {r.id: r.at for r in df.repartition(5).collect()}
    assert again == got
