"""Functions on fixtures worked by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from phrasemill.functions import text as X
from phrasemill.functions import vectors as V
from phrasemill.operators import corpus, metrics


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "open_", "reading", "plain"), [("the cat", "cat", 1, 1, 1), ("yes", "no", 0, 0, 0), ("", "", 0, 1, 0), ("a b b", "b b c", 0.8, 0.8, 0.8), ("yes sir", "yes", 0, 2 / 3, 2 / 3)])
def test_f1(spark, a, b, open_, reading, plain):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(X.f1_open(F.col("a"), F.col("b")), X.f1_reading(F.col("a"), F.col("b")), X.f1_plain(F.col("a"), F.col("b"))).first()
    assert list(got) == pytest.approx([open_, reading, plain])


def test_normalize_answer(spark):
    assert one(spark, X.normalize_answer(F.col("a")), a="  The U.S.-based  Cat, an apple!") == "usbased cat apple"
    assert one(spark, X.normalize_light(F.col("a")), a="The Cat!") == "the cat"


def test_questions(spark):
    assert one(spark, X.strip_question(F.col("a")), a="who??") == "who?"
    q = "x" * 10 + "[START_ENT] y [END_ENT]" + "z" * 10
    assert one(spark, X.entity_window(F.col("a"), 3), a=q) == "xxx[START_ENT] y [EN"
    assert one(spark, X.entity_window(F.col("a"), 3), a="plain") == "plain"
    assert one(spark, X.prefixed_id(F.col("a"), F.col("b")), a="7", b="nq.json") == "nq-7"
    assert one(spark, X.plain_title(F.col("a")), a=" New_York ") == "New York"


def test_matching(spark):
    df = spark.createDataFrame([("The Émile zola novel", "emile", "zola NOVEL", "(")], "t string, a string, b string, p string")
    row = df.select(X.string_match(F.col("t"), F.col("b")).alias("yes"), X.string_match(F.col("t"), F.col("a")).alias("no"), X.string_match(F.col("t"), F.lit(" ")).alias("none"), X.regex_search(F.col("t"), "zola").alias("s"), X.regex_match(F.col("t"), "zola").alias("m"), X.regex_match_each(F.col("t"), F.col("p")).alias("bad")).first()
    assert list(row) == [True, False, True, True, False, False]


def test_tokens(spark):
    assert one(spark, X.simple_tokens(F.col("a")), a="don't 3.5") == ["don", "'", "t", "3", ".", "5"]
    assert one(spark, X.whitespace_tokens(F.col("a")), a=" a\tb  c") == ["a", "b", "c"]
    assert one(spark, X.ngrams(F.col("a"), 2), a=["a", "b", "c"]) == ["a", "a b", "b", "b c", "c"]


def test_paragraph_bounds(spark):
    low, high = X.paragraph_bounds(F.col("a"), F.lit(11), F.lit(13))
    text = "one [PAR] two x [PAR] three"
    df = spark.createDataFrame([(text,)], "a string").select(low.alias("l"), high.alias("h")).first()
    assert text[df.l : df.h] == "two x"


def test_python_functions(spark):
    assert one(spark, X.html_unescape(F.col("a")), a="a &amp; b") == "a & b"
    assert one(spark, X.rouge_l(F.col("a"), F.col("b")), a="the cat sat", b="the cat ran") == pytest.approx(2 / 3)
    assert one(spark, X.bleu(F.col("a"), F.col("b")), a="a b c d", b="a b c d") == pytest.approx(1)
    assert X.sentence_starts("One. Two! Three") == [0, 5, 10]


def test_codes(spark):
    v = [0.1, -0.52, 0.33, 0.0]
    codes = one(spark, V.to_int8(F.col("a")), a=v)
    back = one(spark, V.from_int8(F.lit(codes)))
    assert max(abs(x - y) for x, y in zip(v, back)) <= 0.5 / 20
    packed = one(spark, V.to_int4(F.col("a")), a=v)
    assert len(packed) == 2 and max(abs(x - y) for x, y in zip(v, one(spark, V.from_int4(F.lit(packed))))) <= 0.5 / 4


def test_packing_paragraphs(spark):
    rows = [(["x" * 100, "y" * 450, "z" * 30],), (["s" * 20],), ([],)]
    df = spark.createDataFrame(rows, "pieces array<string>")
    got = [[len(p) for p in r.packs] for r in corpus.pack_paragraphs(df).collect()]
    assert got == [[552 + 1 + 31], [21], []]


def test_evidence_ranks():
    assert metrics.ranks_of_sets(["a", "b", "c"], [["a", "c"], ["b"]]) == ([True, True], 2)
    assert metrics.ranks_of_sets(["x", "a"], [["a"]]) == ([False, True], 1)
    assert metrics.ranks_of_sets([], [["a"]]) == ([], 1)


def test_metrics(spark):
    assert one(spark, metrics.r_precision(F.col("g"), F.col("s")), g=["a", "b"], s=[["b", "c"], ["a"]]) == 1.0
    assert one(spark, metrics.padded(F.col("a"), 4), a=["x", "y"]) == ["x", "y", "y", "y"]
    assert one(spark, metrics.restrict(F.col("a"), F.col("b")), a=["X", "y"], b=["x"]) == ["X"]
    assert one(spark, metrics.support_scores(F.col("a"), F.col("b"))["f1"], a=["x"], b=["x", "y"]) == pytest.approx(2 / 3)
    df = spark.createDataFrame([(1, i, i == 4) for i in range(30)] + [(2, 0, True), (3, 0, False)], "qid int, place int, hit boolean")
    m = metrics.passage_metrics(df, (1, 5)).first()
    # a question without a hit counts as found at one over its number of passages
    assert (m.hit1, m.hit5) == pytest.approx((1 / 3, 1)) and m.mrr20 == pytest.approx((1 + 1 / 5 + 1 / 3) / 3)


def test_best_threshold(spark):
    rows = [(1, 0.1, True, 1.0, False), (2, 0.2, False, 0.0, False), (3, 0.3, True, 1.0, False), (4, 0.9, False, 0.0, False)]
    df = spark.createDataFrame(rows, "qid int, na_prob double, has_ans boolean, score double, empty boolean")
    got = metrics.best_threshold(df).first()
    assert (got.best, got.threshold) == (75.0, 0.1)


def test_spaces(spark):
    assert one(spark, X.plain_spaces(F.col("a")), a="a b") == "a b"
    assert one(spark, X.whitespace_tokens(F.col("a")), a="a b c d") == ["a", "b c", "d"]


def test_dull_ngrams(spark):
    df = spark.createDataFrame([(1, "The cat of dog - x '' mice"), (2, None), (3, ""), (4, "word")], "doc_id int, text string")
    terms = lambda n, m: {(r.doc, r.term): r.tf for r in corpus.term_counts(df, n, m).collect()}
    got = {m: {t for d, t in terms(2, m) if d == 1} for m in ("any", "all", "ends", None)}
    assert got["any"] == {"cat", "dog", "x", "mice"}
    assert got["all"] == {"cat", "dog", "x", "mice", "the cat", "cat of", "of dog", "dog -", "- x", "x '", "' mice"}
    assert got["ends"] == got["any"] and (4, "word") in terms(3, "any")
    assert {t for d, t in terms(3, "ends") if d == 1} == got["any"] | {"cat of dog", "dog - x"}
    assert len(got[None]) == 8 + 8


def test_feature_hash_is_unsigned_murmur_of_seed_zero(spark):
    # published test values of the x86 32-bit variant
    assert X.murmur3([b"", b"a", b"abc", b"Hello, world!", b"The quick brown fox jumps over the lazy dog"]).tolist() == [0, 0x3C2569B2, 0xB3DD93FA, 0xC0363E43, 0x2E4FF723]
    df = spark.createDataFrame([("abc",), ("",), ("abc",)], "t string")
    assert [r[0] for r in df.select(X.feature_hash(F.col("t"), F.lit(1000))).collect()] == [0xB3DD93FA % 1000, 0, 0xB3DD93FA % 1000]


def test_documents_are_counted_whole(spark, monkeypatch):
    """F6, F7, F8: some documents are counted at a time, whatever the batches, and rows of one id together."""
    import pyarrow as pa

    monkeypatch.setattr(corpus, "TOKENS", 5)
    rows = [(i // 3 if i > 5 else None, ["a"] * (i % 4)) for i in range(40)]
    table = pa.table({"doc": pa.array([d for d, _ in rows], pa.int64()), "w": pa.array([w for _, w in rows], pa.list_(pa.string()))})
    parts = [(d.to_pylist(), w.to_pylist()) for d, w in corpus._whole_documents(table.to_batches(7))]
    assert [r for d, w in parts for r in zip(d, w, strict=True)] == rows and len(parts) > 5
    assert all(a[0][-1] != b[0][0] for a, b in zip(parts, parts[1:], strict=False))
    df = spark.createDataFrame([(1, "cat dog"), (1, "dog cat dog"), (None, "cat"), (None, "cat")], "doc_id int, text string")
    got = {(r.doc, r.term): r.tf for r in corpus.term_counts(df).collect()}
    assert got == {(1, "cat"): 2, (1, "dog"): 3, (1, "cat dog"): 2, (1, "dog cat"): 1, (None, "cat"): 2}
