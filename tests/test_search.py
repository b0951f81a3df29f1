"""Index and search operators: pruned search with all probes is exact, merging twice changes nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.operators import corpus, index, mips, phrases, sampling, search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(i, [float(x) for x in rng.integers(-9, 9, 8)]) for i in range(200)], "id bigint, vec array<double>")


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("id < 5").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def test_exact_and_all_probes(vectors, queries):
    exact = mips.exact_top_k(vectors, queries, 7)
    matrix = {r.id: np.array(r.vec) for r in vectors.collect()}
    for q in range(5):
        want = sorted(matrix, key=lambda i: (-matrix[i] @ matrix[q], i))[:7]
        assert [r.id for r in exact.where(f"qid = {q}").orderBy("rank").collect()] == want
    cents = index.train_centroids(vectors, 6)
    postings = index.assign(vectors, cents)
    assert postings.count() == 200
    pruned = mips.pruned_top_k(postings, cents, queries, 7, probes=6)
    cols = ["qid", "id", "score", "rank"]
    assert sorted(map(tuple, pruned.select(cols).collect())) == sorted(map(tuple, exact.select(cols).collect()))
    assert mips.pruned_top_k(postings, cents, queries, 7, probes=1).count() <= 35


def test_queries_in_blocks(vectors, queries, monkeypatch):
    whole = sorted(map(tuple, mips.exact_top_k(vectors, queries, 3).collect()))
    monkeypatch.setattr(mips.query_blocks, "__defaults__", (2,))
    assert sorted(map(tuple, mips.exact_top_k(vectors, queries, 3).collect())) == whole
    assert mips.exact_top_k(vectors, queries.limit(0), 3).count() == 0


def test_product_codes(vectors):
    books, turn = index.train_codebooks(vectors, 4, codes=64, rotate=True)
    assert np.allclose(turn @ turn.T, np.eye(8))
    coded = index.pq_encode(vectors, books, turn)
    q = vectors.where("id = 0").first().vec
    got = {r.id: r.score for r in index.pq_scores(coded, q, books, turn).collect()}
    true = {r.id: float(np.dot(r.vec, q)) for r in vectors.collect()}
    a, b = np.array([got[i] for i in range(200)]), np.array([true[i] for i in range(200)])
    assert np.corrcoef(a, b)[0, 1] > 0.9


def test_all_filtered_keeps_the_first(spark):
    rows = [(0, i, 0.0, 0.0) for i in range(4)] + [(1, i, s, e) for i, (s, e) in enumerate([(0.9, 0.0), (0.0, 0.0), (0.9, 0.9), (0.0, 0.9), (0.0, 0.0), (0.5, 0.9)])]
    kept = phrases.filtered(spark.createDataFrame(rows, "doc_idx bigint, word_idx bigint, fs double, fe double"), 0.4)
    got = sorted((r.doc_idx, r.idx, r.f2o) for r in kept.collect())
    assert got == [(0, 0, 0), (1, 0, 0), (1, 1, 2), (1, 2, 3), (1, 3, 5)]
    links = {(r.idx, r.o): r.end_idx for r in phrases.start_to_end(kept.where("doc_idx = 1"), 0.4, 3).collect()}
    assert links[0, 0] == -1 and links[0, 2] == 1 and links[1, 1] == 2


def test_upsert_and_offsets(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_idx int, v string")
    assert sorted(r.v for r in phrases.upsert(old, spark.createDataFrame([(2, "c")], "doc_idx int, v string")).collect()) == ["a", "c"]
    p = spark.createDataFrame([(1, 0, "abc"), (1, 1, "de")], "doc_idx int, par_idx int, text string")
    assert [r.offset for r in phrases.paragraph_offsets(p).orderBy("par_idx").collect()] == [0, 10]
    w = spark.createDataFrame([(1, 1, 0, ["c"]), (1, 0, 1, ["b"]), (1, 0, 0, ["a"])], "doc_idx int, par_idx int, span_idx int, tokens array<string>")
    assert phrases.assemble(w).first().tokens == ["a", "b", "c"]
    f = spark.createDataFrame([(0, 5), (5, 9), (10, 12)], "first_doc int, last_doc int")
    assert [r.first_doc for r in phrases.chain_breaks(f).collect()] == [10]


HITS = [
    (1, 0, 1, 10, 0, 0, 9.0, "T", 0, 3, "one [PAR] two", "one"), (1, 1, 1, 10, 0, 0, 9.0, "T", 0, 3, "one [PAR] two", "one"),
    (1, 0, 2, 11, 1, 1, 8.0, "U", 10, 13, "one [PAR] two", "The one!"), (1, 0, 3, 12, 0, 0, 7.0, "T", 10, 13, "one [PAR] two", "two"),
]


@pytest.mark.parametrize(("strategy", "n"), [("opt1", 2), ("opt2", 2), ("opt3", 2), ("opt4", 2)])
def test_merging(spark, strategy, n):
    df = spark.createDataFrame(HITS, "qid int, anchor int, rank int, doc_idx int, start_idx int, end_idx int, score double, title string, start_pos int, end_pos int, context string, answer string")
    once = search.aggregate(search.to_paragraph(df), strategy)
    assert once.count() == n and search.aggregate(once, strategy).count() == n
    if strategy == "opt4":
        assert {tuple(r.titles) for r in once.collect()} == {("T", "U"), ("T",)}
    assert search.best(once, 1).first().score == 9.0


def test_sentences(spark):
    df = spark.createDataFrame([("One here. Two there. Three.", 14, 19)], "context string, start_pos int, end_pos int")
    r = search.to_sentences(df).first()
    assert r.context == "Two there." and r.context[r.start_pos : r.end_pos] == "there"


def test_samples_are_repeatable(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("g"), F.lit(5).cast("bigint").alias("w"))
    a = {r.id for r in sampling.quota_sample(rows, "g", "id", 4).collect()}
    assert a == {r.id for r in sampling.quota_sample(rows.repartition(5), "g", "id", 4).collect()} and len(a) == 12
    assert sampling.word_budget_sample(rows, "id", "w", 101).count() == 20
    assert sampling.shuffled(rows, "id").count() == 300


def test_articles(spark):
    q = spark.createDataFrame([(1, "T", "aa bb cc dd", "cc", 6), (2, "V", "aa", "aa", 0)], "qid int, title string, context string, answer string, answer_start int")
    a = spark.createDataFrame([("T", 0, "other"), ("T", 1, "AA  bb CC dd more")], "title string, par_idx int, text string")
    got = {r.qid: r for r in corpus.locate_in_article(q, a).collect()}
    assert got[1].wiki_matched and got[1].context.startswith("AA") and not got[2].wiki_matched and got[2].context == "aa"
    assert index.index_name(256, fine_tuned="9", first_passage=True) == "256_flat_OPQ96_first_ft9"


def test_records(spark):
    from phrasemill.operators import records

    assert records.raw_span("new york's", "in New York 's town") == "New York 's"
    assert records.raw_span("absent", "Raw Text") == "Raw Text" and records.raw_span(None, None) is None
    assert records.tightened(["a", "b", "c"], 0, 2, ["b"]) == (1, 1) and records.tightened(["a"], 0, 0, ["z"]) == (0, 0)
    assert records.balanced({"a": 5, "b": 4, "c": 3}, 2) == [["a"], ["b", "c"]]
    q = spark.createDataFrame([(1, 10, [11]), (2, 11, [])], "id int, passage_id int, negatives array<int>")
    p = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "passage_id int, text string")
    assert sorted((r.id, r.passage, r.negative) for r in records.with_negatives(q, p).collect()) == [(1, "x", "y"), (2, "y", "z")]
    t = spark.createDataFrame([([("<p>", True), ("one", False), ("two", False)],)], "t array<struct<token: string, html_token: boolean>>")
    assert t.select(records.visible_context(F.col("t"))).first()[0] == "one two"
    two = spark.createDataFrame([("york city", "New York  City, NY")], "p string, r string")
    assert two.select(records.final_text("p", "r")).first()[0] == "York  City"
