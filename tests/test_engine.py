"""The engine end to end on a few phrases."""

import pytest
from pyspark.sql import functions as F

from phrasemill.engine import PhraseEngine
from phrasemill.operators import index, metrics
from phrasemill.options import EvaluationOptions, SearchOptions


@pytest.fixture(scope="module")
def parts(spark):
    vecs = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 1.0, 0.0]]
    phrases = spark.createDataFrame([(d, i, i, [x + d / 10 for x in vecs[i]]) for d in range(2) for i in range(4)], "doc_idx bigint, idx bigint, f2o bigint, vec array<double>")
    docs = spark.createDataFrame([(0, "T", "the red car stops"), (1, "U", "a blue cat runs")], "doc_idx bigint, title string, context string")
    questions = spark.createDataFrame([(1, "which?", ["blue cat"], [0.0, 3.0, 0.0], [0.0, 0.0, 3.0])], "qid bigint, question string, golds array<string>, q_start array<double>, q_end array<double>")
    return phrases, docs, questions


def test_search_and_evaluate(parts):
    phrases, docs, questions = parts
    engine = PhraseEngine(phrases, docs, lambda q: q.select("qid", "q_start", "q_end"))
    best = engine.search(questions, SearchOptions(top_k=3)).where("place = 1").first()
    assert best.found == "blue cat"
    assert engine.search(questions, SearchOptions(unit="document", top_k=1)).first().found == "U"
    assert engine.evaluate(questions, SearchOptions(top_k=3), EvaluationOptions(top_k=3)).first().em_top1 == 100
    spark = phrases.sparkSession
    only = spark.createDataFrame([("red",)], "candidate string")
    assert engine.evaluate(questions, SearchOptions(top_k=3), EvaluationOptions("webq", 3), only).first().em_top1 == 0
    pruned = PhraseEngine(phrases, docs, engine.encoder, index.train_centroids(phrases, 2))
    assert pruned.search(questions, SearchOptions(top_k=3, probes=2)).where("place = 1").first().found == "blue cat"
    pruned.set_encoder(lambda q: q.select("qid", F.col("q_end").alias("q_start"), F.col("q_start").alias("q_end")))
    assert pruned.search(questions).count() > 0


def test_modes_and_vectors(parts):
    phrases, docs, questions = parts
    engine = PhraseEngine(phrases, docs, lambda q: q.select("qid", "q_start", "q_end"))
    o = SearchOptions(top_k=3)
    assert engine.run("query", questions, options=o).collect() == engine.search(questions, o).collect()
    spans = engine.run("spans", questions, options=o)
    stored = {(r.doc_idx, r.idx): r.vec for r in phrases.collect()}
    rows = spans.collect()
    assert rows and all(r.start_vec == stored[r.doc_idx, r.start_idx] and r.end_vec == stored[r.doc_idx, r.end_idx] for r in rows)
    both = {r.dataset: r for r in engine.run("eval_all", {"nq": questions, "webq": questions}, search_options=o, candidates={"webq": questions.select(F.lit("red").alias("candidate"))}).collect()}
    assert both["nq"].em_top1 == 100 and both["webq"].em_top1 == 0
    assert engine.run("eval", questions, search_options=o).first().em_top1 == 100
    with pytest.raises(ValueError):
        engine.run("serve", questions)


def test_questions_of_any_id(parts):
    phrases, docs, questions = parts
    engine = PhraseEngine(phrases, docs, lambda q: q.select("qid", "q_start", "q_end"))
    named = questions.withColumn("qid", F.lit("s1"))
    assert [r.found for r in engine.search(named).orderBy("place").collect()] == [r.found for r in engine.search(questions).orderBy("place").collect()]


def test_options():
    with pytest.raises(ValueError):
        SearchOptions(unit="word")
    assert SearchOptions(unit="document", top_k=4).fetch == 8 and SearchOptions().merge == "opt1"
    assert EvaluationOptions("trec").match == "regex"


def test_ids_and_choices(spark):
    rows = spark.createDataFrame([("T", "(x)")], "title string, p string")
    ids = spark.createDataFrame([("T", "9")], "title string, wikipedia_id string")
    assert metrics.with_article_ids(rows, ids).first().wikipedia_id == "9"
    with pytest.raises(Exception, match="no article"):
        metrics.with_article_ids(rows, ids.limit(0)).collect()
    got = rows.select(metrics.chosen_answer(F.col("p"), F.col("title"), False), metrics.chosen_answer(F.col("p"), F.col("title"), True)).first()
    assert list(got) == ["x", "T"]
    s = spark.createDataFrame([("a", 1.0), ("a", 0.0)], "tag string, em double")
    assert metrics.by_group(s, ["tag"], ["em"]).first().em == 0.5


def test_pages_of_one_address_are_different_articles(spark, tmp_path):
    """addresses repeat, and may be null."""
    from oracle import rows_of

    from phrasemill.plans import catalog

    spark.createDataFrame([(0, "http://a"), (1, "http://a"), (2, None)], "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(c, t) for c in range(3) for t in range(2)], "conv_id bigint, turn bigint").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in catalog.QUERIES["title_id_lookup"](spark, str(tmp_path)).collect()]
    assert rows_of(["a", "b", "c"], got) == rows_of(["a", "b", "c"], [(c, t, str((c + t) % 3)) for c in range(3) for t in range(2)])
