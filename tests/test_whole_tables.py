"""Queries over whole tables."""

import hashlib
import re
import unicodedata

import pytest
from oracle import differences
from pyspark.sql import functions as F

from phrasemill.functions import text as X
from phrasemill.operators import metrics
from phrasemill.plans import catalog
from phrasemill.plans import views as W

SF = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"


def test_string_match_whole(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    b = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    token = lambda t: f" {' '.join(t)} "
    docs = [(i, token(t)) for i, t in d.select("doc_id", X.simple_tokens(F.lower("text"))).collect()]
    items = [(i, token(t)) for i, t in b.select("item_id", X.simple_tokens(F.lower(X.nfd(F.col("text"))))).collect()]
    want = sorted((i, j) for i, t in docs for j, a in items if a in t)
    assert want and sorted(map(tuple, catalog.QUERIES["string_match"](spark, SF).collect())) == want


def test_matches_odd_answers(spark):
    docs = spark.createDataFrame([(1, "The cat sat"), (2, "cat the"), (3, None), (4, ""), (None, "a cat sat")], "doc_id bigint, t string")
    answers = spark.createDataFrame([(1, "the CAT"), (2, "dog"), (3, None), (4, " "), (5, "cat sat")], "item_id bigint, a string")
    got = sorted(map(tuple, metrics.matches(docs, answers).select("doc_id", "item_id").collect()), key=repr)
    plain = docs.crossJoin(answers).where(X.string_match(docs["t"], answers["a"])).select("doc_id", "item_id")
    assert got == sorted(map(tuple, plain.collect()), key=repr) and (None, 5) in got and (1, 1) in got and (2, 1) not in got


def test_results_hold_every_document(spark):
    assert W.results(spark, BIG).count() == spark.read.parquet(f"{BIG}/documents.parquet").count()


def test_no_query_samples_its_tables():
    for name, sql in catalog.ORACLES.items():
        if name == "shard_lookup_range":  # a range of ids is its feature
            continue
        assert not re.search(r"_id < \d|lang = '|doc_id % 2 = 0\)", sql), name


@pytest.mark.parametrize("name", ["span_vote", "kilt_align", "ngram_counts", "doc_freq", "tfidf", "hits_mrr_p20", "conditional_accuracy", "bucket_metrics", "max_context", "best_threshold", "proportional_sample", "stratified_sample", "title_id_lookup"])
def test_whole_equals_sql(spark, name):
    assert not differences(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_nfd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((i, hashlib.md5(unicodedata.normalize("NFD", t).encode()).hexdigest()) for i, t in docs)
    assert sorted(map(tuple, catalog.QUERIES["nfd"](spark, SF).collect())) == want
