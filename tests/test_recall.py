"""Trained indexes find at least nine tenths of the exact neighbours of every 50th vector."""

import numpy as np
import pytest
from test_every_query import SF, brute_force

from phrasemill.operators import index, mips
from phrasemill.plans import catalog
from phrasemill.plans import views as W


@pytest.mark.parametrize("name", ["ivf_probe_topk", "pq_encode_score", "opq_encode_score"])
def test_recall(spark, name):
    want, got = brute_force(spark), {}
    for r in catalog.QUERIES[name](spark, SF).collect():
        got.setdefault(r.qid, set()).add(r.id)
    recall = [len(got[q] & set(ids)) / len(ids) for q, ids in want.items()]
    assert set(got) == set(want) and sum(recall) / len(recall) >= 0.9


@pytest.mark.parametrize("name", ["ivf_recall_at_k", "pq_recall_at_k", "opq_recall_at_k", "graph_recall_at_k", "ivf_lists_recall"])
@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_query(spark, name, sf):
    rows = catalog.QUERIES[name](spark, f"/root/testdata/sf{sf}").collect()
    assert sum(r.recall for r in rows) / len(rows) >= 0.9


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_walks_and_lists_save_work(spark, sf):
    spent = catalog.QUERIES["graph_products"](spark, f"/root/testdata/sf{sf}").collect()
    assert sum(r.products for r in spent) < 0.25 * sum(r.vectors for r in spent)
    read = catalog.QUERIES["ivf_lists_recall"](spark, f"/root/testdata/sf{sf}").collect()
    assert sum(r.read for r in read) < 0.25 * len(read)


@pytest.mark.parametrize("block", [65_536, 3])
def test_pruned_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(mips, "CENTROID_BLOCK", block)
    rows = W.coded(spark, SF)
    c, q = index.train_centroids(rows, 10), catalog._asked(spark, SF)
    postings = index.assign(rows, c)
    cents = {r.cluster_id: np.array(r.centroid) for r in c.collect()}
    vectors = {r.id: np.array(r.vec) for r in rows.collect()}
    best = lambda v, n: sorted(cents, key=lambda i: (-cents[i] @ v, i))[:n]
    of = {r.id: r.cluster_id for r in postings.collect()}
    assert of == {i: best(v, 1)[0] for i, v in vectors.items()}
    got = {}
    for r in mips.pruned_top_k(postings, c, q, 10, 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    for i, found in got.items():
        near = [j for j in vectors if of[j] in best(vectors[i], 3)]
        assert found == sorted(near, key=lambda j: (-vectors[j] @ vectors[i], j))[:10]


def test_rotation_lessens_the_error_of_codes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) @ rng.normal(size=(16, 16))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, vec array<double>")

    def error(rotate):
        books, rotation = index.train_codebooks(rows, 4, 16, rotate=rotate)
        assert np.allclose(rotation @ rotation.T, np.eye(16))
        got = index.pq_decode(index.pq_encode(rows, books, rotation).select("id", "code"), books).orderBy("id").collect()
        return ((np.array([r.vec for r in got]) - x @ rotation) ** 2).sum()

    assert error(True) < 0.9 * error(False)
