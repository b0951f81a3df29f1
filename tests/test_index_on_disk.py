"""Indexes on disk: shards and versions, inverted lists that prune files, codes scored from tables, graphs."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemill import jobs
from phrasemill.operators import graph, lists, mips
from phrasemill.plans import built
from phrasemill.sources import manifest


def vectors(spark, x, ids=None):
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x)) if ids is None else ids), "vec": lists.arrays(x)}))


def clustered(n, d=16, centres=40, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, d))


def asked(rows, every=50):
    return rows.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def by_query(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


def recall(want, got):
    return np.mean([len(set(got.get(q, ())) & set(ids)) / len(ids) for q, ids in want.items()])


def test_best_of_breaks_ties_by_place():
    rng = np.random.default_rng(0)
    score = rng.integers(0, 4, (50, 30)).astype(float)
    score[rng.random(score.shape) < 0.3] = -np.inf
    for k in (1, 5, 29, 30, 40):
        row, column = mips.best_of(score, k)
        for i in range(50):
            want = [j for j in np.argsort(-score[i], kind="stable")[:k] if score[i, j] > -np.inf]
            assert sorted(want) == column[row == i].tolist()


def test_many_equal_vectors_stay_few_rows(spark):
    rows = vectors(spark, np.ones((3000, 2))).repartition(2)
    q = rows.where("id < 2").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    assert by_query(mips.exact_top_k(rows, q, 3)) == {0: [0, 1, 2], 1: [0, 1, 2]}


# manifest


def test_ids_of_many_documents_stay_apart(spark, tmp_path):
    """Two shards with more than 2^20 documents each, merged, rerun, and with a torn run beside them."""
    for name in ("a", "b"):
        ids = [d << 20 | p for d in (0, 5, (1 << 20), (1 << 20) + 7) for p in (0, 3)]
        jobs.build_index(vectors(spark, np.eye(8)[:, :3] + np.arange(8)[:, None], ids), f"{tmp_path}/{name}", 2)
    both = f"{tmp_path}/both"
    for _ in range(2):
        jobs.merge_indexes(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], both)
        merged, centroids = jobs.load_index(spark, both)
        assert merged.count() == 16 and merged.select("id").distinct().count() == 16 and centroids.count() == 2
    s = {x.name: x for x in manifest.shards(spark, both)}
    assert s["0/all"].base == 0 and s["1/all"].base % manifest.STEP == 0 and s["1/all"].base > (1 << 20) + 7 << 20
    phrases = spark.createDataFrame([((1 << 20) + 7, 3)], "doc_idx bigint, idx int")
    found = jobs.merged_phrases(spark, both, {"0/all": phrases, "1/all": phrases})
    ids = {(r.doc_idx << 20) + r.idx for r in found.collect()}
    assert ids <= {r.id for r in merged.collect()} and len(ids) == 2
    # the same ids as through a join by shard
    got = merged.withColumn("own", F.col("id")).select("shard", "id").limit(1).first()
    mapped = spark.createDataFrame([(got.shard, got.id - s[got.shard].base)], "s string, i bigint").select(manifest.global_id(spark, both, F.col("s"), F.col("i"))).first()[0]
    assert mapped == got.id


def test_rerun_torn_run_and_versions(spark, tmp_path):
    path, rows = f"{tmp_path}/x", vectors(spark, clustered(120, 4, 5))
    jobs.build_index(rows, path, 4)
    jobs.build_index(rows, path, 4)
    postings, _ = jobs.load_index(spark, path)
    assert postings.count() == 120
    jobs.add_shard(rows, path, "more")
    jobs.add_shard(rows.limit(60), path, "more")
    assert jobs.load_index(spark, path)[0].count() == 180
    # a run that wrote its rows but never committed
    os.makedirs(f"{path}/lists/torn/bucket=0")
    assert jobs.load_index(spark, path)[0].count() == 180
    assert manifest.versions(spark, path) == [1, 2, 3, 4]
    assert json.loads(open(f"{path}/manifest/v00000004.json").read())[1]["name"] == "more"
    # a version that another writer took in the meantime isn't overwritten
    taken = manifest.versions
    try:
        manifest.versions = lambda *_: [3]
        with pytest.raises(RuntimeError):
            manifest.commit(spark, path, [])
    finally:
        manifest.versions = taken
    assert jobs.load_index(spark, path)[0].count() == 180
    with pytest.raises(ValueError):
        jobs.add_shard(vectors(spark, np.ones((2, 4)), [-1, 0]), path, "negative")


def test_bases_of_replaced_shards():
    s = [manifest.Shard("a", "f", 1, 10)]
    known = manifest.placed([], s[0])
    known = manifest.placed(known, manifest.Shard("b", "g", 1, manifest.STEP + 1))
    assert [(x.name, x.base) for x in known] == [("a", 0), ("b", manifest.STEP)]
    known = manifest.placed(known, manifest.Shard("a", "h", 1, 5))
    assert [(x.name, x.base, x.folder) for x in known] == [("a", 0, "h"), ("b", manifest.STEP, "g")]
    known = manifest.placed(known, manifest.Shard("a", "i", 1, 2 * manifest.STEP))
    assert [(x.name, x.base) for x in known] == [("b", manifest.STEP), ("a", 3 * manifest.STEP)]


def test_flat_index_prunes_folders(spark, tmp_path):
    rows = vectors(spark, clustered(2000, 8, 30))
    jobs.build_index(rows, f"{tmp_path}/i", 24)
    postings, centroids = jobs.load_index(spark, f"{tmp_path}/i")
    q = asked(rows, 1000)
    top = mips.pruned_top_k(postings, centroids, q, 5, 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert by_query(top) == by_query(mips.pruned_top_k(postings.drop("bucket"), centroids, q, 5, 2))


# lists


@pytest.fixture(scope="module")
def index_of(spark, tmp_path_factory):
    x = clustered(6000, 16, 60)
    rows = vectors(spark, x / np.linalg.norm(x, axis=1)[:, None]).repartition(5).cache()
    out = lists.train(rows, str(tmp_path_factory.mktemp("lists") / "x"), 8, 12, 8)
    lists.add(rows, out, "all")
    return rows, out


def test_postings_lie_in_their_nearest_cluster(index_of):
    rows, found = index_of
    cells = {r.cell: np.array(r.centroid) for r in found.cells.collect()}
    clusters = {r.cluster_id: (r.cell, np.array(r.centroid)) for r in found.clusters.collect()}
    assert len(cells) == 8 and 60 <= len(clusters) <= 96
    posted = found.postings.collect()
    assert sorted(r.id for r in posted) == list(range(6000))
    for r in posted[::37]:
        v = np.array(r.vec)
        assert r.cell == min(cells, key=lambda c: ((cells[c] - v) ** 2).sum())
        mine = [c for c, (cell, _) in clusters.items() if cell == r.cell]
        assert r.cluster_id == min(mine, key=lambda c: ((clusters[c][1] - v) ** 2).sum()) and r.bucket == r.cell % mips.BUCKETS


def test_scores_are_sums_of_table_entries(spark, index_of):
    rows, found = index_of
    books, clusters = found.books, {r.cluster_id: np.array(r.centroid) for r in found.clusters.collect()}
    posted = {r.id: r for r in found.postings.collect()}
    q = {r.qid: np.array(r.qvec) for r in asked(rows, 997).collect()}
    for r in lists.search(found, asked(rows, 997), 6, 3, 5).collect():
        p = posted[r.id]
        want = q[r.qid] @ clusters[p.cluster_id] + sum(books[i, c] @ q[r.qid][2 * i : 2 * i + 2] for i, c in enumerate(p.code))
        assert abs(want - r.score) < 1e-9
        left = np.array(p.vec) - clusters[p.cluster_id]
        assert all(c == ((books[i] - left[2 * i : 2 * i + 2]) ** 2).sum(1).argmin() for i, c in enumerate(p.code))


def test_a_tenth_of_the_postings_gives_nine_tenths_of_the_neighbours(spark, index_of):
    rows, found = index_of
    q = asked(rows, 500)
    want = by_query(mips.exact_top_k(rows, q, 10))
    got = by_query(lists.search(found, q, 10, 2, 4, rescore=60))
    assert recall(want, got) >= 0.9
    probed = lists.probes(found, q, 2, 4)
    sizes = {r.cluster_id: r["count"] for r in found.postings.groupBy("cluster_id").count().collect()}
    reads = {}
    for r in probed.collect():
        reads[r.qid] = reads.get(r.qid, 0) + sizes.get(r.cluster_id, 0)
    assert np.mean(list(reads.values())) < 600


def test_one_query_reads_the_folders_of_its_cells(spark, index_of):
    rows, found = index_of
    q = rows.where("id = 17").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    top = lists.search(found, q, 10, 1, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 17 in by_query(lists.search(found, q, 10, 1, 3, rescore=20))[17]


def test_blocks_of_queries_and_odd_tables(spark, index_of, monkeypatch, tmp_path):
    rows, found = index_of
    q = asked(rows, 600)
    want = by_query(lists.search(found, q, 5, 2, 4))
    monkeypatch.setattr(lists, "TABLE_NUMBERS", 3 * 8 * 256)
    assert by_query(lists.search(found, q, 5, 2, 4)) == want
    assert lists.search(found, q.limit(0), 5, 2, 4).count() == 0
    # fewer vectors than clusters, nulls, repeated vectors
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (None, [0.0, 1.0])], "id bigint, vec array<double>")
    small = lists.train(few, f"{tmp_path}/few", 2, 5, 1)
    lists.add(few, small, "all")
    assert sorted(r.id for r in small.postings.collect()) == [0, 1, 3]


# graphs


def test_graph_walks_find_neighbours(spark, tmp_path):
    x = clustered(1500, 12, 200) * np.linspace(0.5, 2, 1500)[:, None]  # of different lengths
    rows = vectors(spark, x)
    graph.build(rows.unionByName(spark.createDataFrame([(None, [0.0] * 12), (9999, None)], rows.schema)), f"{tmp_path}/g", shards=2)
    graphs = spark.read.parquet(f"{tmp_path}/g")
    assert graphs.count() == 1500 and {r.shard for r in graphs.select("shard").distinct().collect()} == {0, 1}
    q = asked(rows)
    got = by_query(graph.graph_top_k(graphs, q, 10, 48))
    assert recall(by_query(mips.exact_top_k(rows, q, 10)), got) >= 0.9
    spent = graph.walked(graphs, q, 10, 48).groupBy("qid").agg(F.sum("products").alias("n")).agg(F.avg("n")).first()[0]
    assert spent < 0.4 * 1500
    scores = {(r.qid, r.id): r.score for r in graph.graph_top_k(graphs, q, 10, 48).collect()}
    assert all(abs(x[a] @ x[b] - s) < 1e-9 for (a, b), s in scores.items())


def test_small_and_equal_graphs(spark, tmp_path):
    for n in (1, 2, 3, 30):
        x = np.ones((n, 3))
        links = graph.links_of(graph.even(x), 1)
        place, score, many = graph.walk(x, links, np.ones((2, 3)), 5, 5)
        assert many.max() <= n and (score[:, 0] == 3).all()
    rows = vectors(spark, np.ones((4, 2)))
    graph.build(rows, f"{tmp_path}/g")
    assert graph.graph_top_k(spark.read.parquet(f"{tmp_path}/g"), asked(rows, 5), 3).count() <= 3
    graph.build(rows.limit(0), f"{tmp_path}/none")
    assert graph.graph_top_k(spark.read.parquet(f"{tmp_path}/none"), asked(rows, 5), 3).count() == 0


def test_links_go_both_ways_or_there_is_no_room():
    x = graph.even(clustered(400, 6, 30))
    links = graph.links_of(x, 2)
    out = {i: set(r[: 2 * graph.NEAR].tolist()) - {-1} for i, r in enumerate(links)}
    for i, r in enumerate(links):
        for j in r[: graph.NEAR]:
            assert i in out[j] or len(out[j]) == 2 * graph.NEAR


def test_best_of_blocks_equals_best_of_all():
    """scores come in blocks of rows and ids, of which the best stay; ties go to the smaller id whatever the order."""
    from phrasemill.operators.mips import Best

    rng = np.random.default_rng(5)
    scores, ids = rng.integers(0, 9, (7, 300)).astype(float), rng.permutation(300)
    scores[2], scores[3, 5:] = -np.inf, -np.inf
    best = Best(7, 10)
    for at in range(0, 300, 40):
        part = ids[at : at + 40]
        order = np.argsort(part)
        for first in (4, 0):
            best.add(first, scores[first : first + 4, at : at + 40][:, order], part[order])
        if at % 80:
            best.settle()
    got = [tuple(r.values()) for b in best.batches(pa.array(range(7))) for r in b.to_pylist()]
    want = [(q, i, s) for q in range(7) for s, i in sorted(zip(scores[q], ids.tolist(), strict=True), key=lambda t: (-t[0], t[1]))[:10] if s > -np.inf]
    assert sorted(got) == sorted(want) and len(best.row) == len(want)


def test_best_of_some_rows():
    """scores of any rows, and as many as there are for rows that are full."""
    rng = np.random.default_rng(8)
    score = np.round(rng.random((6, 900)), 2)
    best = mips.Best(6, 5)
    for at in range(0, 900, 90):
        for rows in (np.array([4, 1]), np.array([0, 5, 2, 3])):
            best.add(rows, score[rows, at : at + 90], np.arange(at, at + 90))
    got = {(r["qid"], r["id"]) for b in best.batches(pa.array(range(6))) for r in b.to_pylist()}
    assert got == {(q, int(i)) for q in range(6) for i in np.lexsort((np.arange(900), -score[q]))[:5]}


def test_rescored_where_vectors_are_read(spark, tmp_path, monkeypatch):
    """exact products of the best codes, with vectors dropped on the way, equal those of a join."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[200:230] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    found = lists.train(rows, f"{tmp_path}/lists", 3, 4, 4, 16)
    lists.add(rows, found, "all")
    q = rows.where("id % 40 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    want = {}
    for r in lists.search(found, q, 30, 2, 5).collect():
        want.setdefault(r.qid, []).append((round(-float(x[r.id] @ x[r.qid]), 9), r.id))
    for held, block in ((1 << 16, 4096), (9, 7)):
        monkeypatch.setattr(lists, "HELD", held)
        monkeypatch.setattr(lists, "POSTING_BLOCK", block)
        got = {}
        for r in lists.search(found, q, 10, 2, 5, rescore=30).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((round(-r.score, 9), r.id))
        assert got == {k: sorted(v)[:10] for k, v in want.items()}


def test_document_vectors_equal_counts_by_rows(spark, tmp_path):
    """texts of one id are one document, whatever the batches; null texts have no vector, empty ones have."""
    texts = [(i % 23, " ".join(f"W{j % (i + 2)}" for j in range(i % 9))) for i in range(60)]
    spark.createDataFrame([*texts, (70, None), (71, ""), (None, "a b"), (None, "c")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    n = {}
    for r in words.groupBy("doc_id", F.pmod(F.xxhash64("w"), F.lit(built.WIDTH)).alias("dim")).count().collect():
        n.setdefault(r.doc_id, np.zeros(built.WIDTH))[r.dim] = r["count"]
    roots = {i: np.sqrt(v / v.sum()) for i, v in n.items()}
    mean = np.mean(list(roots.values()), axis=0)
    want = {i: (v - mean) / np.linalg.norm(v - mean) for i, v in roots.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.id: np.array(r.vec) for r in built.document_vectors(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)
