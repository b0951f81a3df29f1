"""Jobs from files to files, and small operators of articles that they need."""

from pyspark.sql import functions as F

from phrasemill import jobs
from phrasemill.operators import corpus, index, mips
from phrasemill.sources import manifest, readers


def encode(docs):
    """Vectors and scores from the letters of each token."""
    t = docs.select("doc_idx", F.posexplode("tokens").alias("word_idx", "w"))
    n = F.length("w").cast("double")
    return t.select("doc_idx", "word_idx", (n / 10).alias("fs"), (n / 20).alias("fe"), F.array(n, F.ascii("w").cast("double")).alias("vec"))


def test_phrases_and_filters(spark, tmp_path):
    windows = spark.createDataFrame([(1, 0, 0, ["a", "phrase"]), (1, 1, 0, ["longer"]), (1002, 0, 0, ["b"])], "doc_idx bigint, par_idx int, span_idx int, tokens array<string>")
    jobs.write_phrases(windows, encode, f"{tmp_path}/phrases", 0.5)
    jobs.write_filter(windows, encode, f"{tmp_path}/filter")
    dump = readers.phrase_dump(spark, f"{tmp_path}/phrases")
    got = sorted((r.doc_idx, r.word_idx, r.idx) for r in dump.collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1002, 0, 0)]
    scores = spark.read.parquet(f"{tmp_path}/filter")
    tokens = encode(jobs.phrases.assemble(windows)).select("doc_idx", "word_idx", "vec")
    again = jobs.filtered_dump(tokens, scores, 0.5)
    assert sorted((r.doc_idx, r.word_idx, r.idx) for r in again.collect()) == got
    jobs.light_copy(dump, f"{tmp_path}/light")
    assert "vec" not in spark.read.parquet(f"{tmp_path}/light").columns


def test_index_built_loaded_and_merged(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(120)], "id bigint, vec array<double>")
    for name in ("a", "b"):
        jobs.build_index(rows, f"{tmp_path}/{name}", 4)
    postings, centroids = jobs.load_index(spark, f"{tmp_path}/a")
    assert postings.count() == 120 and centroids.count() == 4
    assert spark.read.parquet(f"{tmp_path}/a/moments").count() == 3
    q = rows.where("id < 3").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    want = sorted(map(tuple, mips.exact_top_k(rows, q, 5).select("qid", "id", "rank").collect()))
    assert sorted(map(tuple, mips.pruned_top_k(postings, centroids, q, 5, 4).select("qid", "id", "rank").collect())) == want
    jobs.merge_indexes(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/both")
    merged, _ = jobs.load_index(spark, f"{tmp_path}/both")
    assert merged.select("id").distinct().count() == 240 and merged.where(F.col("id") >= manifest.STEP).count() == 120


def test_samples_of_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(1000)], "id bigint, vec array<double>")
    some = index.sample_vectors(rows, 0.3, replace=False, norm_limit=500.0)
    assert 80 < some.count() < 220 and some.agg(F.max("id")).first()[0] <= 500
    assert index.sample_vectors(rows, 2.0).count() > 1500


def test_answers_in_articles(spark):
    df = spark.createDataFrame([(1, "the cat sat", "cat", 4), (2, "the cat sat", "cat", 3)], "qid int, context string, answer string, answer_start int")
    assert [r.qid for r in corpus.answers_at(df).collect()] == [1]
    spans = spark.createDataFrame([([(5, 8)],), ([(0, 3), (40, 50)],), ([],)], "s array<struct<start: int, end: int>>")
    assert [r[0] for r in spans.select(corpus.contained(F.lit(4), F.lit(9), F.col("s"))).collect()] == [True, False, False]
    qas = spark.createDataFrame([([("a", ["x"]), ("b", [])],)], "q array<struct<id: string, answers: array<string>>>")
    assert [q["id"] for q in qas.select(corpus.without_unanswerable(F.col("q"))).first()[0]] == ["a"]
