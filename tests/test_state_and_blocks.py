"""Streams that remember, a growing log of requests, metadata in blocks, banded sums, and rows that stay whole."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.operators import corpus, metrics, records, spans, training
from phrasemill.sources import metadata
from phrasemill.streaming import log, state


def put(folder, name, df):
    df.coalesce(1).write.parquet(f"{folder}/in/{name}")


def streamed(spark, folder, schema, transform, parts):
    """All rows that a stream over some files, one a micro-batch, gives."""
    state.use_store(spark)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = []
    query = transform(rows).writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_in_any_micro_batching(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(k, i, rng.choice(["a", "b", None])) for k in range(5) for i in range(rng.randint(1, 30))]
    schema = "k bigint, i bigint, tag string"
    cuts = sorted(rng.sample(range(1, 30), 3))
    for n, (low, high) in enumerate(zip([0, *cuts], [*cuts, 99])):
        some = [r for r in rows if low <= r[1] < high]
        rng.shuffle(some)
        put(tmp_path, n, spark.createDataFrame(some, schema))
    out = streamed(spark, tmp_path, schema, lambda s: state.open_runs(s, "k", "i", "tag"), 4)
    got = {tuple(r) for r in state.latest_runs(spark.createDataFrame(out, "k bigint, tag string, first bigint, last bigint, n bigint"), "k", "tag").select("k", "tag", "first", "last", "n").collect()}
    want = {tuple(r) for r in corpus.consecutive_groups(spark.createDataFrame(rows, schema), "k", "i", "tag").select("k", "tag", "first", "last", "n").collect()}
    assert got == want


def test_stream_runs_is_three_micro_batches_of_any_files(spark, tmp_path, monkeypatch):
    from phrasemill.plans import built

    rng = random.Random(5)
    rows = [(k, i, rng.choice(["a", "b"])) for k in range(4) for i in range(14)] + [(9, None, "a"), (9, 7, "a"), (9, 8, "b"), (9, 9, "a")]
    # later turns are in earlier files
    for turn in range(13, -1, -2):
        some = [r for r in rows if (turn if r[1] is None else r[1]) in (turn, turn - 1)]
        rng.shuffle(some)
        spark.createDataFrame(some, "conv_id bigint, turn bigint, role string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{turn:02d}")
    whole = spark.read.parquet(*(f"{tmp_path}/{turn:02d}" for turn in range(13, -1, -2))).repartitionByRange(7, F.desc("turn"))
    monkeypatch.setattr(built.W, "table", lambda *_: whole)
    monkeypatch.setattr(built, "new_path", lambda _, name: f"{tmp_path}/{name}")
    got = sorted(map(tuple, built.stream_runs(spark, "").collect()), key=repr)
    plain = whole.withColumn("turn", F.coalesce("turn", F.lit(99)))
    want = corpus.consecutive_groups(plain, "conv_id", "turn", "role").select("conv_id", "role", "first", F.when(F.col("last") == 99, 9).otherwise(F.col("last")), "n")
    assert got == sorted(map(tuple, want.collect()), key=repr)
    assert len(list((tmp_path / "runs").glob("batch=*"))) == 3


def test_max_context_never_shuffles_tokens(spark):
    rng = random.Random(8)
    rows = [(d, i, rng.choice([0, 5, 126, 127, 128, 700]) + rng.randint(0, 9), rng.choice([0, 1, 2, 60, 400])) for d in (1, 2, None) for i in range(9)]
    spans_ = spark.createDataFrame([*rows, *rows[:4]], "doc_idx bigint, span_idx int, start int, length int")
    want = {}
    for d, i, start, n in rows:
        for t in range(start, start + n):
            value = (100 * min(t - start, start + n - 1 - t) + n, -i)
            want[d, t] = max(want.get((d, t), value), value)
    found = corpus.max_context(spans_)
    assert dict(found.dtypes) == {"doc_idx": "bigint", "token": "int", "span_idx": "int"}
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((d, t, -v[1]) for (d, t), v in want.items()), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_idx" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "token#" in x]


def test_losses_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, b, 4, 100 * k + 4 * b + i, rng.normal(size=3).tolist(), rng.normal(size=3).tolist()) for k in range(2) for b in range(6) for i in range(4)]
    schema = "k bigint, batch bigint, size bigint, id bigint, qvec array<double>, pvec array<double>"
    order = rng.permutation(len(rows))
    for n, part in enumerate(np.array_split(order, 4)):
        put(tmp_path, n, spark.createDataFrame([rows[i] for i in part], schema))
    out = streamed(spark, tmp_path, schema, lambda s: state.batch_losses(s, 2, "k"), 4)
    got = {(r.k, r.qid): r.loss for r in out}
    assert len(got) == len(out) == len(rows)
    for k in range(2):
        df = spark.createDataFrame([r for r in rows if r[0] == k], schema)
        scores = training.batch_scores(df.select(F.col("id").alias("qid"), "batch", F.col("id").alias("pid"), "qvec"), df.select(F.col("id").alias("pid"), "batch", "pvec"), 2)
        for r in training.marginal_loss(scores, ["qid"], "score", F.col("own")).collect():
            assert abs(r.loss - got[k, r.qid]) < 1e-9


def test_every_request_is_answered_once(spark, tmp_path):
    """A log that grows, a line that is still being written, a micro-batch that fails, restarts."""
    (tmp_path / "log").mkdir()
    a, b = tmp_path / "log/a.jsonl", tmp_path / "log/b.jsonl"
    line = lambda i: json.dumps({"qid": i, "question": f"what is {i} é"}) + "\n"
    a.write_text("".join(line(i) for i in range(50)) + "not json\n[1]\n" + line(50)[:9])
    failing = {1}

    def search(batch):
        number = len(list((tmp_path / "out").glob("batch=*"))) if (tmp_path / "out").exists() else 0
        if number in failing:
            failing.clear()
            raise RuntimeError("lost")
        return batch.select("qid", F.upper("question").alias("found"))

    def run():
        requests = log.request_log(spark, str(tmp_path / "log"), most_bytes=600)
        query = log.answer(requests, search, str(tmp_path / "out"), str(tmp_path / "check"))
        try:
            query.awaitTermination(200)
        except Exception as e:
            assert "lost" in str(e)
            return False
        return True

    # a run takes what there is at its start, at most 600 bytes of it
    assert [run() for _ in range(3)] == [True, False, True]
    b.write_text("".join(line(i) for i in range(100, 120)))
    assert all(run() for _ in range(7))
    got = lambda: sorted((r.qid, r.found) for r in log.answers(spark, str(tmp_path / "out"), "qid BIGINT, found STRING").collect())
    want = lambda ids: sorted((i, f"WHAT IS {i} É") for i in ids)
    assert got() == want([*range(50), *range(100, 120)])
    with a.open("a") as f:
        f.write(line(50)[9:] + line(51))
    assert run()
    assert run()
    assert got() == want([*range(52), *range(100, 120)])


def test_log_is_cut_at_lines(tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"qid": i, "pad": "é" * (i % 40)}) + "\n" for i in range(400)) + '{"qid": 9')
    reader = log.RequestReader(StructType([StructField("qid", LongType())]), {"path": str(tmp_path), "maxbytespertrigger": "3000", "bytespertask": "700"})
    at, seen = reader.initialOffset(), []
    for _ in range(50):
        end = reader.latestOffset()
        for p in reader.partitions(at, end):
            seen += [r[0] for r in reader.read(p)]
        at = end
    assert seen == list(range(400))


# metadata


def test_metadata_reads_the_blocks_of_its_hits(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("doc_idx"), F.concat(F.lit("t\n\"é"), "id").alias("title"), F.when(F.col("id") % 7 > 0, F.array("id", "id")).alias("f2o"))
    odd = spark.createDataFrame([(None, "x", None)], "doc_idx bigint, title string, f2o array<bigint>")
    metadata.write(rows.unionByName(odd), f"{tmp_path}/m", block_records=32)
    hits = spark.createDataFrame([(5, "a"), (5, "b"), (31, "c"), (32, "d"), (999, "e"), (5000, "f"), (None, "g")], "doc_idx bigint, h string")
    got = {(r.h, r.title, tuple(r.f2o) if r.f2o else None) for r in metadata.read(spark, f"{tmp_path}/m", hits, "title string, f2o array<bigint>").collect()}
    want = {(r.h, r.title, tuple(r.f2o) if r.f2o else None) for r in hits.join(rows, "doc_idx", "left").collect()}
    assert got == want and len(got) == 7
    assert {r.block for r in metadata.blocks_read(spark, f"{tmp_path}/m", hits).collect()} == {0, 1, 31}
    assert spark.read.parquet(f"{tmp_path}/m/blocks").count() == 32


# banded sums


def test_banded_sums_equal_the_matrix(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(80):
        n = int(rng.integers(0, 25))
        data.append((i, *(rng.normal(size=n).tolist() for _ in range(4))))
    data += [(80, None, None, None, None), (81, [5.0], [5.0], [1.0], [1.0]), (82, [-5.0, -1.0], [-5.0, -9.0], [1.0, 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(data, "id bigint, start array<double>, end array<double>, fs array<double>, fe array<double>").repartition(3)
    for band in (1, 2, 3, 10):
        for threshold in (None, 0.2):
            got = {r.id: r.best for r in spans.banded_best(df, band, threshold, -3.0).collect()}
            for i, s, e, fs, fe in data:
                pairs = [s[a] + e[b] for a in range(len(s or ())) for b in range(a, min(a + band, len(s))) if (a, b) != (0, 0) and (threshold is None or (fs[a] > threshold and fe[b] > threshold))]
                assert abs(got[i] - max([*pairs, -3.0])) < 1e-12
    assert spans.banded_best(df.limit(0)).count() == 0


def test_scores_of_examples_and_far_losses(spark):
    rows = spark.createDataFrame([(1, "gold", 3.0), (1, "topic", 1.0), (1, "topic", 2.0), (2, "topic", 9.0), (3, "gold", -800.0), (3, "entailed", 900.0)], "q bigint, mode string, best double")
    got = {r.q: (r.gold, r.topic, r.entailed) for r in spans.example_scores(rows, "q", "mode").collect()}
    assert got == {1: (3.0, 2.0, -1e9), 3: (-800.0, -1e9, 900.0)}
    r = spans.contrast(spans.example_scores(rows, "q", "mode")).first()
    assert r.gold_mean == -398.5 and abs(r.entailed_loss - 850.0) < 1e-9 and abs(r.topic_loss - math.log1p(math.exp(-1)) / 2) < 1e-12


# rows that stay whole


def test_wide_rows_are_numbered_without_loss(spark):
    """Counts and rows are shuffled with other sizes, and adaptive execution joins their partitions differently."""
    wide = spark.range(150_000).select((F.xxhash64("id") % 1000).alias("k"), "id", F.repeat(F.lit("x"), 768).alias("pad"), F.lit(1).alias("_p"), F.lit(2).alias("_n")).repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = records.feature_ids(wide, ["k", "id"], 10)
        assert out.columns == [*wide.columns, "feature_id"]
        r = out.agg(F.count("*"), F.count_distinct("feature_id"), F.min("feature_id"), F.max("feature_id"), F.sum("_n")).first()
        assert tuple(r) == (150_000, 150_000, 10, 150_009, 300_000)
        pairs = records.by_position(wide.select("id", "pad"), wide.select(F.col("id").alias("other"), F.repeat(F.lit("y"), 300).alias("z")), "id", "other")
        assert pairs.where("id = other").count() == 150_000
        sizes = {r.chunk: r["count"] for r in records.even_chunks(wide, 7, "id").groupBy("chunk").count().collect()}
        assert sum(sizes.values()) == 150_000 and max(sizes.values()) - min(sizes.values()) <= 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_feature_ids_are_in_order_whatever_the_names(spark):
    df = spark.createDataFrame([(None, "b"), (2, "a"), (1, "c"), (2, "a")], "_place bigint, _range string")
    rows = records.feature_ids(df, ["_place"], 0).orderBy("feature_id").collect()
    assert [r._place for r in rows] == [None, 1, 2, 2] and [r.feature_id for r in rows] == [0, 1, 2, 3]
    assert records.feature_ids(df.limit(0), ["_place"]).count() == 0


def sweep(rows):
    """Best score and threshold, question by question in the order of the odds."""
    score = best = sum(not has for _, _, has, _, _ in rows)
    at = 0.0
    for _, odds, has, f, empty in sorted(rows, key=lambda r: (r[1], r[0])):
        score += f if has else (0 if empty else -1)
        if score > best:
            best, at = score, odds
    return 100 * best / len(rows), at


@pytest.mark.parametrize("seed", range(4))
def test_thresholds_of_odds_of_any_sign(spark, seed):
    rng = random.Random(seed)
    odds = lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), -rng.random() * 1e-7, 0.0, -5.0, -1e300, 1e300])
    rows = [(i, odds() - (2 if seed % 2 else 0), rng.random() < 0.6, rng.choice([0.0, 0.5, 1.0]), rng.random() < 0.5) for i in range(300)]
    got = metrics.best_threshold(spark.createDataFrame(rows, "qid bigint, na_prob double, has_ans boolean, score double, empty boolean")).first()
    best, at = sweep(rows)
    assert abs(got.best - best) < 1e-9 and got.threshold == at
    with_nulls = [(i, None if i % 3 == 0 else o, *rest) for i, o, *rest in rows]
    best, at = sweep([(i, 0.0 if o is None else o, *rest) for i, o, *rest in with_nulls])
    got = metrics.best_threshold(spark.createDataFrame(with_nulls, "qid bigint, na_prob double, has_ans boolean, score double, empty boolean")).first()
    assert abs(got.best - best) < 1e-9 and got.threshold == at


def test_answerable_questions_with_negative_odds(spark):
    rows = [(i, -1.5 - i, True, 1.0, False) for i in range(50)] + [(100 + i, 0.5, False, 0.0, False) for i in range(10)]
    got = metrics.best_threshold(spark.createDataFrame(rows, "qid bigint, na_prob double, has_ans boolean, score double, empty boolean")).first()
    assert got.best == 100.0 and got.threshold == -1.5


def test_questions_without_a_prediction_are_counted(spark):
    q = spark.createDataFrame([(1, "The cat"), (2, "dog"), (3, "x"), (4, None), (5, "y")], "id bigint, answer string")
    p = spark.createDataFrame([(1, "cat"), (2, "cow"), (4, "z"), (5, None), (9, "y")], "id bigint, predicted string")
    assert tuple(records.prediction_counts(q, p).first()) == (5, 1, 1, 3)
