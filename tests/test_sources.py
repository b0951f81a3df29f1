"""Round trips of every format, and serving as a stream."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from phrasemill.operators import mips, truecasing
from phrasemill.sources import readers, writers
from phrasemill.streaming import requests

READING = {"data": [{"title": "New_York", "paragraphs": [
    {"context": "big apple", "qas": [{"id": "q1", "question": "what?", "answers": [{"text": "apple", "answer_start": 4}]}, {"id": "q2", "question": "who", "is_impossible": True, "answers": []}]},
    {"context": "no", "is_paragraph": False, "qas": []}]}]}


@pytest.fixture
def put(tmp_path):
    def write(name, data):
        path = tmp_path / name
        if name.endswith(".gz"):
            path.write_bytes(gzip.compress(data.encode()))
        else:
            path.write_text(data if isinstance(data, str) else json.dumps(data))
        return str(path)

    return write


def test_reading(spark, put):
    rows = {r.id: r for r in readers.reading(spark, put("r.json", READING)).collect()}
    assert rows["q1"].title == "New York" and rows["q1"].context == "big apple" and rows["q1"].question == "what"
    assert rows["q2"].impossible and not rows["q1"].impossible
    assert readers.corpus(spark, put("c.json", READING)).count() == 1
    assert readers.reading(spark, put("r.jsonl", json.dumps(READING) + "\n" + json.dumps(READING))).count() == 4


def test_questions(spark, put):
    data = {"data": [{"id": "1", "question": "who is it?", "answers": ["x"], "origin": "nq.json"}, {"id": "2", "question": "none", "answers": []}]}
    row = readers.questions(spark, put("q.json", data)).collect()
    assert [(r.id, r.question, r.titles) for r in row] == [("nq-1", "who is it", [""])]
    casing = truecasing.counts(spark.createDataFrame([("Ask who is IT now",)], "text string"))
    assert readers.questions(spark, put("q2.json", data), seed=3, draft=1, casing=casing).first().question == "Who is IT"


def test_lines(spark, put):
    assert readers.passages(spark, put("p.tsv", "id\ttext\ttitle\n1\ta \"b\ttt\n")).first().text == 'a "b'
    assert readers.candidates(spark, put("c.txt", " A\na \nb\n")).count() == 2
    assert readers.lines(spark, put("l.txt", "x\ny\n")).count() == 2
    kilt = readers.provenance(spark, put("k.jsonl", '{"id":"1","input":"s [SEP] r","output":[{"answer":" a "},{"answer":"a"}]}\n{"id":"2","input":"x","output":[{}]}\n'))
    assert readers.valid_provenance(kilt).count() == 1
    assert readers.adapt(readers.valid_provenance(kilt), "relation").first().asDict() == {"id": "1", "question": "s r", "answers": ["a"]}
    assert readers.generated(spark, put("g.jsonl", '{"question":"q","answer":["a"]}\n')).count() == 1
    assert readers.natural_questions(spark, put("n.jsonl.gz", '{"example_id":1}\n{"example_id":2}\n')).count() == 2
    assert readers.labelled(spark, put("x.tsv", "a\tb\n"), ["label", "text"]).first().text == "b"
    turns = readers.round_robin(spark, [put("a.txt", "a1\na2\na3\n"), put("b.txt", "b1\nb2\n")])
    assert [r.value for r in turns.orderBy("at").collect()] == ["a1", "b1", "a2", "b2"]


@pytest.mark.parametrize("kind", ["pairs", "columns", "single", "reading"])
def test_adapters(spark, kind):
    row = {"pairs": ("q", [" a ", "a"], None), "columns": ("q", None, [" a ", "a"]), "single": ("q", " a ", None), "reading": ("q", None, None)}[kind]
    df = {"pairs": "question string, answer array<string>, answers array<string>", "columns": "question string, answer string, answers array<string>", "single": "question string, answer string, answers string"}.get(kind)
    rows = spark.createDataFrame([row], df) if df else spark.createDataFrame([("1", "q", [(" a ",)])], "id string, question string, answers array<struct<text: string>>")
    assert readers.adapt(rows, kind).first().answers == ["a"]


def test_sinks(spark, tmp_path):
    rows = spark.range(2500).select(F.col("id").alias("doc_idx"), F.lit("x").alias("text"))
    writers.phrase_dump(rows, f"{tmp_path}/dump")
    part = readers.phrase_dump(spark, f"{tmp_path}/dump", 990, 1010)
    assert part.count() == 20 and "PartitionFilters: [" in part._jdf.queryExecution().toString()
    writers.replace_documents(rows, rows.limit(1).withColumn("text", F.lit("new")), f"{tmp_path}/dump2")
    assert spark.read.parquet(f"{tmp_path}/dump2").where("text = 'new'").count() == 1
    writers.shards(rows, f"{tmp_path}/shards")
    assert spark.read.json(f"{tmp_path}/shards").groupBy("shard").count().count() == 3
    writers.ranges(rows, f"{tmp_path}/halves")
    assert spark.read.parquet(f"{tmp_path}/halves").count() == 2500
    p = rows.select((F.col("doc_idx") + 1).cast("string").alias("id"), "text")
    writers.bucketed_passages(p, f"{tmp_path}/psg", width=1000)
    assert readers.bucketed_passages(spark, f"{tmp_path}/psg", 1500, width=1000).count() == 1
    writers.predictions(p.limit(3), f"{tmp_path}/pred")
    writers.json_lines(p.limit(3).withColumn("none", F.lit(None).cast("string")), f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/pred").count() == 3 and "none" not in spark.read.json(f"{tmp_path}/lines").columns
    twice = p.limit(2).withColumn("ordinal", F.lit(1)).unionByName(p.limit(2).withColumn("ordinal", F.lit(2)))
    writers.first_key_wins(twice, f"{tmp_path}/first")
    assert [r.ordinal for r in spark.read.parquet(f"{tmp_path}/first").collect()] == [1, 1]
    writers.compressed(p, f"{tmp_path}/zstd")
    writers.question_table(p.withColumn("question", F.col("text")), f"{tmp_path}/qs")
    writers.append_log(p.limit(1), f"{tmp_path}/log")
    writers.append_log(p.limit(1), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2 and spark.read.csv(f"{tmp_path}/qs", header=True).count() == 2500


def test_results_and_articles(spark, put, tmp_path):
    assert readers.results(spark, put("res.json", [{"id": "1", "ctxs": [{"title": "t", "text": "x"}]}])).first().ctxs[0].title == "t"
    (tmp_path / "wiki/AA").mkdir(parents=True)
    (tmp_path / "wiki/AA/w0").write_text('{"id":"1","title":"T","text":"x"}\n')
    assert readers.articles(spark, f"{tmp_path}/wiki").count() == 1


def test_serving(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id bigint, vec array<double>")
    for i in range(3):
        spark.createDataFrame([(i, [1.0, 0.0])], "qid bigint, qvec array<double>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = requests.request_stream(spark, f"{tmp_path}/in", files=1)
    requests.serve(stream, lambda q: mips.exact_top_k(vectors, q, 2), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(rows) == 6 and {r.id for r in rows} == {18, 19} and len({r.batch for r in rows}) == 3


def test_throughput_as_a_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 00:50:00",), ("2024-01-01 03:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = requests.throughput(spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/events"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.requests for r in spark.sql("SELECT * FROM hours ORDER BY start").collect()][:1] == [2]
