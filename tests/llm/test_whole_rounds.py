"""Random strings through the encoder and the counter, factor sums, longest matches, and the pipeline on odd rows."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from conftest import alnum_words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from phrasemill.llm import decontaminate, exact_dedup, quality, token_counts
from phrasemill.llm._bpe import encoder
from phrasemill.llm.entries import BYTE_BPE, PIECE_BPE

_PARTS = ["the", "ing", "  ", "\n", "\n\n", "\t", " ", "'s", "'ll", "12", "3456", "—", "…", "日本", "テ", "ひらがな", "é", "é", "ß", " ", " ", "​", "🙂", "👩‍👧", "<|endoftext|>", "<s>", "a1", "1a", "!?", "...", "_", "x\x1cy", "\r\n", "Ω", "אב", "عر", "नम", "don't", "　", "﻿", "٣"]


def _strings(seed, count, longest=40):
    drawn = random.Random(seed)
    return ["".join(drawn.choice(_PARTS) if drawn.random() < 0.8 else chr(drawn.choice([drawn.randrange(32, 0x250), drawn.randrange(0x3040, 0x9FFF), drawn.randrange(0x1F300, 0x1F6FF)])) for _ in range(drawn.randrange(longest))) for _ in range(count)]


def test_encoder_on_random_strings():
    texts = _strings(1, 3000)
    ids, offsets = encoder(BYTE_BPE).encode(pa.array(texts))
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, want in enumerate(tool.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want.ids, repr(texts[i])


@pytest.mark.parametrize("long", [token_counts.LONG, 4])
def test_counter_on_random_strings(monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    drawn = random.Random(2)
    texts = _strings(3, 1500) + ["".join(drawn.choice("日本語の文字列をつなぐ言葉です。") for _ in range(5000)), "ab" * 4000, "=" * 3000, "".join(drawn.choice("abcdefgh") for _ in range(6000))]
    tool = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = token_counts.Counter(PIECE_BPE).count(pa.array(texts))
    assert got.tolist() == [len(x) for x in tool.encode(texts, num_threads=1)]


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(5)
    texts = pa.array(["one two three, one", "", "All rights reserved 2024", None, "x" * 300 + " y z"])
    begin, bucket, value, dense = quality.features(texts)
    model = quality.fit([(begin, bucket, value, dense)], np.array([1.0, 0.0, 1.0, 0.0, 1.0]))
    model.factor[:] = rng.normal(0, 0.3, model.factor.shape)
    got = model.score(texts)
    for t in range(len(texts)):
        i = np.append(bucket[begin[t] : begin[t + 1]], quality.BUCKETS + np.arange(quality.STRUCTURE))
        x = np.append(value[begin[t] : begin[t + 1]], np.clip((dense[t] - model.mean) / model.scale, -5, 5) * 0.3)
        z = model.bias + (model.weight[i] * x).sum()
        for a in range(len(i)):
            for b in range(a):
                z += (model.factor[i[a]] * model.factor[i[b]]).sum() * x[a] * x[b]
        assert got[t] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_longest_match_and_its_location(spark):
    drawn = random.Random(9)
    items = [(f"i{k}", " ".join(f"w{drawn.randrange(60)}" for _ in range(40))) for k in range(12)]
    rows = []
    for d in range(60):
        words = [f"v{drawn.randrange(500)}" for _ in range(drawn.randrange(40))]
        for _ in range(drawn.randrange(3)):
            source = drawn.choice(items)[1].split()
            a = drawn.randrange(30)
            words += source[a : a + drawn.randrange(6, 30)] + [f"v{drawn.randrange(500)}"]
        rows.append((d, " ".join(words)))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    text, hits = dict(rows), 0
    for r in decontaminate.report(docs, bench, width=10).collect():
        words = alnum_words(text[r.doc_id])
        best = 0
        for _, item in items:
            other = alnum_words(item)
            for a in range(len(words)):
                for b in range(len(other)):
                    n = 0
                    while a + n < len(words) and b + n < len(other) and words[a + n] == other[b + n]:
                        n += 1
                    best = max(best, n)
        assert r.longest == (best if best >= 10 else 0)
        if r.longest:
            hits += 1
            piece = " " + " ".join(words[r.longest_at : r.longest_at + r.longest]) + " "
            assert piece in " " + dict(items)[r.longest_item] + " "
    assert hits > 10


def _folder(path, odd, labels, bench):
    odd.withColumn("lang", F.lit("en")).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path, monkeypatch):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([("b", "rights reserved cc by"), ("c", None)], "item_id string, text string")
    seen = {}
    inner = list(corpus_pipeline.STAGES)
    for name, stage in inner:
        assert stage.__doc__
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, d, f, n=n, g=g: seen.setdefault(n, g(s, d, f))) for n, g in inner])
    packed = corpus_pipeline.run(spark, _folder(tmp_path / "odd", odd, labels, bench)).collect()
    columns = set(odd.columns) | {"lang"}
    for name, _ in inner[:-1]:
        assert set(seen[name].columns) == columns
    kept = [(r.doc_id, r.text) for r in seen["decontamination"].collect()]
    assert len(kept) == len({"".join((t or "").split()) for _, t in kept})
    assert not any(t and "CC-BY" in t for _, t in kept) and any(t and "Unicode" not in t and "日本語" in t for _, t in kept)
    assert sorted({r.doc_id for r in packed}, key=str) == sorted({i for i, _ in kept}, key=str)
    seen.clear()
    assert corpus_pipeline.run(spark, _folder(tmp_path / "empty", empty, labels, bench)).count() == 0


def test_more_frequent_digests_than_the_summary_holds(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRACKED", 16)
    rows = spark.createDataFrame([(i, f"text {i % 60}") for i in range(3000)], "doc_id bigint, text string")
    got = exact_dedup.label_copies(rows).collect()
    assert all(r.keep_id == r.doc_id % 60 and r.group_size == 50 and r.kept == (r.doc_id < 60) for r in got) and len(got) == 3000
