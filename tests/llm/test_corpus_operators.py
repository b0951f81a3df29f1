"""Decontamination, sharding, licences, scores, classifier and duplicates against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import BASE, SF, TEXTS, alnum_words, crc, spaced_words
from pyspark.sql import functions as F

from phrasemill.llm import decontaminate, exact_dedup, licences, near_dedup, quality, sharding, suffix_tree


def contaminated(docs, bench, width=10):
    windows = defaultdict(set)
    for item, text in bench:
        w = alnum_words(text)
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = alnum_words(t)
        hit, items = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    items |= found
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_decontamination(spark, documents, odd, empty, block):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    extra = spark.createDataFrame([(900, "rights reserved"), (901, "One"), (902, None), (903, " . "), (None, "x"), (904, BASE), (905, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12 word13")], "item_id bigint, text string")
    bench = bench.unionByName(extra)
    items = [tuple(r) for r in bench.collect() if r[0] is not None]
    for docs in (odd, documents.limit(60)):
        rows = decontaminate.report(docs, bench, block_bytes=block).collect()
        assert Counter(tuple(r[n] for n in NAMES) for r in rows) == contaminated(pairs(docs), items)
    kept = decontaminate.clean(odd, bench, block_bytes=block)
    assert kept.columns == odd.columns
    want = contaminated(pairs(odd), items)
    assert kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(odd, bench.limit(0)).where("contaminated").count() == 0


def check_shards(rows, docs, shards=24):
    counts = Counter(r.shard for r in rows)
    n = len(rows)
    assert all(abs(counts[s] - n / shards) < 1 for s in range(shards))
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)


def test_sharding(documents, odd, empty):
    for df in (odd, documents):
        check_shards(sharding.interleave(df).collect(), pairs(df))
    assert sharding.interleave(empty).count() == 0
    rows = sharding.interleave(documents, shards=4).collect()
    sources = Counter(r.source for r in rows)
    mixed = Counter((r.source, r.shard) for r in rows)
    assert all(abs(mixed[s, k] - n / 4) <= 2 for s, n in sources.items() for k in range(4))


def licence_rows(docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    out = Counter()
    for i, t in docs:
        w = alnum_words(t)
        found = [(a, label) for p, label in phrases.items() for a in range(len(w) - len(p) + 1) if tuple(w[a : a + len(p)]) == p]
        starts = [a for a, _ in found]
        out[i, len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))] += 1
    return out


def test_licences(documents, odd, empty):
    for df in (odd, documents):
        rows = licences.scan(df).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == licence_rows(pairs(df))
        for r in rows:
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
            assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    by = {r.doc_id: r for r in licences.scan(odd).collect()}
    assert by[TEXTS.index("Released under the MIT License. All rights reserved")].labels == "mit,reserved"
    assert licences.scan(empty).count() == 0


def test_scores(documents, odd, empty):
    for df in (documents, odd):
        docs = pairs(df)
        held = [i is not None and crc(i, 7) == 2 for i, _ in docs]
        tokens = [[*spaced_words(t), None] for _, t in docs]
        seen = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
        n, v = sum(seen.values()), len(seen)
        want = Counter((i, h, len(ws), sum(seen[w] > 0 for w in ws), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), 4)) for (i, _), h, ws in zip(docs, held, tokens))
        rows = suffix_tree.score(df).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
        assert all(r.score < 0 for r in rows)
    held = [r for r in suffix_tree.score(documents).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert suffix_tree.score(empty).count() == 0


def test_quality(spark, documents, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(r.held_out == (crc(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    test = [(r.quality, rows[r.doc_id].score) for r in labels.collect() if crc(r.doc_id, 5) == 0]
    good, bad = [s for y, s in test if y], [s for y, s in test if not y]
    better = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert better > 0.9
    model = quality.learn(docs, labels)
    scored = quality.classify(odd, labels, model=model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.classify(empty, labels, model=model).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} and quality.accepted(odd, labels).columns == odd.columns


def test_exact_copies(documents, odd, empty):
    for df in (documents, odd):
        docs = pairs(df)
        groups = defaultdict(list)
        for i, t in docs:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
        want = Counter()
        for t, g in groups.items():
            keep = min(g, key=lambda x: x[:3])[3]
            for x in g:
                want[x[3], keep, len(g), x[3] == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
        rows = exact_dedup.label_copies(df)
        assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in rows.collect()) == want
    assert exact_dedup.label_copies(empty).count() == 0
    assert exact_dedup.without_copies(odd).columns == odd.columns


def test_frequent_finds_all_heavy_values(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 20 == 1, "warm").otherwise(F.col("id").cast("string")).alias("v"))
    found = {r.v for r in exact_dedup.frequent(rows, "v", 64).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 64


def test_exact_copies_sql(documents):
    from oracle import differences

    spark = documents.sparkSession
    assert not differences(spark, "op10", lambda s, d: exact_dedup.label_copies(documents), exact_dedup.ORACLE_SQL, SF)


def near(docs, percent, size):
    sets = {}
    for i, t in docs:
        w = spaced_words(t)
        s = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, many in sets.items() if i is not None for s in many if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, len(s), find(i) if i is not None else None) for i, many in sets.items() for s in many)


@pytest.mark.parametrize(("percent", "size"), [(85, 3), (80, 5)])
def test_near_copies(documents, odd, empty, percent, size):
    for df in (documents, odd):
        rows = near_dedup.link_groups(df, percent, size).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == near(pairs(df), percent, size)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    assert near_dedup.link_groups(empty).count() == 0


def test_near_copies_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 2)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 1)
    rows = near_dedup.link_groups(documents).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == near(pairs(documents), 85, 3)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns and out.count() <= left
            left = out.count()
        if name == "near_dedup":
            want = near(pairs(docs), 80, 5)
            assert {r.doc_id for r in out.collect()} == {i for i, _, c in want if i == c}
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert docs.select("doc_id").distinct().count() == left
