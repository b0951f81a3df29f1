"""Sparse matrices, truecasing and word pieces against brute force."""

import pickle
import random
import string
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.functions import wordpiece
from phrasemill.operators import corpus, sparse, truecasing
from phrasemill.plans import built, catalog

# sparse


def random_entries(rng, docs, columns, each):
    return [(d, rng.randrange(columns) * 10**12 + 7, rng.random()) for d in range(docs) for _ in range(rng.randint(0, each))]


@pytest.mark.parametrize("block", [3, 1024])
def test_sparse_round_trip_and_product(spark, tmp_path, block, monkeypatch):
    rng = random.Random(block)
    rows = random_entries(rng, 60, 40, 12)
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (3, None, 1.0), (3, 1, None)], "doc bigint, column bigint, weight double")
    sparse.save(sparse.blocks(df, 60, block), f"{tmp_path}/m")
    matrix = sparse.load(spark, f"{tmp_path}/m")
    want = defaultdict(float)
    for d, c, w in rows:
        want[d, c] += w
    got = {(r.doc, r.column): r.weight for r in sparse.entries(matrix).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    for r in matrix.collect():
        assert r.docs == sorted(r.docs) and r.offsets[0] == 0 and r.offsets[-1] == len(r.columns) == len(r.weights)
    asked = [(q, c, w) for q, c, w in random_entries(rng, 9, 60, 20)]
    q = spark.createDataFrame(asked, "qid bigint, column bigint, weight double")
    scores = defaultdict(float)
    for i, c, w in asked:
        for (d, x), v in want.items():
            if x == c:
                scores[i, d] += w * v
    expected = {i: sorted((round(-s, 9), d) for (j, d), s in scores.items() if j == i)[:5] for i, _, _ in asked}
    for rows_, dense in ((256, 1 << 23), (2, 64)):
        monkeypatch.setattr(sparse, "QUERY_ROWS", rows_)
        monkeypatch.setattr(sparse, "DENSE", dense)
        found = defaultdict(list)
        for r in sparse.sparse_top_k(matrix, q, 5).orderBy("qid", "rank").collect():
            found[r.qid].append((round(-r.score, 9), r.id))
        assert dict(found) == {k: v for k, v in expected.items() if v}
    assert sparse.sparse_top_k(matrix, q.limit(0), 5).count() == 0
    assert sparse.blocks(df.limit(0), 0).count() == 0


# truecasing


def python_counts(texts):
    out = {"words": Counter(), "before": Counter(), "after": Counter(), "around": Counter()}
    for t in texts:
        w = (t or "").split()
        for i, x in enumerate(w):
            prev, nxt = (w[i - 1] if i else None), (w[i + 1].lower() if i + 1 < len(w) else None)
            out["words"][x] += 1
            if prev is not None:
                out["before"][prev, x] += 1
            if nxt is not None:
                out["after"][x, nxt] += 1
            if prev is not None and nxt is not None:
                out["around"][prev, x, nxt] += 1
    return out


def python_truecase(text, c, unknown="title"):
    if text is None:
        return None
    known = defaultdict(list)
    for w in c["words"]:
        known[w.lower()].append(w)
    tokens, done = text.split(), []
    share = lambda counter, key, rivals: log((counter[key] + 5.0) / sum(counter[k] + 5.0 for k in rivals))
    for i, token in enumerate(tokens):
        forms = sorted(known.get(token.lower(), []))
        if token in string.punctuation or token.isdigit():
            done.append(token)
            continue
        if not forms:
            done.append({"title": token.lower().title(), "lower": token.lower(), "as-is": token}[unknown])
            continue
        prev, nxt = (done[-1] if i else None), (tokens[i + 1].lower() if i + 1 < len(tokens) else None)
        scores = []
        for f in forms:
            s = share(c["words"], f, forms)
            s += share(c["before"], (prev, f), [(prev, x) for x in forms]) if prev is not None else 0.0
            s += share(c["after"], (f, nxt), [(x, nxt) for x in forms]) if nxt is not None else 0.0
            s += share(c["around"], (prev, f, nxt), [(prev, x, nxt) for x in forms]) if prev is not None and nxt is not None else 0.0
            scores.append(round(s, 11))
        best = forms[scores.index(max(scores))]
        done.append(best[0].upper() + best[1:] if i == 0 else best)
    return "".join(t if t.startswith("'") or t in string.punctuation else " " + t for t in done).strip()


def test_truecasing_of_random_texts(spark):
    rng = random.Random(2)
    words = "the The THE cat Cat of Of paris Paris us US Us 'S 's , . 12 new New york York".split()
    corpus = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, "  lead\tand\n trail "]
    c = python_counts(corpus)
    tables = truecasing.counts(spark.createDataFrame([(t,) for t in corpus], "text string"))
    for name, counter in c.items():
        got = {tuple(r)[:-1]: r.n for r in tables[name].collect()}
        assert got == {k if isinstance(k, tuple) else (k,): n for k, n in counter.items()}
    asked = [" ".join(rng.choice([w.lower() for w in words] + ["qwerty", "o'neil-x", "?!"]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "the", "the"]
    rows = spark.createDataFrame(list(enumerate(asked[:-1])) + [(3, asked[-1]), (None, "us")], "id bigint, text string").withColumns({x: F.lit("clash") for x in ("row", "word", "n", "low", "known")})
    for unknown in ("title", "lower", "as-is"):
        got = Counter((r.id, r.cased) for r in truecasing.truecased(rows, tables, unknown=unknown).collect())
        want = Counter((r.id, python_truecase(r.text, c, unknown)) for r in rows.select("id", "text").collect())
        assert got == want
    assert truecasing.truecased(rows.limit(0), tables).count() == 0


@pytest.mark.parametrize("most", [500_000, 3])
def test_only_asked_keys_are_counted(spark, monkeypatch, most):
    monkeypatch.setattr(truecasing, "BROADCAST_KEYS", most)
    rng = random.Random(4)
    words = "the The THE cat Cat of Of us US Us straße Straße , 12 other Other".split()
    corpus = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, ""]
    texts = spark.createDataFrame([(t,) for t in corpus], "text string")
    c, asked = python_counts(corpus), truecasing.counts_asked(texts)
    seen = []
    counted = lambda name, keys: seen.append((name, keys, out := asked(name, keys))) or out
    rows = spark.createDataFrame([(0, "the cat of us"), (1, "of the straße , us 12 qwerty cat"), (1, None), (None, "us")], "id bigint, text string")
    got = Counter((r.id, r.cased) for r in truecasing.truecased(rows, counted).collect())
    assert got == Counter((r.id, python_truecase(r.text, c)) for r in rows.collect())
    assert [name for name, *_ in seen] == list(truecasing.KEYS)
    for name, keys, out in seen:
        wanted = {tuple(r) for r in keys.collect()}
        found = {tuple(r)[:-1]: r.n for r in out.collect()}
        key = (lambda k: (k[0].lower(),)) if name == "words" else (lambda k: k)
        assert found == {k: n for k, n in (((x,) if name == "words" else x, n) for x, n in c[name].items()) if key(k) in wanted}


def test_truecase_query_over_the_whole_benchmark(spark):
    from phrasemill.plans import catalog

    sf = "/root/testdata/sf0.001"
    c = python_counts(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect())
    got = {r.item_id: r.cased for r in catalog.QUERIES["truecase"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("low", F.lower("text")).collect()
    assert got == {r.item_id: python_truecase(r.low, c) for r in rows}


def test_stored_counts(spark, tmp_path):
    c = python_counts(["The cat of Paris sat", "the Cat of paris"])
    flat = lambda x: Counter({"_".join(k) if isinstance(k, tuple) else k: n for k, n in x.items()})
    data = {"uni_dist": flat(c["words"]), "backward_bi_dist": flat(c["before"]), "forward_bi_dist": flat(c["after"]), "trigram_dist": flat(c["around"]), "word_casing_lookup": {"the": {"the", "The"}}}
    (tmp_path / "c.dist").write_bytes(pickle.dumps(data))
    tables = truecasing.stored_counts(spark, str(tmp_path / "c.dist"))
    rows = spark.createDataFrame([(1, "the cat of paris sat down")], "id bigint, text string")
    assert truecasing.truecased(rows, tables).first().cased == python_truecase("the cat of paris sat down", c)
    (tmp_path / "bad.dist").write_bytes(pickle.dumps({"uni_dist": pytest.raises}))
    with pytest.raises(pickle.UnpicklingError):
        truecasing.stored_counts(spark, str(tmp_path / "bad.dist"))


# word pieces


def greedy(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append((piece, at, end))
                break
        else:
            return None
        at = end
    return out


def test_word_pieces_of_random_words(spark):
    rng = random.Random(4)
    some = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(40)}
    vocabulary = ["[UNK]", "[CLS]", "[SEP]", *sorted(some), *sorted("##" + x for x in some if rng.random() < 0.7), ",", "##", "的"]
    place = {x: i for i, x in reversed(list(enumerate(vocabulary)))}
    texts = ["".join(rng.choice("abé ,的\t") for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", "a" * 101, "ab" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(3)
    for r in wordpiece.word_pieces(rows, vocabulary, lower=False).collect():
        if r.text is None:
            assert r.pieces is None
            continue
        want = []
        for n, m in enumerate(wordpiece._WORD.finditer(r.text)):
            cut = greedy(m.group(), vocabulary) if len(m.group()) <= 100 else None
            want += [(place[p], n, m.start() + a, m.start() + z) for p, a, z in cut] if cut is not None else [(0, n, *m.span())]
        assert [tuple(p) for p in r.pieces] == want


def test_word_pieces_equal_a_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *string.ascii_lowercase, *("##" + c for c in string.ascii_lowercase), *string.digits, *string.punctuation, "the", "##ing", "run", "##ni", "cafe", "日", "本"]
    library = tokenizers.BertWordPieceTokenizer({x: i for i, x in enumerate(vocabulary)}, lowercase=True)
    texts = ["The running café, isn't it?", "日本 x日本x", "a\tb\n c d", "ÀÉÎ straße $5 #1", "zero​width \x07bell", "Running" * 20, "", "…“quoted”—dash", "İstanbul ǅ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for r in wordpiece.word_pieces(rows, vocabulary).collect():
        found = library.encode(r.text, add_special_tokens=False)
        assert [p.piece for p in r.pieces] == found.ids, r.text
        if r.text.isascii():
            assert [(p.start, p.end) for p in r.pieces] == found.offsets


def test_features_cover_the_context(spark):
    vocabulary = ["[UNK]", "[CLS]", "[SEP]", *"abcdefgh", *("##" + c for c in "abcdefgh")]
    rows = spark.createDataFrame([(1, "ab cd", "abc de fg " * 5), (2, "a", ""), (3, None, "a"), (4, "abcdefgh" * 3, "h g")], "id bigint, question string, context string")
    got = defaultdict(list)
    for r in wordpiece.features(rows, vocabulary, 16, 4, most_question=6).orderBy("id", "span_idx").collect():
        got[r.id].append(r)
    assert set(got) == {1, 2, 4}
    whole = [tuple(p)[2:] for p in wordpiece.word_pieces(rows, vocabulary, "context").where("id = 1").first().pieces]
    seen = {}
    for r in got[1]:
        assert len(r.input) <= 16 and len(r.input) == len(r.segment) and sum(r.segment) == len(r.offsets) + 1
        assert [vocabulary[i] for i in (r.input[0], r.input[5], r.input[-1])] == ["[CLS]", "[SEP]", "[SEP]"]
        for i, o in enumerate(r.offsets):
            seen[r.first + i] = tuple(o)
    assert [seen[i] for i in range(len(whole))] == whole and len(seen) == len(whole)
    assert [vocabulary[i] for i in got[2][0].input] == ["[CLS]", "a", "[SEP]", "[SEP]"] and len(got[4][0].input) == 6 + 3 + 2


def test_checksums_of_long_texts_are_longs(spark, tmp_path):
    """the product of a piece's number and its place is beyond 32 bits."""
    text = "zebra xylophone " * 8000
    spark.createDataFrame([(0, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = catalog.QUERIES["word_pieces"](spark, str(tmp_path)).first()
    found = wordpiece.word_pieces(spark.createDataFrame([(text,)], "text string"), built.vocabulary()).first().pieces
    assert r.checksum == sum(p.piece * (p.start + 1) for p in found) and max(p.piece * (p.start + 1) for p in found) > 1 << 31


def test_texts_are_cut_in_slices(spark, monkeypatch):
    """what Python holds at once is bounded by bytes of text, and slices give what whole batches give."""
    import pyarrow as pa

    batch = pa.record_batch({"id": range(40), "text": ["ab " * (i % 7) if i % 5 else None for i in range(40)]})
    monkeypatch.setattr(wordpiece, "SLICE", 30)
    some = list(wordpiece._slices([batch], ["text"]))
    assert pa.Table.from_batches(some).equals(pa.Table.from_batches([batch]))
    assert len(some) > 10 and all(b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= 30 for b in some)


def test_products_compared_as_rounded():
    """common columns are multiplied densely and rare ones pair by pair, in pieces; both together are the whole product."""
    rng = np.random.default_rng(2)
    left, right = rng.random((30, 50)) * (rng.random((30, 50)) < 0.4), rng.random((50, 9)) * (rng.random((50, 9)) < 0.5)
    right[:, 0] = 1.0
    owner, place = np.nonzero(left)
    column, row = np.nonzero(right)
    first = np.append(0, np.cumsum(np.bincount(column, minlength=50)))
    for common in (np.arange(0), np.arange(0, 50, 3), np.arange(50)):
        got = sparse._products(owner, place, left[owner, place], 30, (9, first, row, right[column, row], common))
        assert np.allclose(got, left @ right)


def test_rounded_scores_tie_by_id(spark):
    """scores that differ beyond the digits go by id; entries of one place are added up and come back one by one."""
    rows = [(0, 1, 0.5), (0, 1, 0.5), (3, 1, 1.0 + 1e-9), (2, 1, 1.0), (5, 2, 1.0)]
    matrix = sparse.blocks(spark.createDataFrame(rows, "doc bigint, column bigint, weight double"), 6, 2)
    assert sorted(map(tuple, sparse.entries(matrix).collect())) == [(0, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0 + 1e-9), (5, 2, 1.0)]
    q = spark.createDataFrame([(9, 1, 1.0)], "qid bigint, column bigint, weight double")
    assert [r.id for r in sparse.sparse_top_k(matrix, q, 2, 6).orderBy("rank").collect()] == [0, 2]


def moved(spark, job):
    """What a job returns, and the bytes that it shuffled, spilled and wrote."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        found = [stages.apply(i) for i in range(stages.size())]
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in found}

    before = total()
    got = job()
    return got, sum(n for stage, n in total().items() if stage not in before)


def test_round_trip_moves_few_bytes(spark):
    """F2: entries as rows took 17.9 MB."""
    sf = "/root/testdata/sf0.01"
    rows, size = moved(spark, lambda: catalog.QUERIES["sparse_round_trip"](spark, sf).collect())
    assert len(rows) == 998 and size < 9e6


@pytest.mark.parametrize(("block", "longest"), [(4, 2), (1024, 3)])
def test_weighted_blocks_equal_counts_as_rows(spark, tmp_path, block, longest, monkeypatch):
    """repeated ids, null and empty texts, one very frequent word, no word at all, texts longer than what is counted at once."""
    monkeypatch.setattr(sparse, "TOKENS", 8)
    rng = random.Random(block)
    texts = [(i % 37, " ".join(rng.choice(["Eins", "zwei", "drei", "the", "!", "\u00e4\u00f6", f"w{i}"]) for _ in range(rng.randint(0, 30)))) for i in range(41)]
    docs = spark.createDataFrame([*texts, (50, None), (51, ""), (52, "the the !"), (None, "zwei")], "doc_id bigint, text string")
    n = docs.count()
    plain = docs.where("doc_id IS NOT NULL")
    counts = corpus.term_counts(plain, longest).groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
    want = defaultdict(list)
    for r in corpus.tfidf(counts, spark.createDataFrame([(n,)], "n bigint")).where("weight > 0").collect():
        want[r.doc].append(round(r.weight, 9))
    sparse.save(sparse.weighted(sparse.term_blocks(docs, n, longest, block), n, block), f"{tmp_path}/m")
    matrix = sparse.load(spark, f"{tmp_path}/m")
    got, columns = defaultdict(list), set()
    for r in sparse.entries(matrix).collect():
        got[r.doc].append(round(r.weight, 9))
        columns.add(r.column)
    assert {d: sorted(w) for d, w in got.items()} == {d: sorted(w) for d, w in want.items()}
    assert len(columns) == counts.join(corpus.tfidf(counts, spark.createDataFrame([(n,)], "n bigint")).where("weight > 0"), ["doc", "term"]).select("term").distinct().count()
    assert {r.doc: (r.entries, round(r.weight, 6)) for r in sparse.row_sums(matrix).collect()} == {d: (len(w), round(sum(w), 6)) for d, w in want.items()}
    assert sparse.weighted(sparse.term_blocks(docs.limit(0), 0), 0).count() == 0


def test_search_moves_few_bytes(spark):
    """entries as rows took 18 MB."""
    rows, size = moved(spark, lambda: catalog.QUERIES["sparse_topk"](spark, "/root/testdata/sf0.01").collect())
    assert len(rows) == 60 and size < 9e6


@pytest.mark.parametrize("digits", [None, 1])
def test_search_in_several_passes(spark, tmp_path, monkeypatch, digits):
    """a task's best of many blocks, for queries sent some at a time, as lists or by entries; many products tie."""
    monkeypatch.setattr(sparse, "QUERY_ROWS", 3)
    monkeypatch.setattr(sparse, "QUERY_BLOCKS", 2)
    rng = random.Random(5)
    entries = {(d, c): rng.choice([0.25, 0.3125, 0.5, 1.0]) for d in range(90) for c in rng.sample(range(30), rng.randint(1, 9))}
    df = spark.createDataFrame([(d, c, w) for (d, c), w in entries.items()], "doc bigint, column bigint, weight double")
    sparse.save(sparse.blocks(df, 90, 4), f"{tmp_path}/m")
    matrix = sparse.load(spark, f"{tmp_path}/m").coalesce(2)
    asked = [d for d in range(90) if d % 5 == 0]
    score = lambda a, b: sum(w * entries.get((b, c), 0.0) for (d, c), w in entries.items() if d == a)
    want = {}
    for q in asked:
        found = [(d, score(q, d)) for d in range(90)]
        shown = lambda s: -s if digits is None else -round(s, digits)
        want[q] = [d for d, s in sorted(found, key=lambda x: (round(shown(x[1]), 9), x[0])) if s > 0][:4]
    lists = sparse.rows(matrix).where("doc % 5 = 0").withColumnRenamed("doc", "qid")
    flat = lists.select("qid", F.explode(F.arrays_zip("columns", "weights")).alias("e")).select("qid", F.col("e.columns").alias("column"), F.col("e.weights").alias("weight"))
    for queries in (lists, flat):
        got = defaultdict(list)
        for r in sparse.sparse_top_k(matrix, queries, 4, digits).orderBy("qid", "rank").collect():
            got[r.qid].append(r.id)
            assert abs(r.score - score(r.qid, r.id)) < 1e-9
        assert dict(got) == want
