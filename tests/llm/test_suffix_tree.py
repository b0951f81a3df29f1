"""The suffix tree against one in dictionaries, whole or cut into many chunks, buckets and crown contexts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import crc, spaced_words

from phrasemill.llm import suffix_tree as S

SMALL = {"chunk_text": 300_000, "bucket_records": 2000, "bucket_names": 9000, "least": 4}


def tree(docs):
    """Counts of next symbols by context, and the retained contexts."""
    counts = defaultdict(Counter)
    for i, words in docs:
        if i is None or crc(i, 7) != 2:
            for j, x in enumerate(words):
                for k in range(min(j, S.DEPTH) + 1):
                    counts[words[j - k : j]][x] += 1
    kept = set()
    for context, c in counts.items():
        n = sum(c.values())
        if context and n >= S.SUPPORT:
            parent = counts[context[1:]]
            above = sum(parent.values())
            if sum((k - 1) * math.log((k / n) / (parent[x] / above)) for x, k in c.items()) >= S.DIVERGENCE:
                kept.add(context)
    return counts, kept


def distribution(counts, kept, context, symbols):
    root = counts[()]
    n, v = sum(root.values()), len(root)
    p = {x: (root[x] + 1) / (n + v + 1) for x in symbols}
    for k in range(1, len(context) + 1):
        if context[-k:] in kept:
            c = counts[context[-k:]]
            p = {x: (max(c[x] - S.DISCOUNT, 0) + S.DISCOUNT * len(c) * p[x]) / sum(c.values()) for x in symbols}
    return p


def sequences(df):
    return [(r.doc_id, (*spaced_words(r.text), "\0end")) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_scores_equal_those_of_a_tree_in_dictionaries(documents, odd, sizes):
    for df in (documents, odd):
        docs = sequences(df)
        counts, kept = tree(docs)
        assert df is odd or {len(c) for c in kept} == set(range(1, S.DEPTH + 1))
        want = defaultdict(list)
        for i, words in docs:
            p = [distribution(counts, kept, words[max(0, j - S.DEPTH) : j], [x])[x] for j, x in enumerate(words)]
            want[i].append(sum(map(math.log10, p)))
        got = defaultdict(list)
        for r in S.score(df, **sizes).collect():
            got[r.doc_id].append(r.score)
        assert got.keys() == want.keys()
        off = {i: (got[i], want[i]) for i in want if not np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-5, atol=1e-6)}
        assert not off


def test_distributions_sum_to_one(documents):
    counts, kept = tree(sequences(documents))
    v = len(counts[()])
    unknown = "\0unknown"
    for context in sorted(kept, key=lambda c: (-len(c), c))[:50]:
        p = distribution(counts, kept, context, [*counts[()], unknown])
        assert len(p) == v + 1 and abs(sum(p.values()) - 1) < 1e-9


def test_a_context_like_its_parent_is_not_retained_and_a_diverging_one_is(spark):
    same = [(i, "a b c" if i % 2 else "d b c") for i in range(7000, 7060)]
    other = [(i, "p q r" if i % 2 else "s q t") for i in range(8000, 8060)]
    docs = [(i, (*t.split(), "\0end")) for i, t in same + other]
    _, kept = tree(docs)
    assert ("a", "b") not in kept and ("p", "q") in kept and ("b",) in kept
    df = spark.createDataFrame(same + other, "doc_id bigint, text string")
    by = {r.doc_id: r.score for r in S.score(df).collect()}
    counts, kept = tree(docs)
    want = sum(math.log10(distribution(counts, kept, w[max(0, j - S.DEPTH) : j], [x])[x]) for w in [docs[0][1]] for j, x in enumerate(w))
    assert by[7000] == pytest.approx(want, rel=1e-5)


def test_texts_of_one_word_all_over_and_nothing_to_learn_from(spark):
    hot = spark.createDataFrame([(i, "same " * 200) for i in range(40)], "doc_id bigint, text string")
    docs = sequences(hot)
    counts, kept = tree(docs)
    words = docs[0][1]
    want = sum(math.log10(distribution(counts, kept, words[max(0, j - S.DEPTH) : j], [x])[x]) for j, x in enumerate(words))
    for sizes in ({}, {"chunk_text": 2000, "bucket_records": 40, "bucket_names": 2, "least": 2}):
        assert all(r.score == pytest.approx(want, rel=1e-5) for r in S.score(hot, **sizes).collect())
    held = next(i for i in range(100) if crc(i, 7) == 2)
    row = S.score(spark.createDataFrame([(held, "x y")], "doc_id bigint, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_numbers_pack_and_unpack():
    rng = np.random.default_rng(1)
    for top in (1, 200, 70_000, 2**40):
        x = rng.integers(0, top, 1000)
        assert (S._unpack(S._pack(x)) == x).all()
    assert len(S._unpack(S._pack(np.zeros(0, np.int64)))) == 0
