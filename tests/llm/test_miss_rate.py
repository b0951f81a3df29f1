"""The number of collections keeps one miss rate at every asked similarity; candidates are few below it."""

import math
import random

import numpy as np
import pytest

from phrasemill.llm import near_dedup


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95, 100])
def test_miss_rate_is_held(percent):
    c = near_dedup.collections_for(percent)
    assert near_dedup.miss_rate(percent / 100, c) <= near_dedup.MISSED
    assert c == 2 or near_dedup.miss_rate(percent / 100, c - 1) > near_dedup.MISSED


def test_more_hashes_at_lower_similarity():
    assert near_dedup.collections_for(85) == 12 and near_dedup.collections_for(80) == 16
    assert (near_dedup.multipliers(16)[:36] == near_dedup.multipliers(12)[:36]).all()
    sets, begin = np.arange(1, 9, dtype=np.uint64), np.array([0, 8])
    keys, small = near_dedup.signatures(sets, begin, 16)
    assert keys.shape == (1, 16) and small.shape == (1, 48 + near_dedup.EXTRA)
    assert len(set(near_dedup.more_multipliers().tolist())) == near_dedup.EXTRA


def _tail(n, p, k):
    """The probability of at least ``k`` of ``n``."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def test_candidates_are_few_among_less_similar_pairs():
    c = near_dedup.collections_for(85)
    more = near_dedup.EXTRA
    hashes = c * near_dedup.ROWS + more
    need = near_dedup.agreeing(0.85, hashes)
    assert _tail(hashes, 0.85, need) >= 1 - near_dedup.MISSED
    # a pair that shares a table agrees on six minhashes at least; the others decide
    bound = (1 - near_dedup.miss_rate(0.6, c)) * _tail(hashes - 6, 0.6, need - 6)
    assert bound < 0.1
    drawn = random.Random(3)
    found = trials = 0
    for _ in range(4000):
        agree = [drawn.random() < 0.6 for _ in range(hashes)]
        whole = sum(all(agree[3 * i : 3 * i + 3]) for i in range(c))
        trials += 1
        found += whole >= 2 and sum(agree) >= need
    assert found / trials < 0.1


def test_groups_of_several_blocks_are_decided_like_small_ones(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 8)
    drawn = random.Random(5)
    base = [f"w{drawn.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(drawn.choice([0, 1, 2, 5, 9, 14])):
            words[drawn.randrange(len(words))] = f"x{drawn.randrange(10**6)}"
        texts.append(words)
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.link_groups(rows).collect()}
    assert len({find(i) for i in up}) > 5 and got == {i: find(i) for i in range(len(texts))}


def pages(similarity, n, rng, size=200):
    """Sets of shingles that all share a part, so that any two have the similarity."""
    common = round(2 * size * similarity / (1 + similarity))
    base = rng.integers(0, 2**63, common, dtype=np.uint64)
    return [np.sort(np.concatenate([base, rng.integers(0, 2**63, size - common, dtype=np.uint64)])) for _ in range(n)]


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("members", [3, 300])
def test_ties_in_buckets_of_any_size(percent, members):
    """What one bucket ties: hardly any of the pages that share a template, in small buckets as in large ones, and pairs that are similar."""
    rng = np.random.default_rng(members)
    collections = near_dedup.collections_for(percent)
    least = near_dedup.agreeing(percent / 100, collections * near_dedup.ROWS + near_dedup.EXTRA)
    for similarity, most in ((0.5, 0.0005), (0.6, 0.002), (0.7, 0.2 if percent == 85 else 0.6)):
        tied = pairs = 0
        for _ in range(max(1, 300 // members)):
            sets = pages(similarity, members, rng)
            begin = np.append(0, np.cumsum([len(s) for s in sets]))
            _, small = near_dedup.signatures(np.concatenate(sets), begin, collections)
            for i in range(members):
                tied += int(((small[i + 1 :] == small[i]).sum(1) >= least).sum())
            pairs += members * (members - 1) // 2
        assert tied / pairs <= most, (similarity, tied / pairs)
    missed = trials = 0
    for _ in range(400):
        a, b = pages(percent / 100 + 0.004, 2, rng)
        _, small = near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), collections)
        missed += int((small[0] == small[1]).sum() < least)
        trials += 1
    assert missed <= 2


def test_tied_pairs_join_what_a_loop_joins():
    rng = np.random.default_rng(8)
    small = rng.integers(0, 3, (60, 20)).astype(np.uint8)
    for least in (0, 10, 12, 14, 21):
        label = list(range(60))
        for _ in range(60):
            for i in range(60):
                for j in range(60):
                    if i != j and (small[i] == small[j]).sum() >= least:
                        label[i] = label[j] = min(label[i], label[j])
        up = list(range(60))
        for a, b in near_dedup.tied_pairs(small, least):
            x, y = up[a], up[b]
            assert x != y
            up = [x if u == y else u for u in up]
        assert len(set(up)) == len(set(label)) and all((up[i] == up[j]) == (label[i] == label[j]) for i in range(60) for j in range(60))


def test_pages_of_one_template_are_few_candidates(spark, monkeypatch):
    """400 pages of similarity 0.6, none linked with another: candidate groups of a few at most."""
    drawn = random.Random(4)
    base = [f"t{i}" for i in range(153)]
    rows = [(i, " ".join(base + [f"p{drawn.randrange(10**9)}" for _ in range(50)])) for i in range(400)]
    found = []
    real = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: found.append(real(edges)) or found[-1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert near_dedup.link_groups(docs).where("NOT kept").count() == 0
    groups = [r["count"] for r in found[0].groupBy("root").count().collect()]
    assert max(groups, default=0) <= 8 and sum(groups) <= 60
