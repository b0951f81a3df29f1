"""Labels and scores of licence texts, whole, shifted, with words put in, left out or changed, against brute force."""

import random

import pytest
from conftest import alnum_words

from phrasemill.llm import licences as L

_FILL = [f"filler{i}" for i in range(400)] + "the of and software license copy version".split()


def brute(words, templates, idf):
    """Labels and score of one file, by looking at every start of every template."""
    labels, score = set(), 0.0
    for t in templates:
        at, k = t.key
        m, distinct = len(t.words), sorted(set(t.words), key=lambda w: (-idf[w], w))
        rare = [w for w in distinct if w in words][: L.RARE]
        for s in range(-at, len(words)):
            if tuple(words[s + at : s + at + k]) != t.key_words:
                continue
            if m == k:
                labels.add(t.label)
                score = max(score, t.worth)
                continue
            agree = sum(any(words[p] == w and any(x == w and abs(p - s - o) <= t.slack for o, x in enumerate(t.words)) for p in range(len(words))) for w in rare)
            around = set(words[max(0, s - t.slack) : s + m + t.slack])
            cover = sum(idf[w] for w in distinct if w in around) / sum(idf[w] for w in distinct)
            if agree >= L.AGREE and cover >= L.COVERAGE:
                labels.add(t.label)
                score = max(score, min(1.0, cover) * t.worth)
    return ",".join(sorted(labels)), score


def _damaged(drawn, t):
    words = list(t.words)
    kind = drawn.choice(["whole", "in", "out", "change", "cut", "phrase gone"])
    for _ in range({"whole": 0, "cut": 0, "phrase gone": 0}.get(kind, max(1, len(words) // 8))):
        i = drawn.randrange(len(words))
        if kind == "in":
            words.insert(i, drawn.choice(_FILL))
        elif kind == "out" and len(words) > 1:
            del words[i]
        else:
            words[i] = drawn.choice(_FILL)
    if kind == "cut":
        words = words[: max(1, len(words) // 2)]
    if kind == "phrase gone":
        words[t.key[0]] = "gone"
    return words


def test_labels_and_scores_equal_brute_force(spark):
    drawn = random.Random(11)
    templates = L.BASE + L.NOTICES
    rows = []
    for i in range(400):
        words = drawn.choices(_FILL, k=drawn.randrange(40))
        for t in drawn.sample(templates, drawn.randrange(4)):
            words += _damaged(drawn, t) + drawn.choices(_FILL, k=drawn.randrange(30))
        rows.append((i, ("-" if i % 3 else "") + drawn.choice([" ", ", ", "\n"]).join(words).upper()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    idf = L.inverse_frequencies(*L.document_frequencies(docs))
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    found = 0
    for i, text in rows:
        labels, score = brute(alnum_words(text), templates, idf)
        assert (got[i].labels, pytest.approx(score, abs=1e-9)) == (labels, got[i].score), i
        found += bool(labels)
    assert 100 < found < 400


def test_document_frequencies(spark):
    docs = spark.createDataFrame([(1, "MIT mit license"), (2, None), (3, "the License"), (3, "nothing here")], "doc_id bigint, text string")
    n, seen = L.document_frequencies(docs)
    assert (n, seen["mit"], seen["license"], seen["the"], seen["apache"]) == (4, 1, 2, 1, 0)


@pytest.mark.parametrize(
    ("text", "label"),
    [("Distributed under the MIT License", "mit"), ("The MIT License (MIT)", "mit"), ("Apache License, Version 2.0, January 2004", "apache-2.0"), ("terms of the GNU General Public License version 3", "gpl-3.0"), ("the GNU Lesser General Public License", "lgpl")],
)
def test_ordinary_mentions(spark, text, label):
    rows = spark.createDataFrame([(1, f"Some words. {text}. More words")], "doc_id bigint, text string")
    assert label in L.scan(rows).first().labels.split(",")
