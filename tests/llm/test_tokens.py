"""Token counts, id files and packing against the libraries themselves."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import TEXTS
from tokenizers import Tokenizer

from phrasemill.llm import packing, simple8b, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_are_the_library_s(odd, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (odd, documents):
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in df.select("doc_id", "text").collect())
        assert Counter(map(tuple, token_counts.count_tokens(df, PIECES).collect())) == want


def test_counts_of_random_strings():
    import random

    import pyarrow as pa

    rng, model = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    many = ["".join(rng.choice("ab c\n.thein▁-=0é") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    many += ["ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(5000))]
    assert token_counts.counter(PIECES).count(pa.array(many)).tolist() == [len(x) for x in model.encode(many)]


def test_no_rows(empty):
    assert token_counts.count_tokens(empty, PIECES).count() == 0
    assert simple8b.id_file_digest(empty, BPE).count() == 0
    assert packing.pack_documents(empty, BPE).count() == 0


@pytest.mark.parametrize("values", [[], [0], [1] * 1000, [2**64 - 1, 5, 2**60, 3], list(range(50257)), [2**i for i in range(64)] * 9])
def test_words_round_trip(values):
    packed = simple8b.frame(np.array(values, np.uint64), np.array([len(values)]))
    ids, lengths = simple8b.unframe(packed)
    assert ids.tolist() == values and lengths.tolist() == [len(values)]


def test_files_hold_the_library_s_ids(documents, library, texts):
    rows = {r.doc_id: r for r in simple8b.id_file_digest(documents, BPE, 2).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*ids_of(library, texts[i]), 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), crc_of(ids))
        start += len(ids)


def test_files_of_odd_rows(odd, library):
    want = Counter(crc_of([*ids_of(library, t), 2]) for (t,) in odd.select("text").collect())
    rows = simple8b.id_file_digest(odd, BPE, 2).collect()
    assert Counter(r.ids_crc32 for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def check_packing(rows, docs, library, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = Counter()
    for i, t in docs:
        ids = [*ids_of(library, t), 0]
        head = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        want.update((i, k, a, b - a, crc_of(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(r.length for r in rows)
    assert len(by) >= -(-total // capacity)
    return len(by), -(-total // capacity)


def test_packing(documents, texts, library):
    used, least = check_packing(packing.pack_documents(documents, BPE).collect(), texts.items(), library, 2048)
    assert used <= least + 2


def test_packing_odd_rows(odd, library):
    rows = packing.pack_documents(odd, BPE, capacity=64).collect()
    check_packing(rows, [tuple(r) for r in odd.select("doc_id", "text").collect()], library, 64)


def test_fullest_is_a_best_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = np.zeros(31, np.int64)
        for n in rng.integers(1, 31, 6):
            counts[n] += 1
        items = [n for n in range(31) for _ in range(counts[n])]
        sums = {sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(1 << len(items))}
        found = packing.fullest(counts, 30)
        assert sum(n * k for n, k in found.items()) == max(s for s in sums if s <= 30)
        assert all(k <= counts[n] for n, k in found.items())


def test_ids_come_with_the_pieces(odd):
    rows = packing.pack_documents(odd, BPE, capacity=64, with_ids=True).collect()
    assert len(TEXTS) and all(len(r.ids) == r.length and crc_of(r.ids) == r.ids_crc32 for r in rows)
