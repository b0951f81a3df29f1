"""Every shard matches the mixture, of large sources and of thousands of small ones together."""

from collections import Counter

from phrasemill.llm import sharding


def test_small_sources_are_spread_over_all_shards(spark):
    rows = [(i, f"text {i}", f"only{i}") for i in range(4800)] + [(i, f"text {i}", "large") for i in range(4800, 9600)]
    rows += [(i, f"text {i}", f"pair{i // 2}") for i in range(9600, 14400)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=24).collect()
    kind = {i: s[:4] for i, _, s in rows}
    counts = Counter((kind[r.doc_id], r.shard) for r in got)
    assert len(got) == len(rows)
    for k in ("only", "larg", "pair"):
        assert all(abs(counts[k, s] - 200) <= 8 for s in range(24)), [counts[k, s] for s in range(24)]
    assert max(Counter(r.shard for r in got).values()) - min(Counter(r.shard for r in got).values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(600))


def test_rows_without_ids_are_drawn_apart(spark):
    rows = spark.createDataFrame([(None, "same", "a")] * 3000 + [(i, f"t{i}", "b") for i in range(3000)], "doc_id bigint, text string, source string")
    got = sharding.interleave(rows, shards=8).collect()
    counts = Counter((r.source, r.shard) for r in got)
    assert all(abs(counts[x, s] - 375) <= 2 for x in "ab" for s in range(8))


def test_every_source_gets_its_share_of_every_shard(documents):
    got = sharding.interleave(documents, shards=5).collect()
    sizes = Counter(r.source for r in got)
    counts = Counter((r.source, r.shard) for r in got)
    assert all(abs(counts[x, s] - n / 5) <= 2.5 for x, n in sizes.items() for s in range(5))
