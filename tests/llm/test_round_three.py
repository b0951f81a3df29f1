"""Repeated passages, filter interactions and snapshot differences against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.llm import filter_audit, snapshot_diff, substring_dedup
from phrasemill.llm._rank import ranked


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def without(docs, width):
    """Counter of (id, n_words, n_removed, sha of kept words) by looking up every window."""
    infinite = float("inf")
    smallest = {}
    for i, t in docs:
        w = words_of(t)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            smallest[key] = min(smallest.get(key, infinite), infinite if i is None else i)
    out = Counter()
    for i, t in docs:
        w = words_of(t)
        gone = set()
        for s in range(len(w) - width + 1):
            if smallest[tuple(w[s : s + width])] < (infinite if i is None else i):
                gone.update(range(s, s + width))
        out[i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    return out


def found(docs, width):
    rows = substring_dedup.digested(docs, width).collect()
    return Counter(tuple(r) for r in rows)


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("width", [50, 7, 2])
def test_repeats_equal_every_window(spark, odd, empty, documents, width):
    docs = [odd] if width == 2 else [odd, documents]
    for df in docs:
        assert found(df, width) == without(pairs(df), width)
    assert substring_dedup.without_repeats(empty, width).count() == 0


def test_repeats_at_any_overlap(spark):
    """Passages cut at random from one text, around a passage that all share, in documents of a small alphabet: many
    different reaches of one anchor, repeats that touch and overlap, and anchors of equal hashes."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(280)
            parts += base[a : a + rng.randint(1, 90)] + [rng.choice("xyz") for _ in range(rng.randint(0, 4))]
        texts.append(" ".join(parts))
    texts += [" ".join(rng.choice("ab") for _ in range(400)) for _ in range(12)] + ["a " * 300] * 5
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(7)
    for width in (50, 20):
        assert found(df, width) == without(pairs(df), width)


def test_spans_are_the_removed_words(spark, documents):
    rows = substring_dedup.without_repeats(documents).where("spans IS NOT NULL").collect()
    assert rows
    for r in rows:
        assert r.n_removed == sum(s.end - s.start for s in r.spans) and all(s.end - s.start >= 50 for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_one_anchor_in_every_document(spark):
    """A line of 30 words that 3,000 documents have between words of their own: nothing repeats over 50 words, no pair is
    listed, and rows of the work stay in proportion."""
    line = " ".join(f"l{i}" for i in range(30))
    own = lambda side: F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.concat(F.lit(side), F.col("id").cast("string"), F.lit("_"), k.cast("string"))))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", own("a"), F.lit(line), own("b")).alias("text"))
    out = substring_dedup.digested(df)
    assert out.agg(F.sum("n_removed")).first()[0] == 0 and out.count() == 3000


def test_last_least():
    values = np.array([5, 3, 3, 9, 1, 1, 7, 7, 7, 0])
    for width in range(1, 11):
        got = substring_dedup.last_least(values, width).tolist()
        want = [max(p for p in range(s, s + width) if values[p] == values[s : s + width].min()) for s in range(len(values) - width + 1)]
        assert got == want


# filters


def fails(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang in docs:
        t = t or ""
        w = words_of(t)
        f = first.get(t)
        yield (
            lang or "",
            i,
            {
                "A": len(w) < 100,
                "B": 100 * len(set(w)) < 80 * len(w),
                "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)),
                "E": f is not None and (i is None or i > f),
            },
        )


def audited(docs, good, toxic):
    rows = list(fails(docs))
    out = {}
    shapley = Counter()
    for order in map("".join, permutations("ABCDE")):
        left = defaultdict(list)
        for part, i, f in rows:
            left[part].append((i, f, False))
        for part, entries in left.items():
            for step, x in enumerate(order, 1):
                here = [i for i, f, gone in entries if f[x] and not gone]
                redundant = sum(f[x] and gone for _, f, gone in entries)
                entries = [(i, f, gone or f[x]) for i, f, gone in entries]
                unique = sum(f[x] and sum(f.values()) == 1 for _, f, _ in entries)
                kept = sum(not gone for _, _, gone in entries)
                out[part, order, step] = (kept, len(here), redundant, unique, sum(i in good for i in here), sum(i in toxic for i in here))
                shapley[part, x] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_removal_step_by_step(spark, odd, empty):
    texts = ["up AND DOWN " * 60, "UPPER CASE", "a | b", None, "", "x " * 200, " ".join(f"w{i}" for i in range(150)), " ".join(f"w{i}" for i in range(150)), "A"]
    rows = [(i, t, [None, "en", "", "de"][i % 4]) for i, t in enumerate(texts)] + [(None, "", "en"), (None, "new #", "de"), (3, None, "en"), (7, "A", "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("clash") for c in ("id", "part", "digest", "first", "A", "mask", "n", "words")})
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (3, 1, 1), (3, 0, 0), (5, None, 1), (None, 1, 1), (8, 1, None)], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    want = audited(rows, {0, 3, 8}, {1, 3, 5})
    assert len(got) == len(want) == 120 * 5 * len({x[2] or "" for x in rows})
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in got} == want
    lang = odd.withColumn("lang", F.col("source"))
    plain = [(r.doc_id, r.text, r.lang) for r in lang.collect()]
    got = filter_audit.audit(lang, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in got} == audited(plain, {0, 3, 8}, {1, 3, 5})
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_incidence_counts_every_document_once():
    m = filter_audit.incidence(5)
    assert m["kept"].shape == (32, 600)
    last = m["kept"][:, 4::5]
    assert (last.sum(0) == 1).all() and (last[0] == 1).all()  # only what fails nothing is left
    assert ((m["removed"].reshape(32, 120, 5).sum(2) == 1)[1:]).all()  # everything else is removed once
    hit = np.arange(32)[:, None] >> m["filter"] & 1
    assert (m["removed"] + m["redundant"] == hit).all()


def test_general_filters(spark):
    rows = spark.createDataFrame([(1, None), (5, True), (9, False)], "v int, m boolean")
    got = filter_audit.interactions(rows, F.lit(None), {"x": F.col("v") > 4, "y": F.col("v") > 8}, {"m": F.col("m")}).orderBy("filter_order", "step").collect()
    assert [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.m_lost, r.shapley) for r in got] == [
        ("", "xy", 1, 1, 2, 0, 1, 1, 3), ("", "xy", 2, 1, 0, 1, 0, 0, 1), ("", "yx", 1, 2, 1, 0, 0, 0, 1), ("", "yx", 2, 1, 1, 1, 1, 1, 3),
    ]
    with pytest.raises(ValueError):
        filter_audit.interactions(rows, F.lit(None), {"long": F.col("m")}, {})


# snapshots


def compared(earlier, later, columns):
    """Counter of (key, old_key, op, changed); rows are (key, values...), keys are unique."""
    a, b = {r[0]: r[1:] for r in earlier}, {r[0]: r[1:] for r in later}
    out = Counter()
    for k in a.keys() & b.keys():
        changed = tuple(c for c, x, y in zip(columns, a[k], b[k], strict=True) if x != y)
        out[k, k, "update" if changed else "same", changed] += 1
    gone, come = defaultdict(list), defaultdict(list)
    for mine, other, side in ((a, b, gone), (b, a, come)):
        for k in sorted(mine.keys() - other.keys(), key=lambda k: (k is None, k or 0)):
            side[mine[k]].append(k)
    for content in gone.keys() | come.keys():
        x, y = gone[content], come[content]
        n = min(len(x), len(y))
        out.update((new, old, "rekey", ()) for old, new in zip(x, y, strict=False))
        out.update((k, k, "delete", ()) for k in x[n:])
        out.update((k, None, "insert", ()) for k in y[n:])
    return out


def answers(df):
    return Counter((r["key"], r.old_key, r.op, tuple(r.changed)) for r in df.collect())


def test_snapshots_equal_brute_force(spark):
    rng = random.Random(5)
    columns = ["text", "lang"]
    kind = "k bigint, text string, lang string"
    values = [(t, x) for t in (None, "", "a", "b" * 3000, "~", "null") for x in (None, "en", "")]
    earlier = {k: rng.choice(values) for k in rng.sample(range(-300, 900), 500)} | {None: ("a", None)}
    later = {}
    for k, v in earlier.items():
        draw = rng.randrange(8)
        if draw == 0:
            continue
        later[k + 2000 if draw in (1, 2) and k is not None else k] = rng.choice(values) if draw == 3 else v
        if draw == 4 and k is not None:
            later[-5000 - k] = v
    for x, y in ((earlier, later), (earlier, earlier), ({}, later), (earlier, {}), ({}, {}), ({1: ("a", "b")}, {1: ("a", "c"), 2: ("a", "b")})):
        a, b = ([(k, *v) for k, v in t.items()] for t in (x, y))
        frames = [spark.createDataFrame(t, kind).withColumns({c: F.lit("clash") for c in ("key", "node", "leaf", "nth", "place", "content", "c0", "x0", "a", "b")}) for t in (a, b)]
        assert answers(snapshot_diff.compare(*frames, "k", columns)) == compared(a, b, columns)


def test_repeated_keys_and_carried_columns(spark):
    kind = "k string, v int, w double"
    a = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.5), (None, 1, 1.0), (None, 1, 1.0), ("y", None, None)], kind)
    b = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.5), ("x", 2, 0.5), (None, 1, 1.0), ("z", None, None)], kind)
    out = snapshot_diff.compare(a, b, "k", ["v", "w"], ["v"]).collect()
    got = Counter((r["key"], r.old_key, r.op, tuple(r.changed), r.v) for r in out)
    # the third x and the second null key have no partner by key, and no equal content
    ops = Counter((r["key"], r.op) for r in out)
    assert ops == Counter({("x", "same"): 2, ("x", "insert"): 1, (None, "same"): 1, (None, "delete"): 1, ("z", "rekey"): 1}) or ops[("x", "update")] == 1
    assert got["z", "y", "rekey", (), None] == 1 and sum(got.values()) == 6


def test_contract_snapshot(spark, odd):
    from conftest import crc

    docs = odd.withColumn("lang", F.lit("en")).dropDuplicates(["doc_id"])
    want = []
    for r in docs.select("doc_id", "text", "lang", "source").collect():
        k, t, x, s = r
        draw = None if k is None else crc(k, 10)
        if draw == 0:
            continue
        row = {1: (k, (t or "") + "+", x, s), 2: (k, t, s, x), 3: (-1 - (k or 0), t, x, s), 4: (-1 - (k or 0), t, x, None)}.get(draw, (k, t, x, s))
        want += [row] + ([(-1 - k, t, x, s)] if draw == 5 else [])
    assert Counter(tuple(r) for r in snapshot_diff.next_snapshot(docs).collect()) == Counter(want)
    rows = snapshot_diff.digested(docs, snapshot_diff.next_snapshot(docs)).collect()
    columns = ["text", "lang", "source"]
    old = [tuple(r) for r in docs.select("doc_id", *columns).collect()]
    assert Counter((r["key"], r.old_key, r.op, tuple(x for x in r.changed.split(",") if x)) for r in rows) == compared(old, want, columns)
    lines = {w[0]: sha("\n".join("~" if v is None else v for v in w[1:])) for w in want}
    assert all(r.row_sha256 == (None if r.op == "delete" else lines[r["key"]]) for r in rows)


def test_only_differing_leaves_are_found(spark):
    docs = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 7).cast("string").alias("v"))
    other = docs.withColumn("v", F.when(F.col("k").isin(17, 4000), "new").otherwise(F.col("v"))).where("k <> 99")
    a, b = (snapshot_diff.rows_of(x, "k", ["v"]) for x in (docs, other))
    depth = snapshot_diff.depth_for(5000)
    one, two = snapshot_diff.tree(a, depth), snapshot_diff.tree(b, depth)
    found = {r.node for r in snapshot_diff.differing(one, two).collect()}
    want = {r.node for r in a.where("key IN (17, 99, 4000)").select(snapshot_diff.leaf(depth).alias("node")).collect()}
    assert found == want and len(one.levels) == depth + 1 and one.levels[-1].first().n == 5000
    assert snapshot_diff.differing(one, one).isEmpty()


def test_equal_sums_of_unequal_rows_are_diffed(spark, monkeypatch):
    """Leaves that look equal but aren't are found by the exact check."""
    monkeypatch.setattr(snapshot_diff, "differing", lambda a, b: a.levels[0].limit(0).select("node"))
    a = [(k, "a", str(k)) for k in range(60)]
    b = [(k, "b" if k == 7 else "a", str(k)) for k in range(61) if k != 8]
    b = [r for r in b if r[0] != 60] + [(500, "a", "8")]
    kind = "k bigint, text string, lang string"
    out = snapshot_diff.compare(spark.createDataFrame(a, kind), spark.createDataFrame([r for r in b if r[0] < 60], kind), "k", ["text", "lang"])
    assert answers(out) == compared(a, [r for r in b if r[0] < 60], ["text", "lang"])


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_places_in_large_groups(spark, kind):
    rows = spark.range(20000).select((F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7)).alias("g"), F.nullif(F.xxhash64("id") % 500, F.lit(7)).cast(kind).alias("v"), "id").repartition(9)
    out = ranked(rows, ["g"], "v").collect()
    by = defaultdict(list)
    for r in out:
        by[r.g].append((r.nth, r.v is None, r.v or 0))
    assert len(out) == 20000
    for entries in by.values():
        entries.sort()
        assert [n for n, *_ in entries] == list(range(1, len(entries) + 1))
        values = [v for _, *v in entries]
        assert [v[0] for v in values] == sorted(v[0] for v in values)
        full = [v for null, v in values if not null]
        assert full == sorted(full)
