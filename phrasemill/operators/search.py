"""Phrase search: hits on start and end vectors, completed to spans, ranked, joined to texts, merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.vectors import dot
from ..shared import materialised
from .mips import exact_top_k

#: What each retrieval unit merges by.
STRATEGY = {"phrase": "opt1", "sentence": "opt2", "paragraph": "opt2", "document": "opt3"}


def valid_phrase(start_f2o, end_f2o, max_length: int):
    """Whether a span begins before it ends and spans at most ``max_length`` places."""
    gap = end_f2o - start_f2o
    return (gap >= 0) & (gap <= max_length)


def complete(hits: DataFrame, phrases: DataFrame, max_length: int, anchor: str) -> DataFrame:
    """The best partner of every hit within ``max_length`` kept tokens.

    ``hits``: qid, rank, doc_idx, idx, score and ``other``, the query's vector for the partner. The band
    of partners is an equi-join: a row of a hit for every offset.
    """
    step = 1 if anchor == "start" else -1
    near = hits.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(max_length - 1)))).withColumn("_j", F.col("idx") + step * F.col("o"))
    own = phrases.select("doc_idx", "idx", F.col("f2o").alias("own_f2o"))
    partner = phrases.select(F.col("doc_idx"), F.col("idx").alias("_j"), F.col("f2o").alias("partner_f2o"), F.col("vec").alias("_v"))
    joined = near.join(own, ["doc_idx", "idx"]).join(partner, ["doc_idx", "_j"])
    first, last = ("own_f2o", "partner_f2o") if anchor == "start" else ("partner_f2o", "own_f2o")
    joined = joined.where(valid_phrase(F.col(first), F.col(last), max_length)).withColumn("total", F.col("score") + dot(F.col("other"), F.col("_v")))
    tie = F.col("o").asc() if anchor == "start" else F.col("o").desc()
    best = Window.partitionBy("qid", "rank").orderBy(F.col("total").desc(), tie)
    top = joined.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    a, b = ("idx", "_j") if anchor == "start" else ("_j", "idx")
    return top.select("qid", F.lit(0 if anchor == "start" else 1).alias("anchor"), "rank", "doc_idx", F.col(a).alias("start_idx"), F.col(b).alias("end_idx"), F.col(first).alias("start_f2o"), F.col(last).alias("end_f2o"), F.col("total").alias("score"))


def both_hits(phrases: DataFrame, encoded: DataFrame, k: int, search: Callable[[DataFrame, DataFrame, int], DataFrame] = exact_top_k) -> tuple[DataFrame, DataFrame]:
    """Hits on starts and on ends for ``complete``, from one pass over the vectors: both halves of every query are searched at once.
    ``phrases``: id, vec; ``encoded``: qid, q_start, q_end. Hits: qid, rank, id, score, other."""
    tag = lambda side: F.concat(F.lit(side), F.col("qid").cast("string"))
    halves = [encoded.select(tag("s").alias("tag"), F.col("q_start").alias("qvec")), encoded.select(tag("e").alias("tag"), F.col("q_end").alias("qvec"))]
    top = search(phrases, halves[0].unionByName(halves[1]).withColumnRenamed("tag", "qid"), k).withColumnRenamed("qid", "tag")
    # written: both kinds of hits, and what is joined to them, read it
    top = materialised(top, "hits")
    return tuple(top.join(encoded.select("qid", tag(side).alias("tag"), F.col(other).alias("other")), "tag").select("qid", "rank", "id", "score", "other") for side, other in (("s", "q_end"), ("e", "q_start")))


def near(phrases: DataFrame, hits: DataFrame) -> DataFrame:
    """Phrases of the documents that have hits: all that completing them can need."""
    return phrases.join(hits.select("doc_idx").distinct(), "doc_idx", "left_semi")


def with_vectors(spans: DataFrame, phrases: DataFrame) -> DataFrame:
    """Spans with the vectors of their first and last place, ``start_vec`` and ``end_vec``, to train queries on; null where the phrases lack
    them."""
    first = phrases.select("doc_idx", F.col("idx").alias("start_idx"), F.col("vec").alias("start_vec"))
    last = phrases.select("doc_idx", F.col("idx").alias("end_idx"), F.col("vec").alias("end_vec"))
    return spans.join(first, ["doc_idx", "start_idx"], "left").join(last, ["doc_idx", "end_idx"], "left")


def search_spans(start_hits: DataFrame, end_hits: DataFrame, phrases: DataFrame, max_length: int) -> DataFrame:
    """Spans from both kinds of hits, two rows for every rank of a query."""
    phrases = materialised(near(phrases.select("doc_idx", "idx", "f2o", "vec"), start_hits.select("doc_idx").unionByName(end_hits.select("doc_idx"))), "near")
    return complete(start_hits, phrases, max_length, "start").unionByName(complete(end_hits, phrases, max_length, "end"))


def with_texts(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans with title, context, places in characters and the answer; ``docs``: doc_idx, title, context.
    Words are separated by single spaces. A place beyond the words is the end of the context."""
    joined = spans.join(docs, "doc_idx")
    words = F.split("context", " ")
    n = F.size("_w")
    begin = lambda i: F.when(i >= n, F.length("context")).otherwise(F.length(F.array_join(F.slice("_w", F.lit(1), i.cast("int")), " ")) + (i > 0).cast("int"))
    joined = joined.withColumn("_w", words)
    start = begin(F.col("start_f2o"))
    end = F.when(F.col("end_f2o") >= n, F.length("context")).otherwise(begin(F.col("end_f2o")) + F.length(F.get("_w", F.col("end_f2o").cast("int"))))
    placed = joined.withColumn("start_pos", start.cast("bigint")).withColumn("end_pos", end.cast("bigint")).drop("_w")
    return placed.withColumn("answer", X.answer_span(F.col("context"), F.col("start_pos").cast("int"), F.col("end_pos").cast("int")))


def to_paragraph(hits: DataFrame) -> DataFrame:
    """Contexts cut to the paragraph of the hit, places counted from there."""
    low, high = X.paragraph_bounds(F.col("context"), F.col("start_pos").cast("int"), F.col("end_pos").cast("int"))
    cut = hits.withColumn("_low", low).withColumn("_high", high)
    cut = cut.withColumn("context", F.substring("context", F.col("_low") + 1, F.col("_high") - F.col("_low")))
    return cut.withColumn("start_pos", F.col("start_pos") - F.col("_low")).withColumn("end_pos", F.col("end_pos") - F.col("_low")).drop("_low", "_high")


def to_sentences(hits: DataFrame, window: int = 0) -> DataFrame:
    """Contexts cut to the sentences that the hit touches, and ``window`` more on either side."""
    starts = hits.withColumn("_s", X.sentences(F.col("context")))
    at = lambda place: F.size(F.filter("_s", lambda s: s <= place)) - 1
    first = F.greatest(at(F.col("start_pos")) - window, F.lit(0))
    last = F.least(at(F.greatest(F.col("end_pos") - 1, F.lit(0))) + window, F.size("_s") - 1)
    cut = starts.withColumn("_a", first).withColumn("_b", last).withColumn("_low", F.get("_s", F.col("_a")))
    high = F.coalesce(F.get("_s", F.col("_b") + 1), F.length("context"))
    cut = cut.withColumn("context", F.rtrim(F.substring("context", F.col("_low") + 1, high - F.col("_low"))))
    return cut.withColumn("start_pos", F.col("start_pos") - F.col("_low")).withColumn("end_pos", F.col("end_pos") - F.col("_low")).drop("_s", "_a", "_b", "_low")


def _keys(strategy: str) -> list:
    return {"opt1": ["title", "start_pos", "end_pos"], "opt2": ["context"], "opt3": ["title"], "opt4": [X.normalize_answer(F.col("answer"))]}[strategy]


ORDER = ("anchor", "rank", "doc_idx", "start_idx", "end_idx")


def aggregate(hits: DataFrame, strategy: str = "opt1") -> DataFrame:
    """One hit for each key: the best, ties by anchor, rank and place. ``opt1`` merges by title and places
    (within the paragraph where contexts were cut), ``opt2`` by context, ``opt3`` by title, ``opt4`` by
    normalised answer, whose winner lists the titles of all in the order of their scores."""
    per = Window.partitionBy("qid", *_keys(strategy))
    order = [F.col("score").desc(), *map(F.col, ORDER)]
    numbered = hits.withColumn("_n", F.row_number().over(per.orderBy(*order)))
    if strategy == "opt4":
        seen = F.struct((-F.col("score")).alias("s"), *ORDER, F.col("title").alias("t"))
        titles = F.array_distinct(F.transform(F.array_sort(F.collect_list(seen).over(per)), lambda x: x["t"]))
        numbered = numbered.withColumn("titles", titles)
    return numbered.where("_n = 1").drop("_n")


def best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query as ``place`` from 1."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), *ORDER)
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def retrieve(hits: DataFrame, unit: str, k: int) -> DataFrame:
    """The unit's text for the ``k`` best distinct hits of each query."""
    cut = to_sentences(to_paragraph(hits)) if unit == "sentence" else to_paragraph(hits)
    top = best(aggregate(cut, STRATEGY[unit]), k)
    what = {"phrase": "answer", "sentence": "context", "paragraph": "context", "document": "title"}[unit]
    return top.select("qid", "place", F.col(what).alias("found"), "score")


def documents_per_query(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qid").agg(F.countDistinct("doc_idx").alias("docs"))
