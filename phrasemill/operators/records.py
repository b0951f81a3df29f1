"""Examples, labels and features: the record work around training and annotation."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..shared import free_name, materialised
from .sampling import draw


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """Every label with its number from 0 in alphabetical order; labels are few."""
    return rows.select(label).distinct().withColumn("index", (F.row_number().over(Window.orderBy(label)) - 1).cast("bigint"))


def padded_batch(rows: DataFrame, tokens: str, width: int, pad: str = "[PAD]", left: bool = False) -> DataFrame:
    """Token arrays cut or filled to ``width``, with a mask of 1 for tokens."""
    cut = F.slice(tokens, 1, width)
    fill = F.array_repeat(F.lit(pad), F.lit(width) - F.size(cut))
    ones, zeros = F.array_repeat(F.lit(1), F.size(cut)), F.array_repeat(F.lit(0), F.lit(width) - F.size(cut))
    joined, mask = ((fill, cut), (zeros, ones)) if left else ((cut, fill), (ones, zeros))
    return rows.withColumn("mask", F.concat(*mask)).withColumn(tokens, F.concat(*joined))


def feature_ids(rows: DataFrame, order: list[str], first: int = 1_000_000_000, name: str = "feature_id") -> DataFrame:
    """Rows numbered in order from ``first``; ties in any order, nulls first. No row is lost or numbered twice.

    Rows are sorted by ranges, not in one task, and written with the number of their range: planned anew, the
    same ranges could be dealt to other partitions. Numbers go on across ranges by their counts. Other columns
    may have any names.
    """
    part, place, low, before, size = (free_name(rows, x) for x in ("_range", "_place", "_low", "_before", "_size"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = materialised(dealt.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "numbered")
    # a row for every range
    per = marked.groupBy(part).agg(F.count("*").alias(size), F.min(place).alias(low))
    per = per.select(part, low, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(before))
    joined = marked.join(F.broadcast(per), part)
    return joined.select(*rows.columns, (F.lit(first) + F.col(before) + F.col(place) - F.col(low)).alias(name))


def by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Two tables row by row in their orders; rows of the longer one that have no partner are left out."""
    a, b = feature_ids(left, [left_order], 0, "at"), feature_ids(right, [right_order], 0, "at")
    return a.join(b, "at")


def consistent(questions: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Questions whose predicted answer is their answer; ``predictions``: id, predicted."""
    joined = questions.join(predictions, key)
    return joined.where(X.normalize_answer(F.col("answer")) == X.normalize_answer(F.col("predicted"))).drop("predicted")


def prediction_counts(questions: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many ``questions`` there are, how many are ``missing`` a prediction, how many have one that is
    ``consistent`` with their answer, and how many have another (``rejected``). A null prediction is another."""
    joined = questions.join(predictions.select(key, "predicted", F.lit(True).alias("_found")), key, "left")
    agree = F.coalesce(X.normalize_answer(F.col("answer")) == X.normalize_answer(F.col("predicted")), F.lit(False))
    found = F.col("_found").isNotNull()
    return joined.agg(F.count("*").alias("questions"), F.count_if(~found).alias("missing"), F.count_if(found & agree).alias("consistent"), F.count_if(found & ~agree).alias("rejected"))


def with_negatives(questions: DataFrame, passages: DataFrame, seed: int = 29) -> DataFrame:
    """Each question with its passage and a hard negative drawn by a seeded hash; without any its own
    passage's neighbour. ``questions``: id, passage_id, negatives; ``passages``: passage_id, text."""
    drawn = F.get("negatives", F.pmod(F.xxhash64(F.lit(seed), "id"), F.greatest(F.size("negatives"), F.lit(1))).cast("int"))
    q = questions.withColumn("negative_id", F.coalesce(drawn, F.col("passage_id") + 1))
    q = q.join(passages.select("passage_id", F.col("text").alias("passage")), "passage_id")
    return q.join(passages.select(F.col("passage_id").alias("negative_id"), F.col("text").alias("negative")), "negative_id", "left")


def annotated(hits: DataFrame, golds: DataFrame) -> DataFrame:
    """Hits with labels: whether the answer is a gold answer, and the title a gold title (any case).
    ``golds``: qid, golds, titles."""
    joined = hits.join(golds, "qid")
    norm = F.transform("golds", lambda g: X.normalize_answer(g))
    phrase = F.array_contains(norm, X.normalize_answer(F.col("answer")))
    doc = F.exists("titles", lambda t: F.lower(t) == F.lower("title"))
    return joined.withColumn("phrase_label", phrase.cast("int")).withColumn("doc_label", doc.cast("int")).drop("golds", "titles")


def first_supporting(results: DataFrame) -> DataFrame:
    """For every question its first passage that holds an answer, with the answer and its place.
    ``results``: qid, place, text, answers."""
    at = F.array_max(F.transform(F.transform("answers", lambda a: F.struct((-F.instr("text", a)).alias("p"), a.alias("a"))), lambda s: F.when(s["p"] < 0, s)))
    found = results.withColumn("_s", at).where("_s IS NOT NULL")
    top = found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where("_n = 1")
    return top.select("qid", "place", F.col("_s.a").alias("answer"), (-F.col("_s.p") - 1).alias("answer_start"))


def best_over_ends(scored: DataFrame, by: str = "doc_idx") -> DataFrame:
    """For every start the best sum over its ends."""
    return scored.groupBy(by, "s").agg(F.max("score").alias("best"))


def word_index(pieces: DataFrame, by: str, order: str, begins: Column) -> DataFrame:
    """The number of the word that each piece belongs to: a running count of beginnings."""
    return pieces.withColumn("word", (F.sum(begins.cast("bigint")).over(Window.partitionBy(by).orderBy(order)) - 1))


def token_offsets(tokens: Column) -> Column:
    """Where each token begins in its text joined by single spaces."""
    step = F.aggregate(tokens, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")), lambda s, t: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), (s["at"] + F.length(t) + 1).alias("at")))
    return step["out"]


def visible_context(tokens: Column) -> Column:
    """Text of tokens (structs token, html_token) without markup."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: ~t["html_token"]), lambda t: t["token"]), " ")


def even_chunks(rows: DataFrame, n: int, order: str, key: str = "chunk") -> DataFrame:
    """Rows in order as ``n`` chunks of nearly equal size."""
    number, total = free_name(rows, "_number"), free_name(rows, "_all")
    numbered = feature_ids(rows, [order], 0, number)
    totals = rows.agg(F.count("*").alias(total))
    return numbered.crossJoin(F.broadcast(totals)).withColumn(key, F.floor(F.col(number) * n / F.col(total)).cast("int")).drop(number, total)


def balanced(sizes: dict[str, int], bins: int) -> list[list[str]]:
    """Names dealt to bins, the largest first to the lightest bin: for a listing of files."""
    heap = [(0, i) for i in range(bins)]
    out: list[list[str]] = [[] for _ in range(bins)]
    for name in sorted(sizes, key=lambda n: (-sizes[n], n)):
        weight, i = heapq.heappop(heap)
        out[i].append(name)
        heapq.heappush(heap, (weight + sizes[name], i))
    return out


def sizes(rows: DataFrame, text: str) -> DataFrame:
    """Bytes of a column as they are and hashed words of them: rows, bytes, words."""
    return rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length(text)).alias("bytes"), F.sum(F.size(F.split(text, " ")).cast("bigint")).alias("words"))


def tightened(tokens: list[str], start: int, end: int, answer: list[str]) -> tuple[int, int]:
    """The first sub-span of tokens ``start..end`` that is exactly the answer's tokens, or the span."""
    n = len(answer)
    return next(((i, i + n - 1) for i in range(start, end - n + 2) if tokens[i : i + n] == answer), (start, end))


def raw_span(predicted: str | None, raw: str | None) -> str | None:
    """A span of normalised tokens in its raw text: characters other than spaces are aligned one to one;
    the raw text as it is if they don't agree."""
    if predicted is None or raw is None:
        return raw
    joined = "".join(c for c in raw.lower() if not c.isspace())
    wanted = "".join(c for c in predicted.lower() if not c.isspace())
    at = joined.find(wanted)
    places = [i for i, c in enumerate(raw) if not c.isspace() for _ in c.lower()]
    if at < 0 or not wanted or len(places) != len(joined):
        return raw
    return raw[places[at] : places[at + len(wanted) - 1] + 1]


#: Predicted spans as they stand in the raw text.
final_text = F.pandas_udf(lambda p, r: pd.Series([raw_span(a, b) for a, b in zip(p, r, strict=True)]), T.StringType())


def with_examples(features: DataFrame, examples: DataFrame) -> DataFrame:
    """Features with the example they were cut from. ``features``: unique_id, example_index; ``examples``:
    example_index and more."""
    return features.join(examples, "example_index")


def generated_id(title: Column, paragraph: Column, sentence: Column, answer: Column) -> Column:
    """The id of a generated question: ``{title}_p{}_s{}_a{}``."""
    return F.concat(title, F.lit("_p"), paragraph.cast("string"), F.lit("_s"), sentence.cast("string"), F.lit("_a"), answer.cast("string"))


def occurrences(text: Column, answer: Column) -> Column:
    """Where an answer, as it stands, begins in a text, in characters from 0; the first place is the one taken
    where any would do."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(answer, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    at = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(F.lit(0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + F.length(p) + F.length(answer))))
    return F.when(F.length(answer) > 0, F.transform(F.slice(at, F.lit(2), F.size(at)), lambda x: x - F.length(answer)))


def drawn_occurrence(text: Column, answer: Column, *keys: Column, seed: int = 29) -> Column:
    """One of the places where an answer begins, drawn by a seeded hash of ``keys``; null without any."""
    at = occurrences(text, answer)
    return F.when(F.size(at) > 0, F.get(at, (F.conv(F.substring(draw(*keys, seed=seed), 1, 8), 16, 10).cast("bigint") % F.size(at)).cast("int")))


def span_bytes(document: Column, start: Column, end: Column) -> Column:
    """The text of a span of bytes ``[start, end)`` of a document's UTF-8 form."""
    return F.decode(F.substring(F.encode(document, "UTF-8"), start + 1, end - start), "UTF-8")


def resource_name(url: Column, etag: Column) -> Column:
    """The name of a cached resource: hash of its address, and of its tag where there is one."""
    return F.concat_ws(".", F.sha2(url, 256), F.sha2(etag, 256))


def untokenised(words: Column, spaces: Column) -> Column:
    """A text from its words and what follows each of them."""
    return F.rtrim(F.array_join(F.zip_with(words, spaces, lambda w, s: F.concat(w, s)), ""))
