"""Evaluation: answers, reading comprehension, passages, provenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X


def answer_metrics(predictions: DataFrame, k: int, metric=X.exact_match) -> DataFrame:
    """``em_top1, em_topk, f1_top1, f1_topk, redundancy`` of rows (qid, predictions, golds): the best over
    gold answers at the first place and among the first ``k``, averaged over all questions in percent."""
    em = lambda p: X.best_over(F.col("golds"), lambda g: metric(p, g).cast("double"))
    f1 = lambda p: X.best_over(F.col("golds"), lambda g: X.f1_open(p, g))
    top = F.slice("predictions", 1, k)
    per = predictions.select(
        em(F.get("predictions", F.lit(0))).alias("em1"), F.coalesce(F.array_max(F.transform(top, em)), F.lit(0.0)).alias("emk"),
        f1(F.get("predictions", F.lit(0))).alias("f11"), F.coalesce(F.array_max(F.transform(top, f1)), F.lit(0.0)).alias("f1k"),
        X.let(X.normalize_answer(F.get("predictions", F.lit(0))), lambda first: F.size(F.filter(top, lambda p: X.normalize_answer(p) == first))).alias("same"))
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0))) * 100
    return per.agg(mean("em1").alias("em_top1"), mean("emk").alias("em_topk"), mean("f11").alias("f1_top1"), mean("f1k").alias("f1_topk"), F.avg("same").alias("redundancy"))


def restrict(predictions: Column, candidates: Column) -> Column:
    """Predictions in the candidate set as they are or in lower case; an empty string without any."""
    kept = F.filter(predictions, lambda p: F.array_contains(candidates, p) | F.array_contains(candidates, F.lower(p)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))


def answerability(scores: DataFrame) -> DataFrame:
    """Means of exact and f1 for all questions, those with and those without an answer: (has_ans, exact, f1)."""
    sets = scores.groupingSets([["has_ans"], []], "has_ans")
    return sets.agg(F.avg(F.col("exact").cast("double")).alias("exact"), F.avg(F.col("f1").cast("double")).alias("f1"), F.count("*").alias("total"))


def with_threshold(score: Column, na_prob: Column, has_ans: Column, threshold: float) -> Column:
    """Above the threshold of the null probability a question counts as unanswered."""
    return F.when(na_prob > threshold, (~has_ans).cast("double")).otherwise(score.cast("double"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """``best`` score in percent, its ``threshold``, and ``has_ans_mean``, the mean score of the
    answerable questions, from rows (qid, na_prob, has_ans, score, empty).

    Starting from the number of unanswerable questions, each question in the order of its null
    probability adds its score if answerable, takes one if a non-empty answer is wrong; equal probabilities
    are ordered by qid. Probabilities may be odds of any sign; a null one counts as zero, and one that isn't a number
    is the largest. Steps are added up by ranges of the probability first, so only rows of one range are ordered in
    one task.
    """
    scores = scores.withColumn("na_prob", F.when(F.isnan("na_prob"), float("inf")).otherwise(F.coalesce(F.col("na_prob").cast("double"), F.lit(0.0))))
    step = F.when(F.col("has_ans"), F.col("score").cast("double")).otherwise(F.when(F.col("empty"), 0.0).otherwise(-1.0))
    start = scores.agg(F.sum((~F.col("has_ans")).cast("bigint")).alias("base"), F.count("*").alias("n"))
    # order-preserving ranges of numbers of either sign, finer for small ones
    size = F.floor(F.log2(F.least(F.abs("na_prob"), F.lit(1e300)) + 2.0**-20) * 256).cast("int") + 20 * 256
    part = F.when(F.col("na_prob") < 0, -size - 1).otherwise(size)
    steps = scores.select("qid", "na_prob", "has_ans", F.col("score").cast("double").alias("score"), step.alias("step"), part.alias("part"))
    sums = steps.groupBy("part").agg(F.sum("step").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"))
    running = F.sum("step").over(Window.partitionBy("part").orderBy("na_prob", "qid").rowsBetween(Window.unboundedPreceding, 0))
    summed = steps.join(F.broadcast(before), "part").withColumn("gain", F.col("before") + running)
    top = summed.agg(F.max("gain").alias("gain"), F.max_by("na_prob", F.struct("gain", -F.col("na_prob"))).alias("at"))
    better = F.col("gain") > 0
    out = start.crossJoin(top).select((100.0 * (F.col("base") + F.when(better, F.col("gain")).otherwise(0.0)) / F.col("n")).alias("best"), F.when(better, F.col("at")).otherwise(0.0).alias("threshold"))
    return out.crossJoin(steps.agg(F.avg(F.when(F.col("has_ans"), F.col("score"))).alias("has_ans_mean")))


def first_hits(results: DataFrame) -> DataFrame:
    """``qid, found``: the place from 0 of the first passage with the answer, or one over their number.
    ``results``: qid, place, hit."""
    rows = results.groupBy("qid").agg(F.min(F.when(F.col("hit"), F.col("place"))).alias("first"), F.count("*").alias("n"), F.sum(F.when(F.col("hit") & (F.col("place") < 20), 1).otherwise(0)).alias("hits20"))
    return rows.select("qid", F.coalesce("first", F.col("n") + 1).alias("found"), "hits20")


def passage_metrics(results: DataFrame, ks: tuple[int, ...] = (1, 5, 20, 100), by: list[str] | None = None) -> DataFrame:
    """hit@k, MRR@20 and P@20 over all questions, or for each value of ``by`` (columns of ``results``)."""
    found = first_hits(results) if not by else first_hits(results).join(results.select("qid", *by).distinct(), "qid")
    cols = [F.avg((F.col("found") < k).cast("double")).alias(f"hit{k}") for k in ks]
    cols += [F.avg(F.when(F.col("found") < 20, 1.0 / (F.col("found") + 1)).otherwise(0.0)).alias("mrr20"), F.avg(F.col("hits20") / 20.0).alias("p20"), F.count("*").alias("n")]
    return found.groupBy(*(by or [])).agg(*cols)


def conditional_accuracy(results: DataFrame, first: int, last: int) -> Column:
    """The share of questions hit within ``first`` among those hit within ``last``; null without any."""
    found = first_hits(results)
    return found.agg(F.try_divide(F.sum((F.col("found") < first).cast("int")), F.sum((F.col("found") < last).cast("int"))).alias("accuracy"))


def r_precision(guess: Column, golds: Column) -> Column:
    """Over the gold sets the largest share of a set's R members among the first R guesses."""

    def one(gold):
        g = F.array_distinct(gold)
        return F.when(F.size(g) > 0, F.size(F.array_intersect(F.slice(F.array_distinct(guess), F.lit(1), F.greatest(F.size(g), F.lit(1))), g)) / F.size(g)).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(golds, one)), F.lit(0.0))


def ranks_of_sets(guess: list, golds: list) -> tuple[list[bool], int]:
    """Walk the guesses; a set of evidence counts where its last member is found."""
    sets, marks = [], []
    for g in golds:
        s = set(g)
        if s and s not in sets:
            sets.append(s)
    left, mark = [set(s) for s in sets], [None] * len(sets)
    for x in guess:
        hit = False
        for i, s in enumerate(left):
            if x in s:
                hit = True
                if mark[i] is not None:
                    marks[mark[i]] = None
                s.discard(x)
                mark[i] = len(marks)
                marks.append(not s)
        if not hit:
            marks.append(False)
    return [m for m in marks if m is not None], len(sets)


def set_recall(k: int):
    """Recall of evidence sets within ``k`` marks: the order of guesses matters, so it is a fold."""

    @F.pandas_udf(T.DoubleType())
    def recall(guess: pd.Series, golds: pd.Series) -> pd.Series:
        out = []
        for g, s in zip(guess, golds, strict=True):
            marks, n = ranks_of_sets(list(g), [list(x) for x in s])
            out.append(sum(marks[:k]) / n if n else 0.0)
        return pd.Series(out, dtype=float)

    return recall


def precision_at(guess: Column, golds: Column, k: int) -> Column:
    """Members of any gold set among the first ``k`` guesses, by ``k``."""
    return F.size(F.array_intersect(F.slice(F.array_distinct(guess), 1, k), F.array_distinct(F.flatten(golds)))) / F.lit(float(k))


def success_at(guess: Column, golds: Column, k: int) -> Column:
    return (precision_at(guess, golds, k) > 0).cast("double")


def composite_ids(records: Column, keys: list[str]) -> Column:
    """Trimmed keys joined by +, without records that miss one, distinct in order."""
    whole = F.filter(records, lambda r: F.forall(F.array(*(r[k] for k in keys)), lambda x: x.isNotNull()))
    return F.array_distinct(F.transform(whole, lambda r: F.concat_ws("+", *(F.btrim(r[k]) for k in keys))))


def aligned(gold: DataFrame, guess: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Gold rows with their guesses by trimmed id, and the number of gold rows without one."""
    g, s = gold.withColumn(key, F.btrim(key)), guess.withColumn(key, F.btrim(key))
    return g.join(s, key), g.join(s, key, "left_anti").agg(F.count("*").alias("missing"))


def gated(scores: DataFrame, rprec: str = "rprec", metrics: tuple[str, ...] = ("em", "f1")) -> DataFrame:
    """Means, and means that count only where all evidence was found."""
    plain = [F.avg(m).alias(m) for m in metrics]
    return scores.agg(*plain, *(F.avg(F.when(F.col(rprec) == 1, F.col(m)).otherwise(0.0)).alias(f"gated_{m}") for m in metrics), F.avg(rprec).alias(rprec))


def answer_scores(prediction: Column, gold: Column) -> Column:
    """Struct em, f1, precision, recall of normalised words; yes, no and noanswer count only as a whole."""
    p, g = X.normalize_answer(prediction), X.normalize_answer(gold)
    closed = (p.isin("yes", "no", "noanswer") | g.isin("yes", "no", "noanswer")) & (p != g)
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")

    def scores(a: Column, b: Column) -> Column:
        both = F.when(closed, 0).otherwise(X.overlap(a, b))
        share = lambda n: F.coalesce(F.try_divide(both, n), F.lit(0.0))
        return F.struct((p == g).cast("double").alias("em"), share((F.size(a) + F.size(b)) / 2).alias("f1"), share(F.size(a)).alias("precision"), share(F.size(b)).alias("recall"))

    return X.let(words(p), lambda a: X.let(words(g), lambda b: scores(a, b)))


def file_scores(golds: DataFrame, guesses: DataFrame, key: str = "id") -> DataFrame:
    """One row of means over all ``golds`` (id, answer, facts): ``em, f1, precision, recall`` of answers, ``sp_em, ...`` of supporting facts, and
    ``joint_em, ...`` of both together (products of precisions and of recalls), and how many are ``missing`` a guess.
    ``guesses``: id, answer, facts. A missing guess, answer or list scores 0."""
    g = golds.select(key, F.col("answer").alias("_a"), F.col("facts").alias("_s"))
    p = guesses.select(key, F.col("answer").alias("_b"), F.col("facts").alias("_t"), F.lit(True).alias("_found"))
    joined = g.join(p, key, "left")
    names = ["em", "f1", "precision", "recall"]
    zero = F.struct(*(F.lit(0.0).alias(n) for n in names))
    facts = support_scores(F.col("_t"), F.col("_s"))
    sets = F.struct((facts["f1"] == 1).cast("double").alias("em"), facts["f1"].alias("f1"), facts["precision"].alias("precision"), facts["recall"].alias("recall"))
    both = joined.select("_found", F.coalesce(F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), answer_scores(F.col("_b"), F.col("_a"))), zero).alias("x"), F.coalesce(F.when(F.col("_t").isNotNull() & F.col("_s").isNotNull(), sets), zero).alias("y"))
    precision, recall = F.col("x.precision") * F.col("y.precision"), F.col("x.recall") * F.col("y.recall")
    joint = {"em": F.col("x.em") * F.col("y.em"), "f1": F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), "precision": precision, "recall": recall}
    means = [F.avg(F.col(f"{side}.{n}")).alias(prefix + n) for side, prefix in (("x", ""), ("y", "sp_")) for n in names]
    return both.agg(*means, *(F.avg(joint[n]).alias(f"joint_{n}") for n in names), F.count_if(F.col("_found").isNull()).alias("missing"))


def provenance_report(golds: DataFrame, guesses: DataFrame, ks: tuple[int, ...] = (1, 5), key: str = "id") -> DataFrame:
    """One row for a whole run: means of ``em`` and ``f1`` (best over gold answers), the same where all evidence was found, R-precision, and for
    each of ``ks`` precision, recall and success, over all ``golds`` (id, answers, sets); ``missing`` guesses score 0. ``guesses``: id,
    answer, pages. Ids are trimmed."""
    g = golds.withColumn(key, F.btrim(key))
    joined = g.join(guesses.withColumn(key, F.btrim(key)).select(key, F.col("answer").alias("_p"), F.col("pages").alias("_q"), F.lit(True).alias("_found")), key, "left")
    pages = F.coalesce("_q", F.array().cast("array<string>"))
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    found = X.best_over(F.col("answers"), lambda a: X.exact_match(F.col("_p"), a).cast("double")), X.best_over(F.col("answers"), lambda a: X.f1_plain(F.col("_p"), a))
    cols = [one(found[0]).alias("em"), one(found[1]).alias("f1"), r_precision(F.col("_g"), F.col("sets")).alias("rprec")]
    for k in ks:
        cols += [precision_at(F.col("_g"), F.col("sets"), k).alias(f"p{k}"), set_recall(k)(F.col("_g"), F.col("sets")).alias(f"r{k}"), success_at(F.col("_g"), F.col("sets"), k).alias(f"s{k}")]
    per = joined.withColumn("_g", pages).select("_found", *cols)
    names = ["em", "f1", "rprec", *(f"{m}{k}" for k in ks for m in "prs")]
    whole = [F.avg(F.when(F.col("rprec") == 1, F.col(m)).otherwise(0.0)).alias(f"gated_{m}") for m in ("em", "f1")]
    return per.agg(*(F.avg(n).alias(n) for n in names), *whole, F.count_if(F.col("_found").isNull()).alias("missing"))


def support_scores(predicted: Column, gold: Column) -> Column:
    """Struct precision, recall, f1 of two sets."""
    both = F.size(F.array_intersect(predicted, gold))
    p = F.coalesce(F.try_divide(both, F.size(F.array_distinct(predicted))), F.lit(0.0))
    r = F.coalesce(F.try_divide(both, F.size(F.array_distinct(gold))), F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def padded(values: Column, k: int) -> Column:
    """A list cut to ``k``, or filled up by its last value."""
    cut = F.slice(values, 1, k)
    return F.when(F.size(cut) == 0, cut).otherwise(F.concat(cut, F.array_repeat(F.element_at(cut, -1), F.lit(k) - F.size(cut))))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def marked(text: Column, start: Column, end: Column, before: str = "<p_start> ", after: str = " <p_end>") -> Column:
    """A text with markers around ``[start, end)``."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit(before), F.substring(text, start + 1, end - start), F.lit(after), F.substring(text, end + 1, F.length(text)))


def chosen_answer(prediction: Column, title: Column, links_entities: bool) -> Column:
    """The answer that is handed in: a title where entities are linked, else the prediction without
    punctuation around it."""
    return title if links_entities else X.strip_punctuation(prediction)


def with_article_ids(rows: DataFrame, ids: DataFrame, title: str = "title") -> DataFrame:
    """Rows with the article id of their title; a title without one is an error. ``ids``: title, wikipedia_id."""
    joined = rows.join(ids, title, "left")
    return joined.withColumn("wikipedia_id", F.coalesce("wikipedia_id", F.raise_error(F.concat(F.lit("no article for "), F.col(title)))))


def by_group(scores: DataFrame, by: list[str], metrics_: list[str]) -> DataFrame:
    """Means and counts of metrics for each group (tags, numbers of pieces, relations)."""
    return scores.groupBy(*by).agg(*(F.avg(m).alias(m) for m in metrics_), F.count("*").alias("n"))


def matches(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs of rows ``doc_id, t`` and ``item_id, a`` where ``string_match`` holds, without a cross join: an
    answer meets only the documents that have its rarest word. One without tokens meets all. Repeated answers
    of an id count once."""
    words = lambda c: F.array_distinct(X.simple_tokens(F.lower(c)))
    posted = docs.select("doc_id", F.explode(words(F.col("t"))).alias("word"))
    asked = answers.where("a IS NOT NULL").select("item_id", "a", F.explode_outer(words(X.nfd(F.col("a")))).alias("word"))
    posted = posted.join(asked.select("word").distinct(), "word", "left_semi")
    counted = asked.join(posted.groupBy("word").agg(F.count("*").alias("df")), "word", "left")
    rarest = counted.groupBy("item_id", "a").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    pairs = posted.join(rarest.where("word IS NOT NULL"), "word").select(F.col("doc_id").alias("at"), "item_id", "a")
    # a repeated document id must not multiply the pairs: they are distinct, and each row of it is looked at
    found = docs.join(pairs.distinct(), F.col("doc_id").eqNullSafe(F.col("at"))).where(X.string_match(F.col("t"), F.col("a")))
    every = docs.crossJoin(F.broadcast(rarest.where("word IS NULL").select("item_id", "a")))
    return found.select("doc_id", "item_id", "a", "t").unionByName(every.select("doc_id", "item_id", "a", "t"))


def context_stats(results: DataFrame) -> DataFrame:
    """``length, titles`` of rows (qid, title, text): words of a passage and distinct titles of a question,
    each by question and then averaged over questions. A missing text has no words; a missing title counts as one."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"(?U)\S+")), F.lit(0))
    titles = F.count_distinct("title") + F.max(F.col("title").isNull().cast("int"))
    per = results.groupBy("qid").agg(F.avg(words).alias("length"), titles.alias("titles"))
    return per.agg(F.avg("length").alias("length"), F.avg("titles").alias("titles"))


def save_rate(rows: DataFrame) -> DataFrame:
    """``save_rate, answer_recall`` of one row for each question (answers, candidates, saved, total): vectors
    saved by all there were, and the share of questions with an answer, in lower case, among the candidates."""
    found = F.coalesce(F.arrays_overlap(F.transform("answers", lambda a: F.lower(a)), "candidates"), F.lit(False))
    return rows.agg((F.sum("saved") / F.sum("total")).alias("save_rate"), F.avg(found.cast("double")).alias("answer_recall"))
