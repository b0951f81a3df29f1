"""Corpus preparation: paragraphs, packing, windows, n-gram statistics, filters, matching to articles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..shared import materialised

#: Words that carry no topic, for n-gram filters.
STOPWORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren
couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn 'll 're 've n't 's 'd 'm '' ``
""".split())


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_idx, par_idx, text``: trimmed pieces between line ends that aren't empty."""
    pieces = F.filter(F.transform(F.split(text_col, "\n+"), lambda p: F.btrim(p)), lambda p: p != "")
    return docs.select(F.col(id_col).alias("doc_idx"), F.posexplode(pieces).alias("par_idx", "text"))


def contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "source") -> DataFrame:
    """``doc_idx, title, context``: a document's paragraphs joined by the delimiter."""
    pieces = F.filter(F.transform(F.split(text_col, "\n+"), lambda p: F.btrim(p)), lambda p: p != "")
    return docs.select(F.col(id_col).alias("doc_idx"), F.col(title_col).alias("title"), F.array_join(pieces, X.PARAGRAPH).alias("context"))


def length_between(text: Column, low: int, high: int, open_end: bool = False) -> Column:
    n = F.length(text)
    return (n >= low) & ((n < high) if open_end else (n <= high))


def pack_paragraphs(docs: DataFrame, minimum: int = 500, pieces: str = "pieces") -> DataFrame:
    """Paragraph arrays packed greedily: a pack is closed once it has ``minimum`` characters; what is left
    at the end joins the last pack, or is one if there is none. Packs begin with a space."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def add(s, p):
        buf = F.concat(s["buf"], F.lit(" "), p)
        full = F.length(buf) >= minimum
        return F.struct(F.when(full, F.concat(s["out"], F.array(buf))).otherwise(s["out"]).alias("out"), F.when(full, F.lit("")).otherwise(buf).alias("buf"))

    def end(s):
        n = F.size(s["out"])
        joined = F.concat(F.slice(s["out"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(s["out"], -1), F.lit(" "), s["buf"])))
        return F.when(s["buf"] == "", s["out"]).when(n > 0, joined).otherwise(F.array(s["buf"]))

    return docs.withColumn("packs", F.aggregate(pieces, zero, add, end))


def windows(docs: DataFrame, length: int, stride: int, tokens: str = "tokens", id_col: str = "doc_idx") -> DataFrame:
    """Windows of ``length`` tokens every ``stride`` tokens; the last one reaches the end."""
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - length) / stride).cast("int"))
    rows = docs.where(n > 0).select(id_col, tokens, F.explode(F.sequence(F.lit(0), last)).alias("span_idx"))
    start = F.col("span_idx") * stride
    return rows.select(id_col, "span_idx", start.alias("start"), F.slice(tokens, start + 1, F.lit(length)).alias("tokens"))


def max_context(spans: DataFrame, id_col: str = "doc_idx", block: int = 128) -> DataFrame:
    """For every token of windows the one that gives it the most context on its poorer side, plus a
    hundredth of the window's length; the first of equals. ``spans``: id, span_idx, start, length.

    Tokens are decided ``block`` by ``block`` of a document, each from the windows that reach it: windows are all that
    is shuffled, tokens never. Contexts are counted in hundredths and put into one number with the window, of which
    there are fewer than 2^24 in a document, so that the best of a token is a plain maximum."""
    end = F.col("start") + F.col("length") - 1
    reached = F.sequence(F.floor(F.col("start") / block), F.floor(end / block))
    rows = spans.where("length > 0").select(id_col, F.struct("span_idx", "start", end.alias("end")).alias("w"), F.explode(reached).alias("block"))
    # a set: repeated ids bring equal windows
    per = rows.groupBy(id_col, "block").agg(F.collect_set("w").alias("ws"))
    size = 1 << 24

    def value(token, w):
        left, right = token - w["start"], w["end"] - token
        return F.when((left >= 0) & (right >= 0), (100 * F.least(left, right) + left + right + 1) * size + (size - 1 - w["span_idx"]))

    of_block = F.sequence(F.col("block") * block, F.col("block") * block + block - 1)
    best = F.transform(of_block, lambda t: F.struct(t.alias("token"), F.array_max(F.transform("ws", lambda w: value(t, w))).alias("best")))
    kinds = spans.select("span_idx", end.alias("token")).schema
    found = per.select(id_col, F.inline(best)).where("best IS NOT NULL")
    return found.select(id_col, F.col("token").cast(kinds["token"].dataType).alias("token"), (size - 1 - F.pmod("best", F.lit(size))).cast(kinds["span_idx"].dataType).alias("span_idx"))


def is_dull(word: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Whether a word is a stop word or all punctuation."""
    return F.lower(word).isin(*stopwords) | word.rlike("^\\p{P}+$")


def term_counts(docs: DataFrame, longest: int = 2, mode: str | None = "any", buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """``doc``, ``term``, ``tf``: n-grams of each document, hashed into buckets on request. An n-gram is left
    out if ``any``, ``all`` or one of the ``ends`` of its words are stop words or punctuation.

    Documents are dealt out and sorted by their id: texts are all that is shuffled. Their n-grams are counted some documents at a time,
    as numbers of words; what is left of them is decided for each n-gram of a document once."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).repartition("doc").sortWithinPartitions("doc")
    words = [f"w{k}" for k in range(longest)]
    rows = rows.select("doc", X.simple_tokens(F.lower("text")).alias("w")).where(F.size("w") > 0)
    schema = rows.select("doc", *(F.lit(None).cast("string").alias(w) for w in words), F.lit(None).cast("bigint").alias("tf")).schema

    def run(batches):
        for doc, tokens in _whole_documents(batches):
            owner, text = doc.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(doc)), np.diff(tokens.offsets.to_numpy()))
            found = tokens.flatten().dictionary_encode()
            code, names = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            gram = np.zeros(len(code), np.int64)
            for n in range(1, longest + 1):
                # n-grams of one text that begin at each place, as dense numbers
                at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
                if not len(at):
                    break
                dense = gram[at] * len(names) + code[at + n - 1]
                dense = np.unique(dense, return_inverse=True)[1]
                gram = np.zeros(len(code), np.int64)
                gram[at] = dense
                mine = owner[text[at]]
                _, place, tf = np.unique(mine * (dense.max() + 1) + dense, return_index=True, return_counts=True)
                for low in range(0, len(place), 1 << 16):
                    some = place[low : low + (1 << 16)]
                    begin = at[some]
                    out = [names.take(pa.array(code[begin + k])) if k < n else pa.nulls(len(begin), pa.string()) for k in range(longest)]
                    yield pa.RecordBatch.from_arrays([doc.take(pa.array(first[mine[some]])), *(x.cast(pa.string()) for x in out), pa.array(tf[low : low + (1 << 16)])], schema.names)

    rows = rows.mapInArrow(run, schema)
    rows = rows.select("doc", "tf", *words, *(is_dull(F.col(w), stopwords).alias(f"d{k}") for k, w in enumerate(words)))
    term = F.lit(None).cast("string")
    for n in range(1, longest + 1):
        dull = [F.col(f"d{k}") for k in range(n)]
        out = {"any": reduce(lambda x, y: x | y, dull), "all": reduce(lambda x, y: x & y, dull), "ends": dull[0] | dull[-1], None: F.lit(False)}[mode]
        term = F.when(F.col(f"w{n - 1}").isNull(), term).otherwise(F.when(~out, F.concat_ws(" ", *words[:n])))
    rows = rows.select("doc", term.alias("term"), "tf").where("term IS NOT NULL")
    if buckets:
        rows = rows.withColumn("term", X.feature_hash(F.col("term"), F.lit(buckets))).groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
    return rows


#: Tokens whose n-grams are counted at once; a longer document is counted as a whole.
TOKENS = 1 << 18


def _whole_documents(batches):
    """Ids and tokens of some whole documents at a time, from batches (doc, w) in order of documents."""
    held, size = [], 0
    for whole in batches:
        ends, at = whole.column("w").offsets.to_numpy(), 0
        while at < whole.num_rows:
            to = min(whole.num_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1))
            held.append(whole.slice(at, to - at))
            size += ends[to] - ends[at]
            at = to
            if size >= TOKENS:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                doc = rows.column("doc")
                # rows of the last document may go on in the next batch
                cut = rows.num_rows - 1
                while cut and doc[cut - 1].as_py() == doc[cut].as_py():
                    cut -= 1
                if cut:
                    yield doc.slice(0, cut), _lists(rows.column("w").slice(0, cut))
                held = [rows.slice(cut)]
                size = len(rows.column("w").slice(cut).flatten())
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield rows.column("doc"), _lists(rows.column("w"))


def _lists(tokens: pa.Array) -> pa.Array:
    """Lists whose offsets begin at 0."""
    offsets = tokens.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), tokens.flatten())


def document_counts(terms: DataFrame) -> DataFrame:
    """``term``, ``df``, from the distinct rows of ``term_counts``."""
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``ln(tf + 1) * max(0, ln((N - df + .5) / (df + .5)))``; ``n_docs``: one row ``n``. Counts are written once and read twice."""
    terms = materialised(terms, "terms")
    joined = terms.join(document_counts(terms), "term").crossJoin(F.broadcast(n_docs))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return joined.select("doc", "term", (F.log1p("tf") * F.greatest(F.lit(0.0), idf)).alias("weight"))


def article_filter(title: Column, text: Column, id_: Column | None = None, blocked: tuple[str, ...] = ()) -> Column:
    """Articles that are neither blocked, nor disambiguations, nor lists, indexes or outlines."""
    ok = ~F.contains(F.lower(title), F.lit("disambiguation")) & ~title.rlike("^(List of .+|Index of .+|Outline of .+)")
    if id_ is not None and blocked:
        ok &= ~id_.isin(*blocked)
    return ok & text.isNotNull()


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def article_or_own(docs: DataFrame, articles: DataFrame, title: str = "title", own: str = "paragraphs") -> DataFrame:
    """A document's paragraphs from the article of its title, or its own without one."""
    found = articles.select(F.col(title), F.col("paragraphs").alias("_p"), F.lit(True).alias("_found"))
    return docs.join(found, title, "left").withColumn("paragraphs", F.coalesce("_p", own)).withColumn("matched", F.coalesce("_found", F.lit(False))).drop("_p", "_found")


def _squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(F.replace(text, F.lit("''"), F.lit('"')), F.lit("``"), F.lit('"')), r"\s+", ""))


def locate_in_article(questions: DataFrame, articles: DataFrame, around: int = 10) -> DataFrame:
    """The first paragraph of the article of the same title that holds the answer with its neighbourhood.

    ``questions``: qid, title, context, answer, answer_start; ``articles``: title, par_idx, text. Compared
    without white space and case: the answer with ``around`` characters on both sides, then on the left
    only, then on the right only. Without any the own context stays, ``wiki_matched`` is false.
    """
    s, n = F.col("answer_start"), F.length("answer")
    a = _squeezed(F.col("answer"))
    left = F.right(_squeezed(F.substring("context", F.lit(1), s)), F.lit(around))
    right = F.left(_squeezed(F.substring("context", s + n + 1, F.length("context"))), F.lit(around))
    q = questions.select("*", F.concat(left, a, right).alias("_k1"), F.concat(left, a).alias("_k2"), F.concat(a, right).alias("_k3"))
    squeezed = articles.select("title", "par_idx", F.col("text").alias("wiki_text"), _squeezed(F.col("text")).alias("_t"))
    level = F.when(F.contains("_t", "_k1"), 1).when(F.contains("_t", "_k2"), 2).when(F.contains("_t", "_k3"), 3)
    hits = q.join(squeezed, "title").withColumn("_l", level).where("_l IS NOT NULL")
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("_l", "par_idx"))).where("_n = 1")
    found = first.select("qid", "par_idx", "wiki_text")
    joined = questions.join(found, "qid", "left")
    return joined.withColumn("wiki_matched", F.col("wiki_text").isNotNull()).withColumn("context", F.coalesce("wiki_text", "context")).drop("wiki_text")


def span_vote(annotations: DataFrame, minimum: int = 2) -> DataFrame:
    """For every question its most frequent span among at least ``minimum`` annotations, the earliest of
    equals. ``annotations``: qid, at, start, end."""
    counts = annotations.where("start >= 0").groupBy("qid", "start", "end").agg(F.count("*").alias("votes"), F.min("at").alias("first"))
    per = Window.partitionBy("qid")
    ranked = counts.withColumn("_all", F.sum("votes").over(per)).withColumn("_n", F.row_number().over(per.orderBy(F.col("votes").desc(), "first")))
    return ranked.where((F.col("_n") == 1) & (F.col("_all") >= minimum)).select("qid", "start", "end", "votes")


def consecutive_groups(rows: DataFrame, by: str, order: str, tag: str) -> DataFrame:
    """Runs of rows with the same tag: ``by``, tag, first and last place, size."""
    per = Window.partitionBy(by).orderBy(order)
    island = F.row_number().over(per) - F.row_number().over(Window.partitionBy(by, tag).orderBy(order))
    runs = rows.withColumn("_g", island).groupBy(by, tag, "_g")
    return runs.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_g")


def contained(candidate_start: Column, candidate_end: Column, spans: Column) -> Column:
    """Whether a candidate interval holds one of the spans (structs start, end)."""
    return F.exists(spans, lambda s: (candidate_start <= s["start"]) & (candidate_end >= s["end"]))


def answers_at(contexts_: DataFrame) -> DataFrame:
    """Rows whose answer stands at its place in the context."""
    return contexts_.where(F.substring("context", F.col("answer_start") + 1, F.length("answer")) == F.col("answer"))


def without_unanswerable(qas: Column) -> Column:
    """Nested questions that have an answer."""
    return F.filter(qas, lambda q: F.size(q["answers"]) > 0)


def has_long(annotations: Column) -> Column:
    """Whether an annotation of a question has a long answer (``long_answer.start_byte`` from 0)."""
    return F.coalesce(F.exists(annotations, lambda a: F.coalesce(a["long_answer"]["start_byte"] >= 0, F.lit(False))), F.lit(False))


def has_short(annotations: Column) -> Column:
    """Whether an annotation of a question has short answers."""
    return F.coalesce(F.exists(annotations, lambda a: F.coalesce(F.size(a["short_answers"]) > 0, F.lit(False))), F.lit(False))


def short_answers(spans: Column, longest: int = 5) -> Column:
    """Answers (structs start_token, end_token) of at most ``longest`` tokens."""
    return F.filter(spans, lambda s: s["end_token"] - s["start_token"] <= longest)


def is_paragraph(contents: Column) -> Column:
    """Whether a candidate is a paragraph, not a table or list."""
    return F.startswith(contents, F.lit("<P>"))
