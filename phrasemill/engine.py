"""The engine as one object: an encoder, phrase tables, search and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import index, metrics, mips, search
from .options import EvaluationOptions, SearchOptions

#: An encoder turns (qid, question) into (qid, q_start, q_end); stored vectors or a model in an Arrow function.
Encoder = Callable[[DataFrame], DataFrame]


class PhraseEngine:
    """Searches phrases (doc_idx, idx, f2o, vec) of documents (doc_idx, title, context)."""

    def __init__(self, phrases: DataFrame, docs: DataFrame, encoder: Encoder, centroids: DataFrame | None = None):
        self.phrases, self.docs, self.encoder, self.centroids = phrases, docs, encoder, centroids
        self.postings = None
        if centroids is not None:
            self.postings = index.assign(phrases.select(self._id().alias("id"), "vec"), centroids)

    def _id(self):
        # documents and places in one number: 2^20 kept tokens a document
        return F.shiftleft(F.col("doc_idx"), 20) + F.col("idx")

    def set_encoder(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def _hits(self, encoded: DataFrame, o: SearchOptions) -> tuple[DataFrame, DataFrame]:
        if self.postings is None:
            rows, find = self.phrases.select(self._id().alias("id"), "vec"), mips.exact_top_k
        else:
            rows = self.postings

            def find(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
                return mips.pruned_top_k(postings, self.centroids, queries, k, o.probes)

        place = lambda t: t.select("qid", "rank", F.shiftright("id", 20).alias("doc_idx"), F.col("id").bitwiseAND(F.lit((1 << 20) - 1)).alias("idx"), "score", "other")
        return tuple(map(place, search.both_hits(rows, encoded, o.fetch, find)))

    def spans(self, questions: DataFrame, options: SearchOptions = SearchOptions(), vectors: bool = False) -> DataFrame:
        """The spans found, with their texts, and with the vectors of both ends if asked for."""
        found = search.search_spans(*self._hits(self.encoder(questions), options), self.phrases, options.max_answer_length)
        texts = search.with_texts(found, self.docs)
        return search.with_vectors(texts, self.phrases) if vectors else texts

    def search(self, questions: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
        """qid, place, found, score: the unit's texts of each question."""
        return search.retrieve(self.spans(questions, options), options.unit, options.top_k)

    def evaluate(self, questions: DataFrame, search_options: SearchOptions = SearchOptions(), options: EvaluationOptions = EvaluationOptions(), candidates: DataFrame | None = None) -> DataFrame:
        """Metrics of the questions' (qid, question, golds) answers."""
        found = self.search(questions, search_options).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "found"))), lambda s: s["found"]).alias("predictions"))
        joined = questions.select("qid", "golds").join(found, "qid", "left").withColumn("predictions", F.coalesce("predictions", F.array(F.lit(""))))
        if options.restricted and candidates is not None:
            rows = joined.select("qid", "golds", F.posexplode("predictions").alias("at", "p"))
            either = candidates.select("candidate").distinct()
            # two equi-joins rather than one on either condition
            own = rows.join(either.withColumnRenamed("candidate", "p"), "p", "left_semi").select("qid", "at", "p")
            low = rows.withColumn("candidate", F.lower("p")).join(either, "candidate", "left_semi").select("qid", "at", "p")
            kept = own.unionByName(low).distinct()
            lists = kept.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda s: s["p"]).alias("_k"))
            joined = joined.join(lists, "qid", "left").withColumn("predictions", F.coalesce("_k", F.array(F.lit("")))).drop("_k")
        metric = X.exact_match
        if options.match == "regex":
            metric = X.regex_match_each
        return metrics.answer_metrics(joined, options.top_k, metric)

    def evaluate_all(self, datasets: dict[str, DataFrame], search_options: SearchOptions = SearchOptions(), candidates: dict[str, DataFrame] | None = None, top_k: int = 10) -> DataFrame:
        """``dataset`` and its metrics, each set of questions evaluated by the rules of its name (how answers match, whether candidates restrict
        them)."""
        found = []
        for name, questions in datasets.items():
            options = EvaluationOptions(dataset=name, top_k=top_k)
            found.append(self.evaluate(questions, search_options, options, (candidates or {}).get(name)).select(F.lit(name).alias("dataset"), "*"))
        return reduce(DataFrame.unionByName, found)

    def run(self, mode: str, questions: DataFrame | dict[str, DataFrame], **options) -> DataFrame:
        """One of the modes by its name: ``query`` (texts), ``spans`` (with vectors, to train on), ``eval``, ``eval_all``."""
        modes = {"query": self.search, "spans": lambda q, **o: self.spans(q, vectors=True, **o), "eval": self.evaluate, "eval_all": self.evaluate_all}
        if mode not in modes:
            raise ValueError(f"mode must be one of {sorted(modes)}")
        return modes[mode](questions, **options)
