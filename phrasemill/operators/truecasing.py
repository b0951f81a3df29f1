"""Restoring the casing of texts from tables of counts, of any size.

Every token can be written in the casings in which the corpus has it. A casing's score is the sum of four smoothed
log shares among the token's casings: alone, after the token before, before the next token, and between both. The token
before is taken as it was decided, so tokens are decided from left to right; the scores for all casings that it may
have are looked up by joins first, whose keys are words, pairs and triples, and a small fold over each text decides.
No table of counts is collected: Spark broadcasts one only if it is small. Where texts are counted for some rows only,
the keys that these rows ask for go to the texts instead.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..shared import materialised

#: What every count is raised by. A fixed value that results depend on.
PSEUDO = 5.0
#: Keys of the tables of counts.
KEYS = {"words": ["word"], "before": ["prev", "word"], "after": ["word", "next"], "around": ["prev", "word", "next"]}
#: Up to so many keys are broadcast to the texts.
BROADCAST_KEYS = 500_000


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def _places(texts: DataFrame, text_col: str) -> DataFrame:
    """Every token of the texts: word, prev, next (in lower case)."""
    rows = texts.select(tokens_of(F.col(text_col)).alias("w"))
    shifted = F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit(None).cast("string")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("prev"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next"))
    return rows.select(F.explode(shifted).alias("t")).select("t.word", "t.prev", F.lower("t.next").alias("next")).where("word IS NOT NULL")


def _counted(places: DataFrame, name: str) -> DataFrame:
    return places.where(" AND ".join(f"{x} IS NOT NULL" for x in KEYS[name])).groupBy(*KEYS[name]).agg(F.count("*").alias("n"))


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key, or lower-case word (``low``), is one of ``keys``."""
    rows = rows.withColumn("low", F.lower("word")) if "low" in keys.columns else rows
    return rows.join(keys, keys.columns, "left_semi").drop("low")


def counts(texts: DataFrame, text_col: str = "text") -> dict[str, DataFrame]:
    """Tables of all texts: ``words`` (word, n), ``before`` (word and the one before it: prev, word, n), ``after`` (word and the
    next in lower case: word, next, n), ``around`` (prev, word, next, n)."""
    places = _places(texts, text_col)
    return {name: _counted(places, name) for name in KEYS}


def counts_asked(texts: DataFrame, text_col: str = "text") -> Callable[[str, DataFrame], DataFrame]:
    """The tables of ``counts`` for ``truecased``, which asks for some keys of each: all texts are read, but only tokens that
    are among the keys are counted, so that what is shuffled grows with the keys and not with the texts. More keys than
    ``BROADCAST_KEYS`` are looked up in the whole table of counts."""
    places = _places(texts, text_col)

    def asked(name: str, keys: DataFrame) -> DataFrame:
        if keys.count() > BROADCAST_KEYS:
            return _among(_counted(places, name), keys)
        return _counted(_among(places, F.broadcast(keys)), name)

    return asked


@F.pandas_udf(T.StringType())
def titled(words: pd.Series) -> pd.Series:
    return words.str.title()


def _first_upper(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def _shares(value: str, entries: Column) -> Column:
    """The entries' logs of smoothed shares of a count."""
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e[value] + PSEUDO)
    return F.transform(entries, lambda e: F.log((e[value] + PSEUDO) / total))


def truecased(rows: DataFrame, tables: dict[str, DataFrame] | Callable[[str, DataFrame], DataFrame], id_col: str = "id", text_col: str = "text", unknown: str = "title") -> DataFrame:
    """``id_col`` and ``cased`` for every row. ``tables`` as of ``counts`` or ``counts_asked``; ties go to the first casing in the order of characters.

    Tokens without any known casing are written as ``unknown`` says: title, lower or as-is; digits and marks stay, and
    the first known token gets a capital. Tokens are joined by spaces but before marks and ``'``. Null stays null, rows
    may be repeated."""
    key = F.monotonically_increasing_id()
    base = materialised(rows.select(key.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "texts")
    tok = base.where("text IS NOT NULL").select("row", F.posexplode(tokens_of(F.col("text"))).alias("i", "token")).withColumn("low", F.lower("token"))
    asked = tables if callable(tables) else lambda name, keys: _among(tables[name], keys) if name == "words" else tables[name]
    wanted = materialised(tok.select("low").distinct(), "words")
    casings = asked("words", wanted).withColumn("low", F.lower("word"))
    # as many entries as a word has casings
    casings = casings.groupBy("low").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("known"))
    marks = F.contains(F.lit(string.punctuation), F.col("token")) | F.col("token").rlike(r"^\p{Nd}+$")
    tok = tok.join(casings, "low", "left").withColumn("known", F.when(~marks, F.col("known")))
    other = {"title": titled(F.col("low")), "lower": F.col("low"), "as-is": F.col("token")}[unknown]
    alone = F.when(marks, F.col("token")).when(F.col("known").isNull(), other).when(F.size("known") == 1, F.col("known")[0]["word"])
    head = (F.col("i") == 0) & F.col("known").isNotNull()
    tok = tok.withColumn("fixed", F.when(head, _first_upper(alone)).otherwise(alone))
    shown = F.when(F.col("fixed").isNotNull(), F.array("fixed")).otherwise(F.transform("known", lambda k: F.when(F.col("i") == 0, _first_upper(k["word"])).otherwise(k["word"])))
    order = Window.partitionBy("row").orderBy("i")
    tok = tok.withColumn("options", shown).withColumns({"prevs": F.lag("options").over(order), "next": F.lead("low").over(order)})
    tok = materialised(tok.select("row", "i", "fixed", "known", "prevs", "next"), "tokens")

    open_ = tok.where("fixed IS NULL").withColumn("prev", F.explode_outer(F.array_distinct("prevs"))).select("row", "i", "prev", "next", F.explode("known").alias("k")).select("row", "i", "prev", "next", "k.word", "k.n")
    open_ = open_keys = materialised(open_, "open")
    n = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    for name in ("before", "after", "around"):
        keys = materialised(open_keys.select(*KEYS[name]).dropna().distinct(), "keys") if callable(tables) else open_keys
        open_ = open_.join(asked(name, keys).withColumnRenamed("n", name), KEYS[name], "left")
    entries = F.array_sort(F.collect_list(F.struct("word", "n", n("before"), n("after"), n("around"))))
    per = open_.groupBy("row", "i", "prev", "next").agg(entries.alias("e"))
    zero = F.transform("e", lambda e: F.lit(0.0))
    has_prev, has_next = F.col("prev").isNotNull(), F.col("next").isNotNull()
    parts = [_shares("n", F.col("e")), F.when(has_prev, _shares("before", F.col("e"))).otherwise(zero), F.when(has_next, _shares("after", F.col("e"))).otherwise(zero), F.when(has_prev & has_next, _shares("around", F.col("e"))).otherwise(zero)]
    scores = parts[0]
    for p in parts[1:]:
        scores = F.zip_with(scores, p, lambda a, b: a + b)
    # entries are in order of their words: the first of the best is the least
    best = F.element_at("e", F.array_position("scores", F.array_max("scores")).cast("int"))["word"]
    chosen = per.withColumn("scores", scores).select("row", "i", "prev", best.alias("word"))
    chosen = chosen.withColumn("word", F.when(F.col("i") == 0, _first_upper(F.col("word"))).otherwise(F.col("word")))
    choices = chosen.groupBy("row", "i").agg(F.collect_list(F.struct("prev", "word")).alias("choices"))
    placed = tok.select("row", "i", "fixed").join(choices, ["row", "i"], "left")
    texts = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "fixed", "choices"))).alias("t"))

    def run(batches):
        for b in batches:
            out = []
            for text in b.column("t").to_pylist():
                words, last = [], None
                for t in text:
                    last = t["fixed"] if t["choices"] is None else next(c["word"] for c in t["choices"] if c["prev"] == last)
                    words.append(last if last.startswith("'") or last in string.punctuation else " " + last)
                out.append("".join(words).strip())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], ["row", "cased"])

    done = texts.mapInArrow(run, "row bigint, cased string")
    cased = F.when(F.col("text").isNotNull(), F.coalesce("cased", F.lit("")))
    return base.join(done, "row", "left").select(F.col("id").alias(id_col), cased.alias("cased"))


def stored_counts(spark, path: str) -> dict[str, DataFrame]:
    """Tables as of ``counts`` from a pickled dictionary of counters (``uni_dist``, ``backward_bi_dist``, ``forward_bi_dist``,
    ``trigram_dist``, whose keys are words joined by ``_``). Nothing but dictionaries, counters and sets is unpickled.

    Keys are cut at the only place where a word of ``word_casing_lookup`` is; words that hold ``_`` themselves are left out."""
    import io
    import pickle
    from collections import Counter, defaultdict

    class Plain(pickle.Unpickler):
        def find_class(self, module, name):
            if (module, name) == ("collections", "Counter") or name in ("FreqDist", "ConditionalFreqDist"):
                return Counter
            if (module, name) == ("collections", "defaultdict"):
                return defaultdict
            if module == "builtins" and name in ("set", "dict", "list", "int", "str", "frozenset"):
                return getattr(__import__("builtins"), name)
            raise pickle.UnpicklingError(f"{module}.{name}")

    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    found = Plain(io.BytesIO(bytes(data))).load()

    def table(counter, names):
        rows = [(*parts, int(n)) for key, n in counter.items() if len(parts := key.split("_")) == len(names)]
        kinds = [*((x, pa.string()) for x in names), ("n", pa.int64())]
        return spark.createDataFrame(pa.table({x: pa.array([r[i] for r in rows], t) for i, (x, t) in enumerate(kinds)}))

    return {
        "words": table(found["uni_dist"], ["word"]), "before": table(found["backward_bi_dist"], ["prev", "word"]),
        "after": table(found["forward_bi_dist"], ["word", "next"]), "around": table(found["trigram_dist"], ["prev", "word", "next"]),
    }
