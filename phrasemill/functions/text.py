"""Text functions as Column expressions; Arrow functions only where no built-in expression exists."""

from __future__ import annotations

import html
import math
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII punctuation, and the paragraph delimiter of joined contexts.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PARAGRAPH = " [PAR] "
#: Letters, digits and marks together, any other visible character alone.
TOKEN = "([\\p{L}\\p{N}\\p{M}]+)|([^\\p{Z}\\p{C}])"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used (also inside lambdas)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def normalize_light(text: Column) -> Column:
    """Lower case without ASCII punctuation, nothing else."""
    return F.translate(F.lower(text), PUNCTUATION, "")


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda w: w != "")


def exact_match(prediction: Column, truth: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(truth)).cast("int")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    times = lambda tokens, w: F.size(F.filter(tokens, lambda t: t == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))


def _with_tokens(prediction: Column, truth: Column, use) -> Column:
    return let(answer_tokens(prediction), lambda a: let(answer_tokens(truth), lambda b: use(a, b)))


def _f1(a: Column, b: Column) -> Column:
    """2 * overlap / (sizes), 0 without overlap: the same as the harmonic mean of precision and recall."""
    return F.when((F.size(a) + F.size(b)) > 0, 2.0 * overlap(a, b) / (F.size(a) + F.size(b))).otherwise(0.0)


def f1_open(prediction: Column, truth: Column) -> Column:
    """Token F1; yes, no and noanswer count only as a whole."""
    p, t = normalize_answer(prediction), normalize_answer(truth)
    closed = p.isin("yes", "no", "noanswer") | t.isin("yes", "no", "noanswer")
    return F.when(closed & (p != t), 0.0).otherwise(_with_tokens(prediction, truth, _f1))


def f1_reading(prediction: Column, truth: Column) -> Column:
    """Token F1 where an empty side is right only against an empty side."""
    either = lambda a, b: F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(_f1(a, b))
    return _with_tokens(prediction, truth, either)


def f1_plain(prediction: Column, truth: Column) -> Column:
    """Token F1 without special cases."""
    return _with_tokens(prediction, truth, _f1)


def best_over(golds: Column, metric) -> Column:
    """The largest value of a metric over all gold answers; 0 without any."""
    return F.coalesce(F.array_max(F.transform(golds, metric)), F.lit(0.0))


def simple_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def spaced(tokens: Column) -> Column:
    """Tokens as one string in which every token stands between spaces."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def string_match(text: Column, answer: Column) -> Column:
    """Whether the answer's tokens stand in a row in the text, in lower case; an answer without tokens does."""
    found = F.contains(spaced(simple_tokens(F.lower(text))), spaced(simple_tokens(F.lower(nfd(answer)))))
    return (F.size(simple_tokens(answer)) == 0) | found


def regex_search(text: Column, pattern: str) -> Column:
    return text.rlike("(?im)" + pattern)


def regex_match(text: Column, pattern: str) -> Column:
    """Anchored at the beginning of the text."""
    return text.rlike("(?im)\\A(?:" + pattern + ")")


@F.pandas_udf(T.BooleanType())
def regex_match_each(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """A pattern for every row, anchored at the beginning; a pattern that doesn't compile matches nothing."""
    import regex

    compiled = {}
    for p in pattern.unique():
        try:
            compiled[p] = regex.compile(p, flags=regex.IGNORECASE | regex.UNICODE | regex.MULTILINE)
        except (regex.error, TypeError):
            compiled[p] = None

    def one(t, p):
        return isinstance(t, str) and compiled[p] is not None and bool(compiled[p].match(t))

    return pd.Series([one(t, p) for t, p in zip(text, pattern, strict=True)], dtype=bool)


@F.pandas_udf(T.StringType())
def nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFD", t) if isinstance(t, str) else None)


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words; 0 for an empty prediction."""

    def one(p, t):
        a, b = (p or "").split(), (t or "").split()
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        n = row[-1]
        return 2.0 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([one(p, t) for p, t in zip(prediction, truth, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def bleu(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    """BLEU of words with as many n-gram orders (4 at most) as the shorter side has words, brevity penalty."""

    def one(p, t):
        from collections import Counter

        a, b = (p or "").split(), (t or "").split()
        order = min(4, len(a), len(b))
        if not order:
            return 0.0
        logs = 0.0
        for n in range(1, order + 1):
            x, y = (Counter(zip(*(w[i:] for i in range(n)), strict=False)) for w in (a, b))
            hit = sum((x & y).values())
            if not hit:
                return 0.0
            logs += math.log(hit / sum(x.values())) / order
        return math.exp(logs + min(0.0, 1 - len(b) / len(a)))

    return pd.Series([one(p, t) for p, t in zip(prediction, truth, strict=True)], dtype=float)


def strip_question(question: Column) -> Column:
    """Without one trailing question mark."""
    return F.regexp_replace(question, r"\?$", "")


def entity_window(text: Column, width: int = 300, start: str = "[START_ENT]", end: str = "[END_ENT]") -> Column:
    """From ``width`` characters before the start marker to ``width`` after the beginning of the end marker."""
    a, b = F.instr(text, start) - 1, F.instr(text, end) - 1
    begin = F.greatest(a - width, F.lit(0))
    return F.when((a >= 0) & (b >= 0), F.substring(text, begin + 1, b + width - begin)).otherwise(text)


def prefixed_id(id_: Column, origin: Column) -> Column:
    """The id behind the stem of its origin, where there is one."""
    return F.when(origin.isNotNull(), F.concat(F.split(origin, r"\.")[0], F.lit("-"), id_)).otherwise(id_)


def plain_title(title: Column) -> Column:
    return F.translate(F.btrim(title), "_", " ")


def plain_spaces(text: Column) -> Column:
    """No-break spaces as spaces."""
    return F.replace(text, F.lit("\u00a0"), F.lit(" "))


def whitespace_tokens(text: Column) -> Column:
    """Split at space, tab, line ends and the narrow no-break space only."""
    return F.filter(F.split(text, "[ \\t\\r\\n\u202f]+"), lambda w: w != "")


def strip_punctuation(text: Column) -> Column:
    return F.btrim(text, F.lit(PUNCTUATION))


def ngrams(tokens: Column, longest: int) -> Column:
    """All n-grams of 1 to ``longest`` tokens, joined by spaces, by their place and then length."""

    def all_of(t: Column) -> Column:
        n = F.size(t)
        per = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda k: F.array_join(F.slice(t, i + 1, k), " "))
        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), per))).otherwise(F.array().cast("array<string>"))

    return let(tokens, all_of)


def only_lower(text: Column) -> Column:
    return text == F.lower(text)


def answer_span(context: Column, start: Column, end: Column) -> Column:
    """``context[start:end]`` with places from 0."""
    return F.substring(context, start + 1, end - start)


def paragraph_bounds(context: Column, start: Column, end: Column, delimiter: str = PARAGRAPH) -> tuple[Column, Column]:
    """Where the paragraph around ``[start, end)`` begins and ends in a joined context: after the last
    delimiter wholly before the start, up to the first one at or after the end."""
    before = F.instr(F.reverse(F.substring(context, F.lit(1), start)), delimiter[::-1])
    low = F.when(before > 0, start - before + 1).otherwise(0)
    after = F.instr(F.substring(context, end + 1, F.length(context)), delimiter)
    high = F.when(after > 0, end + after - 1).otherwise(F.length(context))
    return low, high


_SENTENCE = F.pandas_udf(lambda text: text.map(sentence_starts), T.ArrayType(T.IntegerType()))


def sentence_starts(text: str | None) -> list[int]:
    """Where sentences begin: after ``.``, ``!`` or ``?``, closing marks and white space. A rule instead of
    a trained splitter."""
    import regex

    if not text:
        return [0]
    found = [m.end() for m in regex.finditer(r"[.!?]+[\"')\]]*\s+", text)]
    return [0, *(i for i in found if i < len(text))]


def sentences(text: Column) -> Column:
    """Beginnings of the sentences of each text."""
    return _SENTENCE(text)


def hex_intensity(value: Column, low: Column, high: Column) -> Column:
    """A value scaled between two others as two hexadecimal digits."""
    return F.lpad(F.hex(F.when(high > low, F.floor((value - low) / (high - low) * 255)).otherwise(0).cast("bigint")), 2, "0")


def title_match(title: Column, answers: Column) -> Column:
    """Whether the title begins with one of the answers, both in lower case without outer white space."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    return F.exists(answers, lambda a: F.startswith(plain(title), plain(a)))


def murmur3(strings: list[bytes], seed: int = 0) -> np.ndarray:
    """The unsigned 32-bit murmur hash (x86, version 3) of every string, all at once block by block."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    width = max(4, int(-(-n.max(initial=0) // 4) * 4))
    data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in strings), "<u4").reshape(len(strings), width // 4)
    rotated = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    mixed = lambda k: rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = np.full(len(strings), seed, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(width // 4):
            k = mixed(data[:, i])
            h = np.where(4 * (i + 1) <= n, rotated(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(4 * i < n, h ^ k, h))
        h ^= n.astype(np.uint32)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        return h ^ (h >> np.uint32(16))


@F.pandas_udf(T.LongType())
def feature_hash(term: pd.Series, buckets: pd.Series) -> pd.Series:
    """Murmur hash of seed 0, unsigned, by the number of buckets."""
    names, place = np.unique(term.to_numpy(dtype=str), return_inverse=True)
    hashed = murmur3([x.encode() for x in names.tolist()]).astype(np.int64)[place]
    return pd.Series(hashed % buckets.to_numpy())
