"""Licence scans over a positional index of rare words, in DataFrame operations only.

The index is small and written into the plan: every template's distinct words with their places (the
postings), ordered by inverse document frequency, which a first pass counts over all files. A second pass
looks up each file: of every template those ``RARE`` of its words that are rarest among those the file has,
and where they stand. Each occurrence of the rarest word of a template's mandatory phrase proposes a place,
so none can be missed; the phrase must stand there word by word; the postings of the file's rare words are
intersected with it by relative position, with some slack for words put in or left out; and the share of the
template's weight in the words around the place must reach ``COVERAGE``. All of it happens inside the row of
a file, so there is no shuffle of texts and no group that could grow hot.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text by its words; ``key`` is (place, words) of the mandatory phrase within it. ``worth`` is
    the score of a place where all of it stands."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False
    worth: float = 1.0

    @property
    def key_words(self) -> tuple[str, ...]:
        return self.words[self.key[0] : self.key[0] + self.key[1]]

    @property
    def slack(self) -> int:
        """How far a word may stand from its place."""
        return 2 + len(self.words) // 4


def _of(label: str, text: str, key: str, base: bool = False, worth: float = 1.0) -> Template:
    w, k = (tuple(x for x in re.split(_SPLIT, t.lower()) if x) for t in (text, key))
    at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
    return Template(label, w, (at, len(k)), base, worth)


#: Base phrases, all of whose places count.
BASE = (
    _of("cc-by", "cc by", "cc by", True),
    _of("gpl", "general public license", "general public license", True),
    _of("reserved", "all rights reserved", "all rights reserved", True),
)
#: The wording of public licences and of the notices by which files refer to them.
TEXTS = (
    _of("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""", "permission is hereby granted free of charge"),
    _of("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""", "redistribution and use in source and binary forms"),
    _of("bsd-3", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""", "endorse or promote products derived from this software"),
    _of("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""", "for any purpose with or without fee is hereby granted"),
    _of("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely.""", "to alter it and redistribute it freely"),
    _of("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""", "you may not use this file except in compliance with the license"),
    _of("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""", "either version 3 of the license"),
    _of("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version.""", "either version 2 of the license"),
    _of("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation.""", "lesser general public license"),
    _of("agpl", """You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
        the Free Software Foundation.""", "affero general public license"),
    _of("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "mozilla public license"),
    _of("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""", "free and unencumbered software"),
    _of("bsl-1.0", """Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at
        http://www.boost.org/LICENSE_1_0.txt""", "boost software license"),
)
#: The names by which licences are mentioned.
NAMES = tuple(
    _of(label, name, name, worth=0.5)
    for label, name in (
        ("mit", "mit license"), ("apache-2.0", "apache license version 2 0"), ("apache-2.0", "apache 2 0 license"), ("bsd", "bsd license"),
        ("bsd-3", "bsd 3 clause"), ("bsd", "bsd 2 clause"), ("gpl-3.0", "general public license version 3"), ("gpl-3.0", "gpl v3"),
        ("gpl-2.0", "general public license version 2"), ("gpl-2.0", "gpl v2"), ("lgpl", "lesser general public license"),
        ("agpl", "affero general public license"), ("mpl-2.0", "mozilla public license"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-nc", "cc by nc"),
        ("cc-by-sa", "cc by sa"), ("cc-by-nd", "cc by nd"), ("cc0-1.0", "cc0 1 0"), ("cc-by-4.0", "creative commons attribution 4 0"), ("isc", "isc license"),
    )
)
NOTICES = TEXTS + NAMES
#: The share of a template's weight that has to stand around its place.
COVERAGE = 0.6
#: Words of a template that are looked up in a file, the rarest it has, and how many of them must agree.
RARE, AGREE = 8, 3


def _array(words) -> str:
    return "array(" + ",".join(f"'{w}'" for w in words) + ")"


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and pieces: the lower-cased words, with an empty string before or after where the text begins
    or ends outside a word. Only A-Z may become ASCII letters, so the Kelvin sign is kept apart."""
    text = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return docs.select(F.col(id_col).alias("id"), F.split(text, _SPLIT).alias("pieces"))


def document_frequencies(docs: DataFrame, templates=BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Documents in all, and with each word of the templates: a few hundred numbers."""
    lexicon = sorted({w for t in templates for w in t.words})
    # the empty word stands for the document itself
    found = _words(docs, id_col, text_col).select(F.explode(F.expr(f"concat(array(''), array_intersect({_array(lexicon)}, pieces))")).alias("word"))
    seen = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return seen.get("", 0), {w: seen.get(w, 0) for w in lexicon}


def inverse_frequencies(n: int, seen: dict[str, int]) -> dict[str, float]:
    return {w: math.log((n + 1) / (k + 1)) + 1 for w, k in seen.items()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    ``n_base`` counts all places where a base phrase stands; ``first_word`` and ``last_word`` are the
    smallest and largest start, null without any. A template is found where its mandatory phrase stands,
    ``AGREE`` of its ``RARE`` rarest words that the file has stand near their places, and the distinct words
    around it have ``COVERAGE`` of its weight; one that is all mandatory phrase where that stands. ``score``
    is the largest share of weight times the template's worth, 0 without any. Ties of frequency go by the
    alphabet. A null text has no words; very long texts are read whole. Repeated rows are scanned each; an
    empty table gives no rows; other columns are ignored.
    """
    templates = tuple(base) + tuple(notices)
    idf = inverse_frequencies(*document_frequencies(docs, templates, id_col, text_col))

    def rarest(words) -> list[str]:
        return sorted(set(words), key=lambda w: (-idf[w], w))

    anchors = [rarest(t.key_words)[0] for t in templates]
    rows = _words(docs, id_col, text_col)
    rows = rows.withColumn("lead", F.expr("cast(pieces[0] = '' as int)"))
    rows = rows.select("id", "pieces", "lead", F.expr("cast(greatest(0, size(pieces) - lead - cast(element_at(pieces, -1) = '' as int)) as bigint)").alias("n_words"))
    # most files have no rarest word of any phrase, and are done
    some = F.expr(f"arrays_overlap(pieces, {_array(sorted(set(anchors)))})")
    rows = rows.withColumn("some", F.coalesce(some, F.lit(False)))
    long = [i for i, t in enumerate(templates) if len(t.words) > t.key[1]]
    lexicon = _array(rarest(w for t in templates for w in t.words))
    rows = rows.withColumn("present", F.expr(f"CASE WHEN some THEN array_intersect({lexicon}, pieces) END"))
    # array_intersect keeps the order of the first array: by frequency
    rare = [f"slice(array_intersect({_array(rarest(templates[i].words))}, present), 1, {RARE})" for i in long]
    rows = rows.withColumn("rare", F.expr(f"CASE WHEN some THEN array({', '.join(rare) or 'array()'}) END"))
    wanted = f"array_union({_array(sorted(set(anchors)))}, flatten(rare))"
    rows = rows.withColumn("wanted", F.expr(f"CASE WHEN some THEN {wanted} END"))
    rows = rows.withColumn("hits", F.expr("CASE WHEN some THEN filter(transform(pieces, (w, i) -> struct(i AS i, w AS w)), h -> array_contains(wanted, h.w)) END"))
    found = []
    for i, (t, anchor) in enumerate(zip(templates, anchors, strict=True)):
        at, k = t.key
        starts = f"transform(filter(hits, h -> h.w = '{anchor}'), h -> h.i - {at + t.key_words.index(anchor)})"
        stands = f"filter({starts}, s -> s + {at} >= 0 AND slice(pieces, s + {at + 1}, {k}) = {_array(t.key_words)})"
        if i not in long:
            places = f"transform({stands}, s -> struct(s AS s, {t.worth}D AS cover))"
        else:
            words = rarest(t.words)
            postings = "map(" + ", ".join(f"'{w}', array({', '.join(str(j) for j, x in enumerate(t.words) if x == w)})" for w in words) + ")"
            weights = "map(" + ", ".join(f"'{w}', {idf[w]!r}D" for w in words) + ")"
            near = f"exists(hits, h -> h.w = r AND exists(element_at({postings}, r), o -> abs(h.i - s - o) <= {t.slack}))"
            agreed = f"filter({stands}, s -> size(filter(rare[{long.index(i)}], r -> {near})) >= {AGREE})"
            around = f"slice(pieces, greatest(1, s + {1 - t.slack}), s + {len(t.words) + t.slack + 1} - greatest(1, s + {1 - t.slack}))"
            cover = f"aggregate(array_intersect({_array(words)}, {around}), 0D, (sum, w) -> sum + element_at({weights}, w)) / {sum(idf[w] for w in words)!r}D"
            places = f"filter(transform({agreed}, s -> struct(s AS s, {cover} AS cover)), p -> p.cover >= {COVERAGE})"
            places = f"transform({places}, p -> struct(p.s AS s, least(1D, p.cover) * {t.worth}D AS cover))"
        found.append(f"transform({places}, p -> struct('{t.label}' AS label, {str(t.base).lower()} AS base, p.s AS s, p.cover AS cover))")
    rows = rows.select("id", "n_words", "lead", F.expr(f"CASE WHEN some THEN concat({', '.join(found)}) END").alias("found"))
    rows = rows.withColumn("base", F.expr("filter(found, f -> f.base)"))
    labels = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: f["label"]))), ","), F.lit(""))
    starts = F.transform("base", lambda f: f["s"])
    return rows.select(
        F.col("id").alias(id_col), "n_words",
        F.expr("cast(coalesce(size(base), 0) as bigint)").alias("n_base"),
        (F.array_min(starts) - F.col("lead")).cast("bigint").alias("first_word"),
        (F.array_max(starts) - F.col("lead")).cast("bigint").alias("last_word"),
        labels("base").alias("base_labels"), labels("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["cover"])), F.lit(0.0)).alias("score"))
