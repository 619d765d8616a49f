r"""License scan over a positional rare-token index.

Every template is a licence text with a mandatory key phrase. The inverse document frequencies of the templates' words come
from the whole corpus. A file is looked up by the rarest word of each key phrase: only the spots of those words are indexed,
and a spot counts once all words of the key phrase stand where they must. Around such a spot the template is compared by
relative position, in pieces of PIECE words: a piece is looked for by either of its two rarest words within DRIFT words of
where it should stand, so line breaks, copyright lines and small edits shift a piece without losing the rest. The score of a spot is the
share of the template's information (the sum of its words' frequencies' logarithms) that stands right; a notice needs
MIN_SHARE. Native expressions only; every comparison reads one word of the file by its number, so time is linear in the file
and in the spots of its key phrases. No row leaves its partition but for the counts.

Lower-casing goes beyond A-Z, which can't change a match of a base phrase: no letter outside ASCII becomes one of its letters.

Defined results: a null or empty text has no words and no labels; repeated rows each get their own result; ties in rarity
go to the earlier word of the phrase; an empty table gives an empty result; other columns are left out of it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from .common import NO_WORD, word_array


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: The mandatory phrase, a part of text.
    key: str

    @cached_property
    def words(self) -> list[str]:
        return [w for w in re.split(NO_WORD, self.text.lower()) if w]

    @cached_property
    def key_words(self) -> list[str]:
        return [w for w in re.split(NO_WORD, self.key.lower()) if w]

    @property
    def key_at(self) -> int:
        k = self.key_words
        return next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)


#: The phrases whose every spot is reported.
BASE = (
    Template("cc-by", "cc by", "cc by"),
    Template("gpl", "general public license", "general public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)

# The wording of common licences and of the notices that name them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely"""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License
as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."""

#: A spot needs the key phrase and MIN_SHARE of the template's information; several templates may have one label.
NOTICES = (
    Template("mit", _MIT, "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license", "mit license"),
    Template("bsd", _BSD_2, "redistribution and use in source and binary forms"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd-3-clause", _BSD_3, "endorse or promote products derived from this software"),
    Template("isc", _ISC, "permission to use, copy, modify"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    Template("zlib", _ZLIB, "alter it and redistribute it freely"),
    Template("bsl-1.0", _BSL, "organization obtaining a copy of the software and accompanying documentation"),
    Template("unlicense", _UNLICENSE, "unencumbered software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("apache-2.0", _APACHE, "licensed under the apache license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache license version 2 0 january 2004"),
    Template("mpl-2.0", _MPL, "mozilla public license v 2 0"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("mpl-2.0", "Mozilla Public License Version 2.0 1. Definitions", "mozilla public license version 2 0"),
    Template("gpl-2.0", _GNU.format("General", "2"), "gnu general public license as published by the free software foundation either version 2"),
    Template("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "general public license version 2"),
    Template("gpl-3.0", _GNU.format("General", "3"), "gnu general public license as published by the free software foundation either version 3"),
    Template("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "general public license version 3 29 june 2007"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
)
MIN_SHARE, PIECE, DRIFT = 0.6, 16, 12


def _anchor(words: list[str], idf: dict[str, float]) -> int:
    return max(range(len(words)), key=lambda j: (idf[words[j]], -j))


def second(words: list[str], idf: dict[str, float]) -> int:
    """The spot of the rarest word but one; that of the rarest if there is no other."""
    a = _anchor(words, idf)
    return max((j for j in range(len(words)) if words[j] != words[a]), key=lambda j: (idf[words[j]], -j), default=a)


def _starts(template: Template, idf: dict[str, float]) -> str:
    """Starts of the template (by its relative positions, so maybe before the text) whose key phrase stands complete."""
    key = template.key_words
    a = _anchor(key, idf)
    found = " AND ".join(f"get(words, i + {j - a}) = '{w}'" for j, w in sorted(enumerate(key), key=lambda x: x[0] != a))
    return f"transform(filter(spots, i -> {found}), i -> i - {template.key_at + a})"


def pieces(template: Template) -> list[tuple[int, list[str]]]:
    """The template cut into pieces of about PIECE words, with their starts."""
    n = max(1, round(len(template.words) / PIECE))
    ends = [round(k * len(template.words) / n) for k in range(n + 1)]
    return [(a, template.words[a:b]) for a, b in zip(ends, ends[1:])]


def _share(template: Template, idf: dict[str, float], at: str) -> str:
    """What of the template's information stands right around the start."""
    parts = []
    for begin, words in pieces(template):
        a = _anchor(words, idf)
        listed = ", ".join(f"struct({j - a} AS j, '{w}' AS w, {idf[w]!r}D AS x)" for j, w in enumerate(words))
        got = f"aggregate(array({listed}), 0D, (sum, t) -> sum + IF(get(words, p + t.j) <=> t.w, t.x, 0D))"
        b = second(words, idf)
        near = f"filter(sequence({at} + {begin + a - DRIFT}, {at} + {begin + a + DRIFT}), p -> get(words, p) <=> '{words[a]}' OR get(words, p + {b - a}) <=> '{words[b]}')"
        parts.append(f"coalesce(array_max(transform({near}, p -> {got})), 0D)")
    return f"least(1D, ({' + '.join(parts)}) / {sum(idf[w] for w in template.words)!r}D)"


def _frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """The inverse document frequency of each word of the vocabulary, over all documents."""
    listed = ", ".join(f"'{w}'" for w in vocabulary)
    total = F.lit("")  # a word that no document has stands for the documents
    seen = words.select(F.explode(F.concat(F.array(total), F.expr(f"array_distinct(filter(words, w -> w IN ({listed})))"))).alias("w"))
    n = {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}  # a row for each word of the vocabulary at most
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1e-3 for w in vocabulary}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, min_share: float = MIN_SHARE) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    every, n = list(enumerate((*base, *notices))), len(base)
    vocabulary = sorted({w for _, t in every for w in t.words})
    assert all(w.isascii() and w.isalnum() for w in vocabulary) and not any("k" in w for t in base for w in t.words)  # U+212A becomes a k
    words = docs.select(F.col(id_col), word_array(F.col(text_col)).alias("words"))
    idf = _frequencies(words, vocabulary)

    anchors = ", ".join(f"'{w}'" for w in sorted({t.key_words[_anchor(t.key_words, idf)] for _, t in every}))
    spots = F.expr(f"CASE WHEN size(words) = 0 THEN cast(array() AS array<int>) ELSE filter(sequence(0, size(words) - 1), i -> words[i] IN ({anchors})) END")
    found = words.select(id_col, "words", F.size("words").cast("long").alias("n_words"), spots.alias("spots"))
    found = found.select("*", *(F.expr(_starts(t, idf)).alias(f"k{k}") for k, t in every))
    # The shares of information at each spot; a notice needs min_share of its own.
    found = found.select("*", *(F.expr(f"filter(transform(k{k}, s -> {_share(t, idf, 's')}), x -> x >= {min_share!r}D)").alias(f"x{k}") for k, t in every[n:]))

    def joined(kinds: list[tuple[int, Template]]) -> Column:
        labels = F.array(*(F.when(F.size(f"{'k' if k < n else 'x'}{k}") > 0, F.lit(t.label)) for k, t in kinds))
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), ",")

    starts = F.concat(*(F.col(f"k{k}") for k in range(n)))
    scores = [F.when(F.size(starts) > 0, 1.0).otherwise(0.0), *(F.coalesce(F.array_max(f"x{k}"), F.lit(0.0)) for k, _ in every[n:])]
    return found.select(
        id_col,
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(every[:n]).alias("base_labels"),
        joined(every).alias("labels"),
        F.greatest(*scores).cast("double").alias("score"),
    )
