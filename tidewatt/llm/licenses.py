"""License scans: an exact set-similarity join of text blocks with license templates.

The blocks of a template are all windows of consecutive words of the whole text (line breaks,
punctuation and comment signs do not count) that are as long as the template and a quarter
longer. A template meets a block that holds at least ``containment`` of its different words,
all of its ``must`` words (what tells licenses of one family apart) and none of ``without``.

The join is the prefix filter's: words in ascending order of their frequency in the whole
table, so that a template can only meet a text that holds one of its few rarest words; a text
with fewer different words than needed is skipped (length filter), and so is one whose words
after the last common one are too few (positional filter). What is left is looked at window by
window around the places of those rare words, all windows of a text in one running count: the
work is linear in the text. Only words of templates can be common to both, so only their
frequencies are counted: one number each, however large the table.

Labels of ``PHRASES`` (words that stand consecutively) are found beside it and always stay.

Cases: null text is empty (no words, no labels, score 0); first_word and last_word are null
where no phrase is found; repeated rows are scanned alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewatt.llm import runtime

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    label: str
    text: str
    must: str = ""
    without: str = ""


_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
    the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_GPL_LINE = "This work is licensed under the GNU {name}, version {version}"
_GPL_SHORT = "under the terms of the GNU {name}"
_CC = "This work is licensed under a Creative Commons {name} {version} International License"
_CC_SHORT = "Licensed under CC {name} {version}"

#: Distinctive passages of public licenses, and the notices that name them.
TEMPLATES = [
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions:""", "charge obtaining associated"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files""", "charge obtaining associated"),
    Template("mit", "Released under the MIT License", "mit license"),
    Template("mit", "Licensed under the MIT License", "mit license"),
    Template("mit", "This project is licensed under the terms of the MIT license", "mit license"),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""", "fee purpose"),
    Template("isc", "Licensed under the ISC License", "isc license"),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met""", "redistribution binary"),
    Template("bsd", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""", "binary reproduce"),
    Template("bsd-3", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission.""", "neither endorse"),
    Template("bsd", "Licensed under the BSD License", "bsd license"),
    Template("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "bsd governed"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2"),
    Template("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at""", "apache 2"),
    Template("apache-2", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""", "governing basis"),
    Template("gpl", _GPL_SHORT.format(name="General Public License"), "gnu general public", "lesser library affero"),
    *[Template(f"gpl-{v}", text.format(name="General Public License", version=v), f"gnu general public {v}", "lesser library affero") for v in (2, 3) for text in (_GPL, _GPL_LINE)],
    *[Template("lgpl", text.format(name="Lesser General Public License", version=v), "gnu lesser") for v, text in (("2.1", _GPL), ("3", _GPL), ("3", _GPL_LINE))],
    *[Template("agpl-3", text.format(name="Affero General Public License", version="3"), "gnu affero") for text in (_GPL, _GPL_LINE)],
    Template("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at""", "mozilla 2"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
    Template("epl-2", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0""", "eclipse 2"),
    Template("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works
        of the Software""", "organization execute"),
    Template("bsl-1", "Distributed under the Boost Software License, Version 1.0", "boost 1"),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software.""", "held arising"),
    Template("unlicense", """This is free and unencumbered software released into the public domain.""", "unencumbered"),
    Template("unlicense", """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""", "anyone compile"),
    Template("cc0", """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work""", "dedicated waiving"),
    Template("cc0", "Released under CC0 1.0 Universal Public Domain Dedication", "cc0"),
    *[Template("cc-" + "-".join(short.lower().split()), text.format(name=long if text is _CC else short, version=v), " ".join(f"{must} {v[0]}".split()), without)
      for text in (_CC, _CC_SHORT) for v in ("3.0", "4.0") for short, long, must, without in (
          ("BY", "Attribution", "", "noncommercial sharealike noderivatives noderivs nc sa nd"),
          ("BY SA", "Attribution-ShareAlike", "sharealike" if text is _CC else "sa", "noncommercial nc"),
          ("BY ND", "Attribution-NoDerivatives", "noderivatives" if text is _CC else "nd", "noncommercial nc"),
          ("BY NC", "Attribution-NonCommercial", "noncommercial" if text is _CC else "nc", "sharealike noderivatives noderivs sa nd"),
          ("BY NC SA", "Attribution-NonCommercial-ShareAlike", "noncommercial sharealike" if text is _CC else "nc sa", ""),
          ("BY NC ND", "Attribution-NonCommercial-NoDerivatives", "noncommercial noderivatives" if text is _CC else "nc nd", ""))],
    Template("all-rights-reserved", "All rights reserved", "all rights reserved"),
]
CONTAINMENT = 0.8

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


class Compiled(NamedTuple):
    """A template as word sets: what counts, what must and must not be there, the words of a window, and of a match."""

    label: str
    words: frozenset[bytes]
    must: frozenset[bytes]
    without: frozenset[bytes]
    width: int
    need: int


def compiled(templates: Sequence[Template] = TEMPLATES, containment: float = CONTAINMENT) -> list[Compiled]:
    out = []
    for t in templates:
        own = words_of(t.text.encode())
        words, must, without = (frozenset(x) for x in (own, words_of(t.must.encode()), words_of(t.without.encode())))
        if not must <= words or without & words:
            raise ValueError(f"{t.label}: its words must hold those of must, and none of without")
        out.append(Compiled(t.label, words, must, without, len(own) + len(own) // 4, max(1, -int(-containment * len(words) // 1))))
    return out


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the templates stands in the whole table."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for part in runtime.slices(batch, 0):
                for text in part.column(0).to_pylist():
                    if text:
                        words = words_of(text.encode())
                        if not vocabulary.isdisjoint(words):
                            total.update(w for w in words if w in vocabulary)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total]), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}  # a row a template word


class TemplateIndex:
    """Templates under the global order, with an inverted index of their prefixes."""

    def __init__(self, templates: list[Compiled], counts: dict[bytes, int]):
        self.templates = templates
        vocabulary = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
        self.place = {w: k for k, w in enumerate(vocabulary)}
        self.place |= {w: len(self.place) + k for k, w in enumerate(sorted({w for t in templates for w in t.without}.difference(vocabulary)))}
        self.ordered = [sorted(self.place[w] for w in t.words) for t in templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, ranks in enumerate(self.ordered):
            for at, rank in enumerate(ranks[: len(ranks) - templates[t].need + 1]):
                self.prefix.setdefault(rank, []).append((t, at))
        self.first_words = frozenset(w for w, k in self.place.items() if k in self.prefix)
        size = len(self.place) + 1
        self.is_word, self.is_must, self.is_without, self.is_first = (np.zeros((len(templates), size), bool) for _ in range(4))
        for t, own in enumerate(templates):
            self.is_word[t, self.ordered[t]] = True
            self.is_must[t, [self.place[w] for w in own.must]] = True
            self.is_without[t, [self.place[w] for w in own.without]] = True
            self.is_first[t, self.ordered[t][: len(self.ordered[t]) - own.need + 1]] = True

    def candidates(self, block: list[int]) -> list[int]:
        """Templates that the text's template words (their places, ascending) leave possible."""
        upto: dict[int, int] = {}
        for j, rank in enumerate(block):
            for t, i in self.prefix.get(rank, ()):
                have, need, size = upto.get(t, 0), self.templates[t].need, len(self.ordered[t])
                if have < 0 or len(block) < need:
                    continue
                upto[t] = have + 1 if have + 1 + min(size - i - 1, len(block) - j - 1) >= need else -1
        return [t for t, have in upto.items() if have > 0]

    def meets(self, words: list[bytes]) -> dict[int, float]:
        """Templates that a window of the words meets, and the largest share of each that one holds."""
        get = self.place.get
        rank = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(rank >= 0)
        rank = rank[at]
        out = {}
        for t in self.candidates(np.unique(rank).tolist()):
            own = self.templates[t]
            first = at[self.is_first[t][rank]]
            near = np.flatnonzero(self.is_word[t][rank] | self.is_without[t][rank])
            place = np.searchsorted(first, at[near])  # only words within a window of a rare one
            reach = np.minimum(np.abs(at[near] - first[np.maximum(place - 1, 0)]), np.abs(at[near] - first[np.minimum(place, len(first) - 1)]))
            near = near[reach < own.width]
            pos, word = at[near], rank[near]
            steps = [_in_windows(pos, word, wanted[t], own.width) for wanted in (self.is_word, self.is_must, self.is_without)]
            start = np.unique(np.concatenate([[0], *(s for s, _ in steps)]))  # between these nothing changes
            start = start[(start >= 0) & (start <= max(0, len(words) - own.width))]
            held, must, without = (_on(start, *step) for step in steps)
            good = (held >= own.need) & (must == len(own.must)) & (without == 0)
            if good.any():
                out[t] = float(held[good].max()) / len(own.words)
        return out


def _in_windows(pos: np.ndarray, word: np.ndarray, wanted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different wanted words in the window that starts at s, for each s from which it changes: (s ascending, count)."""
    keep = wanted[word]
    pos, word = pos[keep], word[keep]
    order = np.lexsort((pos, word))
    p, w = pos[order], word[order]
    before = np.where(np.concatenate([[False], w[1:] == w[:-1]])[: len(p)], np.concatenate([[0], p[:-1]])[: len(p)], -width)
    low = np.maximum(before, p - width) + 1  # from here up to itself it is the window's first of its word
    starts, which = np.unique(np.concatenate([low, p + 1]), return_inverse=True)
    return starts, np.cumsum(np.bincount(which, np.repeat([1, -1], len(p)), len(starts)).astype(np.int64))


def _on(at: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The step function (starts, counts) at the places ``at``."""
    if not len(starts):
        return np.zeros(len(at), np.int64)
    place = np.searchsorted(starts, at, side="right") - 1
    return np.where(place >= 0, counts[np.maximum(place, 0)], 0)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = compiled(templates, containment)
    counts = frequencies(docs, frozenset(w for t in own for w in t.words))
    index = TemplateIndex(own, counts)
    phrases = [(b" " + phrase.encode() + b" ", label) for phrase, label in PHRASES.items()]

    def one(text: str | None):
        words = words_of(text.encode()) if text else []
        if not words:
            return 0, 0, None, None, "", "", 0.0
        places: list[int] = []
        base: set[str] = set()
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in phrases:
            at, seen, n = joined.find(phrase), 0, 0
            while at >= 0:
                n += joined.count(b" ", seen, at)
                seen = at
                places.append(n)
                base.add(label)
                at = joined.find(phrase, at + 1)
        score, labels = (1.0 if base else 0.0), set(base)
        if not index.first_words.isdisjoint(words):
            for t, share in index.meets(words).items():
                labels.add(own[t].label)
                score = max(score, share)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    fields += [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
    return runtime.map_texts(docs, lambda: lambda texts: list(zip(*map(one, texts), strict=True)), fields)
