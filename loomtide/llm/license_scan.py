"""License scans with a positional index of rare words.

Words are runs of letters, digits and characters beyond ASCII, in lower case for A to Z. A template is a passage of a licence
with mandatory key phrases. A word weighs what its rarity over all documents gives (floor(1000 * ln((2N + 2) / (2df + 1))), 1
at least, N documents with a word). A template stands at place o of a text if those of its words that are within SLACK of
their place, seen from o, weigh a SHARE of the template at least, and each key phrase stands in the window.

The index holds only the rare words of each template, with their places in it: the heaviest ones, so many that what is left
weighs under half of what a match needs. So a match can't do without them: each text's words are looked up in the index
alone, hits of a template are intersected by their place relative to it, and a place whose hits are too light for any match goes.
Only then are all words of the template and its key phrases compared. Nothing is capped, and a test holds the result
against every template at every place. Of overlapping matches of one template the heaviest counts, then the one with most in
place, then the first.

Base phrases are searched word by word beside the templates. Only templates, phrases and their words' counts are broadcast;
these don't grow with the data. No row is shuffled. Null and empty texts have no words and no labels. Each row is
read by itself, so repeated rows, null ids and ties agree; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, Vocabulary, utf8_blocks, word_ranges

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Phrases whose places count, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed values, from the public texts of the licences: label, passage, key phrases.
TEMPLATES = (
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("affero general public license", "version 3")),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("affero general public license", "version 3")),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2 0",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistributions of source code", "copyright notice")),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote",)),
    ("bsl-1.0", "distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("mit", "released under the MIT License", ("mit license",)),
    ("mit", "licensed under the MIT License", ("mit license",)),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("free of charge", "without restriction")),
    ("mpl-2.0", "this Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("zlib", "this software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("as is", "held liable")),
)

#: Of 100, what the words found must weigh of a template; how far a word may be from its place.
SHARE, SLACK = 70, 2
#: Compared words at a time.
_AT_ONCE = 1 << 22


def split(text: str) -> list[str]:
    """The words of a passage."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text))


class Index:
    """Templates and phrases as word numbers, their weights, and the postings of the rare words."""

    def __init__(self, templates: tuple, phrases: dict[str, str]) -> None:
        self.labels = [t[0] for t in templates]
        self.phrase_labels = list(phrases.values())
        passages, keys, base = [split(t[1]) for t in templates], [[split(k) for k in t[2]] for t in templates], [split(p) for p in phrases]
        words = sorted({w for p in [*passages, *base, *(k for ks in keys for k in ks)] for w in p})
        number = {w: i for i, w in enumerate(words)}
        told = lambda ws: np.array([number[w] for w in ws], np.int64)
        self.words, self.vocabulary = words, Vocabulary(words)
        self.passages, self.keys, self.base = [told(p) for p in passages], [[told(k) for k in ks] for ks in keys], [told(p) for p in base]
        #: words between texts, so that no window sees two
        self.gap = max([len(p) for p in [*self.passages, *self.base]], default=0) + 2 * SLACK + 1

    def weigh(self, df: np.ndarray, n: int) -> None:
        """Sets the words' weights and chooses the rare words of each template."""
        self.weight = np.array([max(1, math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))) for d in df.tolist()], np.int64)
        self.need, self.left, rare = [], [], []
        for t, p in enumerate(self.passages):
            w = self.weight[p]
            need = -(-SHARE * int(w.sum()) // 100)
            order = np.argsort(-w, kind="stable")
            left = int(w.sum()) - np.cumsum(w[order])
            some = int(np.argmax(2 * left < need)) + 1
            self.need.append(need)
            self.left.append(int(left[some - 1]))
            rare += [(int(p[k]), t, int(k)) for k in order[:some]]
        self.rare = np.array(sorted(rare), np.int64).reshape(-1, 3)
        self.count = np.bincount(self.rare[:, 0], minlength=len(self.words))
        self.first = np.cumsum(self.count) - self.count

    def spaced(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the block's words with a gap before each text and after the last, first place of each text, its words)."""
        start, end, of = word_ranges(offsets, data, _BETWEEN)
        n = np.bincount(of, minlength=len(offsets) - 1)
        first = np.cumsum(n) - n + self.gap * (1 + np.arange(len(n)))
        out = np.full(len(start) + self.gap * (len(n) + 1), -1, np.int64)
        out[np.arange(len(start)) + self.gap * (1 + of)] = self.vocabulary.numbers(data, start, end)
        return out, first, n

    def _candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, place) whose rare words found there leave room for a match."""
        hits = np.flatnonzero(words >= 0)
        hits = hits[self.count[words[hits]] > 0]
        k = self.count[words[hits]]
        at = np.repeat(self.first[words[hits]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        t, p = self.rare[at, 1], self.rare[at, 2]
        place = (np.repeat(hits, k) - p)[:, None] + np.arange(-SLACK, SLACK + 1)
        key = np.unique(((place + self.gap) * len(self.labels) + t[:, None]) * self.gap + p[:, None])  # each word of a template once
        where, p = np.divmod(key, self.gap)
        where, start = np.unique(where, return_index=True)
        t, place = where % len(self.labels), where // len(self.labels) - self.gap
        of = np.repeat(t, np.diff(np.append(start, len(key))))
        longest = np.zeros((len(self.labels), self.gap), np.int64)
        for i, x in enumerate(self.passages):
            longest[i, : len(x)] = self.weight[x]
        found = np.add.reduceat(longest[of, p], start) if len(start) else start
        good = found + np.array(self.left)[t] >= np.array(self.need)[t]
        return t[good], place[good]

    def matches(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(template, place, share) of all matches, by template and place."""
        template, place = self._candidates(words)
        padded = np.concatenate((np.full(self.gap, -1, np.int64), words, np.full(self.gap, -1, np.int64)))
        out = []
        for t in np.unique(template).tolist():
            p, all_at = self.passages[t], place[template == t]
            total = int(self.weight[p].sum())
            good: list[tuple[int, int, int]] = []
            for some in range(0, len(all_at), max(1, _AT_ONCE // self.gap)):
                at = all_at[some : some + max(1, _AT_ONCE // self.gap)]
                seen = padded[(at + self.gap)[:, None] + np.arange(-SLACK, len(p) + SLACK)]
                hit = np.zeros((len(at), len(p)), bool)
                for d in range(2 * SLACK + 1):
                    hit |= seen[:, d : d + len(p)] == p
                weight, exact = hit @ self.weight[p], (seen[:, SLACK : SLACK + len(p)] == p) @ self.weight[p]
                fine = weight >= self.need[t]
                for key in self.keys[t]:
                    fine &= phrase_places(seen, key).any(1)
                good += zip((-weight[fine]).tolist(), (-exact[fine]).tolist(), at[fine].tolist(), strict=True)
            taken: list[int] = []
            for w, _, o in sorted(good):
                i = bisect_left(taken, o)
                if (i == 0 or o - taken[i - 1] >= len(p)) and (i == len(taken) or taken[i] - o >= len(p)):
                    insort(taken, o)
                    out.append((t, o, -w / total))
        return sorted(out)


def phrase_places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Along the last axis: whether the phrase's words stand from a place on."""
    n = words.shape[-1] - len(phrase) + 1
    out = np.ones((*words.shape[:-1], max(n, 0)), bool)
    for k, w in enumerate(phrase.tolist()):
        out &= words[..., k : k + max(n, 0)] == w
    return out


def _counts(docs: DataFrame, index: Index) -> None:
    """Counts the documents that hold each word of the index, over all rows, and weighs the words."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(index.words) + 1, np.int64)
        for b in batches:
            for _, offsets, data in utf8_blocks(b.column(0)):
                words, first, n = index.spaced(offsets, LOWERED[data])
                at = np.flatnonzero(words >= 0)
                text = np.searchsorted(first, at, "right") - 1
                df[:-1] += np.bincount(np.unique(text * len(index.words) + words[at]) % len(index.words), minlength=len(index.words))
                df[-1] += int((n > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df)).astype(np.int32)), pa.array(df)], ["word", "df"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(sums, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()  # a row a word of the index
    df = np.zeros(len(index.words) + 1, np.int64)
    for r in rows:
        df[r["word"]] = r["df"]
    index.weigh(df[:-1], int(df[-1]))


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int32()), ("share", pa.float64())]))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row: doc_id, n_words, base and matches, both arrays of (label, first_word, words, share)."""
    index = Index(templates, phrases)
    _counts(docs, index)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            for at, offsets, data in utf8_blocks(b.column("text")):
                words, first, n = index.spaced(offsets, LOWERED[data])
                base: list[list] = [[] for _ in range(len(n))]
                found: list[list] = [[] for _ in range(len(n))]
                for label, phrase in zip(index.phrase_labels, index.base, strict=True):
                    for o in np.flatnonzero(phrase_places(words, phrase)).tolist():
                        text = int(np.searchsorted(first, o, "right")) - 1
                        base[text].append((label, o - int(first[text]), len(phrase), 1.0))
                for t, o, share in index.matches(words):
                    # the middle of the window is in the text or beside it, never nearer to another one
                    text = int(np.searchsorted(first, o + len(index.passages[t]) + SLACK - 1, "right")) - 1
                    found[text].append((index.labels[t], o - int(first[text]), len(index.passages[t]), share))
                spans = [pa.array([[dict(zip(("label", "first_word", "words", "share"), x, strict=True)) for x in sorted(xs, key=lambda x: (x[1], x[0]))] for xs in col], _SPANS) for col in (base, found)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(n)), pa.array(n.astype(np.int64)), *spans], ["doc_id", "n_words", "base", "matches"])

    kind = "array<struct<label:string,first_word:bigint,words:int,share:double>>"
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, f"doc_id long, n_words long, base {kind}, matches {kind}")


def labelled(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, the greatest share of a
    template that is there (a base phrase counts as a whole template, nothing as 0)."""
    found = scan(docs, templates, phrases)
    joined = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(s, lambda x: x["label"]) for s in spans]))), ",")
    place = F.transform("base", lambda x: x["first_word"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("base"), F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "matches"), lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
