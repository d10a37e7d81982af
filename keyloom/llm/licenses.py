"""License scans by an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters and digits, and of all characters beyond ASCII, with A-Z lower-cased. A
template of t words meets the blocks [k*t, (k+2)*t) of a text's words for k = 0, 1, ...: every run of t words lies
in one of them. A block matches if it holds at least `threshold` of the template's distinct words. The join finds
every such block:

* frequency order: in how many texts each template word occurs is counted over the whole table; template words are
  ordered from rare to frequent (ties by the word);
* prefix filter: a block can match only if it has one of the t - need + 1 rarest words of the template;
* length filter: it must have `need` distinct words or more;
* positional filter: if the rarest word that it shares is the template's i-th, at most t - i words can be shared;
* the words of what is left are compared in full.

`labels` are all labels that the join finds. As short templates of different licenses share most words, `licenses` are those
whose block also holds the template's distinguishing words (`MARKS`), beside the base phrases' labels.

Templates are a fixed list in this module, so their index goes along with the code; texts never meet each other and
nothing is shuffled but the count of each template word.

Defined cases: null text is empty; an empty text has no words, no labels and the score 0; repeated rows are
scanned each by itself; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD = 0.8
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This software is released under the MIT License",
        "Licensed under the MIT License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Words that tell licenses apart: a block without those of its template may be of another license.
MARKS = frozenset(b"apache mit bsd gnu lesser affero mozilla creative cc nc noncommercial sharealike unencumbered".split())
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in WORD_BYTES else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TO_WORDS).split()


class Template:
    def __init__(self, label: str, text: str, rank: dict[bytes, tuple], threshold: float):
        self.label, words = label, words_of(text)
        self.span = len(words)
        self.words = sorted(set(words), key=lambda w: rank.get(w, (0, w)))
        self.need = math.ceil(threshold * len(self.words) - 1e-9)
        self.prefix = self.words[: len(self.words) - self.need + 1]
        self.marks = MARKS & set(self.words)
        self.place = {w: i for i, w in enumerate(self.words)}


class Matcher:
    """All templates with one index of their prefix words."""

    def __init__(self, frequency: dict[bytes, int], threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None):
        rank = {w: (n, w) for w, n in frequency.items()}
        self.templates = [Template(k, t, rank, threshold) for k, ts in (templates or TEMPLATES).items() for t in ts]
        self.index: dict[bytes, list[int]] = {}
        for i, t in enumerate(self.templates):
            for w in t.prefix:
                self.index.setdefault(w, []).append(i)

    def candidates(self, words: list[bytes]) -> dict[int, set[int]]:
        """Templates and block numbers that share a prefix word."""
        found: dict[int, set[int]] = {}
        have = self.index.keys() & set(words)
        if have:
            for p, w in enumerate(words):
                if w in have:
                    for i in self.index[w]:
                        k = p // self.templates[i].span
                        found.setdefault(i, set()).update((k, max(0, k - 1)))
        return found

    def match(self, words: list[bytes]) -> list[tuple[str, int, int, float, bool]]:
        """label, first word, end word and containment of every block that meets the threshold, and whether it has the marks."""
        out = []
        for i, blocks in self.candidates(words).items():
            t = self.templates[i]
            for k in sorted(blocks):
                block = words[k * t.span : (k + 2) * t.span]
                if len(block) < t.need:
                    continue
                have = set(block)
                if len(have) < t.need:
                    continue
                first = next((j for j, w in enumerate(t.prefix) if w in have), None)
                if first is None or len(t.words) - first < t.need:
                    continue
                shared = sum(w in have for w in t.words)
                if shared >= t.need:
                    out.append((t.label, k * t.span, k * t.span + len(block), shared / len(t.words), t.marks <= have))
        return out


def phrases_at(words: list[bytes]) -> list[tuple[int, str]]:
    """Start word and label of every place where a base phrase's words stand one after another."""
    out = []
    for phrase, label in PHRASES.items():
        p = phrase.encode().split()
        start = -1
        while True:
            try:
                start = words.index(p[0], start + 1)
            except ValueError:
                break
            if words[start : start + len(p)] == p:
                out.append((start, label))
    return out


def word_frequency(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> dict[bytes, int]:
    """In how many texts of the whole table each template word occurs; one row a word at most comes back."""
    known = {w for ts in (templates or TEMPLATES).values() for t in ts for w in words_of(t)}
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column(0):
                counts.update(known & set(words_of(text.as_py())))
        yield common.batch(schema, [list(counts), list(counts.values())])

    parts = common.map_rows(common.documents(docs).select("text"), run, "word binary, n long")
    return {bytes(r.word): r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of docs: base phrases, labels, licenses, the best containment as score and the matched blocks."""
    matcher = Matcher(word_frequency(docs, templates), threshold, templates)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64()), ("licenses", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                base, blocks = phrases_at(words), matcher.match(words)
                starts, own = [x for x, _ in base], {x for _, x in base}
                score = 1.0 if base else max((x[3] for x in blocks), default=0.0)
                rows.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in blocks})), score, len(blocks), ",".join(sorted(own | {x[0] for x in blocks if x[4]}))))
            yield common.batch(schema, list(zip(*rows, strict=True)) if rows else [[] for _ in schema])

    return common.map_rows(common.documents(docs), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long, licenses string")
