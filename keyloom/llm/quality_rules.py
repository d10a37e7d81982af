"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much goes too.

Every line is judged by itself: navigation (three bars, arrows or bullets and more), boilerplate (stock phrases of
web pages that make up a fifth of the line), shouting (nearly all letters are capitals), symbols (one in ten characters is markup),
a missing full stop, and being a repeat of an earlier line. What is left is the cleaned text; a document is kept
if at least `keep_share` of its word characters stay and the document-level rules hold.

Defined cases: null text counts as empty; an empty text has no words and fails; lines without words are neither
judged nor counted as lost; repeated rows are judged each by itself; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SYMBOLS = b"#*$%&|<>"
STOPS = (".", "!", "?", '"', "'", ")", ":", ";", "…", "”", "。")
NAVIGATION = ("|", "»", "›", "•")
BOILERPLATE = ("lorem ipsum", "javascript", "cookie policy", "terms of use", "privacy policy", "sign in to", "log in to", "click here", "subscribe to our", "skip to content")
STOCK = re.compile("|".join(BOILERPLATE).encode())
MIN_WORDS, REPEAT_PERCENT, KEEP_SHARE = 50, 50, 0.5
REASONS = ("navigation", "boilerplate", "shouting", "symbols", "no_stop", "repeat")
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SPACES = b" \t\n\x0b\x0c\r"
#: Deletes what isn't markup, white space, a capital or a small letter.
ONLY = {k: bytes(set(range(256)) - set(v)) for k, v in {"symbols": SYMBOLS, "spaces": SPACES, "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123))}.items()}


def count(line: bytes, what: str) -> int:
    return len(line.translate(None, ONLY[what]))


def line_fault(line: str) -> str | None:
    """The first rule that a line with words breaks, but for repeats."""
    raw = line.encode("utf-8", "replace")
    if sum(map(line.count, NAVIGATION)) >= 3:
        return "navigation"
    stock = sum(map(len, STOCK.findall(raw.lower())))
    if stock and 5 * stock >= len(line):
        return "boilerplate"
    upper, lower = count(raw, "upper"), count(raw, "lower")
    if upper + lower >= 20 and 10 * upper > 7 * (upper + lower):
        return "shouting"
    if 10 * count(raw, "symbols") > len(line):
        return "symbols"
    if not line.rstrip(" \t\x0b\x0c\r").endswith(STOPS):
        return "no_stop"
    return None


def measure(text: str, ids: common.WordIds, keep_share: float = KEEP_SHARE) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons, cleaned text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - count(raw, "spaces")
    h = common.windows(ids.array(words), 3)
    repeated = 0
    if len(h):
        _, back, often = np.unique(h, return_inverse=True, return_counts=True)
        twice = often[back] > 1
        cover = np.zeros(n, bool)
        for j in range(3):
            cover[j : j + len(h)] |= twice
        repeated = int(cover.sum())
    seen: set[str] = set()
    dup, lost, left, faults = 0, 0, [], dict.fromkeys(REASONS, 0)
    for line in text.split("\n"):
        if not line.strip(" \t\x0b\x0c\r"):
            left.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        fault = line_fault(line) or ("repeat" if again else None)
        if fault:
            faults[fault] += 1
            lost += len(line) - count(line.encode("utf-8", "replace"), "spaces")
        else:
            left.append(line)
    failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
    kept = not failed and word_chars - lost >= keep_share * word_chars
    return n, word_chars, count(raw, "symbols"), dup, repeated, failed, kept, [faults[r] for r in REASONS], "\n".join(left)


def clean_documents(docs: DataFrame, keep_share: float = KEEP_SHARE, with_text: bool = True) -> DataFrame:
    """One row per row of docs(doc_id, text): the measures, the verdict, lines lost by rule and the cleaned text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [("doc_id", pa.int64()), *((x, pa.int64()) for x in names), ("base_failed", pa.bool_()), ("kept", pa.bool_()), *((f"lines_{r}", pa.int64()) for r in REASONS)]
    schema = pa.schema(fields + [("cleaned", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = common.WordIds()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                *m, faults, cleaned = measure(text.as_py(), ids, keep_share)
                rows.append([doc_id, *m, *faults, *[cleaned] * with_text])
            yield common.batch(schema, list(zip(*rows, strict=True)) if rows else [[] for _ in schema])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}
    return common.map_rows(common.documents(docs), run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))
