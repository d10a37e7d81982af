"""Quality scores by a generalised additive model with pairwise interactions.

`measure` turns a text into numbers (shares of kinds of characters, lines, repeats, lengths). The model is a sum of
lookup tables: one for each feature over its quantile bins, then one for each of the `PAIRS` strongest pairs over a
coarser grid. They are learned by cyclic boosting: round after round, a shallow tree (up to `LEAVES` leaves, chosen by
gain) is fitted to the gradient of the logistic loss over one feature's bins, damped by `RATE`, added to its table, and the
next feature follows; pairs are chosen by the gain of a two-way cut of what is left, and boosted the same way. A
score is the logistic function of an intercept and one table entry for each feature and pair: vectorised additions.

Labels come from at most `MAX_ROWS` labelled rows that are not held out, those with the least xxhash64(doc_id): a bound
that doesn't grow with the table. Weights balance nothing: a score is meant as a probability.

Defined cases: null text is empty; an empty text gets the score of its bins; with no labelled rows the score is 0.5, with
labels of one value that value's smoothed share; null labels are left out; repeated rows are scored each by
itself; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROWS, BINS, GRID, ROUNDS, PAIR_ROUNDS, RATE, LEAVES, PAIRS = 8_000, 32, 8, 120, 60, 0.1, 3, 6
FEATURES = ("log_words", "word_length", "letters", "capitals", "digits", "markup", "stops", "other_signs", "blanks", "distinct_words", "echoes", "repeated_lines", "line_words", "stopped_lines", "top_word")
_CLASS = np.full(256, 6, np.int64)
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b"#*$%&|<>")] = 3
_CLASS[list(b".,;:!?")] = 4
_CLASS[list(b" \t\n\x0b\x0c\r")] = 5


def measure(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 7) if raw else np.zeros(7)
    n, words = max(1, len(raw)), raw.split()
    w = max(1, len(words))
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in (x.strip() for x in raw.split(b"\n")) if x]
    rows = max(1, len(lines))
    echoes = sum(map(bytes.__eq__, words, words[1:]))
    ended = sum(x.endswith((b".", b"!", b"?", b'"', b":")) for x in lines)
    letters = max(1.0, kinds[0] + kinds[1])
    return [
        math.log1p(len(words)), (n - kinds[5]) / w, letters / n, kinds[1] / letters, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[6] / n, kinds[5] / n,
        len(counts) / w, echoes / w, 1 - len(set(lines)) / rows, math.log1p(w / rows), ended / rows, max(counts.values(), default=0) / w,
    ]


def best_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A step function over bins: greedy cuts of the largest gain; g, h: gradient and weight of each bin."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def value(a: int, b: int) -> float:
        return (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)

    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, where = 1e-9, None
        for k, (a, b) in enumerate(parts):
            for c in range(a + 1, b):
                if H[c] - H[a] > 0.5 and H[b] - H[c] > 0.5 and (x := value(a, c) + value(c, b) - value(a, b)) > gain:
                    gain, where = x, (k, c)
        if where is None:
            break
        k, c = where
        a, b = parts[k]
        parts[k : k + 1] = [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def best_square(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best of all cuts of a grid into four by one cut each way: its gain and step function."""
    G, H = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best, step = 0.0, np.zeros_like(g)
    n, m = g.shape
    for i in range(1, n):
        for j in range(1, m):
            cells = [(0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)]
            gh = [(G[b, d] - G[a, d] - G[b, c] + G[a, c], H[b, d] - H[a, d] - H[b, c] + H[a, c]) for a, b, c, d in cells]
            gain = sum(x * x / (y + 1.0) for x, y in gh) - G[-1, -1] ** 2 / (H[-1, -1] + 1.0)
            if gain > best:
                best, step = gain, np.zeros_like(g)
                for (a, b, c, d), (x, y) in zip(cells, gh, strict=True):
                    step[a:b, c:d] = x / (y + 1.0)
    return best, step


class Model:
    """Edges of bins, tables of features and of pairs, an intercept."""

    def __init__(self, intercept: float = 0.0):
        self.intercept, self.edges, self.tables = intercept, [], []
        self.grid_edges: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        self.intercept = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        if len(y) < 8 or y.min() == y.max():
            return self
        n = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n)]
        self.grid_edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, GRID + 1)[1:-1])) for j in range(n)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        grid = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.grid_edges)]
        score = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for j in range(n):
                p = 1 / (1 + np.exp(-score))
                size = len(self.tables[j])
                step = RATE * best_tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size))
                self.tables[j] += step
                score += step[bins[j]]
        p = 1 / (1 + np.exp(-score))

        def cells(a: int, b: int, v: np.ndarray) -> np.ndarray:
            shape = len(self.grid_edges[a]) + 1, len(self.grid_edges[b]) + 1
            return np.bincount(grid[a] * shape[1] + grid[b], v, shape[0] * shape[1]).reshape(shape)

        gains = sorted(((best_square(cells(a, b, y - p), cells(a, b, p * (1 - p)))[0], a, b) for a, b in combinations(range(n), 2)), reverse=True)
        self.pairs = [(a, b, np.zeros((len(self.grid_edges[a]) + 1, len(self.grid_edges[b]) + 1))) for _, a, b in gains[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for a, b, t in self.pairs:
                p = 1 / (1 + np.exp(-score))
                step = RATE * best_square(cells(a, b, y - p), cells(a, b, p * (1 - p)))[1]
                t += step
                score += step[grid[a], grid[b]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], "right")]
        if self.pairs:
            grid = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.grid_edges)]
            for a, b, t in self.pairs:
                out += t[grid[a], grid[b]]
        return 1 / (1 + np.exp(-out))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label of at most `most` labelled rows that are not held out, least xxhash64(doc_id) first."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~common.held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # TakeOrdered: no full sort; at most `most` rows, so they are broadcast
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([measure(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], schema=schema)

    got = common.map_rows(labelled_sample(docs, labels, "quality", max_rows), run, "doc_id long, label int, x array<double>")
    # A repeated id counts once, by its largest features, so that at most `max_rows` rows come to the driver.
    got = got.groupBy("doc_id").agg(F.max(F.struct("label", "x")).alias("m")).select("doc_id", "m.label", "m.x").toArrow()
    rows = sorted(zip(got.column(0).to_pylist(), got.column(2).to_pylist(), got.column(1).to_pylist(), strict=True))
    x, y = np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[2] for r in rows], float)
    return Model().fit(x, y)


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([measure(t.as_py()) for t in b.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], schema=SCORED)

    return common.map_rows(common.documents(docs), run, "doc_id long, score double")
