"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are mapped to symbols: insult, threat, person, reference, negation, reported speech, quotation mark, other. Five weighted
transducers stand in a row, each reading what the one before writes:

* negation: within three words after one, insults and threats pass at a part of their weight; negations are used up;
* reported: so do they after a verb of saying, and within quotation marks;
* target: an insult becomes an aimed one if someone or something is in reach of it, within six words before or after: a
  person weighs more than a reference (an article, "this", "is") or another insult, and those more than a plain word right beside it,
  which it may describe; a threat becomes an aimed one if a person follows within three words. All others become plain words.
  That a target follows is guessed, and guesses that fail don't count;
* insult: aimed insults become hits, each after the first in a clause weighing a little more;
* threat: aimed threats become hits, and hits after a threat in the same clause weigh more.

They are composed into one transducer, lazily: its states, tuples of theirs, are made when first reached. An arc's factor is the
product of theirs. A path is worth the sum, over its hits, of the word's weight in the lexicon times the arc's factor; a clause is worth
its best path; a document's score is the logistic function of its clauses' values. A word alone in its clause is worth nothing.
Clauses end at marks and line ends, and have LEAST_WORDS words at least.

The lexicon has seeds (common words of four languages) and stems learned from labels: beginnings of words that
occur in toxic texts far more often than in others, beyond what chance would do among so many. Copies and
near copies count once there (one text for each least five-word hash). Labels come from at most MAX_TOXIC and
MAX_CLEAN labelled rows that are not held out, least xxhash64(doc_id) first: bounds that do not grow with the table, and so
do not the words of those texts, which bound the stems.

Defined cases: null text is empty; an empty text gets the score of no match; without usable labels the seeds and a fixed
curve are used; null labels are left out; repeated rows are scored each by itself; doc_id is a whole number; other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TOXIC, MAX_CLEAN, MIN_DOCS = 4_000, 8_000, 5
STEM_LENGTHS = range(3, 11)
OTHER, INSULT, THREAT, PERSON, REFERENCE, NEGATION, REPORTED, QUOTE, END = range(9)
#: What transducers write besides.
AIMED_INSULT, AIMED_THREAT, HIT = range(9, 12)
SEEDS: dict[int, str] = {
    INSULT: "idiot idiots stupid moron morons loser losers scum trash clown pathetic worthless disgusting dumb imbecile fool bastard jerk creep vermin filth retard freak ugly "
    "dummkopf trottel vollidiot abschaum versager arschloch widerlich erbärmlich connard imbécile crétin salaud ordure abruti minable débile estúpido imbécil basura escoria patético asqueroso inútil",
    THREAT: "kill hurt destroy beat stab shoot murder strangle töten umbringen verprügeln tuer frapper détruire matar golpear destruir",
    PERSON: "you your you're yourself he she they him her them du dich dir ihr euch sie tu toi te vous ton ta tú ti usted ustedes él ella",
    REFERENCE: "the a an this that these those it such is are was were be who der die das den dem des ein eine einen dieser diese dieses ist sind war bist "
    "le la les un une des ce cet cette ces est es sont était el los las una unos unas este esta ese esa lo eres está son era",
    NEGATION: "not no never isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás",
    REPORTED: "said says say told claimed wrote quoted reported sagte sagt schrieb behauptete disait écrit affirma dijo dice escribió",
}
THREAT_WEIGHT = 2.5
#: A clause ends at a mark only if it has so many words: "You! Idiot!" is one.
LEAST_WORDS = 3
SEED_TOXIC, SEED_CLEAN = 2.0, 0.1
#: The curve before labels: intercept, slope of log(1 + sum over clauses), slope of the highest clause.
START = (-4.0, 2.0, 0.5)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.;:!?\n\"«»“”]")


class Transducer:
    """arcs(state, symbol): next states with the symbol written and a factor. State `first` begins a clause, which may end where final(state)."""

    def __init__(self, first, arcs: Callable, final: Callable = lambda state: True):
        self.first, self._arcs, self.final = first, arcs, final
        self._known: dict[tuple, tuple] = {}

    def arcs(self, state, symbol: int) -> tuple:
        if (out := self._known.get((state, symbol))) is None:
            out = self._known[state, symbol] = tuple(self._arcs(state, symbol))
        return out

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this one writes, and factors multiply. States are numbered as they are reached."""
        numbers, states = {(self.first, other.first): 0}, [(self.first, other.first)]

        def arcs(state: int, symbol: int) -> Iterator[tuple]:
            a, b = states[state]
            for to_a, written, f in self.arcs(a, symbol):
                for to_b, out, g in other.arcs(b, written):
                    to = numbers.setdefault((to_a, to_b), len(states))
                    if to == len(states):
                        states.append((to_a, to_b))
                    yield to, out, f * g

        return Transducer(0, arcs, lambda state: self.final(states[state][0]) and other.final(states[state][1]))


def negation(reach: int = 3, factor: float = 0.4) -> Transducer:
    """State: how many words it still reaches."""

    def arcs(left: int, x: int) -> list[tuple]:
        if x == NEGATION:
            return [(reach, OTHER, 1.0)]
        return [(max(0, left - 1), x, factor if left and x in (INSULT, THREAT) else 1.0)]

    return Transducer(0, arcs)


def reported(factor: float = 0.6) -> Transducer:
    """State: 0 outside, 1 after a verb of saying, 2 within quotation marks, until they close or the clause ends."""

    def arcs(state: int, x: int) -> list[tuple]:
        if x == REPORTED:
            return [(max(state, 1), OTHER, 1.0)]
        if x == QUOTE:
            return [(0 if state == 2 else 2, OTHER, 1.0)]
        return [(state, x, factor if state and x in (INSULT, THREAT) else 1.0)]

    return Transducer(0, arcs)


def target(reach: int = 6, after_threat: int = 3, person: float = 1.25, beside: float = 0.5) -> Transducer:
    """State: words for which a person, and a reference, before still counts; whether a plain word stands right before; the kind of target
    promised and the words left for it."""

    def arcs(state: tuple, x: int) -> Iterator[tuple]:
        people, things, plain, kind, left = state
        if kind is not None:
            if x == kind or (kind == REFERENCE and x == INSULT):
                kind, left = None, 0
            elif left == 1:
                return  # the promise failed
            else:
                left -= 1
        people, things = reach if x == PERSON else max(0, people - 1), reach if x in (REFERENCE, INSULT) else max(0, things - 1)
        now = people, things, x == OTHER
        rest = *now, kind, left
        yield rest, OTHER if x in (INSULT, THREAT, PERSON, REFERENCE) else x, 1.0
        if x == INSULT:
            if people:
                yield rest, AIMED_INSULT, person
            if state[1]:
                yield rest, AIMED_INSULT, 1.0
            if plain:
                yield rest, AIMED_INSULT, beside
            for new, f, within in ((PERSON, person, reach), (REFERENCE, 1.0, reach), (OTHER, beside, 1)):
                if kind is None:
                    yield (*now, new, within), AIMED_INSULT, f
                elif kind == new:
                    yield rest, AIMED_INSULT, f
        if x == THREAT and kind in (None, PERSON):
            yield (*now, PERSON, after_threat if kind is None else min(left, after_threat)), AIMED_THREAT, 1.0

    return Transducer((0, 0, False, None, 0), arcs, lambda state: state[3] is None)


def insult(more: float = 1.1) -> Transducer:
    """State: whether the clause had one."""
    return Transducer(0, lambda had, x: [(1, HIT, more if had else 1.0)] if x == AIMED_INSULT else [(had, x, 1.0)])


def threat(more: float = 1.25) -> Transducer:
    """State: whether the clause had one."""
    return Transducer(0, lambda had, x: [(1, HIT, 1.0)] if x == AIMED_THREAT else [(had, x, more if had and x == HIT else 1.0)])


#: The five in their order.
CASCADE = (negation, reported, target, insult, threat)


def grammar() -> Transducer:
    out = CASCADE[0]()
    for make in CASCADE[1:]:
        out = out @ make()
    return out


GRAMMAR = grammar()
_SEEDED = {w: k for k, ws in SEEDS.items() for w in ws.split()}
_MARKS = {x: END for x in ".;:!?\n"} | {x: QUOTE for x in '"«»“”'}


class Lexicon(dict):
    """Symbol and weight of a word; words met last are remembered."""

    def __init__(self, stems: dict[str, float], seeds: dict[str, float], most: int = 60_000):
        super().__init__()
        self.stems, self.seeds, self.most = stems, seeds, most

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        kind = _SEEDED.get(word, _MARKS.get(word, OTHER))
        weight = self.seeds.get(word, 0.0) if kind == INSULT else THREAT_WEIGHT if kind == THREAT else 0.0
        if kind == OTHER and self.stems:
            weight = max((self.stems.get(word[:k], 0.0) for k in range(STEM_LENGTHS.start, min(len(word), STEM_LENGTHS.stop - 1) + 1)), default=0.0)
            kind = INSULT if weight else OTHER
        self[word] = out = (kind, weight)
        return out


def value(clause: list[tuple[int, float]], machine: Transducer = GRAMMAR) -> float:
    """The best path's value of a clause's symbols and weights."""
    active = {machine.first: 0.0}
    for kind, weight in clause:
        reached: dict = {}
        for state, v in active.items():
            for to, out, factor in machine.arcs(state, kind):
                w = v + weight * factor if out == HIT else v
                if w > reached.get(to, -1.0):
                    reached[to] = w
        active = reached
    return max((v for state, v in active.items() if machine.final(state)), default=0.0)


def clauses(text: str, lexicon: Lexicon) -> list[float]:
    """Values of the clauses in which the grammar matches something."""
    low = text.lower()
    if not any(lexicon[w][1] for w in set(_WORD.findall(low))):
        return []
    out, clause = [], []
    for token in _TOKEN.findall(low):
        symbol = lexicon[token]
        if symbol[0] != END or 0 < len(clause) < LEAST_WORDS:
            clause += [symbol] if symbol[0] != END else []
            continue
        if any(weight for _, weight in clause) and (v := value(clause)):
            out.append(v)
        clause = []
    return [*out, v] if any(weight for _, weight in clause) and (v := value(clause)) else out


class Model:
    def __init__(self, stems: dict[str, float] | None = None, seeds: dict[str, float] | None = None, curve: tuple[float, ...] = START):
        self.stems = stems or {}
        self.seeds = seeds or {w: seed_weight(0, 0) for w in SEEDS[INSULT].split()}
        self.curve = curve

    def lexicon(self) -> Lexicon:
        return Lexicon(self.stems, self.seeds)

    def score(self, found: list[float]) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(sum(found)) + c * max(found, default=0.0)))))


def seed_weight(toxic: float, clean: float) -> float:
    return max(0.2, math.log((toxic + SEED_TOXIC) / (clean + SEED_CLEAN)))


def fit_curve(total: np.ndarray, most: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and slopes of a logistic curve over log(1 + sum) and the highest clause, shrunk a little to START."""
    start = np.array(START)
    w, x = start.copy(), np.stack([np.ones_like(total), np.log1p(total), most], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.5 * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(w[0]), float(max(w[1], 0.0)), float(max(w[2], 0.0))


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """doc_id, text, label, key of the bounded sample; key: the least hash of five words in a row."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~common.held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    by = (F.xxhash64("doc_id"), "doc_id")
    known = known.where("label = 1").orderBy(*by).limit(max_toxic).unionByName(known.where("label = 0").orderBy(*by).limit(max_clean))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("label", pa.int32()), ("key", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = common.WordIds()
        for b in batches:
            keys = []
            for t in b.column(1):
                words = ids.array(t.as_py().encode("utf-8", "replace").lower().split())
                h = common.windows(words, 5)
                keys.append(int((h if len(h) else common.mixed(words) if len(words) else np.zeros(1, np.uint64)).min() >> np.uint64(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), b.column(2), pa.array(keys, pa.int64())], schema=schema)

    return common.map_rows(texts, keyed, "doc_id long, text string, label int, key long").dropDuplicates(["label", "key"])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    with common.scope(docs.sparkSession):
        return _train(docs, labels, max_toxic, max_clean)


def _train(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> Model:
    rows = common.cut(sample(docs, labels, max_toxic, max_clean), "toxic-sample")
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model()
    schema = pa.schema([("stem", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(text.as_py().lower()))
                found[min(label, 1)].update({w[:k] for w in words for k in range(STEM_LENGTHS.start, min(len(w), STEM_LENGTHS.stop - 1) + 1)} | {f"={w}" for w in words if w in _SEEDED})
        for at in range(0, len(keys := list(found[0].keys() | found[1].keys())), 50_000):
            part = keys[at : at + 50_000]
            yield common.batch(schema, [part, [found[1][k] for k in part], [found[0][k] for k in part]])

    counts = common.map_rows(rows.select("text", "label"), count, "stem string, toxic long, clean long")
    counts = common.cut(counts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-stems")
    often = F.col("toxic") + F.col("clean") >= MIN_DOCS
    tried = max(2, counts.where(often).count())
    # Twice the log likelihood ratio against an equal rate, and what the best of so many would reach by chance.
    share = n1 / (n1 + n0)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    gain = 2 * (a * F.log(F.greatest(a, F.lit(1e-9)) / ((a + b) * share)) + F.when(b > 0, b * F.log(F.greatest(b, F.lit(1e-9)) / ((a + b) * (1 - share)))).otherwise(0.0))
    odds = F.log((a + 0.5) / (n1 + 1.0) / ((b + 0.5) / (n0 + 1.0)))
    stems = counts.where(often & ~F.col("stem").startswith("=")).withColumn("gain", gain).withColumn("odds", odds)
    stems = stems.where((F.col("gain") > 2 * math.log(tried) + 4) & (F.col("odds") > 2.0))
    found = {r.stem: r for r in stems.collect()}
    # Where one longer stem stands for nearly all texts of a shorter one, the longer one is meant.
    meant: set[str] = {s[:-1] for s, r in found.items() if s[:-1] in found and r.toxic >= 0.95 * found[s[:-1]].toxic}
    learned: dict[str, float] = {}
    for r in sorted((r for s, r in found.items() if s not in meant), key=lambda r: (len(r.stem), r.stem)):
        # A longer stem stands only if it tells clearly more than the stems that it begins with.
        if r.odds > max((learned.get(r.stem[:k], 0.0) for k in range(len(r.stem))), default=0.0) + 0.5:
            learned[r.stem] = r.odds
    told = {r.stem[1:]: (r.toxic, r.clean) for r in counts.where(F.col("stem").startswith("=")).collect()}
    model = Model(learned, {w: seed_weight(*told.get(w, (0, 0))) for w in SEEDS[INSULT].split()})
    fitted = pa.schema([("label", pa.int32()), ("total", pa.float64()), ("most", pa.float64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for b in batches:
            found = [clauses(t.as_py(), lexicon) for t in b.column(0)]
            yield common.batch(fitted, [b.column(1).to_pylist(), [float(sum(x)) for x in found], [float(max(x, default=0)) for x in found]])

    got = common.map_rows(rows.select("text", "label"), sums, "label int, total double, most double").toArrow()
    y, total, most = (got.column(i).to_numpy().astype(float) for i in range(3))
    order = np.lexsort((y, most, total))  # summed in one order: the same curve whatever the partitions
    model.curve = fit_curve(total[order], most[order], np.minimum(y[order], 1.0))
    return model


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_clauses", pa.int64())])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_clauses (matched ones) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for b in batches:
            found = [clauses(t.as_py(), lexicon) for t in b.column(1)]
            yield common.batch(SCORED, [b.column(0).to_pylist(), [model.score(x) for x in found], [len(x) for x in found]])

    return common.map_rows(common.documents(docs), run, "doc_id long, score double, n_clauses long")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for b in batches:
            yield b.filter(pa.array([model.score(clauses(t.as_py() or "", lexicon)) < threshold for t in b.column(at)], pa.bool_()))

    return common.map_rows(docs, run, docs.schema)
