"""BPE of whole texts; long ones by tree concatenation.

A text of up to `leaf_chars` is encoded in one go. A longer one, whatever its script, is cut in halves, at its very middle, until
its pieces are that short (only the strings of special tokens are not cut through); the pieces are rows of their own and are
encoded in parallel, wherever there is room. Then neighbours are joined pair by pair, up the tree. At each join a window around
the cut is encoded again, which grows until both of its sides agree with what stands there already:

* A place is sure if the pre-tokenizer ends a piece there whatever else the text holds: before white space, or between letters,
  digits and signs, not after an apostrophe. From the last sure place before the cut to the first one after it the text is
  encoded again. All before and after is as in the whole text, if both sides have a token ending or beginning there.
* Where there is no such place near (a long run of one kind: Chinese, Thai, a long number, blanks), the window is within the one
  piece that the cut is in, some tokens on either side, and is encoded as bytes. It stands if its first and last token are
  both what they would be beside their neighbours, since a sequence of tokens is the encoding of its bytes exactly if that
  holds for every two neighbours in it; else the window is doubled.

Kinds of characters are asked of the pre-tokenizer itself. The vocabulary has to be a byte-level one with that pre-tokenizer; any
other raises ValueError.

Defined cases: null text is empty and gives no ids; repeated rows are encoded each by itself; null ids are kept; doc_id is
a whole number; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

LEAF_CHARS = 32_768
#: What the byte-level pre-tokenizer splits at.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on either side of a cut that a window begins with, and from which on runs of one kind are looked at; what stays free at a run's ends.
WINDOW, RUN, MARGIN = 64, 256, 4
LETTER, DIGIT, SIGN, BLANK = range(4)
_CODECS: dict[str, Codec] = {}


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def parsed(content: str) -> dict:
    """A tokenizers file without truncation and padding; ValueError if it is not of the kind that Codec knows."""
    spec = json.loads(content)
    spec["truncation"] = spec["padding"] = None
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        raise ValueError("not a byte-level vocabulary with the usual pre-tokenizer")
    return spec


def special_strings(spec: dict) -> list[str]:
    """The strings of special tokens, longest first."""
    return sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)


class Codec:
    """A byte-level BPE vocabulary from a tokenizers file."""

    def __init__(self, content: str):
        spec = parsed(content)
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        # The model alone: what becomes of a run of bytes, written as their stand-ins.
        self.run_tokenizer = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "pre_tokenizer": None, "post_processor": None}))
        self.special = special_strings(spec)
        size, to_byte = self.tokenizer.get_vocab_size(with_added_tokens=True), byte_of_char()
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = token.encode() if token in self.special else bytes(to_byte[c] for c in token)
        self.stand_in = {b: ch for ch, b in to_byte.items()}
        self.longest_special = max(map(len, self.special), default=0)
        self.kinds: dict[str, int] = {}
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict) -> tiktoken.Encoding | None:
        """The same vocabulary for an encoder five times as fast, where ids are ranks of merges; else None."""
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranked = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
        marks = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
        if not (ranked and simple) or model.get("dropout") or model.get("ignore_merges"):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in marks.values()}
        return tiktoken.Encoding("keyloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marks)

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode(text, allowed_special="all")
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(t) for t in texts]

    def decode(self, ids: list[int]) -> str:
        b = self.bytes
        return b"".join([b[i] for i in ids]).decode("utf-8", "replace")

    def kind(self, ch: str) -> int:
        """Letter, digit, sign or blank, as the pre-tokenizer has it."""
        if (k := self.kinds.get(ch)) is None:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.kinds[ch] = k = next((k for k, own in ((LETTER, "a"), (DIGIT, "1"), (SIGN, "!")) if len(pieces(own + ch)) == 1), BLANK)
        return k

    def run_ids(self, raw: bytes) -> list[int]:
        return self.run_tokenizer.encode("".join(map(self.stand_in.__getitem__, raw)), add_special_tokens=False).ids

    def together(self, a: int, b: int) -> bool:
        """Whether two neighbours are what their bytes are encoded to."""
        return self.run_ids(self.bytes[a] + self.bytes[b]) == [a, b]


def codec(path: str, content: str | None = None) -> Codec:
    """The vocabulary of a file, read once a process; executors get the content along with the task."""
    if path not in _CODECS:
        if content is None:
            with open(path, encoding="utf-8") as f:
                content = f.read()
        _CODECS[path] = Codec(content)
    return _CODECS[path]


def cut_place(text: str, special: list[str]) -> int | None:
    """The middle of `text`, or an end of the special string that stands there; None if that is all there is."""
    at = len(text) // 2
    for s in special:
        p = text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)
        if 0 <= p < at < p + len(s):
            at = p or p + len(s)
    return at if 0 < at < len(text) else None


def split_tree(text: str, special: list[str], leaf_chars: int = LEAF_CHARS) -> list[tuple[str, int]]:
    """Leaves from left to right, each with the depth of the join to its right (-1: none)."""
    out: list[tuple[str, int]] = []

    def walk(part: str, depth: int, after: int) -> None:
        place = cut_place(part, special) if len(part) > leaf_chars else None
        if place is None:
            out.append((part, after))
            return
        walk(part[:place], depth + 1, depth)
        walk(part[place:], depth + 1, after)

    walk(text, 0, -1)
    return out


def tail(c: Codec, ids: list[int], chars: int) -> tuple[str, bool]:
    """The text of the last tokens, at least so many characters, and whether it is all."""
    k = size = 0
    while k < len(ids) and size < 4 * chars:
        k += 1
        size += len(c.bytes[ids[-k]])
    raw = b"".join([c.bytes[i] for i in ids[len(ids) - k :]])
    skip = next((p for p in range(min(4, len(raw))) if raw[p] & 0xC0 != 0x80), 0)  # the rest of a character cut by a token's end
    return raw[skip:].decode("utf-8"), k == len(ids)


def head(c: Codec, ids: list[int], chars: int) -> tuple[str, bool]:
    """The text of the first tokens, at least so many characters, and whether it is all."""
    k = size = 0
    while k < len(ids) and size < 4 * chars:
        size += len(c.bytes[ids[k]])
        k += 1
    return b"".join([c.bytes[i] for i in ids[:k]]).decode("utf-8", "strict" if k == len(ids) else "ignore"), k == len(ids)


def sure_places(c: Codec, text: str) -> list[int]:
    """Places at which the pre-tokenizer ends a piece, whatever stands before and after `text`."""
    kinds = [c.kind(ch) for ch in text]
    inside = {p + k for s in c.special for p in _places(text, s) for k in range(1, len(s))}
    return [p for p in range(1, len(text)) if kinds[p - 1] != BLANK and kinds[p] != kinds[p - 1] and (kinds[p] == BLANK or text[p - 1] != "'") and p not in inside]


def _places(text: str, s: str) -> Iterator[int]:
    p = text.find(s)
    while p >= 0:
        yield p
        p = text.find(s, p + 1)


def taken(c: Codec, ids: Iterator[int], size: int) -> int | None:
    """How many of ids make up `size` bytes; None if none ends there."""
    k = 0
    while size > 0:
        size -= len(c.bytes[next(ids)])
        k += 1
    return k if size == 0 else None


def join_at_sure_places(c: Codec, left: list[int], right: list[int], before: tuple[str, bool], after: tuple[str, bool]) -> list[int] | None:
    """Encodes again what stands between sure places, if there are some in the texts before and after the cut."""
    # At the outer end of a part of a text, a special string may be cut.
    i = max((p for p in sure_places(c, before[0]) if before[1] or p >= c.longest_special), default=0 if before[1] else None)
    j = min((p for p in sure_places(c, after[0]) if after[1] or p <= len(after[0]) - c.longest_special), default=len(after[0]) if after[1] else None)
    if i is None or j is None:
        return None
    x, y = before[0][i:], after[0][:j]
    a, b = taken(c, reversed(left), len(x.encode())), taken(c, iter(right), len(y.encode()))
    return None if a is None or b is None else left[: len(left) - a] + c.encode(x + y) + right[b:]


def join_in_run(c: Codec, left: list[int], right: list[int], before: str, after: str) -> list[int] | None:
    """Encodes bytes around a cut within a long run of one kind again, in windows that grow until both sides agree."""
    kind = c.kind(before[-1])
    if c.kind(after[0]) != kind:
        return None
    own_a = next((k for k, ch in enumerate(reversed(before)) if c.kind(ch) != kind), len(before)) - max(MARGIN, c.longest_special)
    own_b = next((k for k, ch in enumerate(after) if c.kind(ch) != kind), len(after)) - max(MARGIN, c.longest_special)
    most_a, most_b = len(before[len(before) - max(own_a, 0) :].encode()), len(after[: max(own_b, 0)].encode())
    width = 4
    while True:
        x, y = b"".join([c.bytes[i] for i in left[-width:]]), b"".join([c.bytes[i] for i in right[:width]])
        # The neighbours that have to agree are tokens of the same piece as well.
        if width >= len(left) or width >= len(right) or len(x) + len(c.bytes[left[-width - 1]]) > most_a or len(y) + len(c.bytes[right[width]]) > most_b:
            return None
        middle = c.run_ids(x + y)
        if c.together(left[-width - 1], middle[0]) and c.together(middle[-1], right[width]):
            return left[:-width] + middle + right[width:]
        width *= 2


def join(c: Codec, left: list[int], right: list[int]) -> list[int]:
    """Ids of the text whose halves have the ids `left` and `right`."""
    if not left or not right:
        return left + right
    chars = WINDOW
    while True:
        before, after = tail(c, left, chars), head(c, right, chars)
        out = join_at_sure_places(c, left, right, before, after)
        if out is None and chars >= RUN:
            out = join_in_run(c, left, right, before[0], after[0])
        if out is not None:
            return out
        if before[1] and after[1]:
            return c.encode(before[0] + after[0])
        chars *= 2


def join_tree(c: Codec, leaves: list[tuple[list[int], int]]) -> list[int]:
    """Joins neighbours from the deepest join upwards; leaves as split_tree() gives them, with ids for texts."""
    done: list[tuple[list[int], int]] = []
    for ids, depth in leaves:
        # A leaf closes all joins to its left that are deeper than the one to its right.
        while done and done[-1][1] > depth:
            ids = join(c, done.pop()[0], ids)
        done.append((ids, depth))
    return done[0][0] if done else []


def digest(c: Codec, doc_id, place, ids: list[int]) -> tuple:
    return doc_id, place, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest(), ids


DIGEST = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])


def encode_documents(docs: DataFrame, vocabulary: str, leaf_chars: int = LEAF_CHARS, with_ids: bool = True, place: str | None = None) -> DataFrame:
    """One row per row of docs: n_tokens, digests of ids and of the decoded text, and the ids themselves; with `place`, a
    column of whole numbers, that too (rows come in no order).

    Long texts' leaves are dealt out by row and place, so one huge text keeps many tasks busy; its leaves' ids (far
    shorter than the text) meet again in the task that joins them.
    """
    schema = pa.schema(list(DIGEST)[: 6 if with_ids else 5])
    columns = "doc_id long, place long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    # The driver checks the file but builds no codec, which would take some 60 MB of it for good.
    special, width = special_strings(parsed(text)), len(schema)
    content = docs.sparkSession.sparkContext.broadcast(text)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return common.batch(schema, list(zip(*(r[:width] for r in found), strict=True)) if found else [[] for _ in schema])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, content.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield rows([digest(c, i, p, ids) for i, p, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), c.encode_batch(texts), strict=True)])

    leaf = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("leaf", pa.int32()), ("depth", pa.int32()), ("text", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for doc_id, text, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                yield common.batch(leaf, list(zip(*((doc_id, p, part, row, k, d, t) for k, (t, d) in enumerate(split_tree(text.as_py(), special, leaf_chars))), strict=True)))
                row += 1

    coded = pa.schema([*list(leaf)[:6], ("ids", pa.binary())])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, content.value)
        for b in batches:
            ids = [np.asarray(x, "<u4").tobytes() for x in c.encode_batch(b.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(ids, pa.binary())], schema=coded)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, content.value)
        at, own = None, []
        for b in batches:
            for r in b.to_pylist():
                if at is not None and at[2:] != (r["part"], r["row"]):
                    yield rows([digest(c, *at[:2], join_tree(c, own))])
                    own = []
                at = r["doc_id"], r["place"], r["part"], r["row"]
                own.append((np.frombuffer(r["ids"], "<u4").tolist(), r["depth"]))
        if at is not None:
            yield rows([digest(c, *at[:2], join_tree(c, own))])

    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), (F.col(place) if place else F.lit(None)).cast("long").alias("place"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = common.map_rows(texts.where(F.length("text") <= leaf_chars), whole, columns)
    long = common.map_rows(texts.where(F.length("text") > leaf_chars), split, "doc_id long, place long, part int, row long, leaf int, depth int, text string")
    long = common.map_rows(long.repartition(n, "part", "row", "leaf"), leaves, "doc_id long, place long, part int, row long, leaf int, depth int, ids binary")
    long = long.repartition(n, "part", "row").sortWithinPartitions("part", "row", "leaf")
    out = short.unionByName(common.map_rows(long, joined, columns))
    return out if place else out.drop("place")
