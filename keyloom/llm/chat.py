"""Chat formatting by event-sourced reconstruction.

`fold` turns a log of events into final messages. Events have conv_id, message_id, seq, kind, role, text:

* message: a whole message, in place of what stood so far;  start: opens one (its text may be empty);  delta: appended in order of seq;
* edit: replaces what stood so far;  regenerate: throws away what stood so far, and its text, if any, begins anew;
* delete: the message goes, and deltas after it too, unless a later start, edit, regenerate or message brings it back.

The log is partitioned by conversation and, within it, by message and sequence, in ranges, and folded as a sorted stream: one
message's standing text is all that a task holds. A range may end within a conversation or within a message, so a conversation, or
one message, with a third of all events is dealt out over many tasks; the folds of a message's stretches are then put
together (a stretch either begins anew or appends). A message stands at its first event's seq; its role is the last one told.
Messages of a conversation are then ordered by (seq, role, text), nulls first. Events of the same seq are taken by kind, text, role.

`render` writes turns as `<|im_start|>role\\ntext<|im_end|>\\n`. Within roles and texts, each `<`, backslashes,
`|` gets one backslash more, so no control string can appear and reading takes it away again; a role's line breaks
and backslashes are escaped too. Rows are range-sorted by (conv_id, seq) and packed into blocks of rendered turns,
so that a hot conversation is rendered by many tasks; only blocks are then brought together by conversation, in order,
and read as a stream with running hashes: no conversation is ever held as a whole.

Defined cases: null text is empty, null role is the empty role; null conv_id is one conversation; null seq sorts first;
repeated rows of kind message are one turn if they have the same message_id, and turns of their own if it is null (no event can
name those); a conversation of deleted messages alone isn't returned; an
empty log gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>\n"
BLOCK_CHARS = 262_144
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered turns."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_spans(formatted: str, trained: str = "assistant") -> list[tuple[int, int]]:
    """Where the rendered text of the trained role stands."""
    return [m.span(2) for m in _TURN.finditer(formatted) if unescape_role(m[1]) == trained]


KINDS = ("message", "start", "delta", "edit", "regenerate", "delete")
#: A stretch of a message's log, folded: its first seq, last role, whether it begins anew (0: appends to what stood before, 1: anew,
#: 2: deleted), its text, and whether the message may go on in a neighbouring partition.
STRETCH = pa.schema([("conv_id", pa.int64()), ("message_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("role", pa.string()), ("fresh", pa.int32()), ("text", pa.string()), ("edge", pa.bool_())])


class Stretch:
    """The running fold of one message's events, in order."""

    def __init__(self, conv_id, message_id, seq):
        self.key, self.seq, self.role, self.fresh, self.pieces = (conv_id, message_id), seq, None, 0, []

    def take(self, kind: str, role: str | None, text: str | None) -> None:
        if role is not None:
            self.role = role
        if kind != "delta":
            self.fresh, self.pieces = 2 if kind == "delete" else 1, []
        elif self.fresh == 2:
            return
        if text and kind != "delete":
            self.pieces.append(text)

    def row(self, part: int, edge: bool) -> tuple:
        return *self.key, part, self.seq, self.role, self.fresh, "".join(self.pieces), edge


def fold(events: DataFrame) -> DataFrame:
    """Final messages conv_id, seq, role, text of a log of events."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            out = []
            for conv_id, message_id, seq, kind, role, text in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if at is None or at.key != (conv_id, message_id):
                    if at is not None:
                        out.append(at.row(part, first))
                        first = False
                    at = Stretch(conv_id, message_id, seq)
                at.take(kind, role, text)
            if out:
                yield common.batch(STRETCH, list(zip(*out, strict=True)))
        if at is not None:
            yield common.batch(STRETCH, [[x] for x in at.row(part, True)])

    unnamed = (F.col("kind") == "message") & F.col("message_id").isNull()
    whole = events.where(unnamed).select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = events.where(F.coalesce(F.col("kind"), F.lit("")).isin(*KINDS) & ~F.coalesce(unnamed, F.lit(False))).select("conv_id", "message_id", "seq", "kind", "role", "text")
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "message_id", "seq", "kind")]
    dealt = e.repartitionByRange(n, *by).sortWithinPartitions(*by, F.col("text").asc_nulls_first(), F.col("role").asc_nulls_first())
    columns = "conv_id long, message_id long, part int, seq long, role string, fresh int, text string, edge boolean"
    parts = common.cut(common.map_rows(dealt, run, columns), "stretches")
    # A message that partitions share: two rows a partition at most, put together in order.
    log = F.array_sort(F.collect_list(F.struct("part", "seq", "role", "fresh", "text")))
    shared = parts.where("edge").groupBy("conv_id", "message_id").agg(log.alias("log"))
    anew = F.array_max(F.transform("log", lambda x, i: F.when(x["fresh"] > 0, i).otherwise(F.lit(0))))
    shared = shared.withColumn("from", anew)
    role = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())), -1)
    text = F.array_join(F.transform(F.slice("log", F.col("from") + 1, F.size("log")), lambda x: x["text"]), "")
    shared = shared.select("conv_id", F.get("log", F.lit(0))["seq"].alias("seq"), role.alias("role"), F.get("log", F.col("from"))["fresh"].alias("fresh"), text.alias("text"))
    final = parts.where("not edge").select("conv_id", "seq", "role", "fresh", "text").unionByName(shared).where("fresh < 2")
    return whole.unionByName(final.select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), "text"))


BLOCK = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("formatted", pa.string())])


def render(messages: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rendered turns in blocks: conv_id, and by (seq, part, block) their order."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, out = TaskContext.get().partitionId(), 0, []
        at, seq, turns, size = None, None, [], 0
        for b in batches:
            for conv_id, s, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if turns and (conv_id != at or size >= block_chars):
                    out.append((at, seq, part, k, "".join(turns)))
                    k, turns, size = k + 1, [], 0
                if not turns:
                    at, seq = conv_id, s
                turns.append(render_turn(role, text))
                size += len(turns[-1])
            if out:
                yield common.batch(BLOCK, list(zip(*out, strict=True)))
                out = []
        if turns:
            yield common.batch(BLOCK, [[x] for x in (at, seq, part, k, "".join(turns))])

    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("seq").asc_nulls_first(), "role", "text"]
    # The place in its partition orders blocks of the same seq: part numbers rise with the range.
    dealt = messages.select("conv_id", "seq", "role", "text").repartitionByRange(n, *by).sortWithinPartitions(*by)
    return common.map_rows(dealt, run, "conv_id long, seq long, part int, block long, formatted string")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class Reader:
    """Running digests of one conversation, from its rendered blocks."""

    def __init__(self, conv_id, trained: str):
        self.conv_id, self.trained = conv_id, trained
        self.turns = self.loss = self.chars = 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == self.trained:
                self.loss += len(text)
                self.under.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.under.hexdigest(), self.chars


def digests(blocks: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation, read back from its rendered blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Reader | None = None
        for b in batches:
            out = []
            for conv_id, formatted in zip(b.column(0).to_pylist(), b.column(4), strict=True):
                if at is None or at.conv_id != conv_id:
                    if at is not None:
                        out.append(at.row())
                    at = Reader(conv_id, trained)
                at.take(formatted.as_py())
            if out:
                yield common.batch(DIGEST, list(zip(*out, strict=True)))
        if at is not None:
            yield common.batch(DIGEST, [[x] for x in at.row()])

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = blocks.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "block")
    return common.map_rows(near, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
