"""Fingerprints of whole texts from prefix polynomial hashes.

`PrefixHash` keeps, for two primes, the prefix sums of c_i * B^i. The hash of any span is the difference of two
prefix values times a power of B, so two spans, in one text or two, are compared in O(1), and the longest common
extension of two places is found by binary search in O(log n).

A fingerprint is a string of three parts: the length, the hash of the whole text, and the `KEEP` least (after mixing)
hashes of its spans of `SPAN` code points (shorter texts: the whole text). Equal texts have equal fingerprints. The likeness
of two fingerprints estimates the share of spans in common (Dice), from the least `KEEP` hashes of both sets together;
it is exact when both texts have no more than `KEEP` different spans.

Defined cases: null text is empty; an empty text has no spans, is 1 like another empty one and 0 like anything
else; "next" is the next row in order of (doc_id, text), nulls first, so repeated rows follow each other and the last row
is followed by the first; a table of one row is its own next; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
SPAN, KEEP = 16, 32
_U = np.uint64


class Powers:
    """B^i and B^-i modulo each prime, grown when needed."""

    def __init__(self):
        self.n = 0
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def reach(self, n: int) -> None:
        if n <= self.n:
            return
        n = max(1024, 1 << (n - 1).bit_length())
        self.up = [self._series(b, p, n) for b, p in zip(BASES, PRIMES, strict=True)]
        self.down = [self._series(pow(b, -1, p), p, n) for b, p in zip(BASES, PRIMES, strict=True)]
        self.n = n

    @staticmethod
    def _series(b: int, p: int, n: int) -> np.ndarray:
        out = np.ones(n, _U)
        done = 1
        while done < n:  # doubling: the next stretch is the last one times B^done
            k = min(done, n - done)
            out[done : done + k] = out[:k] * _U(pow(b, done, p)) % _U(p)
            done += k
        return out


POWERS = Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, points: np.ndarray):
        n = self.n = len(points)
        POWERS.reach(n + 1)
        values = points.astype(_U) + _U(1)
        self.sums = []
        for up, p in zip(POWERS.up, PRIMES, strict=True):
            s = np.zeros(n + 1, _U)
            np.cumsum(values * up[:n] % _U(p), out=s[1:])
            s %= _U(p)
            self.sums.append(s)

    def span(self, i: int, j: int) -> int:
        """The hash of [i, j): equal for equal spans anywhere."""
        out = 0
        for s, down, p in zip(self.sums, POWERS.down, PRIMES, strict=True):
            out = out << 31 | (int(s[j]) - int(s[i])) % p * int(down[i]) % p
        return out

    def spans(self, w: int) -> np.ndarray:
        """Hashes of all spans of w code points."""
        n = self.n - w + 1
        out = np.zeros(max(n, 0), _U)
        if n > 0:
            for s, down, p in zip(self.sums, POWERS.down, PRIMES, strict=True):
                d = s[w:] + _U(p) - s[:n]
                out = out << _U(31) | d % _U(p) * down[:n] % _U(p)
        return out

    def common_prefix(self, other: PrefixHash, i: int = 0, j: int = 0) -> int:
        """Length of the longest common extension of place i here and place j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


def least(h: PrefixHash) -> list[int]:
    if h.n == 0:
        return []
    spans = common.mixed(h.spans(SPAN) if h.n >= SPAN else np.array([h.span(0, h.n)], _U)) >> _U(24)
    if len(spans) > 16 * KEEP:
        # copies of a hash count once, so take more of the least until enough differ
        k = 4 * KEEP
        while True:
            part = np.unique(np.partition(spans, k)[:k] if k < len(spans) else spans)
            if len(part) >= KEEP or k >= len(spans):
                return part[:KEEP].tolist()
            k *= 8
    return np.unique(spans)[:KEEP].tolist()


def fingerprint(h: PrefixHash) -> str:
    return f"{h.n:x}.{h.span(0, h.n):016x}." + "".join(f"{x:010x}" for x in least(h))


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 10] for i in range(0, len(s), 10)} for s in (a.rpartition(".")[2], b.rpartition(".")[2]))
    if not x or not y:
        return 0.0
    if len(x) < KEEP and len(y) < KEEP:
        return 2 * len(x & y) / (len(x) + len(y))
    both = sorted(x | y)[:KEEP]
    shared = sum(v in x and v in y for v in both) / len(both)
    return 2 * shared / (1 + shared)


def edit(text: str, following: str) -> str:
    """The last half of `text` replaced by as many of the first code points of `following`, or all."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_with_edited", pa.int64()), ("common_with_next", pa.int64())])


def row(doc_id, text: str, h: PrefixHash, print_: str, next_text: str, next_h: PrefixHash, next_print: str) -> tuple:
    edited = edit(text, next_text)
    e = PrefixHash(code_points(edited))
    edited_print = fingerprint(e)
    return doc_id, h.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print), h.common_prefix(e), h.common_prefix(next_h)


def by_bucket(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, guest: rows by ranges of doc_id, with the first row of each range also as the guest of the one before.

    The ranges lie between quantiles of doc_id, four to a partition. Those cuts and the first id of each range are all
    that comes to the driver; texts are shuffled once.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20_000)).first()[0]
    cuts = np.unique(np.asarray(cuts or [], np.int64))

    def place(ids: pa.Array) -> np.ndarray:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, known, "right"))

    least_id = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("doc_id", pa.int64())])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for b in batches:
            for k, i in zip(place(b.column(0)).tolist(), b.column(0).to_pylist(), strict=True):
                v = (i is not None, i or 0)
                if k not in found or v < found[k]:
                    found[k] = v
        yield common.batch(least_id, [list(found), [v[0] for v in found.values()], [v[1] for v in found.values()]])

    first = common.map_rows(docs.select("doc_id"), firsts, "bucket int, known boolean, doc_id long")
    first = sorted((r.bucket, *r.first) for r in first.groupBy("bucket").agg(F.min(F.struct("known", "doc_id")).alias("first")).collect())
    #: id of a range's first row -> the range before it; before the first range comes the last
    host = {(i if known else None): first[k - 1][0] for k, (_, known, i) in enumerate(first)}
    dealt = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("bucket", pa.int32()), ("guest", pa.bool_())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(place(b.column(0)), pa.int32()), pa.array([False] * len(b), pa.bool_())], schema=dealt)
            also = [(i, host[x]) for i, x in enumerate(b.column(0).to_pylist()) if x in host]
            if also:
                at = pa.array([i for i, _ in also], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), text.take(at), pa.array([k for _, k in also], pa.int32()), pa.array([True] * len(also), pa.bool_())], schema=dealt)

    return common.map_rows(common.documents(docs), deal, "doc_id long, text string, bucket int, guest boolean")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its fingerprint, that of the edited text, likenesses, and exact common prefixes."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, prev = [], None, None
        for b in batches:
            for doc_id, text, bucket, guest in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if bucket != at:
                    at, prev = bucket, None
                elif prev is None:
                    continue  # the guest has been met: others are copies of its id
                text = text.as_py()
                h = PrefixHash(code_points(text))
                print_ = fingerprint(h)
                if prev is not None:
                    out.append(row(*prev, text, h, print_))
                prev = None if guest else (doc_id, text, h, print_)
                if len(out) >= common.BATCH_ROWS:
                    yield common.batch(SCHEMA, list(zip(*out, strict=True)))
                    out = []
        if out:
            yield common.batch(SCHEMA, list(zip(*out, strict=True)))

    near = by_bucket(docs).repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return common.map_rows(near, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_with_edited long, common_with_next long")
