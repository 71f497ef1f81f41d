"""Document fingerprints by prefix polynomial hashes.

The prefix array of a text holds, for each place, the polynomial of the code points before it modulo a
prime. The hash of any span is a difference of two entries brought to a common power, so spans of any
texts compare in constant time and longest common extensions are found by binary search. The fingerprint
of a text is its length, the hash of the whole, and a sketch: of the hashes of all spans of SPAN code
points, the least in each of LANES classes. A text is preceded by blanks for this, so that one shorter than a span has
as many spans as code points, and texts of any lengths compare. The likeness of two fingerprints is the share of equal
lanes.

Defined results: a null text is an empty text; equal fingerprints have likeness 1, that of an empty and another text
is 0; documents with one doc_id follow each other in an order that their texts' hashes give; null doc_ids come first; a
table of one row is its own next document; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverix.llm.common import mix, small_batches, stored, table

#: Code points of a span; lanes of a sketch.
SPAN, LANES = 16, 64
#: Primes below 2 ** 31 and the bases of their polynomials.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525)


class _Powers:
    """Powers of a base and of its inverse, as many as were asked for."""

    def __init__(self, prime: int, base: int) -> None:
        self.prime, self.bases = prime, (base, pow(base, -1, prime))
        self.tables = [np.ones(1, np.int64), np.ones(1, np.int64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k in (0, 1):
            t = self.tables[k]
            while len(t) < n:
                t = np.concatenate([t, t * pow(self.bases[k], len(t), self.prime) % self.prime])
            self.tables[k] = t
        return self.tables[0][:n], self.tables[1][:n]


_powers = [_Powers(p, b) for p, b in zip(PRIMES, BASES)]


class PrefixHash:
    """Prefix arrays of one text, modulo each prime."""

    def __init__(self, text: str) -> None:
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        self.n = len(self.points)
        self.prefix = []
        for powers, prime in zip(_powers, PRIMES):
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(self.points * powers.upto(self.n + 1)[0][: self.n] % prime, out=sums[1:])
            self.prefix.append(sums % prime)

    def span(self, start: int, length: int) -> tuple[int, int]:
        """Hash of a span, the same wherever it stands."""
        return tuple(int((int(p[start + length]) - int(p[start])) * int(w.upto(self.n + 1)[1][start]) % w.prime) for p, w in zip(self.prefix, _powers))

    def spans(self, length: int, lane: int = 0) -> np.ndarray:
        """Hashes, modulo one prime, of the spans of a length that end at each code point; before the text stand blanks, of value 0."""
        p, w = self.prefix[lane], _powers[lane]
        powers, inverse = w.upto(max(self.n + 1, length))
        k = min(length - 1, self.n)
        head = p[1 : k + 1] * powers[length - k : length][::-1] % w.prime
        d = p[length:] - p[: max(self.n + 1 - length, 0)]
        return np.concatenate([head, (d + (d < 0) * w.prime) * inverse[: len(d)] % w.prime])

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common extension of both texts from two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, mid) == other.span(at, mid):
                low = mid
            else:
                high = mid - 1
        return low


def fingerprint(h: PrefixHash) -> str:
    """Hexadecimal: length, hash of the whole, and LANES lanes of 16 bits (0 where no span fell)."""
    lanes = np.zeros(LANES, np.uint16)
    if h.n:
        x = mix(h.spans(SPAN).view(np.uint64) + (np.uint64(SPAN) << np.uint64(32)))
        lane = (x % np.uint64(LANES)).astype(np.int64)
        low = np.full(LANES, 2**64 - 1, np.uint64)
        np.minimum.at(low, lane, x)
        full = low < 2**64 - 1
        lanes[full] = np.maximum(mix(low[full] ^ np.uint64(LANES)) & np.uint64(0xFFFF), 1)
    a, b = h.span(0, h.n)
    return f"{h.n:010x}{a:08x}{b:08x}" + lanes.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[26:]), ">u2") for s in (a, b))
    some = (x > 0) | (y > 0)
    return float(((x == y) & some).sum() / some.sum()) if some.any() else 0.0


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, shared_prefix long"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _row(doc_id: int | None, text: str, h: PrefixHash, print_: str, following: str, next_print: str) -> tuple:
    edited = edit(text, following)
    e = h if edited == text else PrefixHash(edited)
    f = print_ if e is h else fingerprint(e)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
    return doc_id, len(text), digest, bytes.fromhex(print_), bytes.fromhex(f), likeness(print_, f), likeness(print_, next_print), h.extension(0, e, 0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of docs(doc_id, text) and of its edited text; see _OUT.

    Tasks hold ranges of doc_id in order. What a task can't pair (its last document with the next range's
    first) leaves it as two edge rows; these few rows are paired in a second step, in which a window over the numbers of the
    tasks tells which task follows and a join brings its first text.
    """
    small_batches(docs.sparkSession)
    schema = f"{_OUT}, part long, role int, edge_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 11
            kinds = [*_KINDS, pa.int64(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*_NAMES, "part", "role", "edge_text"])

        edge = lambda role: (last[0], *[None] * 7, part, role, last[1])
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                h = PrefixHash(text)
                now = (doc_id, text, h, fingerprint(h))
                if last is None:
                    last = now
                    rows.append(edge(0))
                else:
                    rows.append((*_row(*last, text, now[3]), None, None, None))
                last = now
            yield out(rows)
        if last is not None:
            yield out([edge(1)])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))  # the rows of one doc_id may be several ranges
    ordered = keyed.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    found = stored(ordered.mapInArrow(run, schema), "fingerprints")
    parts = found.filter("role = 0").select("part")
    order = W.orderBy("part")  # a number for each task
    follows = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order)).alias("then"))
    firsts = found.filter("role = 0").select(F.col("part").alias("then"), F.col("edge_text").alias("following"))
    ends = found.filter("role = 1").select("part", "doc_id", "edge_text").join(follows, "part").join(firsts, "then")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, following in zip(*(c.to_pylist() for c in b.columns)):
                h = PrefixHash(text)
                rows.append(_row(doc_id, text, h, fingerprint(h), following, fingerprint(PrefixHash(following))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, _KINDS)], names=_NAMES)

    rows = found.filter("role is null").select(*_NAMES).unionAll(ends.select("doc_id", "edge_text", "following").mapInArrow(close, _OUT))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
