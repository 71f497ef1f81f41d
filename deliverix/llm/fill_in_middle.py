"""Fill-in-the-middle examples: texts cut into prefix, middle and suffix at units, by arithmetic on words of eight bytes.

A unit is white space and the word after it; white space at the end of a text is a unit of its own. The texts of a
batch, padded to whole words, are one array of uint64. The last byte of each unit is marked by additions and masks on whole words,
bitwise_count gives the marks of a word, and their running sum is searched for the word that holds a text's k-th unit end; there
the lower marks are cleared one by one. Characters are counted in the same way.

Defined results: a null or empty text has no units and is plain; a text that holds a marker is plain; a null doc_id draws no form: plain, cut
nowhere; repeated rows get equal results; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverix.llm.common import ship, table, text_bytes
from deliverix.llm.shingles import blocks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of documents that are transformed, and percent of those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42

_BLOCK = 8_000_000
_u = np.uint64
_ONES = _u(0x0101010101010101)
_HIGH, _LOW = _u(0x80) * _ONES, _u(0x7F) * _ONES


def _spaces(w: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is 0x20 or 0x09 to 0x0D. No sum carries into the next byte."""
    seven = w & _LOW
    other = ((seven ^ _u(0x20) * _ONES) + _LOW) & _HIGH  # 0 for the bytes 0x20 and 0xA0
    within = (seven + _u(0x80 - 0x09) * _ONES) & ~(seven + _u(0x80 - 0x0E) * _ONES) & _HIGH
    return (~other | within) & ~w & _HIGH


class Units:
    """Unit ends and characters of the texts of a block."""

    def __init__(self, texts: list[bytes]) -> None:
        self.size = np.array([len(t) for t in texts], np.int64)
        words = (self.size + 7) // 8
        self.first = np.append(0, np.cumsum(words))
        w = np.frombuffer(b"".join(t + b"\0" * (-len(t) % 8) for t in texts), "<u8")
        full = np.flatnonzero(self.size)
        last = self.first[full + 1] - 1  # the last word of each text that has one
        spare = _u(8) * ((8 - self.size[full] % 8) % 8).astype(_u)
        inside = np.full(len(w), _HIGH)
        inside[last] >>= spare
        white = _spaces(w)
        following = white >> _u(8)
        following[:-1] |= white[1:] << _u(56)
        following[last] &= inside[last] >> _u(8)
        self.ends = ~white & following & inside
        self.ends[last] |= _u(0x80 << 56) >> spare  # the end of a text is that of its last unit
        self.begins = (~w | w << _u(1)) & inside  # bytes that don't continue a character
        self.units_to = np.append(0, np.cumsum(np.bitwise_count(self.ends), dtype=np.int64))
        self.chars_to = np.append(0, np.cumsum(np.bitwise_count(self.begins), dtype=np.int64))
        self.n = np.diff(self.units_to[self.first])

    def end_of(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Byte offsets in the texts after their k-th units (from 1; 0 for none)."""
        out = np.zeros(len(text), np.int64)
        some = np.flatnonzero(k > 0)
        rank = self.units_to[self.first[text[some]]] + k[some]
        at = np.searchsorted(self.units_to, rank) - 1
        marks, more = self.ends[at], rank - self.units_to[at] - 1
        for below in range(1, 8):
            marks = np.where(more >= below, marks & (marks - _u(1)), marks)
        place = np.bitwise_count((marks & -marks) - _u(1)).astype(np.int64) >> 3
        out[some] = 8 * (at - self.first[text[some]]) + place + 1
        return out

    def chars_before(self, text: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Characters of the texts before byte offsets."""
        at, rest = self.first[text] + offset // 8, (offset % 8).astype(_u)
        part = np.append(self.begins, _u(0))[at] & ((_u(1) << _u(8) * rest) - _u(1))
        return self.chars_to[at] - self.chars_to[self.first[text]] + np.bitwise_count(part)


@dataclass
class Example:
    """One output: its form, bytes, and the characters of prefix and middle (None if plain)."""

    form: str
    output: bytes
    prefix_chars: int | None = None
    middle_chars: int | None = None


def transform(doc_ids: list[object], texts: list[bytes]) -> Iterator[tuple[int, Example]]:
    """(units, example) of each text."""
    u = Units(texts)
    drawn = [None if i is None else sha256(b"%d:%d" % (SEED, i)).digest()[:16] for i in doc_ids]
    h = np.frombuffer(b"".join(d or bytes(16) for d in drawn), ">u4").astype(np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (u.n[:, None] + 1), 1)
    every = np.arange(len(texts))
    a, b = (u.end_of(every, cuts[:, j]) for j in (0, 1))
    before, within = (u.chars_before(every, x) for x in (a, b))
    for i, text in enumerate(texts):
        if not text or drawn[i] is None or h[i, 2] % 100 >= RATE or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            yield int(u.n[i]), Example("plain", text)
            continue
        prefix, middle, suffix = text[: a[i]], text[a[i] : b[i]], text[b[i] :]
        if h[i, 3] % 100 < SUFFIX_FIRST:
            form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
        else:
            form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
        yield int(u.n[i]), Example(form, b"".join(parts), int(before[i]), int(within[i] - before[i]))


def restore(form: str, output: bytes) -> bytes:
    """The text of an output. A marker can't begin within another, so the first of each is the one that was put there."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    first, _, rest = output.removeprefix(one).partition(two)
    second, _, middle = rest.partition(MIDDLE)
    return second + middle + first if form == "spm" else first + middle + second


def examples(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, output, prefix_chars and middle_chars of every row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    names = ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids, done = text_bytes(b.column(1)), b.column(0).to_pylist(), 0
            for block in blocks(texts, _BLOCK):
                n, made = zip(*transform(ids[done : done + len(block)], block))
                columns = [
                    b.column(0)[done : done + len(block)],
                    pa.array(n, pa.int64()),
                    pa.array([e.form for e in made], pa.string()),
                    pa.array([e.output for e in made], pa.binary()).cast(pa.string()),
                    pa.array([e.prefix_chars for e in made], pa.int64()),
                    pa.array([e.middle_chars for e in made], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done += len(block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long")


def digests(made: DataFrame) -> DataFrame:
    """The examples with digests of the output and of the text that it is restored to, in place of the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, outputs = b.column(2).to_pylist(), text_bytes(b.column(3))
            out = pa.array([sha256(x).hexdigest() for x in outputs], pa.string())
            back = pa.array([sha256(restore(f, x)).hexdigest() for f, x in zip(forms, outputs)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *b.columns[4:], out, back], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return made.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(examples(table(spark, sf_dir, "documents")))


ORACLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS d FROM units
), cut AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
      WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
