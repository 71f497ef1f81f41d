"""Hierarchical multi-length packing of token ids into training sequences.

Each document is its ids and an end id. Whole windows of it are sequences of the longest tier; the rest
goes to the tier of its length. The longest tier opens a window for each rest and fills the gap with the
best fitting pieces of shorter tiers, cutting one where none fits; then each shorter tier fills windows of
its own length in the same way. Tiers are powers of two, so a full window of any tier has no padding; what
is left of a block of documents at last is cut into windows of powers of two. Blocks have a bounded number
of ids and are packed inside the task that encodes them: no shuffle, and no document waits for another task.
Sequences of a block are dealt to step groups of nearly equal numbers of tokens, longest first.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; a null doc_id stays
null; an empty table gives no rows. Sequence ids hold the task's partition, so a task that is run again gives
the same rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from deliverix.llm.common import small_batches, table, text_bytes
from deliverix.llm.tokens import encoder_for

TIERS = (2048, 1024, 512, 256)
END = 1
#: Ids that a task holds before it packs them, and the tokens of a step group.
BLOCK, STEP = 4_000_000, 65_536

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class _Shelf:
    """Pieces (document, start) by length, with the longest piece of at most a length at hand."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def put(self, length: int, piece: tuple[int, int]) -> None:
        self.by.setdefault(length, []).append(piece)
        self.mask |= 1 << length

    def longest(self, most: int) -> int:
        return (self.mask & ((2 << most) - 1)).bit_length() - 1

    def take(self, length: int) -> tuple[int, int]:
        pieces = self.by[length]
        piece = pieces.pop()
        if not pieces:
            del self.by[length]
            self.mask ^= 1 << length
        return piece

    def fill(self, gap: int) -> list[tuple[int, int, int]]:
        """Pieces (document, start, length) that fill a gap wholly if the shelf has as much: best fits first, then one cut."""
        out = []
        while gap and self.mask:
            n = self.longest(gap)
            if n > 0:
                out.append((*self.take(n), n))
                gap -= n
            else:  # every piece is longer than the gap: cut the shortest
                n = (self.mask & -self.mask).bit_length() - 1
                doc, start = self.take(n)
                out.append((doc, start, gap))
                self.put(n - gap, (doc, start + gap))
                gap = 0
        return out


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (length, [(document, start, length)]) that hold every token of every document once."""
    top = tiers[0]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    rests: list[tuple[int, int, int]] = []
    shelf = _Shelf()
    for doc, n in enumerate(lengths):
        whole = n - n % top
        windows += [(top, [(doc, s, top)]) for s in range(0, whole, top)]
        if n > whole:
            if n - whole > top // 2:
                rests.append((doc, whole, n - whole))
            else:
                shelf.put(n - whole, (doc, whole))
    rests.sort(key=lambda p: (-p[2], p[0]))
    left = 0
    while left < len(rests):
        piece = rests[left]
        left += 1
        window, gap = [piece], top - piece[2]
        more = shelf.fill(gap)
        gap -= sum(p[2] for p in more)
        while gap and left < len(rests):  # the shelf is empty: cut the last and shortest rest
            doc, start, n = rests[-1]
            k = min(gap, n)
            more.append((doc, start, k))
            gap -= k
            rests.pop()
            if n > k:
                rests.append((doc, start + k, n - k))
        if gap:
            for p in window + more:
                shelf.put(p[2], p[:2])
        else:
            windows.append((top, window + more))
    for tier in tiers[1:]:
        while shelf.mask and shelf.mask.bit_length() - 1 > tier // 2:
            n = shelf.mask.bit_length() - 1
            if n > tier:
                doc, start = shelf.take(n)
                windows.append((tier, [(doc, start, tier)]))
                shelf.put(n - tier, (doc, start + tier))
                continue
            window = shelf.fill(tier)
            if sum(p[2] for p in window) < tier:
                for p in window:
                    shelf.put(p[2], p[:2])
                break
            windows.append((tier, window))
    total = sum(n * len(p) for n, p in shelf.by.items())
    while total:
        size = min(top, 1 << (total.bit_length() - 1))
        windows.append((size, shelf.fill(size)))
        total -= size
    return windows


def step_groups(sizes: list[int], tokens: int = STEP) -> list[int]:
    """A group for each window, with nearly equal sums: the longest windows first, each to the least filled group."""
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        filled, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (filled + sizes[i], g))
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """A row for each piece of each document of docs(doc_id, text); see SCHEMA."""
    small_batches(docs.sparkSession)

    def packed(ids: list, tokens: list[np.ndarray], base: int, group: int) -> tuple[pa.RecordBatch, int, int]:
        windows = pack([len(t) for t in tokens])
        groups = step_groups([n for n, _ in windows])
        rows: list[tuple] = []
        for w, (size, pieces) in enumerate(windows):
            offset = 0
            for doc, start, n in pieces:
                crc = zlib.crc32(tokens[doc][start : start + n])
                rows.append((ids[doc], start, n, crc, len(tokens[doc]), base + w, offset, size, group + groups[w]))
                offset += n
        columns = [pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(zip(*rows))]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")]), base + len(windows), group + max(groups) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary)
        base = group = TaskContext.get().partitionId() << 36
        ids, tokens, held = [], [], 0
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), encoder(text_bytes(b.column(1)))):
                t = np.append(t, np.uint32(end)).astype("<u4")
                ids.append(doc_id)
                tokens.append(t)
                held += len(t)
                if held >= BLOCK:
                    out, base, group = packed(ids, tokens, base, group)
                    yield out
                    ids, tokens, held = [], [], 0
        if ids:
            yield packed(ids, tokens, base, group)[0]

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pack_by_default(docs: DataFrame) -> DataFrame:
    """With the ids of the tokenizers library and its byte_bpe_50k.json, in which "<|endoftext|>" in a text is one id."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_default(table(spark, sf_dir, "documents"))
