"""Byte-level BPE by a segment tree over byte positions, and its decoding.

The leaves of a tree are the byte positions of a piece; a leaf holds the rank of the pair that starts
there, with its position, and inner nodes hold the minimum, so that the root is the leftmost pair of least
rank. A merge updates three leaves (the pair, the part it swallowed, the live neighbour before it) and their
paths. Short pieces of one size share an array of trees and merge together, one merge a round each; longer
pieces have a tree of their own. Equal pieces are encoded once a block.

Defined results: a null or empty text has no ids; repeated rows are encoded each; a null doc_id stays null;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from deliverix.llm.common import small_batches, table, text_bytes
from deliverix.llm.tokens import Encoder, gather, ranks

_NONE = np.int64(1) << np.int64(40)
#: Pieces of at most so many bytes share arrays of trees.
_SHARED = 64


class Merges:
    """Ranks of pairs of token ids, and the merging of pieces."""

    def __init__(self, rank: dict[bytes, int]) -> None:
        self.rank = rank
        self.byte = np.array([rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, r in rank.items():
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE >> 16)

    def together(self, pieces: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most cap bytes, cap a power of two: all ids in a row, and how many each has."""
        m = len(pieces)
        size = np.array([len(p) for p in pieces])
        ids = self.byte[np.frombuffer(b"".join(p.ljust(cap, b"\0") for p in pieces), np.uint8).reshape(m, cap)]
        spot = np.arange(cap)
        live = spot < size[:, None]
        after = np.where(spot + 1 < size[:, None], spot + 1, cap)
        before = np.tile(spot - 1, (m, 1))
        tree = np.full((m, 2 * cap), _NONE)
        pair = self.of_pairs(ids[:, :-1], ids[:, 1:])
        tree[:, cap : 2 * cap - 1] = np.where(after[:, :-1] < cap, pair << 16 | spot[:-1], _NONE)
        level = cap // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            best = tree[row, 1]
            at, r = best & 0xFFFF, best >> 16
            gone = after[row, at]
            then = after[row, gone]
            ids[row, at], live[row, gone], after[row, at] = r, False, then
            more = np.flatnonzero(then < cap)
            before[row[more], then[more]] = at[more]
            fresh = np.full(len(row), _NONE)
            fresh[more] = self.of_pairs(r[more], ids[row[more], then[more]]) << 16 | at[more]
            fresh[fresh > _NONE] = _NONE
            tree[row, cap + at], tree[row, cap + gone] = fresh, _NONE
            left = before[row, at]
            more = np.flatnonzero(left >= 0)
            value = self.of_pairs(ids[row[more], left[more]], r[more]) << 16 | left[more]
            tree[row[more], cap + left[more]] = np.minimum(value, _NONE)
            for leaf in (at, gone, np.maximum(left, 0)):
                node = (cap + leaf) >> 1
                while node[0]:
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < _NONE]
        return ids[live], live.sum(1)

    def alone(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length."""
        n = len(piece)
        none = int(_NONE)
        cap = 1 << (n - 1).bit_length()
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [(none, 0)] * (2 * cap)
        get = self.pairs.get
        for i in range(n - 1):
            tree[cap + i] = (get(ids[i] << 20 | ids[i + 1], none), i)
        for i in range(cap - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            i = cap + leaf
            tree[i] = (value, leaf)
            while i > 1:
                i >>= 1
                best = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == best:
                    return
                tree[i] = best

        live = [True] * n
        while tree[1][0] < none:
            r, at = tree[1]
            gone = after[at]
            then = after[gone]
            ids[at], live[gone], after[at] = r, False, then
            put(gone, none)
            if then < n:
                before[then] = at
                put(at, get(r << 20 | ids[then], none))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], get(ids[before[at]] << 20 | r, none))
        return np.array([x for x, y in zip(ids, live) if y], np.int64)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has; a piece that is a token is that token."""
        whole = [self.rank.get(p, -1) for p in pieces]
        by_cap: dict[int, list[int]] = {}
        for i, r in enumerate(whole):
            if r < 0:
                n = len(pieces[i])
                by_cap.setdefault(max(2, 1 << (n - 1).bit_length()) if n <= _SHARED else 0, []).append(i)
        known = np.array(whole, np.int64)
        order, flat, sizes = [np.flatnonzero(known >= 0)], [known[known >= 0]], [np.ones((known >= 0).sum(), np.int64)]
        for cap, some in by_cap.items():
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                if cap:
                    ids, n = self.together([pieces[i] for i in part], cap)
                else:
                    each = [self.alone(pieces[i]) for i in part]
                    ids, n = np.concatenate(each), np.array([len(x) for x in each])
                order.append(np.array(part))
                flat.append(ids)
                sizes.append(n)
        place, size = np.concatenate(order), np.concatenate(sizes)
        start = np.cumsum(size) - size
        back = np.argsort(place)
        return gather(np.concatenate(flat), start[back], size[back]), size[back]


class Codec:
    """Encodes and decodes whole texts with a rank file and a splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.merges = Merges(ranks(path))
        self.pattern = regex.compile(pattern)
        self.encoder = Encoder(self._chunks)
        top = max(self.merges.rank.values()) + 1
        self.bytes_of = [b""] * top
        for token, r in self.merges.rank.items():
            self.bytes_of[r] = token
        self.text_of = [str(i).encode() for i in range(top)]

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        counts = []
        for c in chunks:
            found = self.pattern.findall(c.decode())
            counts.append(len(found))
            pieces += found
        code, distinct = pd.factorize(np.array(pieces, object))
        ids, size = self.merges.encode([p.encode() for p in distinct])
        start = np.cumsum(size) - size
        each = np.concatenate([[0], np.cumsum(size[code])])
        return gather(ids, start[code], size[code]), np.diff(each[np.cumsum([0] + counts)])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        return self.encoder(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b",".join(map(self.text_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x.astype(np.int32) for x in codec(path, pattern).encode(text_bytes(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def digest_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            lists = b.column(1)
            cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            ids = [flat[x:y] for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(c.listed(x)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digest_ids(encode_documents(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
