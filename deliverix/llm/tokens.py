"""Token ids by public vocabularies, remembered by chunk.

The pattern of the byte-level vocabularies never lets a match run across a single space between two
characters that are not white space: a match starts at that space. So a text is cut there, and the ids of
a chunk are computed once and found again by the chunk's 64-bit hash, if its bytes are the same too. The
memory is bounded; when it is full it is emptied, which changes no result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers

from deliverix.llm.common import span_hashes

#: Chunks and ids that one worker remembers at most, besides those of the block in hand.
CHUNKS, IDS = 700_000, 6_000_000
#: Longer chunks (bytes) are encoded each time.
_LONGEST = 64
_BLOCK = 2_000_000
#: Bytes of new chunks that the library encodes in a row.
_ROW = 8192


def _no_white(a: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether the characters that end before these places are surely no white space; beyond ASCII that starts with the bytes C2, E1, E2 or E3."""
    last, second, third = a[before - 1], a[np.maximum(before - 2, 0)], a[np.maximum(before - 3, 0)]
    return ((last > 0x20) & (last < 0x80)) | (last >= 0x80) & (((second >= 0xC3) & (second < 0xE0)) | (second >= 0x80) & (second < 0xC0) & (third >= 0xE4))


def _cuts(a: np.ndarray) -> np.ndarray:
    """Places of single spaces between characters that are surely no white space (bytes padded by eight)."""
    at = np.flatnonzero(a[:-8] == 0x20)
    at = at[at > 0]
    after = a[at + 1]
    return at[(after > 0x20) & ~np.isin(after, [0xC2, 0xE1, 0xE2, 0xE3]) & _no_white(a, at)]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after the other."""
    stop = np.cumsum(sizes)
    n = int(stop[-1]) if len(stop) else 0
    return values[np.arange(n) + np.repeat(starts - stop + sizes, sizes)]


def in_a_row(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and the lists' lengths."""
    return np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(x) for x in lists], np.int64)


def _words(eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 0, 1, ...: the k-th eight bytes (zeros after the end) of the chunks that reach there, and which these are."""
    some, k = np.arange(len(start)), 0
    while len(some):
        left = np.minimum(end[some] - start[some] - 8 * k, 8).astype(np.uint64)
        yield k, eight[start[some] + 8 * k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8))), some
        k += 1
        some = some[end[some] - start[some] > 8 * k]


class Encoder:
    """Encodes texts (UTF-8) by chunks; encode gets distinct new chunks and returns all their ids in a row, and how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slots = np.zeros(0, np.int64)  # where each key's ids are
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.words = np.zeros(1 << 16, np.uint64)  # the bytes of the chunks that the memory holds, each from a new word on
        self.at, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)  # where a slot's words start, and its bytes
        self.n = self.used = self.filled = 0

    def _learn(self, new: list[bytes]) -> np.ndarray:
        flat, sizes = self.encode(new)
        n, k = self.n, len(new)
        while n + k > len(self.starts):
            self.starts, self.sizes, self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.at, self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + k] = sizes
        self.n, self.used = n + k, self.used + len(flat)
        return np.arange(n, n + k)

    def _keep(self, eight: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray) -> None:
        """Notes the bytes of chunks in their slots."""
        words = (end - start + 7) // 8
        at = self.filled + np.cumsum(words) - words
        self.filled += int(words.sum())
        while self.filled > len(self.words):
            self.words = np.concatenate([self.words, np.zeros_like(self.words)])
        self.at[slot], self.length[slot] = at, end - start
        for k, part, some in _words(eight, start, end):
            self.words[at[some] + k] = part

    def _other(self, eight: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The chunks whose bytes are not those in their slots."""
        same = self.length[slot] == end - start
        alike = np.flatnonzero(same)
        at = self.at[slot[alike]]
        for k, part, some in _words(eight, start[alike], end[alike]):
            same[alike[some]] &= self.words[at[some] + k] == part
        return np.flatnonzero(~same)

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text (uint32), in order."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= _BLOCK or i == len(texts) - 1:
                yield from self._block(texts[first : i + 1])
                first, size = i + 1, 0

    def _block(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if self.n > CHUNKS or self.used > IDS:
            self.clear()
        big = b"".join(texts) + b"\0" * 8
        edge = np.cumsum([0] + [len(t) for t in texts])
        total = int(edge[-1])
        start = np.sort(np.concatenate([edge[:-1][np.diff(edge) > 0], _cuts(np.frombuffer(big, np.uint8))]))
        start = start[np.diff(start, prepend=-1) > 0]
        end = np.append(start[1:], total)[: len(start)]
        slot = np.zeros(len(start), np.int64)
        short = np.flatnonzero(end - start <= _LONGEST)
        long = np.flatnonzero(end - start > _LONGEST)
        if len(long):
            slot[long] = self._learn([big[start[i] : end[i]] for i in long])
        if len(short):
            code, key = pd.factorize(span_hashes(big, start[short], end[short]))
            at = np.zeros(len(key), np.int64)
            at[code[::-1]] = np.arange(len(code))[::-1]  # where each key is first
            order = np.argsort(key)
            key, at = key[order], at[order]
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            place = np.searchsorted(self.keys, key)
            known = np.zeros(len(key), bool)
            inside = place < len(self.keys)
            known[inside] = self.keys[place[inside]] == key[inside]
            found = np.zeros(len(key), np.int64)
            found[known] = self.slots[place[known]]
            new = np.flatnonzero(~known)
            eight = np.ndarray((len(big) - 7,), "<u8", big, strides=(1,))
            if len(new):
                first = short[at[new]]
                found[new] = self._learn([big[start[i] : end[i]] for i in first])
                self._keep(eight, start[first], end[first], found[new])
                self.keys, self.slots = np.insert(self.keys, place[new], key[new]), np.insert(self.slots, place[new], found[new])
            slot[short] = found[rank][code]
            other = short[self._other(eight, start[short], end[short], slot[short])]
            if len(other):  # chunks of one hash
                slot[other] = self._learn([big[start[i] : end[i]] for i in other])
        sizes = self.sizes[slot]
        ids = gather(self.ids, self.starts[slot], sizes)
        cut = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, edge)]
        for a, b in zip(cut, cut[1:]):
            yield ids[a:b]


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@lru_cache(maxsize=4)
def rank_file_encoder(path: str, pattern: str) -> Encoder:
    """tiktoken with a rank file; no special tokens, their strings are ordinary text."""
    import tiktoken

    e = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return Encoder(lambda new: in_a_row([e.encode_ordinary(x.decode()) for x in new]))


@lru_cache(maxsize=4)
def library_encoder(path: str) -> Encoder:
    """The tokenizers library with a byte-level vocabulary file, its own default for added tokens in a text.

    New chunks that start with a space and don't end with white space are encoded in a row, some KB at a time: the cuts between them are
    those at which a text is cut, and the ids' byte lengths tell them apart again.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    length = np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size())])  # a character of a token is a byte
    each = lambda parts: in_a_row([e.ids for e in t.encode_batch_fast([x.decode() for x in parts], add_special_tokens=False)])

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        big = np.frombuffer(b"".join(new) + b"\0" * 8, np.uint8)
        size = np.array([len(x) for x in new])
        end = np.cumsum(size)
        first, second = big[end - size], big[end - size + 1]
        fit = (size > 1) & (first == 0x20) & (second > 0x20) & ~np.isin(second, [0xC2, 0xE1, 0xE2, 0xE3]) & _no_white(big, end)
        row = np.flatnonzero(fit)
        if not len(row):
            return each(new)
        stops = np.cumsum(size[row])
        groups = np.flatnonzero(np.diff(stops // _ROW, append=-1)) + 1
        joined = [b"".join([new[i] for i in row[a:b]]) for a, b in zip([0, *groups[:-1]], groups)]
        ids, _ = each(joined)
        reach = np.cumsum(length[ids])
        last = np.searchsorted(reach, stops)
        if reach[-1] != stops[-1] or (reach[last] != stops).any():
            raise ValueError("ids that run across chunks")
        count = np.diff(last, prepend=-1)
        rest = np.flatnonzero(~fit)
        if not len(rest):
            return ids, count
        more, sizes = each([new[i] for i in rest])
        back = np.argsort(np.concatenate([row, rest]), kind="stable")
        counts = np.concatenate([count, sizes])
        flat, starts = np.concatenate([ids, more]), np.cumsum(counts) - counts
        return gather(flat, starts[back], counts[back]), counts[back]

    return Encoder(encode)


def encoder_for(path: str) -> Encoder:
    """By the kind of file: the tokenizers library's .json, or tiktoken's ranks with the public pattern."""
    return library_encoder(path) if path.endswith(".json") else rank_file_encoder(path, public_tokenizers.PATTERN)
