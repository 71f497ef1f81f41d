"""Word shingles as sets of 64-bit hashes, and their minwise signatures, computed for blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

from deliverix.llm.common import mix, span_hashes

WORDS = 5
#: Minwise tokens of a set; the first TOKENS of them lead the trees, and two bits of each make its sketch.
LANES, TOKENS = 512, 96

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK = 2_000_000
_K = np.uint64(0x9E3779B97F4A7C15)
_seeds = mix(np.arange(1, 2 * LANES + 1, dtype=np.uint64) * _K)
_XOR, _ODD = (_seeds[:LANES] >> np.uint64(32)).astype(np.uint32), (_seeds[LANES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: How many of a byte's four two-bit fields are zero.
_ZEROS = np.array([sum((b >> k & 3) == 0 for k in (0, 2, 4, 6)) for b in range(256)], np.uint8)


def blocks(texts: list[bytes], most: int = _BLOCK) -> Iterator[list[bytes]]:
    """Runs of texts of a few MB; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[first:i]
            first, size = i, 0
        size += len(t)
    if texts:
        yield texts[first:]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: windows of five lower-cased words, or the whole of a shorter sequence."""
    out: list[np.ndarray] = []
    for block in blocks(texts):
        big = b"\n".join(block).translate(_LOWER) + b"\n" * 9
        turn = np.diff(_SPACE[np.frombuffer(big, np.uint8)].view(np.int8), prepend=np.int8(1))
        start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        edge = np.cumsum([len(t) + 1 for t in block])
        cut = np.concatenate([[0], np.searchsorted(start, edge)])
        if not len(start):
            out += [np.zeros(0, np.uint64)] * len(block)
            continue
        w = span_hashes(big, start, end)
        n = len(w) - WORDS + 1
        s = np.zeros(0, np.uint64)
        if n > 0:
            s = w[:n].copy()
            for j in range(1, WORDS):
                s = s * _K + w[j : n + j]
            s = mix(s)
        for i in range(len(block)):
            a, b = cut[i], cut[i + 1]
            if b - a >= WORDS:
                out.append(np.unique(s[a : b - WORDS + 1]))
            elif b > a:
                x = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for v in w[a:b]:
                        x = x * _K + v
                out.append(mix(np.array([x], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The LANES minwise tokens (32 bits) of a set that isn't empty."""
    low = np.full(LANES, 2**32 - 1, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 512):
        low = np.minimum(low, ((h[i : i + 512, None] ^ _XOR) * _ODD).min(0))
    return low


def sketch(tokens: np.ndarray) -> bytes:
    """Two bits of each token."""
    two = (tokens * np.uint32(0x9E3779B1) >> np.uint32(30)).astype(np.uint8).reshape(-1, 4)
    return (two << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches (last axis), of which a quarter of the unequal tokens agree by chance."""
    share = _ZEROS[a ^ b].sum(-1, dtype=np.int64) / LANES
    return (share - 0.25) / 0.75


def digest(s: np.ndarray) -> bytes:
    """128-bit cryptographic hash of a set (sorted), so that sets with equal ones are equal."""
    return blake2b(s.tobytes(), digest_size=16).digest()


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on whole sets."""
    few, many = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if 100 * few < percent * many:
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (len(a) + len(b) - both)
