"""Token counts by a transducer compiled from a piece vocabulary, without making the tokens.

A merge vocabulary splits every prefix of a text in one way, and a split is right exactly if each two neighbouring pieces are
right beside each other. So the pieces of a longer prefix follow from few facts about the end of the shorter one: for each place from
which a piece may still be running, the piece before it and the count there, set against the count now. These facts are the states of
a deterministic transducer over characters; a transition is annotated with the tokens it adds. States and transitions are compiled
as texts reach them, into arrays that all later texts use, and compiled anew when they are full.

Texts are cut into chunks. Most cuts stand where the state is known whatever came before: before a space after another character, and
after a character without a piece. Where a stretch has no such place, a chunk starts in the midst, and its map of states (from each state in
which it may be entered to the state at its end, with its count) is worked out for all states that the chunks before may end in.
Maps are composed by a parallel prefix scan: in each round, every run of chunks is joined to the run before it, twice as long each time.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each; a null doc_id stays null; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from deliverix.llm.common import ship, table, text_bytes
from deliverix.llm.shingles import blocks

LIMIT = 4096
#: Characters of a chunk, before the next place where the state is known.
CHUNK = 128
#: Transitions that one worker has compiled at most, besides those of the block in hand.
TRANSITIONS = 2_000_000
_BLOCK = 4_000_000
_SPACE = "▁"
_FREE, _NEVER = -1, 1 << 60


class Pieces:
    """A merge vocabulary: the tree of its pieces, and which two may stand side by side."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i))]
        #: Lower merges first; pieces of one score are equal, and the leftmost goes first.
        self.rank = {p.id_to_piece(i): -p.get_score(i) for i in plain}
        self.pieces = list(self.rank)
        self.chars = {c: k for k, c in enumerate(sorted({c for x in self.pieces for c in x}))}
        if any(c not in self.rank for c in self.chars) or any(_SPACE in x.lstrip(_SPACE) for x in self.pieces):
            raise ValueError("not a vocabulary of this kind: a character without a piece, or a space within one")
        made = [self._merged(x) for x in self.pieces]
        self.heads, self.tails = [m and m[0] for m in made], [m and m[1] for m in made]
        self.children: list[dict[int, int]] = [{}]
        self.piece_at: list[int] = [-1]
        self.starts_with_space = [False]
        for k, x in enumerate(self.pieces):
            if made[k] is None:  # a piece that its own characters never merge to is in no split
                continue
            node = 0
            for c in x:
                node = self.children[node].setdefault(self.chars[c], len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.piece_at.append(-1)
                    self.starts_with_space.append(x[0] == _SPACE)
            self.piece_at[node] = k
        self.ends_with_space = [x[-1] == _SPACE for x in self.pieces]
        self._beside: dict[int, bool] = {}

    def _merged(self, x: str) -> tuple[list, list] | None:
        """The merges of a piece's own characters, as (rank, first symbol after it) and (rank, last symbol after it); None if they end in more than one symbol."""
        parts, heads, tails = list(x), [], []
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == _NEVER:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            heads.append((best, parts[0]))
            tails.append((best, parts[-1]))
        return [(0.0, x[0]), *heads], [(0.0, x[-1]), *tails]

    def beside(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are when their characters are merged together: no merge across the seam is ever due first."""
        key = a << 32 | b
        if (known := self._beside.get(key)) is None:
            known = self._beside[key] = self._seam(self.tails[a], self.heads[b])
        return known

    def _seam(self, left: list[tuple[float, str]], right: list[tuple[float, str]]) -> bool:
        i = j = 0
        while True:
            across = self.rank.get(left[i][1] + right[j][1], _NEVER)
            p = left[i + 1][0] if i + 1 < len(left) else _NEVER
            q = right[j + 1][0] if j + 1 < len(right) else _NEVER
            if across < p and across <= q:
                return False
            if p == q == _NEVER:
                return True
            i, j = (i + 1, j) if p <= q else (i, j + 1)


class Transducer:
    """States as numbers; transitions in an open hash table of (state, symbol) -> (state, tokens)."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        known = len(pieces.chars)
        #: Symbols: characters of pieces, then 1 to 4, the UTF-8 bytes of one without a piece, each of which is a token.
        self.n_symbols = known + 5
        self.symbol = np.empty(0x110000, np.int32)
        for n, (a, b) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000)), 1):
            self.symbol[a:b] = known + n
        for c, k in pieces.chars.items():
            self.symbol[ord(c)] = k
        self.space = pieces.chars[_SPACE]
        self.symbol[0x20] = self.space
        self.known = known
        self.clear()

    def clear(self) -> None:
        #: State 0: nothing before matters.
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, _FREE, 0),)]
        self.number = {self.states[0]: 0}
        self.n = 0
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        old = (self.keys, self.after, self.adds) if self.n else None
        self.keys, self.after, self.adds = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.mask = size - 1
        if old:
            full = np.flatnonzero(old[0] >= 0)
            for k in full.tolist():
                at = self._slot(int(old[0][k]))
                self.keys[at], self.after[at], self.adds[at] = old[0][k], old[1][k], old[2][k]

    def _slot(self, key: int) -> int:
        at = key * 0x9E3779B97F4A7C15 % 2**64 >> 32 & self.mask
        while self.keys[at] not in (-1, key):
            at = at + 1 & self.mask
        return at

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """Compiles one transition."""
        if symbol >= self.known:
            return 0, symbol - self.known
        t = self.pieces
        last, adds, running = None, 0, []
        for node, before, count in self.states[state]:
            to = t.children[node].get(symbol)
            if to is None:
                continue
            piece = t.piece_at[to]
            if last is None and piece >= 0 and (before == _FREE or t.beside(before, piece)):
                last, adds = piece, count + 1
            if t.children[to]:
                free = before == _FREE or t.starts_with_space[to] and not t.ends_with_space[before]
                running.append((to, _FREE if free else before, count))
        if last is None:
            raise ValueError("a text that the vocabulary doesn't split")
        key = (*((node, before, count - adds) for node, before, count in running), (0, last, 0))
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        return number, adds

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one symbol of each lane, and the tokens it adds."""
        key = state.astype(np.int64) * self.n_symbols + symbol
        at = self._first(key)
        off = np.flatnonzero(self.keys[at] != key)
        while len(off):
            empty = off[self.keys[at[off]] == -1]
            for k in np.unique(key[empty]).tolist():
                self._learn(k)
            if len(empty):  # the table may have grown, and places with it
                at = self._first(key)
                off = np.flatnonzero(self.keys[at] != key)
            else:
                at[off] = at[off] + 1 & self.mask
                off = off[self.keys[at[off]] != key[off]]
        return self.after[at], self.adds[at]

    def _first(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) & self.mask

    def _learn(self, key: int) -> None:
        if 3 * self.n > self.mask:
            self._grow(2 * (self.mask + 1))
        at = self._slot(key)
        if self.keys[at] == -1:
            self.after[at], self.adds[at] = self._step(*divmod(key, self.n_symbols))
            self.keys[at] = key
            self.n += 1

    def run(self, state: np.ndarray, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All lanes at once, lane i from state[i] over symbols[start[i]:end[i]]: the states at the end, and the tokens."""
        order = np.argsort(start - end, kind="stable")
        now, at, size = state[order].astype(np.int32), start[order], (end - start)[order]
        added = np.zeros(len(order), np.int64)
        live, k = len(order), 0
        while live := int(np.searchsorted(-size[:live], -k)):  # the lanes longer than k
            now[:live], adds = self(now[:live], symbols[at[:live] + k])
            added[:live] += adds
            k += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], added[back]

    def counts(self, symbols: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Tokens of each text, text i being symbols[edge[i]:edge[i+1]]."""
        if self.n > TRANSITIONS:
            self.clear()
        start, fixed = self._chunks(symbols, edge)
        end = np.append(start[1:], edge[-1])
        total = np.append(0, np.cumsum(self._totals(symbols, start, end, fixed)))
        return np.diff(total[np.searchsorted(start, edge)])

    def _chunks(self, symbols: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks start, and whether the state there is known."""
        heads = edge[:-1][np.diff(edge) > 0]
        space, before = symbols[1:] == self.space, symbols[:-1]
        cut = np.flatnonzero(space & (before != self.space) | (before >= self.known)) + 1
        cut = cut[np.diff(cut // CHUNK, prepend=-1) > 0]
        start = np.union1d(heads, cut)
        size = np.diff(start, append=edge[-1])
        parts = np.where(size > 4 * CHUNK, -(-size // CHUNK), 1)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(start, parts) + nth * CHUNK, nth == 0

    def _totals(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Tokens of each stretch, at its last chunk (a chunk with a known state, and those up to the next such); 0 at other chunks."""
        chunk, entry = np.arange(len(start)), np.zeros(len(start), np.int64)
        maps = np.zeros((4, 0), np.int64)  # chunk, entry, exit, tokens
        while len(chunk):  # rounds until every chunk's map has all states that the chunk before ends in
            exits, tokens = self.run(entry, symbols, start[chunk], end[chunk])
            maps = np.concatenate([maps, np.stack([chunk, entry, exits, tokens])], 1)
            behind = chunk + 1
            open_ = np.flatnonzero((behind < len(start)) & ~fixed[np.minimum(behind, len(start) - 1)])
            wanted = np.unique(behind[open_] << 32 | exits[open_])
            wanted = wanted[~np.isin(wanted, maps[0] << 32 | maps[1])]
            chunk, entry = wanted >> 32, wanted & 0xFFFFFFFF
        return self._composed(maps, fixed)

    @staticmethod
    def _composed(maps: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """A parallel prefix scan: after round r, the map of a chunk is that of the 2^r chunks that end with it, or of all since the known state."""
        first = np.arange(len(fixed))
        maps = maps[:, np.lexsort((maps[1], maps[0]))]
        while (waiting := ~fixed[first]).any():
            key = maps[0] << 32 | maps[1]
            lo, hi = np.searchsorted(maps[0], np.arange(len(fixed))), np.searchsorted(maps[0], np.arange(len(fixed)), "right")
            runs = np.flatnonzero(waiting)
            above = first[runs] - 1  # the run before ends there
            n = hi[above] - lo[above]
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[above], n)
            of = np.repeat(runs, n)
            here = np.searchsorted(key, of << 32 | maps[2][row])
            joined = np.stack([of, maps[1][row], maps[2][here], maps[3][row] + maps[3][here]])
            maps = np.concatenate([maps[:, ~waiting[maps[0]]], joined], 1)
            maps = maps[:, np.lexsort((maps[1], maps[0]))]
            first[runs] = first[above]
        out = np.zeros(len(fixed), np.int64)
        begun = (maps[1] == 0) & np.append(fixed[1:], True)[maps[0]]
        out[maps[0][begun]] = maps[3][begun]
        return out

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text (UTF-8)."""
        out = []
        for block in blocks(texts, _BLOCK):
            marked = [(_SPACE + t.decode()).encode("utf-32-le") if t else b"" for t in block]  # the library puts a space before a text
            edge = np.cumsum([0] + [len(x) // 4 for x in marked])
            symbols = self.symbol[np.frombuffer(b"".join(marked), np.uint32)]
            out.append(self.counts(symbols, edge))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(Pieces(path))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            n = transducer(path).of_texts(texts)
            columns = [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
