"""Ranked lexical search: exact inner products of items and documents, by ball trees.

A document is a sparse vector over the items' terms, whose entries saturate with a term's occurrences and shrink with the document's length; an item
is the vector of its terms' weights. Vectors are stored once, as lists of term numbers and occurrences. A task reads them
in blocks and builds a ball tree over each: a node has the centroid of its documents and the largest distance from it, and is parted across
the line between two far documents. A distance in all terms at once is far more than an item can see of it, so balls
have a radius for each group of terms: those of one item alone, and each term that several items share. By Cauchy and Schwarz no document
below a node scores more than item . centroid + sum over groups of |item in the group| * radius of the group, with all rounding errors added.

Nodes are taken best first, that which exceeds an item's 20th best score so far the most, for all items
that it could still serve; a node that can serve none is dropped with all below it. Documents of leaves are scored in
whole numbers (doubles hold them exactly below 2^53; beyond that 64-bit integers are used). First each task searches its first
block; the 20th best scores of all these are where the search of all blocks starts. A task keeps the best scores from block to block.

Items come to the tasks in batches of bounded size, each of which reads the documents once. Terms are told apart by 64-bit
hashes: that any of a billion other terms shares the hash of one of 16,384 has a probability of about 1e-6.

Defined results: null, empty and term-free texts are no documents and no hits; an item without terms, or whose terms no document holds, has no rows;
repeated documents are documents each, in both ranks; repeated items, also with a null item_id, have rows each; of equal scores the
least doc_id comes first, null last; empty tables give no rows. Other columns are not read. Ids are whole numbers.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverix.llm.common import ship, span_hashes, stored, table, text_bytes
from deliverix.llm.shingles import blocks

TOP = 20
#: Term occurrences and items of a batch (a longer item is a batch of its own).
TERMS, ITEMS = 16_384, 512
#: Entries of a block's dense vectors (8 bytes each), documents of a leaf, and directions in which far documents are looked for.
ENTRIES, LEAF, DIRECTIONS = 4_000_000, 8, 32
#: Relative error allowed for sums of products: far above that of a million terms in doubles.
SAFE = 1e-9

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_NO_ID = np.iinfo(np.int64).max


@dataclass
class Batch:
    """Some items: their ids, and the hashes of all their terms (sorted) with each item's occurrences."""

    ids: list[int | None] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)

    def close(self) -> "Batch":
        every = sorted({h for c in self.counts for h in c})
        self.terms = np.array(every, np.uint64)
        number = {h: i for i, h in enumerate(every)}
        self.counts = [Counter({number[h]: k for h, k in c.items()}) for c in self.counts]
        return self


def _hashes(terms: list[bytes]) -> list[int]:
    end = np.cumsum([len(t) for t in terms])
    return span_hashes(b"".join(terms) + b"\0" * 8, end - [len(t) for t in terms], end).tolist() if terms else []


def item_batches(items: DataFrame) -> Iterator[Batch]:
    """The items that have terms, as they come, in batches of bounded size."""
    now, size = Batch(), 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        terms = Counter(_hashes([t.encode() for t in _TERM.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))]))
        if not terms:
            continue
        if now.ids and (size + terms.total() > TERMS or len(now.ids) == ITEMS):
            yield now.close()
            now, size = Batch(), 0
        now.ids.append(item_id)
        now.counts.append(terms)
        size += terms.total()
    if now.ids:
        yield now.close()


def vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, n (all terms), and the numbers and occurrences of the given terms, for every row of docs that has a term."""
    ship(docs.sparkSession)
    names = ["doc_id", "n", "terms", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for block in blocks(text_bytes(b.column(1))):
                big = b"\n".join(block).translate(_LOWER) + b"\n" * 9
                turn = np.diff(_IN_TERM[np.frombuffer(big, np.uint8)].view(np.int8), prepend=np.int8(0))
                start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                cut = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in block]))
                h = span_hashes(big, start, end)
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == h)
                doc = np.searchsorted(cut, hit, "right") - 1
                key, tf = np.unique(doc * len(terms) + at[hit], return_counts=True)
                offsets = np.searchsorted(key, np.arange(len(block) + 1) * len(terms)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (key % len(terms), tf)]
                out = pa.RecordBatch.from_arrays([b.column(0)[done : done + len(block)], pa.array(np.diff(cut).astype(np.int64)), *lists], names=names)
                done += len(block)
                yield out.filter(pa.array(np.diff(cut) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Tree:
    """A ball tree over rows of vectors, its nodes in arrays; the rows of a node stand together in order. groups: where each group of columns starts."""

    def __init__(self, x: np.ndarray, groups: np.ndarray, directions: np.ndarray) -> None:
        self.order = np.arange(len(x))
        self.span: list[tuple[int, int]] = [(0, len(x))]
        self.child: list[int] = []  # the first of two children, 0 in a leaf
        seen = x @ directions  # distances are about the same there, and nodes are parted by these
        for a, b in self.span:  # grows
            rows = seen[self.order[a:b]]
            if b - a <= LEAF:
                self.child.append(0)
                continue
            away = rows - rows.mean(0)
            one = away[(away**2).sum(1).argmax()]
            other = away[((away - one) ** 2).sum(1).argmax()]
            middle = a + (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(away @ (one - other), middle - a)]
            self.child.append(len(self.span))
            self.span += [(a, middle), (middle, b)]
        self._balls(x[self.order], groups)

    def _balls(self, x: np.ndarray, groups: np.ndarray) -> None:
        """Centroids and radii: of leaves from their rows, of other nodes from their children's."""
        size = np.array([b - a for a, b in self.span])
        self.centre, self.radius = np.zeros((len(size), x.shape[1])), np.zeros((len(size), len(groups)))
        leaves = np.flatnonzero(np.array(self.child) == 0)
        leaves = leaves[np.argsort([self.span[i][0] for i in leaves])]
        start = np.cumsum(size[leaves]) - size[leaves]
        centre = np.add.reduceat(x, start, axis=0) / size[leaves, None]
        away = np.add.reduceat((x - np.repeat(centre, size[leaves], axis=0)) ** 2, groups, axis=1)
        self.centre[leaves], self.radius[leaves] = centre, np.sqrt(np.maximum.reduceat(away, start, axis=0)) * (1 + SAFE)
        for i in range(len(size) - 1, -1, -1):
            if k := self.child[i]:
                c = self.centre[i] = (self.centre[k] * size[k] + self.centre[k + 1] * size[k + 1]) / size[i]
                shift = np.sqrt(np.add.reduceat((self.centre[k : k + 2] - c) ** 2, groups, axis=1))
                self.radius[i] = (self.radius[k : k + 2] + shift).max(0) * (1 + SAFE)

    def bounds(self, q: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each row of q (of the given lengths in the groups) and each node: what no row of the node exceeds as an inner product."""
        return (q @ self.centre.T + lengths @ self.radius.T) * (1 + SAFE)


class Search:
    """Finds the best documents of a batch of items; visited and held count (item, document) pairs.

    best and doc hold the best scores of each item so far and their documents, in order; below least nothing is looked for.
    """

    def __init__(self, batch: Batch, weight: np.ndarray, n: int, length: int, least: np.ndarray, top: int) -> None:
        self.n, self.length, self.size = n, length, len(weight)
        items_with = np.bincount(np.concatenate([list(c) for c in batch.counts]), minlength=self.size)
        group = np.arange(self.size) + len(batch.ids)  # a shared term is a group
        for i, c in enumerate(batch.counts):
            own = np.array(list(c))
            group[own[items_with[own] == 1]] = i
        at = np.argsort(group, kind="stable")
        self.column = np.empty(self.size, np.int64)
        self.column[at] = np.arange(self.size)
        self.groups = np.flatnonzero(np.diff(group[at], prepend=-1))
        q = np.zeros((len(batch.ids), self.size), np.int64)
        for i, c in enumerate(batch.counts):
            for t, k in c.items():
                q[i, self.column[t]] = k * weight[t]
        self.q = q.astype(float) if int(q.sum(1).max()) * 10**6 < 2**53 else q
        self.lengths = np.sqrt(np.add.reduceat(q.astype(float) ** 2, self.groups, axis=1)) * (1 + SAFE)
        self.directions = np.random.default_rng(0).standard_normal((self.size, DIRECTIONS))
        self.least = least
        self.best = np.tile(least[:, None] - 1, (1, top))
        self.doc = np.full((len(q), top), _NO_ID)
        self.visited = self.held = 0

    def entries(self, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """Dense vectors of a block's documents."""
        m = 100 - 25 + 25 * n * self.n // self.length
        x = np.zeros((len(n), self.size))
        row = np.repeat(np.arange(len(n)), np.diff(offsets))
        x[row, self.column[terms]] = 10**9 * tfs // (1000 * tfs + 12 * m[row])
        return x

    def block(self, doc: np.ndarray, x: np.ndarray) -> None:
        """All items against a block of documents."""
        tree = Tree(x, self.groups, self.directions)
        bounds = tree.bounds(self.q, self.lengths)
        self.held += len(self.q) * len(doc)
        waiting = [(0.0, 0)]
        while waiting:
            _, node = heapq.heappop(waiting)
            some = np.flatnonzero(bounds[:, node] >= np.maximum(self.best[:, -1], self.least))
            if not len(some):
                continue
            if first := tree.child[node]:
                for child in (first, first + 1):
                    heapq.heappush(waiting, (-float((bounds[some, child] - self.best[some, -1]).max()), child))
                continue
            rows = tree.order[slice(*tree.span[node])]
            score = self.q[some] @ x[rows].T if self.q.dtype == float else self.q[some] @ x[rows].T.astype(np.int64)
            self._add(some, score.astype(np.int64), doc[rows])
            self.visited += score.size

    def _add(self, some: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Scores of documents for some items."""
        row = np.flatnonzero(score.max(1) >= np.maximum(self.best[some, -1], self.least[some]))
        if len(row):
            some = some[row]
            scores = np.concatenate([self.best[some], score[row]], 1)
            docs = np.concatenate([self.doc[some], np.broadcast_to(doc, (len(row), len(doc)))], 1)
            order = np.lexsort((docs, -scores))[:, : self.best.shape[1]]
            self.best[some], self.doc[some] = np.take_along_axis(scores, order, 1), np.take_along_axis(docs, order, 1)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(k) + 1))) for k in df], np.int64)


def best_of(found: DataFrame, batch: Batch, top: int) -> DataFrame:
    """(no, item_id, rank, doc_id, score): the best documents of each item of a batch among the vectors found."""
    terms = len(batch.terms)
    n, length = found.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(terms, np.int64)
    for t, k in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the batch's terms at most
        df[t] = k
    weight = weights(df, n)
    some = max(LEAF, ENTRIES // terms)

    def searched(least: np.ndarray, first_block: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(batch, weight, n, length, least, top)
            for b in batches:
                doc, size = b.column(0).fill_null(_NO_ID).to_numpy(), b.column(1).to_numpy()
                offsets, of, tfs = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(), b.column(3).values.to_numpy().astype(np.int64)
                for i in range(0, len(doc), some):
                    cut = offsets[i : i + some + 1]
                    search.block(doc[i : i + some], search.entries(size[i : i + some], cut, of[cut[0] : cut[-1]], tfs[cut[0] : cut[-1]]))
                    if first_block:
                        break
                if first_block:
                    break
            no, place = np.nonzero(search.best >= least[:, None])
            doc = search.doc[no, place]
            columns = [pa.array(no), pa.array([batch.ids[i] for i in no.tolist()], pa.int64()), pa.array(doc, mask=doc == _NO_ID), pa.array(search.best[no, place])]
            yield pa.RecordBatch.from_arrays(columns, names=["no", "item_id", "doc_id", "score"])

        order = W.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = found.mapInArrow(run, "no long, item_id long, doc_id long, score long")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    least = np.ones(len(batch.ids), np.int64)
    for no, score in searched(least, True).filter(F.col("rank") == top).select("no", "score").collect():  # a row for each item of the batch
        least[no] = score
    return searched(least, False)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents of docs(doc_id, text) for each of items(item_id, text)."""
    parts = []
    for batch in item_batches(items):
        found = stored(vectors(docs, batch.terms), "lexical")
        if not found.isEmpty():
            parts.append(best_of(found, batch, top).select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH found AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS u
  FROM documents
), sizes AS (SELECT row, doc_id, len(u)::BIGINT AS n FROM found WHERE len(u) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
items AS (
  SELECT row_number() OVER () AS no, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS u
  FROM benchmark
), asked AS (SELECT no, item_id, t, count(*) AS k FROM (SELECT no, item_id, unnest(u) AS t FROM items) GROUP BY ALL),
held AS (SELECT row, t, count(*)::BIGINT AS tf FROM (SELECT row, unnest(u) AS t FROM found) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weighed AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY t, docs),
entries AS (
  SELECT row, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)) AS x FROM held JOIN sizes USING (row), totals
), scored AS (
  SELECT no, item_id, row, doc_id, sum(k * w * x)::BIGINT AS score FROM asked JOIN weighed USING (t) JOIN entries USING (t) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
