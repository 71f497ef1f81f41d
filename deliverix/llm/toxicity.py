"""Toxicity: a linear classifier learnt from confirmed toxic examples and unlabelled text.

The training set is a bounded sample: confirmed positives (labels.toxic = 1) and documents taken
without regard to any label, both outside the held-out fold. Words, word heads, and pairs of neighbouring characters of
scripts that may be written without spaces (three bytes each in UTF-8) are the features.
Their counts in both samples choose the features; numpy then minimises the non-negative
positive-unlabelled risk, in which the class prior corrects for the positives among the unlabelled.

Defined results: a null text is an empty text, and its score is that of the offset alone; repeated rows
are scored each; a null doc_id is scored and never learnt from; null labels are not read; an empty table
gives no rows; without any confirmed positive every score is 0. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverix.llm.common import bounded_sample, held_out, keep_rows, mix, small_batches, span_hashes, stored, table, text_bytes

#: predicted is 1 from this score on.
THRESHOLD = 0.5
#: Distinct rows of the training samples (about) and bound of the features.
POSITIVES, UNLABELLED, FEATURES = 3000, 6000, 2048
#: Tasks that compute the features of the sample.
SAMPLE_TASKS = 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_WORD[128:] = True
#: Bytes of a word's head that count as a feature, besides the whole word.
_HEADS = (4, 5, 6)
_BLOCK = 4_000_000


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of a few MB; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _BLOCK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and 64-bit feature, for each occurrence of a word, a word head or a pair of wide characters."""
    big = b"\n".join(texts).translate(_LOWER) + b"\n" * 32
    a = np.frombuffer(big, np.uint8)
    inside = _WORD[a].view(np.int8)
    turn = np.diff(inside, prepend=np.int8(0))
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(edge, start, side="right")
    eight = np.ndarray((len(big) - 7,), "<u8", big, strides=(1,))
    length = end - start

    def head(at: np.ndarray, k: int) -> np.ndarray:
        return mix(eight[at] & np.uint64((1 << 8 * k) - 1) ^ np.uint64(k << 56) ^ np.uint64(0x5BD1E995))

    docs, found = [doc], [span_hashes(big, start, end)]
    for k in _HEADS:
        long = np.flatnonzero(length > k)
        docs.append(doc[long])
        found.append(head(start[long], k))
    wide = (a >= 0xE0) & (a < 0xF0)
    pair = np.flatnonzero(wide[:-3] & wide[3:])
    docs.append(np.searchsorted(edge, pair, side="right"))
    found.append(head(pair, 6) ^ np.uint64(1))
    return np.concatenate(docs), np.concatenate(found)


def _sets(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Index of each text and its distinct features."""
    for first, block in _blocks(texts):
        doc, f = occurrences(block)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(block) + 1))
        for i in range(len(block)):
            yield first + i, np.unique(f[order[cuts[i] : cuts[i + 1]]])


@dataclass
class PositiveUnlabelled:
    """Weights of the chosen features (sorted) and the offset; score is the logistic of their sum."""

    features: np.ndarray
    weights: np.ndarray
    offset: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.features >> np.uint64(44)] = True

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.offset)
        for first, block in _blocks(texts):
            doc, f = occurrences(block)
            some = np.flatnonzero(self.seen[f >> np.uint64(44)]) if len(f) else np.zeros(0, int)
            if len(some):
                at = np.minimum(np.searchsorted(self.features, f[some]), len(self.features) - 1)
                hit = self.features[at] == f[some]
                pair = np.unique(doc[some][hit] * len(self.features) + at[hit])
                np.add.at(z, first + pair // len(self.features), self.weights[pair % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Rows of zeros and ones by the places of their ones."""

    def __init__(self, lists: list[list[int]], size: int) -> None:
        self.m, self.size = len(lists), size
        self.row = np.repeat(np.arange(self.m), [len(x) for x in lists])
        self.at = np.fromiter((k for x in lists for k in x), np.int64, len(self.row))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.m)

    def summed(self, s: np.ndarray) -> np.ndarray:
        """The sum of s over the rows that have a one, for each place."""
        return np.bincount(self.at, weights=s[self.row], minlength=self.size)


def non_negative_fit(p: Rows, u: Rows, prior: float, steps: int = 500, rate: float = 0.05, decay: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise prior * R_p+ + max(0, R_u- - prior * R_p-), sigmoid loss, by Adam; where the second term is negative, steps undo it.

    The two kinds of steps take turns about the end, so steps get smaller and the weights of the later half are averaged: what is
    left of rounding and of the order of rows stays far below any score's digits that matter.
    """
    loss = lambda z: 1 / (1 + np.exp(np.clip(z, -40, 40)))
    w, m, v, mean = (np.zeros(p.size + 1) for _ in range(4))
    later = steps - steps // 2
    for t in range(1, steps + 1):
        lp, lu = loss(p.times(w[:-1]) + w[-1]), loss(u.times(w[:-1]) + w[-1])
        # d loss(z)/dz = -loss (1 - loss); the loss of -z is 1 - loss(z)
        slope_p, slope_u = lp * (1 - lp), lu * (1 - lu)
        pos = -np.append(p.summed(slope_p), slope_p.sum()) / p.m
        neg_p, neg_u = -pos, np.append(u.summed(slope_u), slope_u.sum()) / u.m
        rest = (1 - lu).mean() - prior * (1 - lp).mean()
        g = prior * pos + neg_u - prior * neg_p if rest >= 0 else -(neg_u - prior * neg_p)
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps - later:
            mean += w / later
    return mean[:-1], float(mean[-1])


def fit(docs: DataFrame, labels: DataFrame) -> PositiveUnlabelled | None:
    """Learns from about POSITIVES confirmed toxic and UNLABELLED other documents outside the held-out fold."""
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg("toxic")).first()[0]
    if not share:
        return None
    confirmed = bounded_sample(known.filter("toxic = 1").select("doc_id").distinct(), POSITIVES)
    some = stored(confirmed, "toxicity-sample")  # about POSITIVES ids
    positive = bounded_sample(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left_semi"), POSITIVES).withColumn("positive", F.lit(1))
    others = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    other = bounded_sample(others, UNLABELLED).withColumn("positive", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for _, s in _sets(text_bytes(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["positive", "f"])

    chosen = positive.unionAll(other).select("positive", "text").repartition(SAMPLE_TASKS)  # about POSITIVES + UNLABELLED rows
    rows = stored(chosen.mapInArrow(run, "positive int, f array<long>"), "toxicity-features")
    n = {r.positive: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return None
    counts = rows.select("positive", F.explode("f").alias("f")).groupBy("f").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    lift = ((F.col("p") + 0.1) / n[1]) / ((F.col("u") + 1) / n[0])
    best = counts.filter((F.col("p") >= 2) & (lift >= 2)).orderBy((F.col("p") * F.log(lift)).desc(), "f").limit(FEATURES).select("f").collect()
    features = np.sort(np.array([r.f for r in best], np.int64).view(np.uint64))
    if not len(features):
        return None
    ids = features.view(np.int64)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [np.flatnonzero(np.isin(ids, np.array(f, np.int64))).astype(np.int32) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.list_(pa.int32()))], names=["positive", "at"])

    x = {0: [], 1: []}
    for r in rows.mapInArrow(narrow, "positive int, at array<int>").collect():
        x[r.positive].append(r["at"])
    weights, offset = non_negative_fit(*(Rows(sorted(x[k]), len(features)) for k in (1, 0)), float(share))  # sums depend on the order, a little
    return PositiveUnlabelled(features, weights, offset)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not predicted to be toxic."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    return keep_rows(docs, lambda texts: model.score(texts) < THRESHOLD) if model else docs


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            s = model.score(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
