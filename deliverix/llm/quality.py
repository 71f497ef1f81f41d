"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document becomes a vector of transformed statistics of its bytes, words and lines. Each class has
a mean and a covariance, shrunk towards the pooled one and towards its diagonal; the score is the
difference of the two Gaussian log-densities (Mahalanobis distances by the cached Cholesky factors),
brought to 0..1 by a one-dimensional logistic map.

Defined results: a null text is an empty text and has a score; a null doc_id is in the training rows
if it has a label, which it cannot have, so it is only scored; repeated rows are scored each and count
each in the fit; rows of labels that are repeated or contradict each other count each too; labels that are null are not read; an empty table gives no rows; without labels of
both classes every score is the share of label 1 (0.5 without any label). Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverix.llm.common import bounded_sample, held_out, keep_rows, small_batches, stored, table, text_bytes

#: predicted is 1 from this score on.
THRESHOLD = 0.3
#: About so many labels (twice as many at most) are learnt from, and so many rows' log-density differences set the slope and
#: offset of the final logistic map.
TRAINING_LABELS, CALIBRATION_ROWS = 50_000, 20_000

_CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\f\v", b"\n",
    b".", b",;:", b"!?", b"|", b"#$%&*+=@^~\\/<>_", b"()[]{}\"'`-",
]
_BYTES = np.zeros((256, len(_CLASSES) + 1))
for _k, _chars in enumerate(_CLASSES):
    _BYTES[list(_chars), _k] = 1
_BYTES[128:, -1] = 1

NAMES = [
    "log_bytes", "upper", "lower", "digit", "space", "newline", "full_stop", "comma", "mark", "bar", "symbol", "bracket", "wide",
    "byte_entropy", "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs", "symbol_ends", "capital_words",
    "loud_words", "words_a_sentence", "repeated_lines", "line_words", "longest_word",
]


def _statistics(text: bytes) -> list[float]:
    n = len(text) or 1
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = hist @ _BYTES / n
    p = hist[hist > 0] / n
    words = text.split()
    k = len(words) or 1
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = b"".join([w[-1:] for w in words])
    heads = b"".join([w[:1] for w in words])
    end_symbols = len(ends) - len(ends.translate(None, b"!#$%&*+=@^~|"))
    capital = len(heads) - len(heads.translate(None, _CLASSES[0]))
    loud = sum(w.isupper() for w in counts)
    stops = ends.count(b".") + ends.count(b"!") + ends.count(b"?") + 1
    return [
        math.log1p(len(text)), *np.sqrt(shares), float(-(p * np.log(p)).sum()), math.log1p(len(words)),
        math.log1p(sum(map(len, words)) / k), math.sqrt(len(counts) / k), math.sqrt(max(counts.values(), default=0) / k),
        math.sqrt(len(set(zip(words, words[1:]))) / k), math.sqrt(end_symbols / k), math.sqrt(capital / k),
        math.sqrt(loud / (len(counts) or 1)), math.log(k / stops + 1), math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        math.log1p(k / (len(lines) or 1)), math.log1p(max(map(len, counts), default=0)),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its vector of transformed statistics (see NAMES), for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_statistics(t) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f array<double>")


@dataclass
class Discriminant:
    """Two class densities; factor k is the inverse of the Cholesky factor of the class covariance."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0
    ready: bool = True

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        d = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * g for m, f, g in zip(self.means, self.factors, self.log_dets)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.prior)
        z = np.sign(d := self.difference(x)) * np.log1p(np.abs(d))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of f by label, added up by Spark; only 2 x (1 + d + d^2) sums return."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, d)
            y = np.array(b.column(0).to_pylist(), int)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["label", "part"])

    parts = rows.select("label", "f").mapInArrow(run, "label int, part array<double>")
    sums = parts.select("label", F.posexplode("part").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x")).collect()
    out = {}
    for k in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in sums:
            if r.label == k:
                v[r["at"]] = r.x
        out[k] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def logistic_map(z: np.ndarray, y: np.ndarray, least_slope: float = 0.05) -> tuple[float, float]:
    """Slope and offset of a logistic regression of y on z with a weak prior, by Newton steps that are halved until the loss falls; it settles on separable data too."""
    sign = 2 * y - 1

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (v[0] * z + v[1])).sum() + 5e-3 * ((v[0] - 1) ** 2 + v[1] ** 2))

    v = np.array([1.0, 0.0])
    now = loss(v)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(v[0] * z + v[1], -40, 40)))
        w = p * (1 - p)
        g = np.array([((p - y) * z).sum() + 1e-2 * (v[0] - 1), (p - y).sum() + 1e-2 * v[1]])
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-9 and loss(v - size * step) > now - 1e-4 * size * float(g @ step):
            size /= 2
        if size <= 1e-9:
            break
        v = v - size * step
        before, now = now, loss(v)
        if before - now <= 1e-10 * (1 + now):
            break
    return max(float(v[0]), least_slope), float(v[1])


def fit(rows: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.05, ridge: float = 1e-3) -> Discriminant:
    """Fits on rows(label 0/1, f); to_pooled and to_diagonal are the shares of shrinkage."""
    m = moments(rows)
    n = np.array([m[0][0], m[1][0]])
    d = len(NAMES)
    if n.min() < 2:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), float((n[1] + 0.5) / (n.sum() + 1)), ready=False)
    means = np.array([m[k][1] / n[k] for k in (0, 1)])
    own = [m[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (own[0] * n[0] + own[1] * n[1]) / n.sum()
    factors, dets = [], []
    for k in (0, 1):
        few = min(0.9, to_pooled + d / (d + n[k]))
        c = (1 - few) * own[k] + few * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    model = Discriminant(means, np.array(factors), np.array(dets), float(n[1] / n.sum()))
    some = bounded_sample(rows.select("label", "f"), CALIBRATION_ROWS).toPandas()
    f, y = np.stack(some.f), some.label.to_numpy(float)
    order = np.lexsort((y, *f.T))
    z, y = model.difference(f[order]), y[order]
    z = np.sign(z) * np.log1p(np.abs(z))
    model.slope, model.offset = logistic_map(z, y)
    return model


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) to learn from: about TRAINING_LABELS of the rows of labels(doc_id, quality) that are not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return stored(bounded_sample(known, TRAINING_LABELS), "quality-labels")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are predicted to be of label 1. Statistics are computed for the training rows, and once for every row."""
    small_batches(docs.sparkSession)
    known = F.broadcast(training_labels(labels))  # about TRAINING_LABELS rows of two numbers
    rows = stored(statistics(docs.select("doc_id", "text").join(known.select("doc_id").distinct(), "doc_id", "left_semi")), "quality-statistics")
    model = fit(rows.join(known, "doc_id"))
    return keep_rows(docs, lambda texts: model.score(np.array([_statistics(t) for t in texts]).reshape(-1, len(NAMES))) >= THRESHOLD)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    small_batches(docs.sparkSession)
    stats = stored(statistics(docs), "quality-statistics")
    model = fit(stats.join(F.broadcast(training_labels(labels)), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array(b.column(1).to_pylist(), float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
