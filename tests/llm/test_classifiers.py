"""The classifiers against versions of their own: statistics and features by characters, fits by plain loops."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from deliverix.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    return docs, labels


def learnable(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 0


def entropy(values):
    n = sum(values)
    return -sum(v / n * math.log(v / n) for v in values)


def plain_statistics(text):
    """The 26 statistics, one after the other, as their names say."""
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\f\v", "\n", ".", ",;:", "!?", "|", "#$%&*+=@^~\\/<>_", "()[]{}\"'`-"]
    n = max(len(text), 1)
    words = re.findall(rb"[^ \t\n\r\f\v]+", text)
    k = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if re.search(rb"[^ \t\r\f\v]", x)]
    count = lambda f: sum(1 for w in words if f(w))
    share = lambda f: math.sqrt(count(f) / k)
    kinds_of_words = Counter(words)
    loud = [w for w in kinds_of_words if re.search(rb"[A-Z]", w) and not re.search(rb"[a-z]", w)]
    return [
        math.log(1 + len(text)),
        *(math.sqrt(sum(text.count(c.encode()) for c in kind) / n) for kind in kinds),
        math.sqrt(sum(b >= 128 for b in text) / n),
        entropy(Counter(text).values()) if text else 0.0,
        math.log(1 + len(words)),
        math.log(1 + sum(len(w) for w in words) / k),
        math.sqrt(len(kinds_of_words) / k),
        math.sqrt(max(kinds_of_words.values(), default=0) / k),
        math.sqrt(len({(a, b) for a, b in zip(words, words[1:])}) / k),
        share(lambda w: chr(w[-1]) in "!#$%&*+=@^~|"),
        share(lambda w: chr(w[0]) in kinds[0]),
        math.sqrt(len(loud) / max(len(kinds_of_words), 1)),
        math.log(1 + k / (1 + count(lambda w: chr(w[-1]) in ".!?"))),
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        math.log(1 + k / max(len(lines), 1)),
        math.log(1 + max(map(len, words), default=0)),
    ]


def test_statistics_one_by_one(tables):
    odd = [b"", b" ", b"\n\n", b"A B! a.b\n\nA B!", "É é 中文".encode(), b"a\x00b", b"one\ttwo\x0bthree\x0c4", b"#x! |y| (z)"]
    for text in [t for _, t in tables[0][:250]] + odd:
        assert np.allclose(quality._statistics(text), plain_statistics(text), atol=1e-9), text[:60]


def test_quality_from_scratch(spark, tables):
    """Shrunk covariances by sums over rows, densities by a solved system, and the final map by small steps."""
    docs, labels = tables
    x = {i: np.array(plain_statistics(t)) for i, t in docs}
    rows = [(x[i], y) for i, y, _ in labels if learnable(i) and y in (0, 1) and i in x]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    mean = [sum(v for v, y in rows if y == k) / n[k] for k in (0, 1)]
    own = [sum(np.outer(v - mean[k], v - mean[k]) for v, y in rows if y == k) / n[k] for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    d = len(mean[0])
    cov = []
    for k in (0, 1):
        to_pooled = min(0.9, 0.1 + d / (d + n[k]))
        c = (1 - to_pooled) * own[k] + to_pooled * pooled
        cov.append(0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-3 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d))

    def margin(v):
        log_density = [-0.5 * (v - mean[k]) @ np.linalg.solve(cov[k], v - mean[k]) - 0.5 * np.linalg.slogdet(cov[k])[1] for k in (0, 1)]
        z = log_density[1] - log_density[0]
        return math.copysign(math.log(1 + abs(z)), z)

    z, y = np.array([margin(v) for v, _ in rows]), np.array([y for _, y in rows])
    a, b = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a - 0.5 * (((p - y) * z).sum() + 1e-2 * (a - 1)) / len(y) / (z * z).mean(), b - 0.5 * ((p - y).sum() + 1e-2 * b) / len(y)
    for _ in range(30):  # near the end of the steps, by Newton's
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(p * (1 - p) * z * z).sum() + 1e-2, (p * (1 - p) * z).sum()], [(p * (1 - p) * z).sum(), (p * (1 - p)).sum() + 1e-2]])
        a, b = (a, b) - np.linalg.solve(h, g)
    assert np.abs(g).max() < 1e-6
    got = {r.doc_id: r for r in quality.op6_quality(spark, SF).collect()}
    for i, _ in docs:
        want = 1 / (1 + math.exp(-(max(a, 0.05) * margin(x[i]) + b)))
        assert abs(got[i].score - want) < 1e-5, i
        assert got[i].held_out == (not learnable(i)) and got[i].predicted == (got[i].score >= 0.3)
    scored = [(got[i].score, y) for i, y, _ in labels if not learnable(i) and y in (0, 1) and i in got]
    assert np.mean([(s >= 0.3) == y for s, y in scored]) > 0.85


def plain_features(text):
    """Words, their heads and pairs of neighbouring wide characters, by a regular expression each."""
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text)
    out = set()
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", low):
        out.add(("word", w))
        out |= {("head", w[:k]) for k in (4, 5, 6) if len(w) > k}
    out |= {("pair", low[m.start() : m.start() + 6]) for m in re.finditer(rb"(?=[\xe0-\xef][\x80-\xbf]{2}[\xe0-\xef])", low)}
    return out


def test_toxicity_from_scratch(spark, tables):
    """Features, their choice by counts, and the non-negative risk, written out for all rows of a table that is smaller than the samples."""
    docs, labels = tables
    known = [(i, t) for i, _, t in labels if learnable(i) and t in (0, 1)]
    prior = sum(t for _, t in known) / len(known)
    confirmed = {i for i, t in known if t == 1}
    own = {i: plain_features(t) for i, t in docs}
    distinct = {(i, t) for i, t in docs if learnable(i)}
    positive, other = [own[i] for i, t in sorted(distinct) if i in confirmed], [own[i] for i, t in sorted(distinct)]
    assert len(distinct) < toxicity.UNLABELLED and len(positive) > 20
    p, u = Counter(f for s in positive for f in s), Counter(f for s in other for f in s)
    lift = {f: ((p[f] + 0.1) / len(positive)) / ((u[f] + 1) / len(other)) for f in p if p[f] >= 2}
    chosen = sorted((f for f, x in lift.items() if x >= 2), key=lambda f: -p[f] * math.log(lift[f]))
    assert 0 < len(chosen) <= toxicity.FEATURES
    place = {f: k for k, f in enumerate(chosen)}

    def matrix(sets):
        m = np.zeros((len(sets), len(chosen) + 1))
        for row, s in zip(m, sets):
            row[[place[f] for f in s if f in place]] = 1
            row[-1] = 1
        return m

    xp, xu = matrix(positive), matrix(other)
    w, m, v = (np.zeros(xp.shape[1]) for _ in range(3))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    seen = []
    for t in range(1, 501):
        as_negative_p, as_negative_u = sigmoid(xp @ w), sigmoid(xu @ w)  # the loss of calling a row negative
        up, uu = xp.T @ (as_negative_p * (1 - as_negative_p)) / len(xp), xu.T @ (as_negative_u * (1 - as_negative_u)) / len(xu)
        rest = as_negative_u.mean() - prior * as_negative_p.mean()
        g = -prior * up + (uu - prior * up) if rest >= 0 else -(uu - prior * up)
        g = g + 5e-5 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (501 - t) / 500 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        seen.append(w)
    w = sum(seen[250:]) / 250
    got = {r.doc_id: r.score for r in toxicity.op10_toxicity(spark, SF).collect()}
    want = {i: sigmoid(w[-1] + sum(w[place[f]] for f in own[i] if f in place)) for i, _ in docs}
    assert max(abs(got[i] - want[i]) for i, _ in docs) < 1e-6
    held = [(got[i], t) for i, _, t in labels if not learnable(i) and t in (0, 1) and i in got]
    assert np.mean([(s >= 0.5) == (t == 1) for s, t in held]) >= 0.85
