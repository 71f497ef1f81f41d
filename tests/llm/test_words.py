"""Lexical search, fill-in-the-middle and token counts: brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from deliverix.llm import fill_in_middle, lexical, token_counts

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "a A a b", "é É 中文", "b a c <P> x", "x" * 70_000, "a " * 9000, "\U0001f600 a\x85 \xa0b", "tail  \n", " \tlead", "\0a\0 b", "<s> </s> <0x0A>", "▁a ▁▁ b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i}", 7) for i, t in enumerate(ODD)] + [(5, "a A a b", "again", 7), (None, "a b c", None, 7), (None, None, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string, score long")


def same_as_sql(got, sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    want = c.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).to_numpy().tolist())) for x in (got.toPandas(), want))
    assert [x.replace(".0", "") for x in a] == [x.replace(".0", "") for x in b]


def ranked(texts, items, top=20):
    """The contract of the ranked search, document by document."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {k: k + 32 for k in range(65, 91)}
    sets = [(i, Counter(pattern.findall((t or "").translate(lower)))) for i, t in texts]
    sets = [(i, c) for i, c in sets if c]
    n, length = len(sets), sum(c.total() for _, c in sets)
    df = Counter(t for _, c in sets for t in c)
    out = []
    for item, t in items:
        asked = pattern.findall((t or "").translate(lower))
        scores = []
        for i, c in sets:
            m = 75 + 25 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x in asked)
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out += [(item, k + 1, None if i == math.inf else i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return out


def in_order(rows):
    return sorted(rows, key=str)


def test_search_of_odd_tables(spark, docs):
    items = [(1, "a b"), (2, "B b b é zzz"), (None, "a c"), (None, "a c"), (3, None), (4, "..."), (5, "nowhere"), (6, "中文 x")]
    frame = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for top in (20, 3):
        assert in_order(map(tuple, lexical.search(docs, frame, top).collect())) == in_order(ranked(texts, items, top))
    same_as_sql(lexical.search(docs, frame), lexical.ORACLE_SQL, documents=docs, benchmark=frame)
    assert lexical.search(docs.limit(0), frame).count() == 0 and lexical.search(docs, frame.limit(0)).count() == 0
    assert lexical.search(docs.filter("text is null"), frame).count() == 0


def corpus(n, seed=2):
    """Texts of three vocabularies with rare and common words, some equal, some long, and items that are passages of them."""
    r = random.Random(seed)
    words = [[f"{c}{int(r.paretovariate(0.7)) % 400}" for _ in range(4000)] for c in "abc"]
    texts = [(i, " ".join(r.choices(words[i % 3], k=r.choice([5, 50, 400])))) for i in range(n)]
    texts += [(n + i, texts[i][1]) for i in range(60)]
    items = [(i, " ".join(texts[7 * i][1].split()[:40])) for i in range(40)]
    return texts, items


@pytest.mark.parametrize(("terms", "entries"), [(16_384, 40_000), (200, 4_000_000)])
def test_search_of_many_blocks_and_batches(spark, monkeypatch, terms, entries):
    texts, items = corpus(900)
    monkeypatch.setattr(lexical, "TERMS", terms)
    monkeypatch.setattr(lexical, "ENTRIES", entries)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert in_order(map(tuple, got.collect())) == in_order(ranked(texts, items))


def test_whole_numbers_beyond_doubles():
    """Scores of an item with very many repeats, which doubles don't hold."""
    batch = lexical.Batch([1], [Counter({5: 3, 9: 10**10})]).close()
    search = lexical.Search(batch, np.array([7001, 3]), 10, 100, np.ones(1, np.int64), 20)
    assert search.q.dtype == np.int64
    x = search.entries(np.array([10, 12]), np.array([0, 2, 4]), np.array([0, 1, 0, 1]), np.array([1, 7, 2, 7]))
    search.block(np.array([4, 5]), x)
    want = [sum(k * w * (10**9 * f // (1000 * f + 12 * (75 + 25 * n * 10 // 100))) for k, w, f in ((3, 7001, a), (10**10, 3, 7))) for a, n in ((1, 10), (2, 12))]
    assert search.best[0, :2].tolist() == sorted(want, reverse=True)


def test_bounds_hold_and_prune(spark):
    """No row of a node exceeds its bound, and far documents are dropped unscored."""
    r = np.random.default_rng(3)
    x = np.where(r.random((500, 60)) < 0.1, r.integers(1, 10**6, (500, 60)), 0).astype(float)
    groups = np.array([0, 7, 8, 30])
    tree = lexical.Tree(x, groups, r.standard_normal((60, 8)))
    assert sorted(tree.order.tolist()) == list(range(500))
    q = r.integers(0, 9000, (20, 60)).astype(float)
    bounds = tree.bounds(q, np.sqrt(np.add.reduceat(q**2, groups, axis=1)))
    for node, (a, b) in enumerate(tree.span):
        assert (x[tree.order[a:b]] @ q.T <= bounds[:, node]).all()

    texts, items = corpus(4000)
    batch = lexical.Batch()
    for i, t in items[:5]:
        batch.ids.append(i)
        batch.counts.append(Counter(lexical._hashes([w.encode() for w in t.split()])))
    batch.close()
    found = lexical.vectors(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), batch.terms).collect()
    search = lexical.Search(batch, np.full(len(batch.terms), 5000), 4060, 10**6, np.ones(5, np.int64), 20)
    offsets = np.cumsum([0] + [len(f.terms) for f in found])
    flat = lambda k: np.array([v for f in found for v in f[k]], np.int64)
    search.block(np.arange(len(found)), search.entries(np.array([f.n for f in found]), offsets, flat("terms"), flat("tfs")))
    assert search.visited < 0.6 * search.held


def test_search_against_sql(spark):
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    same_as_sql(lexical.op11_lexical(spark, SF), lexical.ORACLE_SQL, documents=d, benchmark=b)


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected_example(i, text):
    text = text or ""
    units = UNIT.findall(text)
    if i is None:
        return len(units), "plain", text, None, None
    h = hashlib.sha256(f"42:{i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", text, None, None
    if h4 % 100 < 80:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def test_examples():
    r = random.Random(4)
    alphabet = " \t\n\x0b\x0c\r\x08\x0e\x1f\0a<PSM>é中\U0001f600\xa0\x89\xad"
    rows = [(i, "".join(r.choices(alphabet, k=r.randint(0, 40)))) for i in range(4000)] + [(10_000 + i, t) for i in range(9) for t in ODD] + [(None, "a b")]
    got = fill_in_middle.transform([i for i, _ in rows], [(t or "").encode() for _, t in rows])
    for (i, t), (n, e) in zip(rows, got, strict=True):
        assert (n, e.form, e.output.decode(), e.prefix_chars, e.middle_chars) == expected_example(i, t)
        assert fill_in_middle.restore(e.form, e.output).decode() == (t or "")


def test_examples_of_odd_tables(spark, docs, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "_BLOCK", 100)
    got = fill_in_middle.examples(docs)
    assert in_order((x.doc_id, x.n, x.form, x.output, x.prefix_chars, x.middle_chars) for x in got.collect()) == in_order((x.doc_id, *expected_example(x.doc_id, x.text)) for x in docs.collect())
    same_as_sql(fill_in_middle.digests(got), fill_in_middle.ORACLE_SQL, documents=docs)
    assert fill_in_middle.digests(fill_in_middle.examples(docs.limit(0))).count() == 0


def test_examples_against_sql(spark):
    same_as_sql(fill_in_middle.op12_fill_in_middle(spark, SF), fill_in_middle.ORACLE_SQL, documents=spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return lambda texts: [len(x) for x in p.encode([t or "" for t in texts], num_threads=1)]


def test_counts_equal_the_library(library, monkeypatch):
    path = P.path("piece_bpe_32k.model")
    t = token_counts.Transducer(token_counts.Pieces(path))
    r = random.Random(6)
    mixed = list(" \t\nab'é1, 　中\x1c\x85s▁") + ["\U0001f600"]
    some = ["".join(r.choices(mixed, weights=[8] + [2] * (len(mixed) - 1), k=r.randint(0, 40))) for _ in range(1500)]
    some += ["".join(r.choices(t.pieces.pieces, k=r.randint(0, 60))) for _ in range(1500)]
    some += ["".join(r.choices(a, k=r.randint(0, 60))) for a in ("etaoinshr", "xy=-_ ", "▁ a") for _ in range(700)]
    some += ["ab" * 4000, "x" * 9001, " " * 5000 + "a", "中文字符" * 2000, "日本語テキスト漢字" * 999, *map("".join, (r.choices(a, k=9000) for a in ("abcdefgh", "aeiou_-=/.")))]
    want = library([*some, *ODD])
    encoded = [(x or "").encode() for x in [*some, *ODD]]
    assert t.of_texts(encoded).tolist() == want
    monkeypatch.setattr(token_counts, "CHUNK", 7)  # nearly every chunk starts where the state isn't known
    monkeypatch.setattr(token_counts, "TRANSITIONS", 0)  # compiled anew for each block
    monkeypatch.setattr(token_counts, "_BLOCK", 60_000)
    assert t.of_texts(encoded).tolist() == want


def test_maps_of_chunks_compose():
    """The scan over chunks against one lane over the whole of a text."""
    t = token_counts.transducer(P.path("piece_bpe_32k.model"))
    symbols = t.symbol[np.frombuffer(("▁" + "antidisestablishment" * 300).encode("utf-32-le"), np.uint32)]
    edge = np.array([0, len(symbols)])
    start = np.arange(0, len(symbols), 13)
    got = t._totals(symbols, start, np.append(start[1:], edge[-1]), start == 0)
    assert got[:-1].sum() == 0 and got[-1] == t.run(np.zeros(1, np.int64), symbols, edge[:1], edge[1:])[1][0]


def test_counts_of_odd_tables(spark, docs, library):
    got = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), limit=100)
    rows = docs.collect()
    want = [(x.doc_id, len((x.text or "").encode()), n, n > 100) for x, n in zip(rows, library([x.text for x in rows]))]
    assert in_order(map(tuple, got.collect())) == in_order(want)
    assert token_counts.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_count_query(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(x.doc_id, len((x.text or "").encode()), n, n > 4096) for x, n in zip(rows, library([x.text for x in rows]))]
    assert in_order(map(tuple, token_counts.op13_token_counts(spark, SF).collect())) == in_order(want)
