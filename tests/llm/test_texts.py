"""Licences, BPE, fingerprints, shingles: brute force and edge cases."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from deliverix.llm import bpe, fingerprints, licenses, near_dup, shingles, tokens

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "MIT License", "mit  license, MIT-LICENSE apache\nlicense", "x" * 70_000, "é" * 300 + " ça", "中文 字 符  a", "\U0001f600 a \U0001f600", "a b  c", "<|endoftext|> a"]


def odd_docs(spark, extra=True):
    rows = [(i, t, f"s{i}", 7) for i, t in enumerate(ODD)] + [(3, "\n\n", "s3", 7), (None, "some text without an id", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return df.withColumnsRenamed({"source": "labels", "n_chars": "score"}) if extra else df


def texts(n=3000, seed=1):
    r = random.Random(seed)
    alphabet = list(" \t\nab'é1, 　中\x1c\x85s") + ["\U0001f600"]
    return ["".join(r.choices(alphabet, weights=[8] + [2] * (len(alphabet) - 1), k=r.randint(0, 30))) for _ in range(n)]


def test_encoders_equal_the_libraries():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = texts() + [x or "" for x in ODD] + ["a<|endoftext|>b <|endoftext|> <|endoftext|>", "\0 a\0", "a\0 a"]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        t.encode_special_tokens = name.endswith("tiktoken")  # the library's default finds the special token in a text; tiktoken has none
        want = [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
        encoder = tokens.encoder_for(P.path(name))
        for _ in range(2):
            assert [x.tolist() for x in encoder([s.encode() for s in some])] == want


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    right = tokens.span_hashes
    monkeypatch.setattr(tokens, "span_hashes", lambda *a: right(*a) & np.uint64(31))
    some = texts(500) + ["a\0 a", "a a\0"]
    encoder = tokens.Encoder(tokens.library_encoder(P.path("byte_bpe_50k.json")).encode)
    for _ in range(2):
        assert [x.tolist() for x in encoder([s.encode() for s in some])] == [t.encode(s, add_special_tokens=False).ids for s in some]


def test_segment_tree_bpe_equals_tiktoken():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks(path), special_tokens={})
    r = random.Random(5)
    some = texts(1500) + [x or "" for x in ODD] + ["".join(r.choices("abcdefghijklmnopqrst", k=r.randint(1, 200))) for _ in range(800)] + ["ab" * 300, " " * 500 + "x"]
    c = bpe.codec(path, P.PATTERN)
    got = list(c.encode([s.encode() for s in some]))
    assert [x.tolist() for x in got] == [e.encode_ordinary(s) for s in some]
    assert [c.decode(x).decode() for x in got] == some


def test_bpe_query(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks(path), special_tokens={})
    docs = odd_docs(spark)
    got = bpe.digest_ids(bpe.encode_documents(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert len(got) == docs.count()
    by = {x.doc_id: x for x in got}
    for i, t in enumerate(ODD):
        ids = e.encode_ordinary(t or "")
        assert (by[i].n_tokens, by[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), path, P.PATTERN).count() == 0


def test_licenses(spark):
    docs = odd_docs(spark)
    got = licenses.scan_documents(docs).collect()
    assert len(got) == docs.count()
    for x in got:
        if x.doc_id is None:
            continue
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), ODD[x.doc_id] or ""))
        at = [(i, k) for p, k in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert x.base_labels == ",".join(sorted({k for _, k in at})) and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
    assert licenses.scan_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "free"),
    [
        ("MIT", {"mit"}, True),
        ("GPL-2.0-only", {"gpl"}, False),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, True),
        ("MIT AND GPL-3.0+", {"mit", "gpl"}, False),
        ("MIT OR GPL-3.0 AND EPL-2.0", {"mit", "gpl", "epl"}, True),
        ("(MIT OR GPL-3.0) AND EPL-2.0", {"mit", "gpl", "epl"}, False),
    ],
)
def test_expressions(text, labels, free):
    assert licenses.evaluate(text) == (labels, free)


def test_tags_and_notices(spark):
    """All columns of texts with tags, notices and long lines, against a plain search."""
    tag = "SPDX-License-Identifier: "
    rows = [
        (f"// {tag}MIT OR Apache-2.0\nCreative Commons, all rights reserved", {"mit", "apache", "cc", "proprietary"}),
        (f"/* {tag}GPL-2.0-only */ see the MIT License", {"gpl", "mit"}),
        (f"{tag}see LICENSE file", set()),
        (f"{tag}unknown-thing", set()),
        (f"{tag}LicenseRef-own.", {"licenseref-own"}),
        (f"{tag}MIT and more words", set()),
        ("word " * 50_000 + "GNU Affero General Public License", {"agpl", "gpl"}),
        ("mitlicense MIT Licenses", set()),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan_documents(docs).collect()}
    for i, (text, labels) in enumerate(rows):
        words = re.findall("[a-z0-9]+", text.lower())
        at = [k for p in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert set(filter(None, got[i].labels.split(","))) == labels and got[i].n_words == len(words) and got[i].n_base == len(at)
        assert 0 <= got[i].score <= 1 and (got[i].score > 0) == bool(labels)


def test_very_many_tags():
    """A text of tags alone, on lines of their own and on one: each byte is read a bounded number of times."""
    import time

    tag = b"SPDX-License-Identifier: MIT"
    assert licenses.scan(tag + b" */ " + tag + b"\n")[7] == ["MIT", "MIT"] and licenses.scan(tag + b" " + tag)[7] == ["MIT"]
    began = time.process_time()
    assert len(licenses.scan((tag + b"\n") * 40_000)[7]) == 40_000 and licenses.scan((tag + b" ") * 40_000)[7] == ["MIT"]
    assert time.process_time() - began < 20


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "MIT)", "()", "see LICENSE file", "MIT?", "some-thing", "MIT see below"])
def test_broken_expressions(text):
    assert licenses.evaluate(text) is None


def test_prefix_hash():
    h = fingerprints.PrefixHash("hello world hello there")
    assert h.span(0, 5) == h.span(12, 5) != h.span(1, 5)
    assert h.extension(0, h, 12) == 6
    assert h.extension(0, fingerprints.PrefixHash("hello wOrld"), 0) == 7
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choices("ab", k=r.randint(0, 40))) for _ in range(2))
        i, j = r.randint(0, len(a)), r.randint(0, len(b))
        want = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert fingerprints.PrefixHash(a).extension(i, fingerprints.PrefixHash(b), j) == want
    spans = h.spans(4)
    assert len(spans) == h.n and spans[3] == h.span(0, 4)[0] and spans[10] == h.span(7, 4)[0]
    assert fingerprints.PrefixHash("he").spans(4).tolist() == spans[:2].tolist() and len(fingerprints.PrefixHash("").spans(4)) == 0


def test_likeness_estimates_the_share_of_equal_spans():
    r = random.Random(8)
    say = lambda n: "".join(r.choices("abcdefghij ", k=n))
    off = []
    for n in [3, 8, 15, 16, 17, 40, 158, 160, 162, 500, 3000] * 20:
        a, b = say(n), say(r.choice([2, 50, 4000]))
        e = fingerprints.edit(a, b)
        cut = lambda t: {("\0" * 15 + t)[k : k + 16] for k in range(len(t))}
        want = len(cut(a) & cut(e)) / len(cut(a) | cut(e))
        off.append(fingerprints.likeness(*(fingerprints.fingerprint(fingerprints.PrefixHash(t)) for t in (a, e))) - want)
        assert abs(off[-1]) < 0.35
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1


def test_fingerprints(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in fingerprints.fingerprints(docs).collect()}
    full = [t or "" for t in ODD]
    assert sorted(got) == list(range(len(ODD)))
    for i, t in enumerate(full):
        n = len(t)
        edited = t[: n - n // 4] + full[(i + 1) % len(full)][: n // 4]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].edited_fingerprint == fingerprints.fingerprint(fingerprints.PrefixHash(edited))
        assert 0 <= got[i].near_next <= 1 and (got[i].near_edited == 1) == (edited == t)
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    assert fingerprints.fingerprints(docs.filter("doc_id = 4")).first().near_next == 1
    assert fingerprints.fingerprints(odd_docs(spark)).count() == len(ODD) + 2


def brute_components(rows):
    sets, link = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        link[i] = i
    find = lambda x: x if link[x] == x else find(link[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    link[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LEAF", 12)  # so that nodes branch and chunks form
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows = [(100 + i, t) for i, t in enumerate(ODD)]
    base = [word() for _ in range(120)]
    for i in range(60):  # a large group of near copies
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w)))
    shared = [word() for _ in range(40)]
    rows += [(2000 + i, " ".join(shared + [word() for _ in range(r.choice([5, 8, 12, 60]))])) for i in range(60)]  # near the threshold
    rows += [(3000 + i, " ".join(base[:50])) for i in range(30)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cls string")
    got = near_dup.near_duplicates(docs).collect()
    want = brute_components(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got) and len(got) == len(rows)


def test_recall_of_pairs_near_the_threshold(spark):
    """2,000 separate pairs at a similarity from 0.75 to 0.80: the trees and the sketches lose none of them."""
    r = random.Random(21)
    rows, want = [], 0
    for i in range(2000):
        n = r.randint(60, 120)
        w = [f"{i}_{k}" for k in range(n)]
        more = r.randint(int(n * 0.25) - 4, int(n / 0.75) - n + 4)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + [f"{i}_x{k}" for k in range(more)]))]
        want += 100 * (n - 4) >= 75 * (n + more - 4)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("component_id != doc_id").count() == want and want > 1000


def test_classes_hold_equal_sets_only():
    a, b = shingles.shingle_sets([b"a b c d e f", b"a b c d e g"])
    assert len(shingles.digest(a)) == 16 and shingles.digest(a) != shingles.digest(b) and shingles.digest(a) == shingles.digest(a.copy())


def test_near_duplicates_of_odd_tables(spark):
    docs = odd_docs(spark)
    assert near_dup.near_duplicates(docs).count() == docs.count()
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.groupBy("doc_id").count().filter("count > 1").count() == 0


def test_keep_one_of_rows_that_share_ids(spark):
    r = random.Random(11)
    say = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(30))
    group, alone, none, both = (say() for _ in range(4))
    rows = [(3, group, "a"), (5, group, "b"), (5, alone, "c"), (5, alone, "c"), (None, none, "d"), (None, say(), "e"), (None, say(), "f")]
    rows += [(None, group + " x", "g"), (None, none, "h"), (7, both, "i"), (7, both + " x", "j"), (9, both, "k")]
    rows += [(None, "", "l"), (None, "", "l"), (None, None, "m"), (11, " ", "n"), (11, "\n", "o"), (11, "\n", "p"), (11, "\n", "p")]
    docs = spark.createDataFrame([(*x, {"a": 1}) for x in rows], "doc_id long, text string, th string, m map<string, int>").repartition(3)
    for some in (docs, docs.orderBy("th"), docs.orderBy(docs["th"].desc())):
        kept = near_dup.keep_one(some).collect()
        tags = sorted({"h": "d", "i": "j"}.get(x.th, x.th) for x in kept)  # d or h: equal texts; i or j: the least hash
        assert "".join(tags) == "cdefgjllmnop"
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    marks = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in got if x.n_shingles)
    assert marks == [(0, 0, None)] * 5 + [(3, 0, None), (5, 0, None)] + [(5, 5, True)] * 2 + [(7, 7, True)] * 2 + [(9, 7, False)]
    assert sum(x.leads for x in got if x.n_shingles) == len("ccdhefg") + len("j")  # rows that are the same lead together


def test_near_duplicates_among_many_unlinked(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LEAF", 12)
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    shared = [word() for _ in range(60)]
    rows = [(i, " ".join(shared + [word() for _ in range(20)])) for i in range(240)]  # at similarity 0.58
    rows += [(1000 + i, rows[i][1] + " x y") for i in range(0, 240, 12)]
    seen, candidates = [], near_dup.candidates

    def counted(groups, across):
        if across:
            seen.append((groups.groupBy("key").count().agg({"count": "max"}).first()[0], groups.filter("abs(node) >= 2147483648").count()))
        return candidates(groups, across)

    monkeypatch.setattr(near_dup, "candidates", counted)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(rows)
    largest, wide = seen[0]
    assert largest <= 7 * near_dup.LEAF  # two blocks of about 2 * LEAF, not all classes of a node
    assert wide


def test_shingle_hashes_tell_long_words_apart():
    a, b = ("w" * 5000 + c for c in "xy")
    x, y = shingles.shingle_sets([a.encode(), b.encode()])
    assert x.tolist() != y.tolist() and np.array_equal(x, shingles.shingle_sets([a.upper().encode()])[0])


def test_texts_of_wanted_classes_pass_the_filter(spark):
    """The text filter loses no wanted text, gives one of repeated rows, and leaves the session's settings alone."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(None, "no id"), (7, "text 7"), (8, "another")], "doc_id long, text string")
    rows = docs.withColumn("th", F.xxhash64("text")).distinct().withColumn("cls", F.xxhash64("doc_id", "th"))
    classes = rows.select("cls", F.col("doc_id").alias("rep"), "th")
    wanted = rows.filter("doc_id is null or doc_id < 10")
    pairs = wanted.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    repeated = docs.withColumn("th", F.xxhash64("text")).groupBy("doc_id", "th").agg(F.count("*").alias("rows")).filter("rows > 1")
    before = {k: spark.conf.get(k, None) for k in near_dup.filter_of(5)}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near_dup.texts_of(pairs, docs, classes, repeated)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.select("cls", "text").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {k: spark.conf.get(k, None) for k in near_dup.filter_of(5)} == before


def test_the_filter_grows_with_what_is_wanted():
    bits = lambda n: int(near_dup.filter_of(n)["spark.sql.optimizer.runtime.bloomFilter.numBits"])
    assert bits(10) == 1 << 16 and bits(10**6) == 8 * 10**6 and bits(10**12) == near_dup.MOST_BITS
    assert all(f[f"spark.sql.optimizer.runtime.bloomFilter.max{k}"] == f[f"spark.sql.optimizer.runtime.bloomFilter.{v}"] for f in (near_dup.filter_of(10**7),) for k, v in (("NumItems", "expectedNumItems"), ("NumBits", "numBits")))
