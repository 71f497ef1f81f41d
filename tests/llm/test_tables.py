"""Archives, packing, ids, neighbours, classifiers and the pipeline."""

import base64
import hashlib
import http.client
import io
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deliverix.llm import ans, neighbours, packing, quality, toxicity, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "hello world " * 3000, "x" * 9000, "é à", "a", "<|endoftext|>", "one <|endoftext|> two<|endoftext|>  <|endoftext|>\n three"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "crc") for i, t in enumerate(ODD)] + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids_crc32 string")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def odd_dir(odd, tmp_path_factory):
    """A folder whose documents are the odd ones, each of them twice over."""
    where = str(tmp_path_factory.mktemp("odd"))
    odd.unionAll(odd).write.parquet(f"{where}/documents.parquet")
    return where


def rows_of(x):
    return toxicity.Rows([np.flatnonzero(r).tolist() for r in x], x.shape[1])


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_warc(spark):
    rows = [(1, "u1", "<p>a</p>"), (2, "u 2", "<p>a</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "é" * 1000), (None, "n", "<p>a</p>"), (None, "n", "alone"), (7, "u7", "z"), (7, "u7", "z")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    key = lambda p: base64.b32encode(hashlib.sha1((p or "").encode()).digest()).decode()
    lead = {}
    for i, _, p in rows:
        if i is not None:
            lead[key(p)] = max(lead.get(key(p), i), i)
    want = sorted((str(i), len((p or "").encode()), key(p), str(lead[key(p)]) if key(p) in lead and lead[key(p)] != i else "None") for i, _, p in rows)
    assert sorted((str(x.page_id), x.payload_bytes, x.payload_digest, str(x.refers_to)) for x in got) == want
    assert all((x.record_type == "revisit") == (x.refers_to is not None) for x in got)
    payload = {x.page_id: bytes(x.payload).decode() for x in got if x.payload is not None and x.page_id}
    assert payload[5] == "é" * 1000
    some = warc.read_records(index.filter("page_id in (2, 5)")).collect()
    assert {x.page_id for x in some} == {2, 5}
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def read_by_the_rules(path):
    """Fields and block of each record of a file, by the rules of the format alone."""
    data = open(path, "rb").read()
    while data:
        z = zlib.decompressobj(31)
        raw = z.decompress(data) + z.flush()
        assert z.eof  # a whole member, which is one record
        data = z.unused_data
        head, block = raw.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(fields["content-length"])
        assert version == "WARC/1.1" and block[size:] == b"\r\n\r\n"
        assert {"warc-type", "warc-record-id", "warc-date"} <= set(fields)
        assert fields["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block[:size]).digest()).decode()
        yield fields, block[:size]


class _Socket:
    def __init__(self, data):
        self.data = data

    def makefile(self, *_):
        return io.BytesIO(self.data)


def test_warc_by_a_second_reader(spark):
    """HTTP responses, payload digests, revisits and ids, as any reader of the format sees them."""
    rows = [(1, "http://a/1", "<p>a</p>"), (2, "http://a/2 x", "<p>a</p>"), (3, "http://a/3", "é\r\n\r\nx"), (4, None, ""), (5, "http://a/5", None), (None, "http://a/n", "alone"), (None, "http://a/n", "alone"), (3, "http://a/3", "é\r\n\r\nx")]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    seen, ids = [], []
    for path in sorted({r.path for r in index.collect()}):
        records = list(read_by_the_rules(path))
        assert records[0][0]["warc-type"] == "warcinfo" and records[0][0]["content-type"] == "application/warc-fields"
        for fields, block in records[1:]:
            assert fields["content-type"] == "application/http; msgtype=response" and fields["warc-warcinfo-id"] == records[0][0]["warc-record-id"]
            response = http.client.HTTPResponse(_Socket(block))
            response.begin()
            assert response.status == 200 and response.getheader("Content-Type") == "text/html; charset=utf-8"
            body = response.read() if fields["warc-type"] == "response" else None
            if body is not None:
                assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            seen.append((fields["warc-type"], fields["warc-target-uri"], body and body.decode(), fields.get("warc-refers-to-target-uri")))
        ids += [f["warc-record-id"] for f, _ in records]
    assert len(ids) == len(set(ids))
    want = [("revisit", "http://a/1", None, "http://a/2 x"), ("response", "http://a/2 x", "<p>a</p>", None), ("response", "http://a/3", "é\r\n\r\nx", None), ("response", "http://a/3", "é\r\n\r\nx", None)]
    want += [("revisit", "urn:empty", None, "http://a/5"), ("response", "http://a/5", b"", None), *[("response", "http://a/n", "alone", None)] * 2]
    assert sorted(map(str, seen)) == sorted(map(str, want))
    got = warc.read_records(index).filter("page_id = 4 or page_id = 3").collect()
    assert {(x.page_id, x.url, x.payload and x.payload.decode()) for x in got} == {(4, "", None), (3, "http://a/3", "é\r\n\r\nx")}


def test_warc_of_one_payload_on_many_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SLICE", 2000)
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.lit("<p>same</p>")).otherwise(F.col("id").cast("string")).alias("html"))
    index = warc.write_archives(rows.repartition(4))
    got = warc.read_records(index)
    assert got.count() == 3000 and got.filter("record_type = 'revisit' and refers_to = 2999").count() == 1999
    assert tasks_with_rows(got) > 4  # slices of files, more than there are files
    first = index.orderBy("path", "offset").first()
    path = first.path
    data = bytearray(open(path, "rb").read())
    data[first.offset + first.length - 6] ^= 1  # in the checksum of the first member
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="Error -3|damaged|incorrect"):
        warc.read_records(index.filter(F.col("path") == path)).count()


def test_ranges_are_joined_up_to_a_gap():
    rows = [("f", "a", 0, 10), ("f", "a", 10, 5), ("f", "a", 15 + warc.GAP + 1, 5), ("f", "b", 0, 3)]
    assert [(p, s, e, len(r)) for _, p, s, e, r in warc.ranges(rows)] == [("a", 0, 15, 2), ("a", 16 + warc.GAP, 21 + warc.GAP, 1), ("b", 0, 3, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    r = np.random.default_rng(seed)
    lengths = [int(x) for x in r.choice([1, 5, 300, 700, 1500, 2048, 5000], r.integers(1, 80)) + r.integers(0, 50, 1)]
    seen = [np.zeros(n, int) for n in lengths]
    windows = packing.pack(lengths)
    for size, pieces in windows:
        assert sum(p[2] for p in pieces) == size <= 2048 and size & (size - 1) == 0
        for doc, start, n in pieces:
            assert n > 0
            seen[doc][start : start + n] += 1
    assert all((s == 1).all() for s in seen)
    groups = packing.step_groups([n for n, _ in windows], 8192)
    sums = np.bincount(groups, weights=[n for n, _ in windows])
    assert sums.max() - sums.min() <= 2048


def test_packing(odd_dir, odd, tokenizer, spark):
    got = packing.op7_packing(spark, odd_dir).collect()
    fill, pieces = {}, {}
    for x in got:
        fill.setdefault(x.sequence_id, []).append((x.offset, x.length))
        text = "no id" if x.doc_id is None else ODD[x.doc_id]
        ids = ids_of(tokenizer, text, 1)
        assert x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
        pieces.setdefault(x.doc_id, []).append((x.start, x.length))
    for some in fill.values():
        at = 0
        for start, n in sorted(some):
            assert start == at
            at += n
        assert at & (at - 1) == 0 and at <= 2048
    for doc_id, some in pieces.items():
        n = len(ids_of(tokenizer, "no id" if doc_id is None else ODD[doc_id], 1))
        seen = np.zeros(n, int)
        for start, k in some:
            seen[start : start + k] += 1
        assert (seen == 2).all()  # each row once
    assert set(pieces) == {None, *range(len(ODD))} and packing.pack_by_default(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, ans.BLOCK_IDS, ans.BLOCK_IDS + 1, 50_000])
def test_rans(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 50_256).astype(np.uint32)
    data = ans.write_archive(ids, [3, None], [n - 1, 1])
    a = ans.Archive(pa.BufferReader(data))
    assert (a.read(0, n) == ids).all() and a.doc_ids.to_pylist() == [3, None]
    assert (a.read(n // 2, n - n // 2) == ids[n // 2 :]).all()
    if n == 50_000:
        with pytest.raises(ValueError, match="damaged"):
            ans.Archive(pa.BufferReader(data[:-1] + bytes([data[-1] ^ 1]))).read(0, n)


def test_ids(odd_dir, odd, tokenizer, spark):
    got = sorted(ans.op8_ids(spark, odd_dir).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted([None, *range(len(ODD))] * 2, key=lambda x: -1 if x is None else x)
    at = 0
    for x in got:
        ids = ids_of(tokenizer, "no id" if x.doc_id is None else ODD[x.doc_id], 0)
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert ans.read_ids(ans.write_ids(odd.limit(0), P.path("byte_bpe_50k.json"))).count() == 0


def test_ids_are_read_by_several_tasks(spark, monkeypatch):
    from deliverix.llm.common import stored

    monkeypatch.setattr(ans, "FILE_IDS", 3000)
    docs = spark.range(200).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("some words "), 40).alias("text")).repartition(6)
    files = stored(ans.write_ids(docs, P.path("byte_bpe_50k.json")), "id-index")
    got = ans.read_ids(files)
    assert files.count() > 4 and got.count() == 200 and tasks_with_rows(got) > 4
    assert tasks_with_rows(files.filter("ids > 0")) >= 1 and len({x.start for x in got.collect()}) == 200


def test_neighbours(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[0]  # a large group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [float("inf")] + [1.0] * 15), (905, [1.0]), (920, [2.0]), (906, [3.0]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    d = x.astype(float)
    queries = [i for i in range(600) if i % 20 == 0]
    hits = 0
    for q in queries:
        s = d @ d[q]
        s[q] = -np.inf
        want = {int(i) for i in np.lexsort((np.arange(600), -s))[:20]}
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in mine] == list(range(1, 21)) and len({g.vec_id for g in mine}) == 20
        assert all(abs(g.score - d[g.vec_id] @ d[q]) < 1e-9 for g in mine)
        assert [(-g.score, g.vec_id) for g in mine] == sorted((-g.score, g.vec_id) for g in mine)
        hits += len(want & {g.vec_id for g in mine})
    assert {g.query_id for g in got} == {*queries, 920} and hits >= 0.9 * 20 * len(queries)
    assert [(g.rank, g.vec_id, g.score) for g in got if g.query_id == 920] == [(1, 906, 6.0), (2, 905, 2.0)]  # vectors of another length meet each other
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2


def test_probing_holds_every_code_within_the_radius():
    r = np.random.default_rng(1)
    codes = r.integers(0, 1 << 16, (3000, 16)).astype(np.uint16)
    codes[:500] = codes[0] ^ (r.random((500, 16)) < 0.3).astype(np.uint16) * r.integers(0, 1 << 16, (500, 16)).astype(np.uint16)
    tables = neighbours.Tables(codes)
    for radius in (0, 3, 15, 16, 40, 70, 110):
        assert sum(s + 1 for s in neighbours.shares(radius, 16)) == radius + 1
        far = np.bitwise_count(codes ^ codes[0]).sum(1)
        assert tables.within(codes[0], radius).tolist() == np.flatnonzero(far <= radius).tolist()
    few = neighbours.Tables(np.tile(codes[:40], (300, 1)))  # few values with many rows each
    assert few.within(codes[0], 0).tolist() == list(range(0, 12_000, 40))


def test_neighbours_of_many_repeated_rows(spark):
    two = spark.range(24_000).select(F.when(F.col("id") < 12_000, 0).otherwise(20).alias("vec_id"), F.when(F.col("id") < 12_000, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8))).alias("embedding"))
    got = neighbours.nearest(two.withColumn("vec_id", F.col("vec_id").cast("long")), F.col("vec_id") % 20 == 0).collect()
    assert sorted((x.query_id, x.rank, x.vec_id) for x in got) == [(q, k, 20 - q) for q in (0, 20) for k in range(1, 21)]
    assert all(abs(x.score - 0.6) < 1e-12 for x in got)


def test_samples_depend_on_the_rows_alone(spark):
    from deliverix.llm.common import bounded_sample

    same = spark.range(25_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert bounded_sample(same, 3000).count() == 1 and bounded_sample(same.limit(0), 3000).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    some = {tuple(r) for r in bounded_sample(many, 3000).collect()}
    assert 2700 <= len(some) <= 3300 and bounded_sample(many, 30_000).count() == 20_000
    for other in (many.repartition(7).unionAll(same), many.orderBy(F.desc("text")).unionAll(many), many.repartition(37, "doc_id").coalesce(2)):
        got = [tuple(r) for r in bounded_sample(other, 3000).collect()]
        assert len(got) == len(set(got)) and len(some & set(got)) > 0.98 * len(some)  # one distinct row more moves the share a little
    assert {tuple(r) for r in bounded_sample(many.unionAll(many), 3000).collect()} == some


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """The tables of sf0.01 as one file each, and as 37 files in another order."""
    folders = []
    for files in (1, 37):
        where = str(tmp_path_factory.mktemp(f"dealt{files}"))
        for t in ("documents", "labels", "embeddings"):
            df = spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
            (df.coalesce(1) if files == 1 else df.repartition(37)).write.parquet(f"{where}/{t}.parquet")
        folders.append(where)
    return folders


@pytest.mark.parametrize("query", ["op6_quality", "op9_nearest", "op10_toxicity"])
def test_results_do_not_depend_on_files_and_splits(spark, dealt, monkeypatch, query):
    """Samples smaller than the tables, for several files and split sizes."""
    from deliverix.llm import queries

    for module, name, most in ((quality, "TRAINING_LABELS", 200), (quality, "CALIBRATION_ROWS", 100), (toxicity, "POSITIVES", 20), (toxicity, "UNLABELLED", 300), (neighbours, "SAMPLE", 200)):
        monkeypatch.setattr(module, name, most)
    found = []
    try:
        for folder, split in ((dealt[0], "128m"), (dealt[0], "64k"), (dealt[1], "128m"), (dealt[1], "64k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            df = queries.queries()[query](spark, folder)
            rows = [tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect()]
            found.append(sorted(rows))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(rows == found[0] for rows in found[1:])


def test_index_recall_on_the_given_vectors(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.stack(v.embedding).astype(float)
    got = {}
    for g in neighbours.op9_nearest(spark, SF).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    hits = [len(got[q] & set(v.vec_id[np.argsort(-np.where(v.vec_id == q, -np.inf, x @ x[i]))[:20]])) for i, q in enumerate(v.vec_id) if q % 20 == 0]
    assert np.mean(hits) >= 0.9 * 20


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_tables(spark, odd, module):
    column = "quality" if module is quality else "toxic"
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(3, None), (None, 1)], f"doc_id long, {column} int")
    got = module.classify(odd, labels).collect()
    assert len(got) == len(ODD) + 1
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= module.THRESHOLD)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    assert module.classify(odd.limit(0), labels).count() == 0
    assert module.classify(odd, labels.limit(0)).count() == len(got)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_repeated_rows_and_clashing_names(spark, module):
    column = "quality" if module is quality else "toxic"
    long = "vile scum " * 40_000
    texts = F.when(F.col("id") % 2 == 0, F.lit("good plain words here")).otherwise(F.lit("vile scum!!! $$$"))
    many = spark.range(25_000).select(F.lit(1).cast("long").alias("doc_id"), texts.alias("text"))
    few = spark.createDataFrame([(2, long), (3, ""), (4, None), (6, "vile scum"), (7, "words")], "doc_id long, text string")
    docs = many.unionAll(few).withColumns({c: F.lit("clash") for c in ("score", "predicted", "held_out", "label", "f", "positive")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (6, 1), (7, 0)], f"doc_id long, {column} int")
    got = module.classify(docs, labels)
    assert got.count() == 25_005 and got.filter("score is null or not score between 0 and 1").count() == 0
    keep = module.keep_good if module is quality else module.keep_clean
    kept = keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.filter("predicted = 1" if module is quality else "predicted = 0").count()
    assert keep(docs.limit(0), labels).count() == 0


def test_quality_equals_a_plain_discriminant(spark):
    """Scores of op6 against densities that numpy computes from the same vectors, without Cholesky factors."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.score for r in quality.op6_quality(spark, sf).collect()}
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = sorted(label)
    x, y = np.array([quality._statistics(text[i]) for i in ids]), np.array([label[i] for i in ids])
    d = x.shape[1]
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * own[k] for k in (0, 1))

    def log_density(k, rows):
        few = min(0.9, 0.1 + d / (d + (y == k).sum()))
        c = (1 - few) * own[k] + few * pooled
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-3 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        e = rows - x[y == k].mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e) - 0.5 * np.linalg.slogdet(c)[1]

    every = sorted(text)
    f = np.array([quality._statistics(text[i]) for i in every])
    diff = log_density(1, f) - log_density(0, f)
    s = np.array([got[i] for i in every])
    z = np.sign(diff) * np.log1p(np.abs(diff))
    some = (s > 1e-6) & (s < 1 - 1e-6)
    slope, offset = np.polyfit(z[some], np.log(s[some] / (1 - s[some])), 1)
    assert slope > 0 and np.allclose(1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40))), s, atol=1e-6)


def test_toxicity_features_by_hand():
    from deliverix.llm.common import span_hashes

    def features(text):
        return set(toxicity.occurrences([text.encode()])[1].tolist())

    long = "w" * 30
    assert features(long + "a") != features(long + "b") and features("A b") == features("b,a") == features("a b b")
    assert len(features("ab abc")) == 2 and len(features("abcdefg")) == 4  # the word, and heads of 4, 5 and 6 bytes
    assert features("好坏人") & features("说好坏") and not features("好坏") & features("坏好")
    big = b"abc" + b"\n" * 32
    assert int(span_hashes(big, np.array([0]), np.array([3]))[0]) in features("abc")
    assert features("") == set() == features("?! ")


def test_non_negative_risk_falls_along_its_gradient():
    """The steps' direction against finite differences of the stated risk, on both sides of zero."""
    r = np.random.default_rng(3)
    x_p, x_u = (r.random((40, 4)) < 0.5).astype(np.float32), (r.random((90, 4)) < 0.4).astype(np.float32)
    loss = lambda z: 1 / (1 + np.exp(z))

    def risk(w, prior):
        zp, zu = x_p @ w[:-1] + w[-1], x_u @ w[:-1] + w[-1]
        rest = loss(-zu).mean() - prior * loss(-zp).mean()
        return prior * loss(zp).mean() + rest if rest >= 0 else -rest

    for prior in (0.2, 0.99):
        w = np.zeros(5)
        g = np.array([(risk(w + 1e-5 * e, prior) - risk(w - 1e-5 * e, prior)) / 2e-5 for e in np.eye(5)])
        got, offset = toxicity.non_negative_fit(rows_of(x_p), rows_of(x_u), prior, steps=1, rate=1e-3, decay=0.0)
        assert (np.sign(np.append(got, offset)) == -np.sign(g))[np.abs(g) > 1e-4].all()
    before = risk(np.zeros(5), 0.2)
    w, b = toxicity.non_negative_fit(rows_of(x_p), rows_of(x_u), 0.2, decay=0.0)
    assert risk(np.append(w, b), 0.2) <= before


def test_quality_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = quality.op6_quality(spark, sf).join(labels, "doc_id").filter("held_out")
    assert q.filter("predicted = quality").count() >= 0.9 * q.count()
    t = toxicity.op10_toxicity(spark, sf).join(labels, "doc_id").filter("held_out")
    assert t.filter("predicted = toxic").count() >= 0.85 * t.count()


def test_non_negative_risk():
    r = np.random.default_rng(0)
    x_p = (r.random((300, 5)) < [0.9, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    clean = (r.random((900, 5)) < [0.02, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    w, b = toxicity.non_negative_fit(rows_of(x_p), rows_of(np.vstack([x_p[:100], clean])), 0.1)
    assert w[0] + b > 0 > b and w[0] > 3 * np.abs(w[1:]).max()


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, before = {}, docs
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.schema == docs.schema and after.join(before, "doc_id", "left_anti").isEmpty()
        rows[name] = {r.doc_id for r in after.select("doc_id").collect()}
        before = after
    got = quality.op6_quality(spark, SF)
    assert rows["quality"] == {r.doc_id for r in got.filter("predicted = 1").collect()}
    held = {r.doc_id for r in toxicity.classify(docs.join(got.filter("predicted = 1"), "doc_id", "left_semi"), spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0").collect()}
    assert rows["toxicity"] == held
    packed = c.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == rows["near_dup"]
    assert [n for n, _ in c.STAGES] == ["quality", "toxicity", "near_dup", "packing"] and c.ORACLE_SQL is None


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, empty and very long texts and clashing names through all stages."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.join(quality.op6_quality(spark, SF).filter("predicted = 1"), "doc_id", "left_semi").join(toxicity.op10_toxicity(spark, SF).filter("predicted = 0"), "doc_id", "left_semi")
    rows = [r.text for r in plain.orderBy(F.desc("n_chars")).limit(3).collect()]
    odd = [(None, rows[0]), (None, rows[1]), (7, rows[2]), (7, rows[2]), (8, None), (9, ""), (None, None), (10, (rows[0] + " ") * 60)]
    names = ("kept", "cls", "score", "label", "query", "digest", "lead")
    mine = spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in odd], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    mine.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    after = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        before, after = after, stage(spark, after, str(tmp_path)).cache()
        assert after.columns == mine.columns, name
        assert after.exceptAll(before).isEmpty(), name
    kept = [(r.doc_id, r.text) for r in after.collect()]
    assert sorted((str(i), t) for i, t in kept if t) == sorted((str(i), t) for i, t in [(None, rows[0]), (None, rows[1]), (7, rows[2])])  # 10 repeats a text of a smaller id
    got = c.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in after.collect()}
    mine.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert c.run(spark, f"{tmp_path}/none").count() == 0
