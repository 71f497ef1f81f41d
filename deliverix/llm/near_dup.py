"""MinHash near-duplicates: a chosen-path set similarity join, confirmed on whole shingle sets.

Documents with equal shingle sets (by a 128-bit cryptographic hash of the whole set) form a class, which has a number
of its own; only classes are joined. Each class is a set of minwise
tokens. A tree picks one of the token positions at its root and puts each class below the token it has there;
nodes with many classes branch again by positions that the node's own hash picks (from the third level on 4/3
of them, so that a pair at the threshold survives a level with an expected one path), unless branching didn't
halve them, and small nodes compare their classes exhaustively by sketches. Twenty independent trees repeat this. Pairs whose sketches agree
well enough are confirmed on the whole shingle sets of the texts.

A node emits a forest first: each class with its most alike earlier one. Confirmed pairs give components;
a second pass emits every remaining pair of a node across two components. Nodes that stay large (groups
of near copies) are dealt out in chunks that share a leader. In the second pass their classes outside the
node's main component, and those of it, are dealt into blocks; each pair of blocks that isn't within the
main component is a task, so that no pair is left out and no task has more than two blocks.

Defined results: null or blank texts have an empty set, no links, and are kept; a null doc_id is the
smallest of ids and names no document: rows that have it are told apart by their texts, and a component that
one leads has a null component_id, and kept is null there; of rows with one doc_id and several texts each is linked by its own
text, and the least text hash leads; repeated rows are copies of each other; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverix.llm.common import mix, settings, small_batches, stored, table, text_bytes
from deliverix.llm.links import components
from deliverix.llm.shingles import LANES, TOKENS, alike, digest, likeness, shingle_sets, signature, sketch

PERCENT = 75
TREES = 20
#: Classes that a node may compare exhaustively, and the levels of a tree.
LEAF, DEPTH = 200, 5
#: Nodes of all trees that a class can be in: in each tree, from the third level on, twice as many at most.
MOST_NODES = TREES * 2 ** (DEPTH - 2)
#: Estimated similarity from which a pair is confirmed (that of pairs at 0.75 has a standard error of 0.023).
CANDIDATE = 0.65
#: Bits of a Bloom filter for each wanted text (about one in fifty others passes), and at most in all (128 MB; beyond that more others pass).
FILTER_BITS, MOST_BITS = 8, 1 << 30

_BASE = "doc_id long, n_shingles long, th long, digest binary, sig binary, sketch binary"


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, LANES // 4)


def describe(docs: DataFrame) -> DataFrame:
    """Set size, digest, signature and sketch of the set of each row; the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(text_bytes(b.column(1)))
            sigs = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    b.column(2),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if s is None else s[:TOKENS].tobytes() for s in sigs], pa.binary()),
                    pa.array([None if s is None else sketch(s) for s in sigs], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "th", "digest", "sig", "sketch"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, _BASE)


def _picks(node: np.ndarray, deep: bool) -> np.ndarray:
    """The positions that nodes pick: one, and for a third of the deep nodes a second (else -1)."""
    h = mix(node)
    first = (h % np.uint64(TOKENS)).astype(np.int64)
    second = ((h >> np.uint64(20)) % np.uint64(TOKENS)).astype(np.int64)
    return np.stack([first, np.where(deep & ((h >> np.uint64(40)) % np.uint64(3) == 0), second, -1)], 1)


def _children(node: np.ndarray, sig: np.ndarray, cls: np.ndarray, up: np.ndarray, deep: bool) -> pa.RecordBatch:
    """The nodes that classes reach from their nodes; up is the size of the node above."""
    at = _picks(node, deep)
    nodes, members, sizes = [], [], []
    for j in (0, 1):
        row = np.flatnonzero((at[:, j] >= 0) & ((at[:, j] != at[:, 0]) | (j == 0)))
        where = at[row, j]
        token = sig[row, where].astype(np.uint64)
        nodes.append(mix(node[row] + mix(token + (where.astype(np.uint64) + np.uint64(1) << np.uint64(40)))))
        members.append(cls[row])
        sizes.append(up[row])
    columns = [np.concatenate(nodes).view(np.int64), np.concatenate(members), np.concatenate(sizes)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "cls", "up"])


def _sized(nodes: DataFrame, label: str) -> DataFrame:
    """Members of the nodes that have two or more, with the node's size and leader, and whether it ends there: it is small, or has over half of the node above, which more branching would not part."""
    last = (F.col("n") <= LEAF) | (F.col("n") > F.col("up") / 2)
    size = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("cls").alias("lead"), F.max("up").alias("up")).filter("n > 1").withColumn("last", last)
    # stored, so that the join has a plain shuffle on both sides and AQE splits a large node's members
    return stored(nodes.drop("up").join(stored(size, f"{label}-sizes"), "node"), label)


def leaves(classes: DataFrame) -> DataFrame:
    """Members (node, cls, n, lead) of all last nodes of all trees."""
    many = mix(np.arange(1, 1 << 10, dtype=np.uint64))
    _, own = np.unique(_picks(many, False)[:, 0], return_index=True)
    roots = many[own[:TREES]]  # trees whose roots pick different positions

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, cls = _tokens(b.column(1)), b.column(0).to_numpy()
            for r in roots:
                yield _children(np.full(len(cls), r), sig, cls, np.full(len(cls), total), False)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, cls, lists = _tokens(b.column(1)), b.column(0).to_numpy(), b.column(2)
            row = np.repeat(np.arange(len(cls)), np.diff(lists.offsets.to_numpy()))
            node, up = (x.to_numpy() for x in lists.flatten().flatten())
            for i in range(0, len(row), 20_000):
                some = slice(i, i + 20_000)
                yield _children(node[some].view(np.uint64), sig[row[some]], cls[row[some]], up[some], deep)

    schema = "node long, cls long, up long"
    total = classes.count()
    members = _sized(classes.select("cls", "sig").mapInArrow(first, schema), "tree")
    ends = [members.filter("last")]
    for depth in range(2, DEPTH + 1):
        large, deep = members.filter("not last"), depth > 2  # the closure of further has it
        if large.isEmpty():
            break
        at = large.groupBy("cls").agg(F.collect_list(F.struct("node", "n")).alias("nodes"))  # at most the paths of one class
        nodes = classes.select("cls", "sig").join(at, "cls").select("cls", "sig", "nodes").mapInArrow(further, schema)
        members = _sized(nodes, "tree")
        ends.append(members if depth == DEPTH else members.filter("last"))
    return reduce(DataFrame.unionAll, ends)


def _forest(cls: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Each class of a group with its most alike earlier one."""
    out = []
    for i in range(0, len(cls), 64):
        e = likeness(m[i : i + 64, None], m[None, : i + 64])
        e[np.arange(e.shape[1]) >= np.arange(i, i + len(e))[:, None]] = 0  # earlier ones only
        best = e.argmax(1)
        j = np.flatnonzero(e[np.arange(len(e)), best] >= CANDIDATE)
        out.append(np.stack([cls[best[j]], cls[i + j]], 1))
    return np.concatenate(out)


def _across(cls: np.ndarray, m: np.ndarray, root: np.ndarray, side: np.ndarray, node: int, nodes: np.ndarray) -> np.ndarray:
    """All pairs of a group across roots that no other group gives: within it if side is 0, else between sides 1 and 2; the node is the first that both are in."""
    out = []
    within = side[0] == 0
    ones, twos = (np.arange(len(cls)),) * 2 if within else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    for i in range(0, len(ones), 64):
        one = ones[i : i + 64]
        two = twos[: i + 64] if within else twos
        e = likeness(m[one, None], m[None, two]) >= CANDIDATE
        e &= root[one, None] != root[None, two]
        if within:
            e &= two < one[:, None]
        j, at = np.nonzero(e)
        for k in range(0, len(j), 500):  # some MB of comparisons of nodes at once
            a, b = two[at[k : k + 500]], one[j[k : k + 500]]
            x, y = nodes[a], nodes[b]
            both = (x[:, :, None] == y[:, None, :]).any(2)
            first = x[np.arange(len(x)), both.argmax(1)] == node
            out.append(np.stack([cls[a[first]], cls[b[first]]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def candidates(groups: DataFrame, across: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of groups(key, cls, sketch): a forest of each, or all pairs across roots.

    Rows of a key meet in one task, a chunk or two blocks of bounded size. Across roots, groups also has root, side (0: pairs
    within the group, 1 and 2: pairs between its two blocks), node, and nodes, the sorted nodes of the class.
    """

    def of(x: list[np.ndarray]) -> pa.RecordBatch:
        key, cls, m = x[:3]
        start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        end = np.append(start[1:], len(key))
        out = []
        if not across:
            two = start[end - start == 2]
            two = two[(likeness(m[two], m[two + 1]) >= CANDIDATE) & (cls[two] != cls[two + 1])]
            out.append(np.stack([cls[two], cls[two + 1]], 1))
        for s, t in zip(start, end):
            if across and t - s > 1:
                out.append(_across(cls[s:t], m[s:t], x[3][s:t], x[4][s:t], x[5][s], x[6][s:t]))
            elif t - s > 2:
                out.append(_forest(cls[s:t], m[s:t]))
        p = np.unique(np.sort(np.concatenate(out), 1), axis=0) if out else np.zeros((0, 2), np.int64)
        p = p[p[:, 0] != p[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
        now = [b.column(0).to_numpy(), b.column(1).to_numpy(), _sketches(b.column(2))]
        if across:
            start = b.column(6).offsets.to_numpy()
            some = np.minimum(np.arange(MOST_NODES), np.diff(start)[:, None] - 1)  # the last one is repeated
            nodes = b.column(6).flatten().to_numpy()[start[:-1, None] - start[0] + some]
            now += [b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_numpy(), nodes]
        return now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            rest = arrays(b) if rest is None else [np.concatenate(x) for x in zip(rest, arrays(b))]
            if len(rest[0]) and rest[0][0] != rest[0][-1]:
                cut = int(np.searchsorted(rest[0], rest[0][-1]))
                yield of([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield of(rest)

    columns = ["key", "cls", "sketch"] + (["root", "side", "node", "nodes"] if across else [])
    rows = groups.select(*columns).repartition("key").sortWithinPartitions("key", "cls")
    return rows.mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are alike; texts is (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
            where: dict[int, tuple[int, int]] = {int(v): (3, i) for i, v in enumerate(b)} | {int(v): (2, i) for i, v in enumerate(a)}
            sets = dict(zip(where, shingle_sets(text_bytes(pa.array([x.column(c)[i].as_py() for c, i in where.values()], pa.string())))))
            ok = np.array([alike(sets[int(p)], sets[int(q)], PERCENT) for p, q in zip(a, b)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    with_b = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def filter_of(wanted: int) -> dict[str, str]:
    """Settings for Spark's own Bloom filter before a join of texts, made for so many wanted ones."""
    items = max(wanted, 1000)
    bits = min(max(FILTER_BITS * items, 1 << 16), MOST_BITS)
    runtime = "spark.sql.optimizer.runtime.bloomFilter"
    sized = {"expectedNumItems": items, "maxNumItems": items, "numBits": bits, "maxNumBits": bits, "applicationSideScanSizeThreshold": 0, "creationSideThreshold": 1 << 60}
    return {f"{runtime}.{k}": str(v) for k, v in sized.items()} | {f"{runtime}.enabled": "true", "spark.sql.optimizer.runtimeFilter.number.threshold": "1"}


def texts_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(cls, text) of the classes in pairs: the text of the row that stands for the class. repeated has the (doc_id, th) of several rows, of which one is taken.

    Few rows of docs are wanted, so a Bloom filter of their text hashes, sized by their number, keeps most texts out of the shuffle; the join decides.
    """
    same = lambda x, y: (x["th"] == y["th"]) & x["doc_id"].eqNullSafe(y["doc_id"])
    ends = pairs.select(F.col("a").alias("cls")).distinct().unionAll(pairs.select(F.col("b").alias("cls")).distinct()).distinct()
    reps = ends.join(classes.select("cls", F.col("rep").alias("doc_id"), "th"), "cls")
    wanted = stored(reps.join(repeated, same(reps, repeated), "left").select("cls", reps["doc_id"], reps["th"], F.coalesce("rows", F.lit(1)).alias("rows")), "ends")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    of = lambda some: rows.join(some, same(rows, some)).select("cls", "text")
    found = of(wanted.filter("rows = 1"))
    if not repeated.isEmpty():
        found = found.unionAll(of(wanted.filter("rows > 1")).dropDuplicates(["cls"]))
    with settings(docs.sparkSession, filter_of(wanted.count())):
        return stored(found, "texts")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described rows of docs(doc_id, text); of each class (digest) its component_id and lead, the id and text hash of the row that leads its component; and the (doc_id, th) that several rows have."""
    small_batches(docs.sparkSession)
    base = stored(describe(docs), "shingles")
    least = base.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "th", "sig", "sketch")).alias("x"))
    classes = stored(least.select(F.monotonically_increasing_id().alias("cls"), "digest", F.col("x.doc_id").alias("rep"), F.col("x.th").alias("th"), F.col("x.sig").alias("sig"), F.col("x.sketch").alias("sketch")), "classes")
    last = leaves(classes)
    chunks = F.ceil(F.col("n") / LEAF)
    own = F.pmod(F.xxhash64("cls"), chunks)
    key = F.when(chunks == 1, F.col("node")).otherwise(F.xxhash64("node", "chunk"))
    sketches = classes.select("cls", "sketch")

    repeated = stored(base.filter("digest is not null").groupBy("doc_id", "th").agg(F.count("*").alias("rows")).filter("rows > 1"), "repeated")
    every = F.when(chunks == 1, F.array(F.lit(0).cast("long"))).when(F.col("cls") == F.col("lead"), F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(own))
    first = last.select("node", "cls", "n", F.explode(every).alias("chunk")).select(key.alias("key"), "cls")
    tried = stored(candidates(first.join(sketches, "cls"), False), "pairs")
    edges = stored(confirm(tried, texts_of(tried, docs, classes, repeated)), "edges")
    roots = stored(components(edges), "roots")

    # second pass: pairs of blocks, of classes outside a node's main component (numbered first) with each other and with those in it
    placed = last.join(roots.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    parts = placed.groupBy("node", "root").agg(F.count("*").alias("k"))
    mains = parts.groupBy("node").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = placed.join(mains.select("node", F.col("main.root").alias("main"), F.col("main.k").alias("k"), "all"), "node")
    lists = mixed.groupBy("cls").agg(F.array_sort(F.collect_set("node")).alias("nodes"))  # the nodes of one class, MOST_NODES at most
    away, one = F.col("root") != F.col("main"), chunks == 1
    outer, inner = F.ceil((F.col("all") - F.col("k")) / (2 * LEAF)), F.ceil(F.col("k") / (2 * LEAF))
    h = F.xxhash64("cls")
    block = F.when(one, F.lit(0).cast("long")).when(away, F.pmod(h, outer)).otherwise(outer + F.pmod(h, inner))
    others = F.when(one, 1).when(away, outer + inner).otherwise(outer)
    dealt = mixed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (others - 1).cast("long"))))
    pair = F.when(one, F.col("node")).otherwise(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("int")
    second = dealt.select(pair.alias("key"), "cls", "root", side.alias("side"), "node").join(lists, "cls")
    left = stored(candidates(second.join(sketches, "cls"), True).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = confirm(left, texts_of(left, docs, classes, repeated))
    joined = components(more.unionAll(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).filter("a != b")))

    reps = classes.select("cls", "digest", "rep", "th").join(joined.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = reps.groupBy("root").agg(F.min(F.struct("rep", "th")).alias("least")).select("root", F.col("least.rep").alias("component_id"), F.col("least.th").alias("lead"))
    return base, stored(reps.join(stored(ids, "leads"), "root").select("digest", "component_id", "lead"), "components"), repeated


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id), and leads (whether the row stays as the one of its component, or is blank) for every row of docs(doc_id, text)."""
    base, found, _ = grouped(docs)
    out = base.select("doc_id", "n_shingles", "th", "digest").join(found, "digest", "left")
    empty = F.col("digest").isNull()
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    leads = empty | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("lead")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), leads.alias("leads")).withColumn("kept", F.col("doc_id") == F.col("component_id")).select("doc_id", "n_shingles", "component_id", "kept", "leads")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that lead their component, one of those with equal id and text, and every blank one; of blank rows equal in all columns, one if they have a doc_id."""
    _, found, repeated = grouped(docs)
    leads = stored(found.select(F.col("component_id").alias("id"), "lead").distinct(), "kept")
    th = max(docs.columns, key=len) + "_"  # not a column of docs
    rows = docs.withColumn(th, F.xxhash64("text"))
    led = rows.join(leads, (rows[th] == leads["lead"]) & rows["doc_id"].eqNullSafe(leads["id"]), "left_semi")
    if not repeated.isEmpty():  # one of each of these
        again = (led[th] == repeated["th"]) & led["doc_id"].eqNullSafe(repeated["doc_id"])
        led = led.join(repeated, again, "left_anti").unionAll(led.join(repeated, again, "left_semi").dropDuplicates(["doc_id", th]))
    blank = docs.filter(F.coalesce(F.ltrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == "")
    repeated = blank.filter("doc_id is not null").withColumn(th, F.to_json(F.struct("*")))  # columns may be maps
    alone = blank.filter("doc_id is null").unionAll(repeated.dropDuplicates([th]).drop(th))
    return led.drop(th).unionAll(alone)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("leads")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), hashed AS (SELECT doc_id, md5_number(s) AS s FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM hashed GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM hashed x JOIN hashed y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN least l USING (doc_id)
"""
