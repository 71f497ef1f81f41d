"""Nearest neighbours by multi-index hashing of learned, rotated binary codes.

A bounded sample gives the rotations: principal axes turned so that their signs lose least (iterative
quantisation), from several starts, so that a code has about BITS bits whatever the vectors' length. Every valid
vector becomes a code. The index is dealt into blocks of vectors; each block has a table for each of the code's
substrings, which lists the codes by the value there. A query probes, in every table, the values within the table's
share of the radius; the shares add up to the radius less the number of tables plus one, so by the pigeonhole
principle the probed lists hold every code within the radius. Codes within the radius, and only these, are ranked by
inner products of the original vectors, in double precision. The radius comes from the sample: the one that
holds TARGET of the true neighbours there.

A task has one block of the index and one of queries; the best of each block meet by query in a second step,
so no task holds all candidates of a query. Tables are built in the task, which costs about what five of its queries
do.

Defined results: vectors that are null, zero, or that hold null or non-finite components take no part; a null
vec_id takes no part; vectors of different lengths aren't compared, and those of any but the most frequent length (of
equally frequent ones the greatest) are compared exactly, without codes; rows with the query's own vec_id are not
its neighbours; repeated rows count each as candidates, and as queries once for each distinct vector of a vec_id; ties go to the smaller vec_id; with fewer
candidates than k in the radius, the whole block is ranked; an empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverix.llm.common import bounded_sample, small_batches, stored, table
from deliverix.llm.tokens import gather

K, EVERY = 20, 20
#: Distinct vectors that the rotation is learned from (about), and of these the queries that set the radius.
SAMPLE, PROBES = 8000, 400
#: Bits of a code (the least multiple of the vectors' length that has as many), those of a substring (its table has
#: 2 ** WIDTH values), and the share of neighbours that the radius holds in the sample.
BITS, WIDTH, TARGET = 256, 16, 0.95
#: Vectors of a block of the index, and queries of a block.
BLOCK, QUERIES = 8192, 4096


@dataclass
class Rotations:
    """mean and axes of the codes' signs, and the radius to search."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Substrings (uint16) of the codes of rows of vectors, a multiple of four."""
        bits = np.zeros((len(x), -(-self.axes.shape[1] // 64) * 64), np.uint8)
        bits[:, : self.axes.shape[1]] = (x - self.mean) @ self.axes > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of codes a to the code b, both in words of 64 bits."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components, so that equal vectors get equal scores."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[d]
    return total


def learn(x: np.ndarray, rounds: int = 15, seed: int = 7) -> Rotations:
    """Axes and radius from a sample of vectors."""
    mean = x.mean(0)
    _, v = np.linalg.eigh((x - mean).T @ (x - mean))
    y = (x - mean) @ v
    random = np.random.default_rng(seed)
    axes = []
    for _ in range(-(-BITS // len(v))):
        turn = np.linalg.qr(random.normal(size=(len(v), len(v))))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ w).T
        axes.append(v @ turn)
    model = Rotations(mean, np.hstack(axes), 0)
    codes = model.codes(x).view(np.uint64)
    far = []
    for i in np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int):
        s = x @ x[i]
        s[i] = -np.inf
        near = np.argsort(-s)[: min(K, len(x) - 1)]
        far.append(distances(codes[near], codes[i]))
    all_far = np.concatenate(far)
    model.radius = int(np.ceil(np.quantile(all_far, TARGET))) if len(all_far) else model.axes.shape[1]
    return model


def shares(radius: int, tables: int) -> list[int]:
    """Bits that each table is probed within, -1 for not at all: if every substring differed in more, the code would differ in over radius bits."""
    each, more = divmod(radius - tables + 1, tables)
    return [max(each + (j < more), -1) for j in range(tables)]


#: All values of a substring, those of fewest bits first, and how many have at most 0, 1, ... bits.
_ones = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint16))
_MASKS = np.argsort(_ones, kind="stable").astype(np.uint16)
_UPTO = np.cumsum(np.bincount(_ones))


class Tables:
    """The index of one block: for each substring, the rows in order of their values there, where each value's rows start, the values that occur, and which of these each row has."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes.view(np.uint64)
        self.tables = []
        for column in codes.T:
            count = np.bincount(column, minlength=1 << WIDTH)
            occur = np.flatnonzero(count)
            self.tables.append((np.argsort(column, kind="stable"), np.concatenate([[0], np.cumsum(count)]), occur.astype(np.uint16), np.searchsorted(occur, column)))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that are listed, in any table, at a value within the table's share: by trying all such values, or those that occur if that is less work."""
        found = np.zeros(len(self.codes), bool)
        for j, share in enumerate(shares(radius, len(self.tables))):
            if share < 0:
                continue
            order, first, occur, which = self.tables[j]
            many = _UPTO[min(share, WIDTH)]
            if many < len(occur) // 4:
                value = (code[j] ^ _MASKS[:many]).astype(np.int64)
                start, size = first[value], first[value + 1] - first[value]
                found[order[gather(np.arange(len(order)), start, size)]] = True
            else:
                found |= (np.bitwise_count(occur ^ code[j]) <= share)[which]
        return np.flatnonzero(found)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are within the radius."""
        rows = self.probed(code, radius)
        return rows[distances(self.codes[rows], code.view(np.uint64)) <= radius]


def search(model: Rotations | None, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, places: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of a block for each query (by vec_id and place); all rows are candidates where there is no model."""
    if model:
        tables, codes = Tables(model.codes(x)), model.codes(q)
    out = []
    for i, own in enumerate(query_ids):
        rows = tables.within(codes[i], model.radius) if model else np.zeros(0, np.int64)
        rows = rows[ids[rows] != own]
        if len(rows) < k:
            rows = np.flatnonzero(ids != own)
        s = inner(x[rows], q[i])
        best = np.lexsort((ids[rows], -s))[:k]
        out.append((np.full(len(best), own), np.full(len(best), places[i]), ids[rows[best]], s[best]))
    columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0)] * 4
    return pd.DataFrame(dict(zip(("query_id", "place", "vec_id", "score"), columns)))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("v")).filter(sound & some)


def _best_of_blocks(rows: DataFrame, n: int, m: int, model: Rotations | None, k: int) -> DataFrame:
    """query_id, place, vec_id, score: the k nearest of every block for each query of rows(vec_id, v, place, query), n rows with m queries."""
    blocks, groups = max(-(-n // BLOCK), 1), max(-(-m // QUERIES), 1)
    dealt = rows.withColumns({"d": F.size("v"), "block": F.pmod(F.xxhash64("place"), F.lit(blocks)), "group": F.pmod(F.xxhash64("place", F.lit(1)), F.lit(groups))})
    to_all = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    index = dealt.select("vec_id", "v", "place", "d", "block", to_all(groups).alias("group"), F.lit(False).alias("query"))
    asked = dealt.filter("query").dropDuplicates(["vec_id", "v"])
    queries = asked.select("vec_id", "v", "place", "d", to_all(blocks).alias("block"), "group", F.lit(True).alias("query"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        ids, places, q = (t.column(c).to_numpy() for c in ("vec_id", "place", "query"))
        found = search(model, ids[~q], x[~q], ids[q], places[q], x[q], k)
        kinds = [("query_id", pa.int64()), ("place", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        return pa.Table.from_pandas(found, preserve_index=False, schema=pa.schema(kinds))

    return index.unionByName(queries).groupBy("d", "block", "group").applyInArrow(run, "query_id long, place long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors(vec_id, embedding) for the rows that is_query marks."""
    spark = vectors.sparkSession
    small_batches(spark, rows=10_000)
    marked = valid_vectors(vectors).select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("place"))
    sound = stored(marked, "vectors")
    sizes = sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("query").alias("m"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    main = sound.filter(F.size("v") == most.d)
    sample = np.stack(bounded_sample(main.select("v"), SAMPLE).toPandas().v)
    model = learn(sample[np.lexsort(sample.T)])  # in an order of its own
    best = _best_of_blocks(main, most.n, most.m, model, k)
    n, m = sound.agg(F.count("*"), F.count_if("query")).first()
    if n > most.n:
        best = best.unionAll(_best_of_blocks(sound.filter(F.size("v") != most.d), n - most.n, m - most.m, None, k))
    order = W.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


#: The exact answer, which the search approximates: for tests of recall only.
EXACT_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""
