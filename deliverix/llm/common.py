"""What the corpus operators share: the shared folder, stored steps, Arrow batches of text."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row in so many is held out of every fit: crc32(doc_id as text) mod 5 = 0.
FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark runs on this machine alone."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/deliverix"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a step to the shared folder and reads it again, which cuts its lineage for good."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the steps that are stored within, and the caller's own afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, unless their PYTHONPATH has it."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if top in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_deliverix_shipped", False):
        return
    to = tempfile.mkdtemp(prefix="deliverix-zip-")
    context.addPyFile(shutil.make_archive(os.path.join(to, "deliverix"), "zip", top, "deliverix"))
    context._deliverix_shipped = True


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bounds the Arrow batches that carry texts, by rows and by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no fit may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def bounded_sample(df: DataFrame, most: int) -> DataFrame:
    """About `most` of the distinct rows of df, or all of them if there are no more; it depends on what the rows hold alone, not on files, splits or order.

    Rows are chosen by a hash of all columns, against the (approximate, order-free) number of distinct hashes. Repeated rows count once, so they neither
    fill nor empty a sample: a task passes each chosen hash on once, and few rows meet in the shuffle.
    """
    h = max(df.columns, key=len) + "_"  # not a column of df
    hashed = df.withColumn(h, F.xxhash64(*df.columns))
    distinct = hashed.agg(F.approx_count_distinct(h, 0.01)).first()[0]
    at = len(df.columns)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            hashes = b.column(at).to_pylist()
            first = [k not in seen and not seen.add(k) for k in hashes]
            yield b.filter(pa.array(first, pa.bool_()))

    share = min(1.0, most / max(1, distinct))
    chosen = hashed.filter(F.pmod(F.xxhash64(h), F.lit(1 << 30)) < int((1 << 30) * share))
    return chosen.mapInArrow(once, chosen.schema).dropDuplicates([h]).drop(h)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of uint64 values (the finaliser of a public 64-bit hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def keep_rows(docs: DataFrame, wanted: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns, whose texts wanted (texts to booleans) marks."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.asarray(wanted(text_bytes(b.column(at))), bool)))

    return docs.mapInArrow(run, docs.schema)


_K = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 2048


def span_hashes(big: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of big, which has eight bytes more than the last end; every byte counts."""
    eight = np.ndarray((len(big) - 7,), "<u8", big, strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) * _K)
    at, skip = np.arange(len(start)), 0
    while len(at):
        left = np.minimum(length[at] - skip, 8).astype(np.uint64)
        mask = np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8))
        h[at] = mix(h[at] ^ (eight[start[at] + skip] & mask)) + _K
        skip += 8
        at = at[length[at] > skip]
        if skip >= _LONG_WORD:
            for i in at:
                rest = big[start[i] + skip : end[i]]
                h[i] ^= np.uint64(int.from_bytes(blake2b(rest, digest_size=8).digest(), "little"))
            break
    return h
