"""Tables in which the rows of some keys are replaced at once, and readers never see half of it.

A write puts its rows into a version folder of their own, which nobody reads yet. A manifest, a small table, then names the version that
is valid for each key; it counts from the moment that its success marker stands, the last and only write that readers notice.
A write that breaks off before leaves the table as it was. Two writers that start from the same manifest can't both end: the second finds its
number taken (so does one after a manifest that broke off in its writing, until vacuum has removed it). Versions and manifests that no key needs are removed later (vacuum). Key values are never part of a path.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "_version"
_MARK = "_SUCCESS"


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    """Hadoop's file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def _current(spark: SparkSession, path: str) -> int:
    """Number of the newest manifest that is whole; 0 if there is none."""
    for name in reversed(_names(spark, f"{path}/manifests")):
        files, mark = _files(spark, f"{path}/manifests/{name}/{_MARK}")
        if files.exists(mark):
            return int(name)
    return 0


def _manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/manifests/{number:012d}")


def _stage(df: DataFrame, path: str, version: str, keys: Sequence[str]) -> DataFrame:
    """Writes the rows of a version, which evaluates df once; returns its keys."""
    to = f"{path}/versions/{VERSION}={version}"
    df.sortWithinPartitions(*keys).write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to).select(*keys).distinct()


def _switch(manifest: DataFrame, path: str, number: int) -> None:
    """Makes a manifest the valid one."""
    manifest.write.mode("error").parquet(f"{path}/manifests/{number:012d}")


def replace_rows(df: DataFrame, path: str, keys: Sequence[str], emptied: DataFrame | None = None) -> None:
    """Replaces the rows of all keys that df has; those of emptied (with the key columns) that df doesn't have are left without rows. Other keys keep theirs."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    number = _current(spark, path)
    has = _stage(df, path, version, keys)
    manifest = has.withColumn(VERSION, F.lit(version))
    if number:
        gone = has.unionByName(emptied.select(*keys)).distinct() if emptied is not None else has
        before = _manifest(spark, path, number)
        manifest = before.join(gone, _same(before, gone, keys), "left_anti").unionByName(manifest)
    _switch(manifest, path, number + 1)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> list:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def read_rows(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table as its newest whole manifest has it. Where no row is left, the schema has to be given."""
    number = _current(spark, path)
    if not number:
        raise ValueError(f"{path} has no snapshot")
    manifest = _manifest(spark, path, number)
    live = [r[0] for r in manifest.select(VERSION).distinct().collect()]  # one for each write that still has rows
    if not live:
        if schema is None:
            raise ValueError(f"{path} has no rows: give the schema")
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{path}/versions").parquet(*(f"{path}/versions/{VERSION}={v}" for v in live))
    keys = [c for c in manifest.columns if c != VERSION]
    valid = (*_same(rows, manifest, keys), rows[VERSION].cast("string") == manifest[VERSION])
    return rows.join(manifest, list(valid), "left_semi").drop(VERSION)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes versions that no row of the valid manifest needs, and other manifests; for times without readers and writers. Returns the removed versions."""
    number = _current(spark, path)
    if not number:
        return []
    live = {f"{VERSION}={r[0]}" for r in _manifest(spark, path, number).select(VERSION).distinct().collect()}
    dead = [n for n in _names(spark, f"{path}/versions") if n not in live]
    for name in [*(f"versions/{n}" for n in dead), *(f"manifests/{n}" for n in _names(spark, f"{path}/manifests") if n != f"{number:012d}")]:
        files, where = _files(spark, f"{path}/{name}")
        files.delete(where, True)
    return [n.removeprefix(f"{VERSION}=") for n in dead]
