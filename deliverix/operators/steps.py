"""Steps that are stored in the folder that driver and executors share, which cuts their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder (spark.checkpoint.dir); in one of our own where none is set and Spark runs on this machine alone."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/deliverix/step-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, part: str | None = None) -> DataFrame:
    """df as a table; where part is given, in a folder for each value of that column, so that a filter on it reads no more than it needs."""
    path = new_path(df.sparkSession)
    (df.write.partitionBy(part) if part else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def drop_steps(spark: SparkSession) -> int:
    """Removes the steps that this application has stored, and says how many; for when no result that rests on them is needed any more."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)
