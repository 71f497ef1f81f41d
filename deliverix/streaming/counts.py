"""Commit counts over a stream of interchange rows.

The batch metrics look back over a calendar and stay batch queries. What a stream can add up as it arrives
are commits and fix-like commits of a week or month; authors are kept apart by (period, author) rows, so that
late rows change a small key. Rows older than the watermark are left out, which a batch run over the stored
table puts right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deliverix.functions import time as t
from deliverix.functions.scalars import ALL_BRANCHES, fix_like

COMMITS = T.StructType([
    T.StructField("repo_slug", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("author_ref", T.StringType()), T.StructField("committed_at", T.LongType()),
    T.StructField("subject_has_keywords", T.IntegerType()), T.StructField("body_has_keywords", T.IntegerType()),
])


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of interchange rows, as they come."""
    return spark.readStream.schema(COMMITS).parquet(path)


def author_weeks(commits: DataFrame, late: str = "60 days", work_style: str = ALL_BRANCHES, tz: str = "UTC") -> DataFrame:
    """repo_slug, period_week, author_ref, commits, fix_like_commits; a commit that is sent again counts once."""
    at = F.timestamp_seconds("committed_at")
    rows = commits.withColumn("at", at).withWatermark("at", late).dropDuplicatesWithinWatermark(["repo_slug", "sha"])
    local = t.to_local(F.col("committed_at"), tz)
    keyed = rows.groupBy(F.window("at", "7 days", startTime="4 days").alias("w"), "repo_slug", t.period_week(local).alias("period_week"), "author_ref")
    return keyed.agg(F.count("*").alias("commits"), F.count_if(fix_like(work_style)).alias("fix_like_commits")).drop("w")


def write_author_weeks(rows: DataFrame, path: str, checkpoint: str):
    """Appends closed weeks to Parquet and ends when the files there are have been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
