"""Commit-shaped views over orders and events, in Spark and in SQL: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverix.functions.scalars import keyword_flags
from deliverix.functions.time import DAY
from deliverix.operators.ordering import number_rows


def commits_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of commits of four repositories; sha, author, time, subject, body and flags from an order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    subject = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("hotfix: order "), "o_orderkey"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("feat: order "), "o_orderkey"))
        .otherwise(F.concat(F.lit("chore: order "), "o_orderkey"))
    )
    rows = o.select(
        F.concat(F.lit("repo"), F.col("o_custkey") % 4).alias("repo_slug"),
        F.concat(F.lit("dev"), F.floor(F.col("o_custkey") / 4) % 40).alias("author_ref"),
        (F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 1440 * 60).alias("committed_at"),
        F.col("o_orderkey").cast("string").alias("sha"),
        "o_orderkey",
        subject.alias("subject"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "bug leftover").otherwise("").alias("body"),
    )
    rows = rows.withColumns(keyword_flags(F.col("subject"), F.col("body")))
    message = F.when(F.col("body") == "", F.col("subject")).otherwise(F.concat_ws("\n\n", "subject", "body"))
    order = [F.desc("committed_at"), F.desc("o_orderkey")]
    return number_rows(rows.withColumn("message", message), ["repo_slug"], F.floor(F.col("committed_at") / DAY), order, "log_ordinal", newest_first=True)


def edges_orders(commits: DataFrame) -> DataFrame:
    """Parent edges: one or two older commits of the repository, where there are such."""
    o = F.col("o_orderkey")
    far, near = F.col("log_ordinal") + 1 + o % 3, F.col("log_ordinal") + 1
    ends = F.when((o % 5 == 0) & (far != near), F.array(far, near)).otherwise(F.array(far))
    links = commits.select("repo_slug", F.col("sha").alias("child_sha"), F.posexplode(ends).alias("parent_ord", "at"))
    parents = commits.select("repo_slug", F.col("log_ordinal").alias("at"), F.col("sha").alias("parent_sha"))
    return links.join(parents, ["repo_slug", "at"]).select("repo_slug", "child_sha", "parent_sha", "parent_ord")


def commits_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of commits of four repositories, from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    rows = e.select(
        F.concat(F.lit("repo"), F.col("event_id") % 4).alias("repo_slug"),
        F.col("user_id").cast("string").alias("author_ref"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("committed_at"),
        F.col("event_id").cast("string").alias("sha"),
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("subject_has_keywords"),
        F.lit(0).alias("body_has_keywords"),
    )
    chunk = F.floor(F.col("event_id") / (1 << 16))
    return number_rows(rows, ["repo_slug"], chunk, [F.desc("event_id")], "log_ordinal", newest_first=True)


ORDERS_SQL = """
commits AS (
  SELECT 'repo' || (o_custkey % 4) AS repo_slug, 'dev' || ((o_custkey // 4) % 40) AS author_ref,
    CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 1440 * 60 AS committed_at, CAST(o_orderkey AS VARCHAR) AS sha, o_orderkey,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'hotfix: order ' WHEN '2-HIGH' THEN 'feat: order ' ELSE 'chore: order ' END || o_orderkey AS subject,
    CASE o_orderpriority WHEN '2-HIGH' THEN 'bug leftover' ELSE '' END AS body,
    CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END AS subject_has_keywords,
    CASE o_orderpriority WHEN '2-HIGH' THEN 1 ELSE 0 END AS body_has_keywords,
    row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY epoch(o_orderdate) + o_orderkey % 1440 * 60 DESC, o_orderkey DESC) - 1 AS log_ordinal
  FROM orders
), local AS (
  SELECT *, make_timestamp(committed_at * 1000000) AS at, strftime(make_timestamp(committed_at * 1000000), '%Y-%m') AS period_month,
    strftime(make_timestamp(committed_at * 1000000), '%G-W%V') AS period_week,
    date_trunc('week', make_timestamp(committed_at * 1000000))::TIMESTAMP AS monday
  FROM commits
)"""
EVENTS_SQL = """
commits AS (
  SELECT 'repo' || (event_id % 4) AS repo_slug, CAST(user_id AS VARCHAR) AS author_ref, CAST(floor(epoch(ts)) AS BIGINT) AS committed_at,
    CAST(event_id AS VARCHAR) AS sha, event_id, CAST(event_type = 'error' AS INTEGER) AS subject_has_keywords, 0 AS body_has_keywords,
    row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id DESC) - 1 AS log_ordinal
  FROM events
), local AS (
  SELECT *, make_timestamp(committed_at * 1000000) AS at, strftime(make_timestamp(committed_at * 1000000), '%Y-%m') AS period_month,
    strftime(make_timestamp(committed_at * 1000000), '%G-W%V') AS period_week,
    date_trunc('week', make_timestamp(committed_at * 1000000))::TIMESTAMP AS monday
  FROM commits
)"""
EDGES_SQL = """
edges AS (
  SELECT c.repo_slug, c.sha AS child_sha, p.sha AS parent_sha, c.ord AS parent_ord FROM (
    SELECT repo_slug, sha, 0 AS ord, log_ordinal + 1 + o_orderkey % 3 AS far FROM commits
    UNION ALL SELECT repo_slug, sha, 1, log_ordinal + 1 FROM commits WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0
  ) c JOIN commits p ON p.repo_slug = c.repo_slug AND p.log_ordinal = c.far
)"""
DELTAS_SQL = """
deltas AS (
  SELECT * FROM (
    SELECT repo_slug, author_ref, committed_at, sha AS child_sha, lag(sha) OVER w AS prev_sha, log_ordinal, period_month,
      round((committed_at - lag(committed_at) OVER w) / 60.0, 2)::DOUBLE AS cycle_minutes
    FROM local WINDOW w AS (PARTITION BY repo_slug, author_ref ORDER BY log_ordinal DESC)
  ) WHERE prev_sha IS NOT NULL
)"""
