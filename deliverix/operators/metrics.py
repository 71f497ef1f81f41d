"""Counts and rates by repository and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverix.functions import time as t
from deliverix.functions.scalars import ALL_BRANCHES, SQUASH, fix_like, fix_like_message
from deliverix.operators.selection import joined

REPO_MONTH, REPO_WEEK = ["repo_slug", "period_month"], ["repo_slug", "period_week"]


def with_month(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return commits.withColumn("period_month", t.period_month(t.to_local(F.col("committed_at"), tz)))


def with_week(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return commits.withColumn("period_week", t.period_week(t.to_local(F.col("committed_at"), tz)))


def activity_rows(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    """Commits in the shape of author days: each a row of weight 1. Author days are returned as they are, so that all metrics here and in `activity` take either."""
    if "weight" in commits.columns:
        return commits
    local, at = t.to_local(F.col("committed_at"), tz), F.col("committed_at")
    return commits.withColumns({"first_at": local, "last_at": local, "first_unix": at, "last_unix": at, "weight": F.lit(1).cast("long")})


#: Columns of author days that count fix-like commits of each work style.
_FIXES = {ALL_BRANCHES: "fixes_all_branches", SQUASH: "fixes_squash"}


def author_days(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    """A row for each repository, author and local day: commits (weight), fix-like ones by work style, first and last local time and instant.

    Everything that counts commits or authors by day, week, month or window, or in all, follows from these rows.
    """
    day = F.date_trunc("day", "first_at")
    fixes = [F.count_if(fix_like(style)).alias(name) for style, name in _FIXES.items()] if "subject_has_keywords" in commits.columns else []
    rows = activity_rows(commits, tz).groupBy("repo_slug", "author_ref", day.alias("day"))
    return rows.agg(
        F.sum("weight").alias("weight"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("first_unix").alias("first_unix"), F.max("last_unix").alias("last_unix"), *fixes
    )


def _by_author(df: DataFrame, keys: list[str]) -> DataFrame:
    """Commits by keys and author first, so that counting authors has no group larger than their number."""
    return df.groupBy(*keys, "author_ref").agg(F.sum("weight").alias("commits"))


def _throughput(df: DataFrame, keys: list[str]) -> DataFrame:
    return _by_author(df, keys).groupBy(*keys).agg(F.sum("commits").alias("commit_count"), F.count("author_ref").alias("unique_authors"))


def _months(commits: DataFrame, tz: str) -> DataFrame:
    return activity_rows(commits, tz).withColumn("period_month", t.period_month(F.col("first_at")))


def throughput_monthly(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return _throughput(_months(commits, tz), REPO_MONTH)


def throughput_weekly(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return _throughput(activity_rows(commits, tz).withColumn("period_week", t.period_week(F.col("first_at"))), REPO_WEEK)


def throughput_rate_monthly(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    rate = F.when(F.col("unique_authors") > 0, F.col("commit_count") / F.col("unique_authors")).otherwise(0.0)
    return throughput_monthly(commits, tz).select(*REPO_MONTH, rate.alias("commits_per_author"))


def active_developers_monthly(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return throughput_monthly(commits, tz).select(*REPO_MONTH, "unique_authors")


def authors_by_month(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return _months(commits, tz).select(*REPO_MONTH, "author_ref").distinct()


def active_authors_recent(commits: DataFrame, as_of: Column, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    """Authors with a commit since as_of (an instant) less so many weeks of local time."""
    since = t.shift_days(t.to_local(as_of, tz), -7 * weeks_back)
    return commits.filter(t.to_local(F.col("committed_at"), tz) >= since).select("repo_slug", "author_ref").distinct()


def change_failure_monthly(commits: DataFrame, work_style: str = ALL_BRANCHES, tz: str = "UTC") -> DataFrame:
    """All commits, those that look like fixes, and their share in per cent with one decimal, ties to even."""
    fixes = F.col(_FIXES[work_style]) if "weight" in commits.columns else fix_like(work_style).cast("int")
    return _failure(_months(commits, tz).withColumn("_fix", fixes))


def change_failure_from_messages(commits: DataFrame, work_style: str = ALL_BRANCHES, tz: str = "UTC") -> DataFrame:
    """The same from a message column."""
    return _failure(_months(commits, tz).withColumn("_fix", fix_like_message(F.col("message"), work_style).cast("int")))


def _failure(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy(*REPO_MONTH).agg(F.sum("weight").alias("total_commits"), F.coalesce(F.sum("_fix"), F.lit(0)).cast("long").alias("fix_like_commits"))
    rate = F.bround(F.lit(100.0) * F.col("fix_like_commits") / F.col("total_commits"), 1)
    return counted.withColumn("failure_rate", rate)


def author_commit_totals(commits: DataFrame) -> DataFrame:
    return activity_rows(commits).groupBy("repo_slug", "author_ref").agg(F.sum("weight").alias("commit_count"))


def author_commit_percentiles(commits: DataFrame) -> DataFrame:
    """Share of the repository's authors with at most as many commits, in per cent. Ranks are made over distinct counts, which are few."""
    totals = author_commit_totals(commits)
    steps = totals.groupBy("repo_slug", "commit_count").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy("repo_slug").orderBy("commit_count").rowsBetween(W.unboundedPreceding, 0))
    every = F.sum("k").over(W.partitionBy("repo_slug"))
    share = steps.select("repo_slug", "commit_count", (upto / every * 100).alias("percentile"))
    return totals.join(share, ["repo_slug", "commit_count"]).select("repo_slug", "author_ref", "commit_count", "percentile")


def repo_summary(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    iso = lambda c: F.date_format(t.to_local(c, tz), "yyyy-MM-dd'T'HH:mm:ss")
    each = activity_rows(commits, tz).groupBy("repo_slug", "author_ref").agg(F.sum("weight").alias("n"), F.min("first_unix").alias("lo"), F.max("last_unix").alias("hi"))
    return each.groupBy("repo_slug").agg(F.sum("n").alias("total_commits"), F.count("author_ref").alias("unique_authors"), iso(F.min("lo")).alias("first_commit"), iso(F.max("hi")).alias("last_commit"))


def avg_p75(cycle: DataFrame) -> DataFrame:
    """Mean of the months' percentiles, every month the same weight."""
    return cycle.groupBy("repo_slug").agg(F.coalesce(F.avg("p75_minutes"), F.lit(0.0)).alias("avg_p75_minutes"))


def avg_rate(failure: DataFrame) -> DataFrame:
    return failure.groupBy("repo_slug").agg(F.coalesce(F.avg("failure_rate"), F.lit(0.0)).alias("avg_failure_rate"))


#: Seconds of a chunk of commit_runs.
RUN_SECONDS = 6 * 3600


def commit_runs(commits: DataFrame, tz: str = "UTC", seconds: int = RUN_SECONDS) -> DataFrame:
    """A row for each run of commits with one author and week, in order of time and log.

    Runs are found in chunks of time, and stitched: a chunk's first run goes on with the last of the chunk before if both are of one author. What
    meets for a week is a row for each of its chunks.
    """
    week = t.period_week(t.to_local(F.col("committed_at"), tz))
    rows = commits.select("repo_slug", "author_ref", "committed_at", "log_ordinal", week.alias("week"), F.floor(F.col("committed_at") / seconds).alias("chunk"))
    part = ["repo_slug", "week", "chunk"]
    w = W.partitionBy(*part).orderBy("committed_at", "log_ordinal")
    change = F.coalesce((F.col("author_ref") != F.lag("author_ref").over(w)).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", change).withColumn("_r", F.sum("_new").over(w))
    runs = runs.groupBy(*part, "_r").agg(F.first("author_ref").alias("author_ref"), F.count("*").alias("commits"), F.min("committed_at").alias("started_at"))
    ends = runs.groupBy(*part).agg(F.max("_r").alias("_k"), F.min_by("author_ref", "_r").alias("_first"), F.max_by("author_ref", "_r").alias("_last"))
    over = W.partitionBy("repo_slug", "week").orderBy("chunk")
    ends = ends.withColumn("_on", (F.col("_first") == F.coalesce(F.lag("_last").over(over), F.lit(None).cast("string"))).cast("int")).fillna({"_on": 0})
    before = F.coalesce(F.sum(F.col("_k") - F.col("_on")).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = joined(runs, ends.select(*part, "_on", before.alias("_before")), part).withColumn("run", F.col("_before") + F.col("_r") - F.col("_on"))
    return numbered.groupBy("repo_slug", "week", "run").agg(F.first("author_ref").alias("author_ref"), F.sum("commits").alias("commits"), F.min("started_at").alias("started_at"))


def parent_count_share(commits: DataFrame) -> DataFrame:
    """Commits by number of parents, and the share of merges."""
    n = commits.groupBy("repo_slug", "parent_count").agg(F.count("*").alias("commits"))
    return n.withColumn("share", F.col("commits") / F.sum("commits").over(W.partitionBy("repo_slug")))


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo_slug").agg(F.count("*").alias("edges"))


def require_edges(edges: DataFrame, repo_slug: str) -> None:
    if edges.filter(F.col("repo_slug") == repo_slug).isEmpty():
        raise ValueError(f"commit_parent_edges has no rows for {repo_slug!r}")
