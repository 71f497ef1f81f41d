"""Cycle time between consecutive commits of an author, in log order and local wall time."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliverix.functions import time as t
from deliverix.functions.scalars import half_even, minutes_to_days
from deliverix.operators.ordering import number_rows, with_older
from deliverix.operators.selection import counts_by_value, joined, percentiles

AUTHOR = ["repo_slug", "author_ref"]


def integer_epoch(commits: DataFrame) -> DataFrame:
    """Cuts fractions of seconds off committed_at."""
    return commits.withColumn("committed_at", F.col("committed_at").cast("long"))


def consecutive_pairs(commits: DataFrame) -> DataFrame:
    """repo_slug, author_ref, newer_sha, older_sha and both times, for each pair next to each other in the author's log; by time where there are no log ordinals."""
    pairs = with_older(integer_epoch(commits), AUTHOR, ["sha", "committed_at"]).filter("older is not null")
    return pairs.select(
        *AUTHOR, F.col("sha").alias("newer_sha"), F.col("older.sha").alias("older_sha"), F.col("committed_at").alias("newer_at"),
        F.col("older.committed_at").alias("older_at"), "log_ordinal",
    )


def delta_events(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    """A row for each pair: the newer commit's time and sha, the older sha, and the minutes between; negative if the log isn't in time order."""
    p = consecutive_pairs(commits)
    minutes = t.wall_minutes(t.to_local(F.col("newer_at"), tz), t.to_local(F.col("older_at"), tz))
    return p.select(*AUTHOR, F.col("newer_at").alias("committed_at"), F.col("newer_sha").alias("child_sha"), F.col("older_sha").alias("prev_sha"), minutes.alias("cycle_minutes"), "log_ordinal")


def commit_deltas(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return delta_events(commits, tz).select(*AUTHOR, "committed_at", "cycle_minutes", "log_ordinal")


def commit_deltas_by_time(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    """For commits without log ordinals: pairs in order of time, then sha."""
    warnings.warn("no log ordinals: commits are paired by time", stacklevel=2)
    events = delta_events(commits.withColumn("log_ordinal", F.lit(None).cast("long")), tz)
    return events.select(*AUTHOR, "committed_at", F.col("child_sha").alias("sha"), "cycle_minutes")


def _measured(d: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """Measures of groups: pairs, sum, mean, 75th percentile and sample deviation of cycle_minutes, the last two as whole numbers; and the least of extra.

    All come from counts by value. Minutes have two decimals, so that sums of hundredths, and of their squares, are exact.
    """
    names = [f"_x{i}" for i in range(len(extra))]
    counts = counts_by_value(d, keys, "cycle_minutes", *(F.min(x).alias(n) for n, x in zip(names, extra)))
    h, n = F.round(F.col("_v") * 100).cast("decimal(12,0)"), F.col("_n").cast("decimal(13,0)")
    sums = counts.withColumns({"_h": h, "_m": n}).groupBy(*keys).agg(
        F.sum("_n").alias("sample_count"), F.sum(F.col("_h") * F.col("_m")).alias("_s"), F.sum((F.col("_h") * F.col("_h")).cast("decimal(24,0)") * F.col("_m")).cast("decimal(38,0)").alias("_q"), *(F.min(x).alias(x) for x in names)
    )
    total, k = F.col("_s").cast("double") / 100, F.col("sample_count")
    spread = F.col("_q").cast("double") - F.col("_s").cast("double") * F.col("_s").cast("double") / k
    std = F.when(k > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (k - 1)) / 100)
    ranked = percentiles(counts, keys, {"p75": 0.75})
    return joined(sums, ranked, keys).select(*keys, *names, "sample_count", total.alias("sum_minutes"), (total / k).alias("avg_minutes"), half_even(F.col("p75")).alias("p75_minutes"), half_even(std).alias("std_minutes"))


def cycle_stats_by_month(commits: DataFrame, tz: str = "UTC", least: int = 2) -> DataFrame:
    """Measures by repository and month of the newer commit; months with fewer than two pairs are left out."""
    d = commit_deltas(commits, tz).withColumn("period_month", t.period_month(t.to_local(F.col("committed_at"), tz)))
    return _measured(d, ["repo_slug", "period_month"]).filter(F.col("sample_count") >= least)


def cycle_stats_by_bucket(commits: DataFrame, bucket_size: int = 1000, tz: str = "UTC", least: int = 2) -> DataFrame:
    """Measures of every bucket_size pairs in order of time; ties in the order in which authors and commits stand in the log."""
    first_seen = integer_epoch(commits).groupBy(*AUTHOR).agg(F.min("log_ordinal").alias("author_ord"))
    d = delta_events(commits, tz).join(first_seen, AUTHOR)
    order = [F.col("committed_at"), F.col("author_ord"), F.col("log_ordinal"), F.col("child_sha")]
    rows = number_rows(d, ["repo_slug"], F.floor(F.col("committed_at") / t.DAY), order, "n")
    rows = rows.withColumn("bucket", F.floor(F.col("n") / bucket_size)).withColumn("month", t.period_month(t.to_local(F.col("committed_at"), tz)))
    found = _measured(rows, ["repo_slug", "bucket"], F.struct("n", "month")).filter(F.col("sample_count") >= least)
    return found.select("repo_slug", "bucket", F.col("_x0.month").alias("period_month"), "sample_count", "sum_minutes", "avg_minutes", "p75_minutes", "std_minutes")


def cycle_chart_series(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    """Monthly measures with percentile and deviation in days."""
    return cycle_stats_by_month(commits, tz).withColumns(
        {"p75_days": minutes_to_days(F.col("p75_minutes")), "std_days": minutes_to_days(F.col("std_minutes"))}
    )


def cycle_time_between_commits_by_author(commits: DataFrame, bucket_size: int = 1000, tz: str = "UTC") -> DataFrame:
    return cycle_stats_by_bucket(commits, bucket_size, tz)
