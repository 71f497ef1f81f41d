"""Roll-ups over repositories: every repository has the same weight where a mean is taken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverix.functions import time as t
from deliverix.operators import activity, deltas, metrics
from deliverix.operators.steps import stored

#: Names of the long rows.
CYCLE = {"sum_minutes": "aggregate_cycle_time.monthly_sum", "avg_minutes": "aggregate_cycle_time.monthly_average", "p75_minutes": "aggregate_cycle_time.monthly_p75", "std_minutes": "aggregate_cycle_time.monthly_std"}
FAILURE = "aggregate_failure_rate.monthly_rate"
AUTHORS = "aggregate_active_developers.monthly_unique_count"
THROUGHPUT = "aggregate_throughput.monthly_total_commits"
PER_ACTIVE_DEV = "aggregate_throughput_per_active_dev.weekly_value"


def lattice(commits: DataFrame, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """What all metrics come from, stored: the narrow rows of the commits, which read them once, and the author days of those."""
    wanted = ["repo_slug", "author_ref", "sha", "committed_at", "log_ordinal", "subject_has_keywords", "body_has_keywords"]
    rows = stored(commits.select(*(c for c in wanted if c in commits.columns)))
    return rows, stored(metrics.author_days(rows, tz))


def repo_metrics(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> dict[str, DataFrame]:
    """All series by repository, for all repositories at once, from one reading of the commits."""
    rows, days = lattice(commits, tz)
    return {
        "cycle_time": stored(deltas.cycle_stats_by_month(rows, tz)),
        "change_failure": metrics.change_failure_monthly(days, tz=tz),
        "active_developers": metrics.active_developers_monthly(days, tz),
        "authors_by_month": metrics.authors_by_month(days, tz),
        "throughput": metrics.throughput_monthly(days, tz),
        "throughput_per_active_dev": activity.throughput_per_active_dev_weekly(days, weeks_back, tz),
        "active_developers_weekly": activity.active_developers_weekly(days, weeks_back, tz),
        "window_authors": window_authors_by_week(days, weeks_back, tz),
        "author_percentiles": metrics.author_commit_percentiles(days),
        "summary": metrics.repo_summary(days, tz),
    }


def aggregate_cycle_time(cycle: DataFrame) -> DataFrame:
    return cycle.groupBy("period_month").agg(*(F.avg(c).alias(c) for c in CYCLE))


def aggregate_failure_rate(failure: DataFrame) -> DataFrame:
    return failure.groupBy("period_month").agg(F.avg("failure_rate").alias("failure_rate"))


def aggregate_active_developers(authors: DataFrame) -> DataFrame:
    """From (repo_slug, period_month, author_ref): authors of a month over all repositories."""
    return authors.select("period_month", "author_ref").distinct().groupBy("period_month").agg(F.count("*").alias("unique_authors"))


def aggregate_throughput(throughput: DataFrame) -> DataFrame:
    return throughput.groupBy("period_month").agg(F.sum("commit_count").alias("commit_count"))


def aggregate_throughput_per_active_dev(weekly: DataFrame, authors: DataFrame) -> DataFrame:
    """Commits of a week over the distinct window authors of the repositories that have commits in it; 0 without authors.

    weekly is (repo_slug, period_week, commit_count), authors (repo_slug, period_week, author_ref).
    """
    commits = weekly.groupBy("period_week").agg(F.sum("commit_count").alias("commit_count"))
    people = authors.join(weekly.select("repo_slug", "period_week").distinct(), ["repo_slug", "period_week"], "left_semi")
    n = people.select("period_week", "author_ref").distinct().groupBy("period_week").agg(F.count("*").alias("active_authors"))
    both = commits.join(n, "period_week", "left").fillna({"active_authors": 0})
    value = F.when(F.col("active_authors") > 0, F.col("commit_count") / F.col("active_authors")).otherwise(0.0)
    return both.select("period_week", "commit_count", "active_authors", value.alias("commits_per_author"))


def window_authors_by_week(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    w = activity.window_authors(commits, weeks_back, tz)
    return w.select("repo_slug", t.period_week(F.col("monday")).alias("period_week"), "author_ref")


def cohort_rows(cycle: DataFrame, failure: DataFrame, authors: DataFrame, throughput: DataFrame, weekly: DataFrame, window: DataFrame, batch_id: str = "default", cohort_id: str = "all") -> DataFrame:
    """The five aggregates as long rows (batch_id, cohort_id, metric_name, period_key, value_real, value_json)."""
    c = aggregate_cycle_time(cycle).select(F.col("period_month").alias("period_key"), *(F.col(k).cast("double").alias(name) for k, name in CYCLE.items()))
    names = [f"`{n}`" for n in CYCLE.values()]
    parts = [c.unpivot(["period_key"], names, "metric_name", "value_real").select("metric_name", "period_key", "value_real")]
    for df, key, value, name in (
        (aggregate_failure_rate(failure), "period_month", "failure_rate", FAILURE),
        (aggregate_active_developers(authors), "period_month", "unique_authors", AUTHORS),
        (aggregate_throughput(throughput), "period_month", "commit_count", THROUGHPUT),
        (aggregate_throughput_per_active_dev(weekly, window), "period_week", "commits_per_author", PER_ACTIVE_DEV),
    ):
        parts.append(df.select(F.lit(name).alias("metric_name"), F.col(key).alias("period_key"), F.col(value).cast("double").alias("value_real")))
    rows = reduce(DataFrame.unionAll, parts)
    return rows.select(F.lit(batch_id).alias("batch_id"), F.lit(cohort_id).alias("cohort_id"), "metric_name", "period_key", "value_real", F.lit(None).cast("string").alias("value_json"))


def cohort_rows_of(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC", batch_id: str = "default", cohort_id: str = "all") -> DataFrame:
    m = repo_metrics(commits, weeks_back, tz)
    return cohort_rows(m["cycle_time"], m["change_failure"], m["authors_by_month"], m["throughput"], m["throughput_per_active_dev"], m["window_authors"], batch_id, cohort_id)


def summary_report(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    """One row: repositories, commits, distinct authors over all of them, first and last commit, means for each repository."""
    each = metrics.repo_summary(commits, tz)
    people = commits.select("author_ref").distinct().agg(F.count("*").alias("unique_authors"))
    totals = each.agg(
        F.count("*").alias("repositories"), F.sum("total_commits").alias("total_commits"), F.min("first_commit").alias("first_commit"), F.max("last_commit").alias("last_commit"),
        F.avg("total_commits").alias("commits_per_repo"), F.avg("unique_authors").alias("authors_per_repo"),
    )
    return totals.crossJoin(F.broadcast(people))  # one row with one row
