"""Tables ready to draw: trends, bands, matrices and stacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverix.functions import time as t
from deliverix.functions.scalars import minutes_to_days
from deliverix.operators import activity, deltas, metrics, rollup


def trendline(df: DataFrame, value: str, order: str, keys: Sequence[str] = ("repo_slug",)) -> DataFrame:
    """Adds trend (the least-squares line over the rows' numbers from 0) and trend_end; null for a single row. Series are periods, so they are short."""
    rows = df.withColumn("_x", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)
    line = rows.groupBy(*keys).agg(F.regr_slope(value, "_x").alias("_slope"), F.regr_intercept(value, "_x").alias("_cut"), F.max("_x").alias("_last"), F.count(value).alias("_n"))
    at = lambda x: F.when(F.col("_n") > 1, F.col("_cut") + F.col("_slope") * F.col(x))
    return rows.join(line, list(keys)).withColumns({"trend": at("_x"), "trend_end": at("_last")}).drop("_x", "_slope", "_cut", "_last", "_n")


def cycle_time_series(commits: DataFrame, tz: str = "UTC", both_sides: bool = True) -> DataFrame:
    """Percentile and deviation in days, a band of one deviation (above only for comparisons), and the trend."""
    s = deltas.cycle_chart_series(commits, tz).select("repo_slug", "period_month", "p75_days", "std_days")
    low = F.col("p75_days") - F.col("std_days") if both_sides else F.col("p75_days")
    return trendline(s.withColumns({"band_low": low, "band_high": F.col("p75_days") + F.col("std_days")}), "p75_days", "period_month")


def failure_rate_series(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    s = metrics.change_failure_monthly(commits, tz=tz).select("repo_slug", "period_month", "failure_rate")
    return trendline(s.withColumn("above_10pct", F.col("failure_rate") > 10), "failure_rate", "period_month")


def active_dev_series(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return metrics.active_developers_monthly(commits, tz).select("period_month", "repo_slug", F.col("unique_authors").alias("value"))


def throughput_series(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return metrics.throughput_monthly(commits, tz).select("period_month", "repo_slug", F.col("commit_count").alias("value"))


def _week(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.date_format(t.week_label_to_monday(F.col("period_week")), "yyyy-MM-dd").alias("week_monday"), "repo_slug", F.col(value).alias("value"))


def tpad_weekly_series(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    return _week(activity.throughput_per_active_dev_weekly(commits, weeks_back, tz), "commits_per_author")


def active_devs_weekly_comparison(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    return _week(activity.active_developers_weekly(commits, weeks_back, tz), "active_developers")


def stack_base(df: DataFrame, period: str, category: str, value: str) -> DataFrame:
    """Adds base: the sum of the categories below, within a period."""
    w = W.partitionBy(period).orderBy(category).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("base", F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def tpad_stacked_matrix(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    """A cell for each week and repository, 0 where there is none, with the week's total and the stack's base. Weeks and repositories are few."""
    s = tpad_weekly_series(commits, weeks_back, tz)
    grid = s.select("week_monday").distinct().crossJoin(s.select("repo_slug").distinct())  # period labels by repositories, the matrix itself
    full = grid.join(s, ["week_monday", "repo_slug"], "left").fillna({"value": 0.0})
    return stack_base(full.withColumn("total", F.sum("value").over(W.partitionBy("week_monday"))), "week_monday", "repo_slug", "value")


def tpad_pivot(commits: DataFrame, repos: Sequence[str], weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    """The same with a column for each of the named repositories."""
    s = tpad_weekly_series(commits, weeks_back, tz)
    return s.groupBy("week_monday").pivot("repo_slug", list(repos)).agg(F.first("value")).na.fill(0.0)


def tpad_weekly_combined(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    weekly = activity.active_developers_weekly(commits, weeks_back, tz)
    return rollup.aggregate_throughput_per_active_dev(weekly, rollup.window_authors_by_week(commits, weeks_back, tz))


def active_devs_weekly_combined(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    return tpad_weekly_combined(commits, weeks_back, tz).select("period_week", "active_authors", "commit_count")


def repository_summary(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    p75 = metrics.avg_p75(deltas.cycle_stats_by_month(commits, tz))
    rate = metrics.avg_rate(metrics.change_failure_monthly(commits, tz=tz))
    s = metrics.repo_summary(commits, tz).select("repo_slug", "total_commits", "unique_authors").join(p75, "repo_slug", "left").join(rate, "repo_slug", "left")
    return s.select("repo_slug", "total_commits", "unique_authors", minutes_to_days(F.coalesce("avg_p75_minutes", F.lit(0.0))).alias("avg_p75_days"), F.coalesce("avg_failure_rate", F.lit(0.0)).alias("avg_failure_rate"))


def work_category_stack(wide: DataFrame) -> DataFrame:
    """Long rows (Month, category, value, base) of every column but Month and Total."""
    names = [c for c in wide.columns if c not in ("Month", "Total")]
    long = wide.select("Month", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["Month"], names, "category", "value")
    return stack_base(long, "Month", "category", "value")


def sprint_completion_series(df: DataFrame, target: float = 80.0) -> DataFrame:
    return df.withColumn("below_target", F.col("Percentage Completed") < target).orderBy("Week")


def commit_trend_rows(commits: DataFrame, tz: str = "UTC") -> DataFrame:
    return metrics.commit_runs(commits, tz).select(F.col("week").alias("date"), "commits", F.col("author_ref").alias("author"), "repo_slug")


def period_ranks(df: DataFrame, keys: Sequence[str | Column], value: str, ties: Sequence[str] | None = None) -> DataFrame:
    """Adds rank_in_period by value, ties by the given columns; by all others, in order of their names, where none are given."""
    others = sorted(c for c in df.columns if c != value) if ties is None else ties
    return df.withColumn("rank_in_period", F.row_number().over(W.partitionBy(*keys).orderBy(value, *others)))
