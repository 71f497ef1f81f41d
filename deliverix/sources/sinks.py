"""Writers: metric tables, roll-ups, CSV series and JSON summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliverix.sources.snapshots import replace_rows

# The names of the report columns below.
#: Columns that every metric table has besides its own.
LINEAGE = ("source_commits_schema_version", "computed_at", "tenant_id", "metrics_schema_version")


def with_lineage(df: DataFrame, dataset_id: str, computed_at: int, source_version: int = 3, tenant: str | None = None, version: int = 1) -> DataFrame:
    return df.withColumns({
        "dataset_id": F.lit(dataset_id), "source_commits_schema_version": F.lit(source_version), "computed_at": F.lit(computed_at).cast("long"),
        "tenant_id": F.lit(tenant).cast("string"), "metrics_schema_version": F.lit(version),
    })


def write_metric_table(df: DataFrame, path: str, snapshots: Sequence[tuple[str, str]] = ()) -> None:
    """Replaces the snapshots (repo_slug, dataset_id) that df has; those named in snapshots that df has no rows of are emptied. No others change. Read by snapshots.read_rows."""
    named = df.sparkSession.createDataFrame(list(snapshots), "repo_slug string, dataset_id string") if snapshots else None
    replace_rows(df, path, ["repo_slug", "dataset_id"], named)


def write_commits_export(df: DataFrame, path: str, repos: Sequence[str] = ()) -> None:
    """Replaces the rows (commits, or edges) of the repositories that df has, and empties those named that it doesn't have. Read by snapshots.read_rows."""
    replace_rows(df, path, ["repo_slug"], df.sparkSession.createDataFrame([(r,) for r in repos], "repo_slug string") if repos else None)


def write_multi_repo_aggregate(df: DataFrame, path: str) -> None:
    """Replaces the batches and cohorts that df has, so that a batch may be written again."""
    replace_rows(df, path, ["batch_id", "cohort_id"])


def read_multi_repo_aggregate(df: DataFrame, batch_id: str, cohort_id: str) -> DataFrame:
    return df.filter((F.col("batch_id") == batch_id) & (F.col("cohort_id") == cohort_id)).orderBy("metric_name", "period_key")


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _reports(df: DataFrame, path: str, order: str) -> None:
    """A folder for each repository, its rows in order."""
    df.orderBy("repo_slug", order).write.mode("overwrite").partitionBy("repo_slug").csv(path, header=True)


def _two(name: str) -> Column:
    return F.format_string("%.2f", F.col(name).cast("double"))


def cycle_csv(cycle: DataFrame) -> DataFrame:
    """repo_slug and the columns of the cycle time report."""
    return cycle.select(
        "repo_slug", F.col("period_month").alias("INTERVAL START"), F.col("sum_minutes").alias("SUM"), F.round("avg_minutes", 2).alias("AVERAGE"), F.col("p75_minutes").alias("p75 CYCLE TIME (minutes)"), F.col("std_minutes").alias("std CYCLE TIME")
    )


def write_cycle_csv(cycle: DataFrame, path: str) -> None:
    _reports(cycle_csv(cycle), path, "INTERVAL START")


def write_failure_csv(failure: DataFrame, path: str) -> None:
    _reports(failure.select("repo_slug", F.col("period_month").alias("Month"), _two("failure_rate").alias("Change Failure Rate (%)")), path, "Month")


def write_authors_csv(authors: DataFrame, path: str) -> None:
    _reports(authors.select("repo_slug", F.col("period_month").alias("Month"), F.col("unique_authors").alias("Unique Authors")), path, "Month")


def write_throughput_csv(rate: DataFrame, path: str) -> None:
    _reports(rate.select("repo_slug", F.col("period_month").alias("Month"), _two("commits_per_author").alias("Commits Per Unique Developer")), path, "Month")


def save_metrics_csv(cycle: DataFrame, failure: DataFrame, folder: str, prefix: str = "") -> None:
    c = cycle.select("repo_slug", F.col("period_month").alias("Month"), F.col("sum_minutes").alias("Sum"), F.col("avg_minutes").alias("Average"), F.col("p75_minutes").alias("p75"), F.col("std_minutes").alias("std"))
    _reports(c, f"{folder}/{prefix}cycle_time_data.csv", "Month")
    _reports(failure.select("repo_slug", F.col("period_month").alias("Month"), F.col("failure_rate").alias("Rate")), f"{folder}/{prefix}change_failure_data.csv", "Month")


def save_author_runs(runs: DataFrame, percentiles: DataFrame, folder: str) -> None:
    """Runs of each repository by author and week, and its authors' percentiles, highest first; a folder for each repository, not for each author."""
    r = runs.select("repo_slug", F.col("author_ref").alias("Author"), F.col("week").alias("Date"), F.col("commits").alias("Commits"))
    r.orderBy("repo_slug", "Author", "Date").write.mode("overwrite").partitionBy("repo_slug").csv(f"{folder}/authors", header=True)
    p = percentiles.orderBy("repo_slug", F.desc("percentile"), "author_ref").select("repo_slug", F.col("author_ref").alias("Author"), F.col("percentile").alias("Percentile"))
    p.write.mode("overwrite").partitionBy("repo_slug").csv(f"{folder}/percentiles", header=True)


def save_repo_json(summary: DataFrame, path: str) -> None:
    """A folder for each repository with its summary as JSON."""
    summary.write.mode("overwrite").partitionBy("repo_slug").json(path)


def save_aggregates(parts: dict[str, DataFrame], summary: DataFrame, folder: str) -> list[str]:
    """Writes each aggregate that has rows, and the summary; returns what was written."""
    written = []
    for name, df in parts.items():
        if not df.isEmpty():
            _csv(df, f"{folder}/{name}")
            written.append(name)
    summary.write.mode("overwrite").json(f"{folder}/summary")
    return [*written, "summary"]


#: Fixed value: fields of the canonical monthly rows.
CANONICAL = ("repo_slug", "period_month", "sample_count", "sum_minutes", "avg_minutes", "p75_minutes", "std_minutes")


def write_canonical_csv(cycle: DataFrame, path: str) -> None:
    _csv(cycle.select(*CANONICAL).orderBy("repo_slug", "period_month"), path)


def branch_cycle_csv(summary: DataFrame) -> DataFrame:
    """repo_slug and the 19 columns of the branch report."""
    names = {"commits": "COMMITS", "cycle": "CYCLETIME", "close": "QA", "work": "WORKTIME"}
    head = [F.date_format(F.timestamp_seconds("interval_start"), "EEE MMM dd HH:mm:ss yyyy").alias("INTERVAL START"), F.col("branches").alias("BRANCHES"), F.col("total_commits").alias("COMMITS")]
    return summary.orderBy("repo_slug", "bucket").select("repo_slug", *head, *(F.col(f"{k}_{c}").alias(f"{k} {name}") for k in ("p50", "p75", "avg", "std") for c, name in names.items()))


def write_branch_cycle_csv(summary: DataFrame, path: str) -> None:
    branch_cycle_csv(summary).write.mode("overwrite").partitionBy("repo_slug").csv(path, header=True)
