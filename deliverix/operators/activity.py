"""Rolling look-back windows: authors active in the weeks before, and commits for each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverix.functions import time as t
from deliverix.operators.metrics import activity_rows


def _weeks(commits: DataFrame, tz: str) -> DataFrame:
    """A row for each repository, author, Monday and whether a commit was exactly at its midnight, with its commits."""
    monday = t.week_monday(F.col("first_at"))
    rows = activity_rows(commits, tz).select("repo_slug", "author_ref", monday.alias("monday"), (F.col("first_at") == monday).alias("at_start"), "weight")
    return rows.groupBy("repo_slug", "author_ref", "monday", "at_start").agg(F.sum("weight").alias("commits"))


def window_authors(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    """repo_slug, monday, author_ref: who has a commit from weeks_back weeks before a week's Monday to the next Monday, both ends included.

    The listing itself: each author-week is expanded to the weeks it counts for, and only weeks with commits stay. To count authors,
    active_developers_weekly needs no such rows. A commit at a Monday's midnight counts for the week before too.
    """
    weeks = _weeks(commits, tz)
    first = F.when(F.col("at_start"), -1).otherwise(0)
    spread = weeks.select("repo_slug", "author_ref", "monday", F.explode(F.sequence(first, F.lit(weeks_back))).alias("k"))
    spread = spread.select("repo_slug", "author_ref", t.shift_days(F.col("monday"), F.col("k") * 7).alias("monday")).distinct()
    return spread.join(weeks.select("repo_slug", "monday").distinct(), ["repo_slug", "monday"])


def _changes(weeks: DataFrame, weeks_back: int) -> DataFrame:
    """repo_slug, w (number of a week), change: how many authors' windows begin less how many have ended, two rows for an author-week whatever weeks_back is.

    An author-week counts from its own week (or the one before, if a commit was at its midnight) for weeks_back weeks; where the author's next one begins
    before that is over, it ends there. So the stretches of an author don't overlap, and their beginnings and ends add up to distinct authors.
    """
    begin = F.col("w") - F.col("at_start").cast("int")
    mine = W.partitionBy("repo_slug", "author_ref").orderBy("begin", "end")
    spans = weeks.select("repo_slug", "author_ref", begin.alias("begin"), (F.col("w") + weeks_back + 1).alias("end"))
    spans = spans.withColumn("end", F.least("end", F.lead("begin").over(mine)))
    signed = F.explode(F.array(F.struct(F.col("begin").alias("w"), F.lit(1).alias("change")), F.struct(F.col("end").alias("w"), F.lit(-1).alias("change"))))
    return spans.filter("end > begin").select("repo_slug", signed.alias("x")).groupBy("repo_slug", "x.w").agg(F.sum("x.change").alias("change"))


def active_developers_weekly(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    """For each week with commits: its commits and the authors of its window (from weeks_back weeks before its Monday to the next Monday, both included)."""
    number = F.floor(F.datediff("monday", F.lit("1969-12-29")) / 7)
    weeks = _weeks(commits, tz).withColumn("w", number)
    counts = weeks.groupBy("repo_slug", "w").agg(F.sum("commits").alias("commit_count"), F.first("monday").alias("monday"))
    events = _changes(weeks, weeks_back).withColumns({"commit_count": F.lit(None).cast("long"), "monday": F.lit(None).cast("timestamp")})
    rows = events.unionByName(counts.withColumn("change", F.lit(0).cast("long")))
    upto = W.partitionBy("repo_slug").orderBy("w").rangeBetween(W.unboundedPreceding, 0)  # two rows for a week of the repository at most
    found = rows.withColumn("active_developers", F.sum("change").over(upto)).filter("commit_count is not null")
    return found.select("repo_slug", t.period_week(F.col("monday")).alias("period_week"), F.lit(weeks_back).alias("weeks_back"), "commit_count", "active_developers")


def throughput_per_active_dev_weekly(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    """For each week: commits over the week's authors that are in its window. The window holds the week itself (weeks_back is not negative), so these are all of them."""
    if weeks_back < 0:
        raise ValueError("weeks_back is negative")
    weeks = _weeks(commits, tz).groupBy("repo_slug", "monday", "author_ref").agg(F.sum("commits").alias("commits"))
    found = weeks.groupBy("repo_slug", "monday").agg(F.sum("commits").alias("commit_count"), F.count("*").alias("active_authors"))
    rate = F.col("commit_count") / F.col("active_authors")
    return found.select("repo_slug", t.period_week(F.col("monday")).alias("period_week"), F.lit(weeks_back).alias("weeks_back"), "commit_count", "active_authors", rate.alias("commits_per_author"))


def throughput_per_active_dev_monthly(commits: DataFrame, weeks_back: int = 4, tz: str = "UTC") -> DataFrame:
    """For each month: commits over the month's authors who were active in the weeks before its first midnight, both ends included.

    An author's activity is brought down to one row for each month it lies in; the look-back reaches a
    bounded number of months, so each such row is expanded to the months it may count for.
    """
    rows = activity_rows(commits, tz).withColumn("start", t.month_start(F.col("first_at")))
    seen = rows.groupBy("repo_slug", "author_ref", F.col("start").alias("own")).agg(F.sum("weight").alias("commits"), F.max("last_at").alias("at"), F.min("first_at").alias("first"))
    months = seen.select("repo_slug", t.period_month(F.col("own")).alias("period_month"), F.col("own").alias("start"), "author_ref", "commits")
    reach = weeks_back * 7 // 28 + 1
    at_start = F.when(F.col("first") == F.col("own"), 0).otherwise(1)
    spread = seen.select("repo_slug", "author_ref", "at", "own", F.explode(F.sequence(at_start, F.lit(reach))).alias("k"))
    spread = spread.withColumn("start", F.col("own") + F.make_interval(months=F.col("k")))
    active = spread.filter(F.col("at") >= t.shift_days(F.col("start"), -7 * weeks_back)).select("repo_slug", "author_ref", "start").distinct().withColumn("_in", F.lit(1))
    both = months.join(active, ["repo_slug", "author_ref", "start"], "left")
    found = both.groupBy("repo_slug", "period_month").agg(F.sum("commits").alias("commit_count"), F.count("_in").alias("active_authors"))
    rate = F.when(F.col("active_authors") > 0, F.col("commit_count") / F.col("active_authors")).otherwise(0.0)
    return found.select("repo_slug", "period_month", F.lit(weeks_back).alias("weeks_back"), "commit_count", "active_authors", rate.alias("commits_per_author"))
