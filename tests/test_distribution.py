"""Percentiles, windows, runs, author days and digests at their borders: brute force, and what each step reads."""

import random
from statistics import quantiles

import numpy as np
import pytest
from pyspark.sql import functions as F

from deliverix.operators import activity, deltas, graph, metrics, reconcile, rollup, selection, series, steps
from deliverix.plans import registry, views

COMMITS = "repo_slug string, author_ref string, sha string, committed_at long, log_ordinal long, subject_has_keywords int, body_has_keywords int"
MONDAY = 1704067200  # 2024-01-01


def commits(spark, n=600, seed=1, span=60 * 86400):
    r = random.Random(seed)
    times = sorted((MONDAY + r.choice([r.randrange(span), 86400 * 7 * r.randrange(8)]) for _ in range(n)), reverse=True)
    rows = [(f"r{r.randrange(2)}", f"a{int(r.paretovariate(0.8)) % 9}", f"s{i}", at, i, r.randrange(2), r.randrange(2)) for i, at in enumerate(times)]
    return rows, spark.createDataFrame(rows, COMMITS)


@pytest.mark.parametrize("width", [1000, 7])
def test_percentiles_by_selection(spark, width):
    r = random.Random(2)
    groups = {"one": [5.25], "two": [1.0, 2.5], "ties": [3.0] * 50 + [9.0] * 2, "wide": [round(r.lognormvariate(5, 3), 2) for _ in range(3000)], "below": [round(r.uniform(-900, 900), 2) for _ in range(777)], None: [1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)], "g string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
    got = {x.g: x for x in selection.percentiles(selection.counts_by_value(df, ["g"], "v"), ["g"], shares, width).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose([got[g][p] for p in shares], np.quantile(vs, list(shares.values())), rtol=1e-12), g
    want = df.groupBy("g").agg(F.percentile("v", 0.75).alias("p")).filter("p is not null").collect()
    assert {x.g: x.p for x in want} == {g: x.p75 for g, x in got.items()}


def test_no_buffer_holds_a_group(spark):
    """The measures of a month are made of hash aggregates and sorted ranges; no percentile function collects values."""
    _, df = commits(spark)
    plan = deltas.cycle_stats_by_month(df)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "collect_" not in plan


def test_measures_of_a_month(spark):
    rows, df = commits(spark, 400)
    got = {(x.repo_slug, x.period_month): x for x in deltas.cycle_stats_by_month(df).collect()}
    pairs = {}
    for repo, author in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if (r[0], r[1]) == (repo, author)]
        for newer, older in zip(own, own[1:]):
            month = str(np.datetime64(newer[3], "s"))[:7]
            pairs.setdefault((repo, month), []).append(round((newer[3] - older[3]) / 60, 2))
    assert set(got) == {k for k, v in pairs.items() if len(v) > 1}
    for k, x in got.items():
        v = pairs[k]
        assert x.sample_count == len(v) and abs(x.sum_minutes - sum(v)) < 1e-6 and abs(x.avg_minutes - np.mean(v)) < 1e-6
        assert x.std_minutes == round(np.std(v, ddof=1)) and x.p75_minutes == round(quantiles(v, n=4, method="inclusive")[2])


@pytest.mark.parametrize("weeks_back", [0, 1, 4, 52])
def test_windows_as_differences(spark, weeks_back):
    rows, df = commits(spark, 300, seed=weeks_back)
    week, got = 7 * 86400, activity.active_developers_weekly(df, weeks_back).collect()
    mondays = sorted({(r[0], r[3] - (r[3] - MONDAY) % week) for r in rows})
    want = []
    for repo, monday in mondays:
        own = [r for r in rows if r[0] == repo]
        active = {r[1] for r in own if monday - weeks_back * week <= r[3] <= monday + week}
        want.append((repo, sum(monday <= r[3] < monday + week for r in own), len(active)))
    assert sorted((x.repo_slug, x.commit_count, x.active_developers) for x in got) == sorted(want)
    listed = activity.window_authors(df, weeks_back).groupBy("repo_slug", "monday").count().select("repo_slug", "count")
    assert sorted(map(tuple, listed.collect())) == sorted((x.repo_slug, x.active_developers) for x in got)


def test_rows_of_windows_do_not_grow_with_the_look_back(spark):
    _, df = commits(spark)
    weeks = activity._weeks(df, "UTC").withColumn("w", F.floor(F.datediff("monday", F.lit("1969-12-29")) / 7))
    rows = [activity._changes(weeks, k).agg(F.count("*")).first()[0] for k in (4, 520)]
    assert rows[1] <= rows[0] + weeks.select("repo_slug").distinct().count() * 60 and rows[0] <= 2 * weeks.count()
    with pytest.raises(ValueError, match="negative"):
        activity.throughput_per_active_dev_weekly(df, -1)


@pytest.mark.parametrize("seconds", [1800, 6 * 3600, 8 * 7 * 86400])
def test_runs_are_stitched_over_chunks(spark, seconds):
    """Chunks of a few rows, of the usual size, and longer than the history."""
    rows, df = commits(spark, 500, seed=5, span=4 * 86400)
    want = []
    for repo in ("r0", "r1"):
        last, run = None, 0
        for _, author, _, at, _, *_ in sorted((r for r in rows if r[0] == repo), key=lambda r: (r[3], r[4])):
            week = (at - MONDAY) // (7 * 86400)
            if last is None or last[0] != week:
                run = 0
            if last != (week, author):
                run += 1
                want.append([repo, run, author, 0, at])
            want[-1][3] += 1
            last = (week, author)
    got = [[x.repo_slug, x.run, x.author_ref, x.commits, x.started_at] for x in metrics.commit_runs(df, seconds=seconds).collect()]
    assert sorted(got) == sorted(want)


def test_author_days_give_what_commits_give(spark):
    _, df = commits(spark, 500, seed=8)
    for tz in ("UTC", "America/Los_Angeles"):
        days = metrics.author_days(df, tz)
        same = lambda f: sorted(map(str, f(df).collect())) == sorted(map(str, f(days).collect()))
        for f in (metrics.throughput_monthly, metrics.throughput_weekly, metrics.change_failure_monthly, metrics.authors_by_month, metrics.repo_summary):
            assert same(lambda c, f=f, tz=tz: f(c, tz=tz)), f
        for f in (activity.active_developers_weekly, activity.throughput_per_active_dev_weekly, activity.throughput_per_active_dev_monthly, activity.window_authors):
            assert same(lambda c, f=f, tz=tz: f(c, 4, tz)), f
        assert same(metrics.author_commit_percentiles) and same(lambda c, tz=tz: metrics.change_failure_monthly(c, "squash", tz))


@pytest.mark.parametrize("several", [lambda c: rollup.cohort_rows_of(c), lambda c: list(registry.run_metrics(c).values())[0]])
def test_all_metrics_read_the_commits_once(spark, tmp_path, several):
    """What is left to read are stored steps: the source isn't in the plan any more, and its files may go."""
    _, df = commits(spark)
    source = f"{tmp_path}/source"
    df.write.parquet(source)
    out = several(spark.read.parquet(source))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert source not in plan and "step-" in plan
    for f in tmp_path.glob("source/*.parquet"):
        f.unlink()
    assert out.count() > 0
    assert steps.drop_steps(spark) > 0


def test_equal_ranges_are_not_joined(spark):
    left = spark.range(20_000).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo"), F.col("id").alias("k"), (F.col("id") / 7).alias("v"))
    right = left.filter("k != 11").withColumn("v", F.when(F.col("k") == 500, 0.0).otherwise(F.col("v"))).repartition(7)
    ranges = reconcile.unequal_ranges(left, right, ["repo", "k"])
    assert ranges.count() == 2
    joined = reconcile.rows_of_ranges(left, ranges, ["repo", "k"]).count()
    assert 2 <= joined < 20_000 / (3 * reconcile.RANGES) * 2 * 3
    got = {(x.k, x.problem, x.column) for x in reconcile.reconcile(left, right, ["repo", "k"]).collect()}
    assert got == {(11, "only left", None), (500, "value mismatch", "v")}
    assert reconcile.reconcile(left, left.orderBy(F.desc("k")), ["repo", "k"]).count() == 0
    twice = left.unionAll(left.filter("k < 2").unionAll(left.filter("k < 2")))
    assert reconcile.unequal_ranges(left, twice, ["repo", "k"]).count() == 2  # rows that cancel in an exclusive or are still counted
    nulls = left.withColumn("repo", F.lit(None).cast("string"))
    assert reconcile.reconcile(nulls, nulls.filter("k > 0"), ["repo", "k"]).count() == 1


def test_ranks_of_ties(spark):
    df = spark.createDataFrame([("p", v, n) for v, n in ((1, "b"), (1, "a"), (0, "c"), (1, "c"))], "p string, v int, n string")
    for some in (df, df.orderBy(F.desc("n"))):
        assert {(x.n, x.v): x.rank_in_period for x in series.period_ranks(some, ["p"], "v").collect()} == {("c", 0): 1, ("a", 1): 2, ("b", 1): 3, ("c", 1): 4}


def test_repositories_without_a_default_branch(spark):
    c = views.commits_orders(spark, "/root/testdata/sf0.001").filter("log_ordinal < 5")
    refs = c.filter("log_ordinal = 0 and repo_slug != 'repo2'").select("repo_slug", F.lit("main").alias("ref_name"), F.col("sha").alias("tip_sha"))
    assert [r[0] for r in graph.without_default_branch(refs, c).collect()] == ["repo2"]
    edges = views.edges_orders(c)
    assert {r.repo_slug for r in graph.squash_commits(refs, c, edges).collect()} == {"repo0", "repo1", "repo3"}
    with pytest.raises(ValueError, match="no default branch: repo2"):
        graph.squash_commits(refs, c, edges, strict=True)


def test_interchange_is_checked_in_few_passes(spark, tmp_path):
    """Edges are read once, before the result is, and the commits twice; every rule is in the result all the same, as often as it is broken."""
    c = spark.createDataFrame([("r", "a", "b", 1), ("r", "b", "", 0), ("r", "b", "", 0), ("r", "c", "b a", 3)], "repo_slug string, sha string, parent_shas string, parent_count int")
    e = spark.createDataFrame([("r", "a", "b", 0), ("r", "c", "b", 0), ("r", "c", "b", 0), ("r", "c", "a", 1), ("r", "c", "a", 1), ("r", "z", "a", 1), (None, "a", "b", 0)], "repo_slug string, child_sha string, parent_sha string, parent_ord int")
    for name, df in (("commits", c), ("edges", e)):
        df.write.parquet(f"{tmp_path}/{name}")
    found = reconcile.validate_interchange(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("commits", "edges")))
    files = found._jdf.queryExecution().executedPlan().toString()
    assert files.count("FileScan parquet") == 4  # the commits and a stored row for each commit with edges, twice each
    assert not any("/edges/" in f for f in found.inputFiles()) and any("/commits/" in f for f in found.inputFiles())
    got = sorted((x.rule, str(x.repo_slug), x.sha) for x in found.filter("rule not like 'column: %'").collect())
    assert got == sorted([
        ("unique commit", "r", "b"), ("unique edge", "r", "c"), ("unique edge", "r", "c"), ("parents in order from 0", "r", "c"), ("parents in order from 0", "r", "z"),
        ("edge of a known commit", "r", "z"), ("edge of a known commit", "None", "a"), ("edges match parent_count", "r", "c"), ("edges match parent_shas", "r", "c"),
    ])
