"""Golden values of generated histories, and hand-made edge cases."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from deliverix.functions import scalars as s
from deliverix.functions import time as t
from deliverix.operators import activity, deltas, metrics, reconcile, rollup, series

LA = "America/Los_Angeles"
COMMITS = "repo_slug string, sha string, author_ref string, committed_at long, log_ordinal long, subject_has_keywords int, body_has_keywords int"
START = int(dt.datetime(2023, 9, 1, tzinfo=dt.UTC).timestamp())


def commits(spark, rows):
    """rows: (author, time[, sha[, fix]]) newest in the log first."""
    full = [("r", r[2] if len(r) > 2 else f"c{i}", r[0], r[1], i, r[3] if len(r) > 3 else 0, 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, COMMITS)


def history(spark, offsets, authors):
    made = [(f"a{i % authors}", START + d * 86400, f"c{i + 1}", int((i + 1) % 4 == 0 or (i + 1) % 3 == 0)) for i, d in enumerate(offsets)]
    return commits(spark, sorted(made, key=lambda r: (-r[1], -int(r[2][1:]))))


def stats(rows, order):
    return [(r.period_month, r.sum_minutes, round(r.avg_minutes, 2), r.p75_minutes, r.std_minutes) for r in sorted(rows.collect(), key=lambda r: r[order])]


# Day offsets of commits, and the expected months, buckets and rates of these histories.
def test_monthly_golden(spark):
    h = history(spark, [10, 11, 12, 13, 34, 35, 41, 49, 60, 75, 80, 85], 1)
    assert stats(deltas.cycle_stats_by_month(h), "period_month") == [("2023-09", 4320, 1440, 1440, 0), ("2023-10", 67680, 13536, 15840, 10708), ("2023-11", 36000, 12000, 14400, 8314)]


@pytest.mark.parametrize(
    ("offsets", "authors", "expected"),
    [
        (range(1, 13), 1, [("2023-09", 5760, 1440, 1440, 0)] * 2 + [("2023-09", 4320, 1440, 1440, 0)]),
        ([1, 2, 4, 7, 8, 10, 13, 14, 16, 19, 20, 22], 1, [("2023-09", 10080, 2520, 3240, 1379), ("2023-09", 11520, 2880, 3240, 1176), ("2023-09", 8640, 2880, 3600, 1440)]),
        ([7 * i for i in range(12)], 4, [("2023-09", 161280, 40320, 40320, 0), ("2023-10", 161280, 40320, 40320, 0)]),
        ([6 + i % 3 for i in range(12)], 4, [("2023-09", 5760, 1440, 1440, 0)] * 2),
        ([1, 10, 11, 15, 25, 26, 30, 40, 41, 45, 55, 56], 4, [("2023-09", 120960, 30240, 34920, 6109), ("2023-10", 109440, 27360, 29520, 6109)]),
        ([1, 18, 40, 157, 255, 256, 257, 398, 431, 432, 433, 434], 4, [("2024-05", 1368000, 342000, 351720, 22075), ("2024-11", 812160, 203040, 253440, 100800)]),
    ],
)
def test_bucket_golden(spark, offsets, authors, expected):
    assert stats(deltas.cycle_stats_by_bucket(history(spark, offsets, authors), 4), "bucket") == expected


def test_failure_golden(spark):
    got = metrics.change_failure_monthly(history(spark, [7 * i for i in range(12)], 4)).collect()
    assert {r.period_month: r.failure_rate for r in got} == {"2023-09": 40.0, "2023-10": 75.0, "2023-11": 33.3}


# End of the fixed values.
def epoch(*when, tz=LA):
    return int(dt.datetime(*when, tzinfo=ZoneInfo(tz)).timestamp())


def test_wall_clock_across_a_clock_change(spark):
    c = commits(spark, [("a", epoch(2020, 3, 9, 12)), ("a", epoch(2020, 3, 7, 12))])
    assert [r.cycle_minutes for r in deltas.commit_deltas(c, LA).collect()] == [2880.0]


def test_log_order_is_not_time_order(spark):
    base = 1_700_000_000
    c = commits(spark, [("x", base + 300, "A"), ("x", base + 100, "B"), ("x", base + 200, "C")])
    got = {(r.child_sha, r.prev_sha): r.cycle_minutes for r in deltas.delta_events(c).collect()}
    assert got == {("A", "B"): 3.33, ("B", "C"): -1.67}
    with pytest.warns(UserWarning):
        by_time = deltas.commit_deltas_by_time(c)
    assert sorted(r.cycle_minutes for r in by_time.collect()) == [1.67, 1.67]


def test_ties_in_buckets(spark):
    n = 1_700_000_000
    c = commits(spark, [("z", n), ("a", n), ("m", n), ("z", n - 600), ("a", n - 1800), ("m", n - 3000)])
    assert [(r.sum_minutes, r.sample_count) for r in deltas.cycle_stats_by_bucket(c, 2).collect()] == [(40.0, 2)]


def test_half_even_percentile(spark):
    n = 1_700_000_000
    c = commits(spark, [("a", n), ("a", n), ("a", n - 120), ("a", n - 300)])
    assert deltas.cycle_stats_by_month(c).first().p75_minutes == 2


def test_long_logs_are_cut_into_chunks(spark):
    from deliverix.operators.ordering import with_older

    c = commits(spark, [(f"a{i % 3}", 1000 - i, f"s{i}") for i in range(50)])
    got = {r.sha: r.older and r.older.sha for r in with_older(c, deltas.AUTHOR, ["sha"], chunk=4).collect()}
    assert got == {f"s{i}": f"s{i + 3}" if i + 3 < 50 else None for i in range(50)}


def test_delta_events_and_empty(spark):
    n = 1_700_000_000
    one = commits(spark, [("a", n)])
    assert deltas.delta_events(one).count() == 0 and deltas.cycle_stats_by_month(one).count() == 0
    two = commits(spark, [("a", n), ("b", n - 5), ("a", n - 1000), ("b", n - 1005)])
    assert [r.cycle_minutes for r in deltas.delta_events(two).collect()] == [16.67, 16.67]
    assert deltas.cycle_stats_by_bucket(one.limit(0)).count() == 0


def test_week_bounds(spark):
    at = epoch(2020, 3, 2, 1)
    r = spark.range(1).select(*(c.alias(k) for k, c in t.week_bounds(F.lit(at), LA).items())).first()
    assert r.period_week == "2020-W10" and r.week_monday_unix == epoch(2020, 3, 2) and r.week_end_unix - r.week_monday_unix == 604800 - 3600
    assert spark.range(1).select(t.period_week(F.lit("2024-12-30").cast("timestamp"))).first()[0] == "2025-W01"


def weekly_rule(rows, weeks_back, tz):
    local = [(a, dt.datetime.fromtimestamp(x, ZoneInfo(tz)).replace(tzinfo=None)) for a, x in rows]
    out = {}
    for _, x in local:
        monday = (x - dt.timedelta(days=x.weekday())).replace(hour=0, minute=0, second=0)
        lo, hi = monday - dt.timedelta(weeks=weeks_back), monday + dt.timedelta(weeks=1)
        own = [a for a, y in local if monday <= y < hi]
        window = {a for a, y in local if lo <= y <= hi}
        y, w, _ = x.isocalendar()
        out[f"{y}-W{w:02d}"] = (len(own), len(window), len(own) / len(set(own) & window))
    return out


@pytest.mark.parametrize("weeks_back", [0, 1, 4])
def test_weekly_windows(spark, weeks_back):
    import random

    r = random.Random(weeks_back)
    rows = [(f"d{r.randrange(8)}", epoch(2020, 2, 3) + r.randrange(70 * 24) * 3600) for _ in range(150)] + [("m", epoch(2020, 3, 9)), ("n", epoch(2020, 3, 2)), ("o", epoch(2020, 4, 20))]
    c = commits(spark, rows)
    active = {x.period_week: (x.commit_count, x.active_developers) for x in activity.active_developers_weekly(c, weeks_back, LA).collect()}
    rate = {x.period_week: x.commits_per_author for x in activity.throughput_per_active_dev_weekly(c, weeks_back, LA).collect()}
    assert {k: (*v, rate[k]) for k, v in active.items()} == weekly_rule(rows, weeks_back, LA)


@pytest.mark.parametrize("weeks_back", [0, 1, 4, 9])
def test_monthly_activity(spark, weeks_back):
    import random

    r = random.Random(weeks_back)
    rows = [(f"d{r.randrange(12)}", epoch(2020, 1, 1) + r.randrange(150 * 24) * 3600) for _ in range(120)] + [("m", epoch(2020, 3, 1)), ("m", epoch(2020, 3, 5))]
    local = [(a, dt.datetime.fromtimestamp(x, ZoneInfo(LA)).replace(tzinfo=None)) for a, x in rows]
    want = {}
    for _, x in local:
        first = dt.datetime(x.year, x.month, 1)
        before = {a for a, y in local if first - dt.timedelta(weeks=weeks_back) <= y <= first}
        own = [a for a, y in local if (y.year, y.month) == (x.year, x.month)]
        want[f"{x:%Y-%m}"] = (len(own), len(set(own) & before))
    got = {x.period_month: (x.commit_count, x.active_authors) for x in activity.throughput_per_active_dev_monthly(commits(spark, rows), weeks_back, LA).collect()}
    assert got == want


def test_percentile_ties(spark):
    c = commits(spark, [(f"a{i}", 1000 + i) for i in range(4)])
    assert {r.percentile for r in metrics.author_commit_percentiles(c).collect()} == {100.0}


@pytest.mark.parametrize(("value", "expected"), [("2023-9", "2023-09"), ("2023-10", "2023-10"), ("2023-13", "2023-13"), ("Fri Sep 29 00:00:00 2023", "2023-09"), ("soon", "soon"), ("", ""), ("2023-9-1", "2023-9-1"), (None, None)])
def test_normalize_date(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(t.normalize_date(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize(("url", "name"), [("https://host/team/app.git", "app"), ("git@host:team/app", "app"), ("/srv/app/", "app"), ("", "repo")])
def test_repo_name(spark, url, name):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(s.repo_name_from_url(F.col("u"))).first()[0] == name


def test_hmac(spark):
    import hashlib
    import hmac

    key = b"k" * 80
    got = spark.range(1).select(s.hmac_sha256(key, F.lit("t:x|r:y|e:é"))).first()[0]
    assert got == hmac.new(key, "t:x|r:y|e:é".encode(), hashlib.sha256).hexdigest()


def test_work_style(spark):
    with pytest.raises(ValueError, match="one of"):
        s.fix_like("other")
    df = spark.createDataFrame([("feat: login\n\nfix leftover",), ("hotfix",), (None,)], "m string")
    assert [tuple(r) for r in df.select(s.fix_like_message(F.col("m")), s.fix_like_message(F.col("m"), s.SQUASH)).collect()] == [(True, False), (True, True), (False, False)]


def test_rollup_of_three_repositories(spark):
    """Means give each repository the same weight, whatever its size; counts add up; people who are in several count once."""
    figures = {"p": (7.0, 3.5, 4, 1), "q": (120.0, 40.0, 61, 13), "s": (26.0, 6.5, 7, 4)}
    cycle = spark.createDataFrame([(r, "1999-12", *v) for r, v in figures.items()] + [("q", "2000-01", 9.0, 9.0, 9, 0)], "repo_slug string, period_month string, sum_minutes double, avg_minutes double, p75_minutes long, std_minutes long")
    failure = spark.createDataFrame([("p", "1999-12", 0.0), ("q", "1999-12", 12.5), ("s", "1999-12", 4.0)], "repo_slug string, period_month string, failure_rate double")
    people = {"p": "kl", "q": "lmno", "s": "k"}
    authors = spark.createDataFrame([(r, "1999-12", x) for r, xs in people.items() for x in xs], "repo_slug string, period_month string, author_ref string")
    through = spark.createDataFrame([("p", "1999-12", 11), ("q", "1999-12", 830), ("s", "1999-12", 2)], "repo_slug string, period_month string, commit_count long")
    weekly = spark.createDataFrame([("p", "1999-W50", 9), ("q", "1999-W50", 33), ("s", "1999-W51", 5)], "repo_slug string, period_week string, commit_count long")
    window = spark.createDataFrame([("p", "1999-W50", "k"), ("q", "1999-W50", "k"), ("q", "1999-W50", "m"), ("q", "1999-W50", "n"), ("s", "1999-W50", "o"), ("p", "1999-W51", "k")], "repo_slug string, period_week string, author_ref string")
    got = {(r.metric_name.split(".")[1], r.period_key): r.value_real for r in rollup.cohort_rows(cycle, failure, authors, through, weekly, window).collect()}
    months = {"monthly_sum": 51.0, "monthly_average": 50 / 3, "monthly_p75": 24.0, "monthly_std": 6.0, "monthly_rate": 5.5, "monthly_unique_count": 5.0, "monthly_total_commits": 843.0}
    want = {(k, "1999-12"): v for k, v in months.items()} | {(k, "2000-01"): v for k, v in (("monthly_sum", 9.0), ("monthly_average", 9.0), ("monthly_p75", 9.0), ("monthly_std", 0.0))}
    want |= {("weekly_value", "1999-W50"): 14.0, ("weekly_value", "1999-W51"): 0.0}  # o has no commits' repository in W50, nobody of s is in W51
    assert got == pytest.approx(want)


def test_reconcile(spark):
    schema = "k string, n long, x double"
    a = spark.createDataFrame([("both", 1, 1.0), ("left", 1, 1.0), ("near", 1, 1.0), ("far", 2, 1.0), ("null", 1, None)], schema)
    b = spark.createDataFrame([("both", 1, 1.0), ("right", 1, 1.0), ("near", 1, 1.01), ("far", 3, 1.2), ("null", 1, 2.0)], schema)
    got = {(r.k, r.problem, r.column) for r in reconcile.reconcile(a, b, ["k"], {"x": 0.02}).collect()}
    assert got == {("left", "only left", None), ("right", "only right", None), ("far", "value mismatch", "n"), ("far", "value mismatch", "x"), ("null", "value mismatch", "x")}


def test_trend(spark):
    df = spark.createDataFrame([("r", f"2024-0{i}", float(2 * i)) for i in range(1, 5)] + [("one", "2024-01", 5.0)], "repo_slug string, period_month string, v double")
    got = {(r.repo_slug, r.period_month): r.trend for r in series.trendline(df, "v", "period_month").collect()}
    assert got[("r", "2024-03")] == pytest.approx(6) and got[("one", "2024-01")] is None


def test_an_aggregate_is_worked_out_once_for_its_batches(spark, monkeypatch):
    from deliverix import catalog
    from deliverix.operators import rollup

    made, rows_of = [], rollup.cohort_rows_of
    monkeypatch.setattr(rollup, "cohort_rows_of", lambda *a, **k: (made.append(1), rows_of(*a, **k))[1])
    got = catalog.queries()["k2_write_multi_repo_aggregate"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and {x.batch_id for x in got.collect()} == {"default"} and got.count() > 0
