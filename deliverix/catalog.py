"""Registry of the delivery-metric queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverix.functions import scalars as s
from deliverix.functions import time as t
from deliverix.operators import activity, deltas, graph, metrics, reconcile, rollup, series
from deliverix.operators.steps import stored
from deliverix.plans import registry, views
from deliverix.plans.views import DELTAS_SQL, EDGES_SQL, EVENTS_SQL, ORDERS_SQL
from deliverix.sources import export, readers, sinks
from deliverix.sources.snapshots import read_rows

Query = Callable[[SparkSession, str], DataFrame]

#: The look-back of the registered queries, the size of a bucket, and the instant of "recent" ones.
WEEKS_BACK, BUCKET, AS_OF = 4, 100, 1706572800

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql:
        _sql[name] = sql


def _orders(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, ctes: str = "") -> None:
    _add(name, lambda spark, d: f(views.commits_orders(spark, d)), sql and f"WITH {ORDERS_SQL}{ctes} {sql}")


def _events(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, ctes: str = "") -> None:
    _add(name, lambda spark, d: f(views.commits_events(spark, d)), sql and f"WITH {EVENTS_SQL}{ctes} {sql}")


# cycle time
_STATS = """count(*) AS sample_count, sum(cycle_minutes) AS sum_minutes, avg(cycle_minutes) AS avg_minutes,
  CAST(round_even(quantile_cont(cycle_minutes, 0.75), 0) AS BIGINT) AS p75_minutes, CAST(round_even(stddev_samp(cycle_minutes), 0) AS BIGINT) AS std_minutes"""
_events("d1_commit_deltas", deltas.commit_deltas, "SELECT repo_slug, author_ref, committed_at, cycle_minutes, log_ordinal FROM deltas", "," + DELTAS_SQL)
_events(
    "d2_commit_deltas_by_time",
    deltas.commit_deltas_by_time,
    """SELECT repo_slug, author_ref, committed_at, sha, cycle_minutes FROM (
      SELECT *, round((committed_at - lag(committed_at) OVER w) / 60.0, 2)::DOUBLE AS cycle_minutes FROM local
      WINDOW w AS (PARTITION BY repo_slug, author_ref ORDER BY committed_at, sha)) WHERE cycle_minutes IS NOT NULL""",
)
_orders("d3_delta_events", deltas.delta_events, "SELECT repo_slug, author_ref, committed_at, child_sha, prev_sha, cycle_minutes, log_ordinal FROM deltas", "," + DELTAS_SQL)
_orders(
    "d4_consecutive_pairs",
    deltas.consecutive_pairs,
    """SELECT d.repo_slug, d.author_ref, d.child_sha AS newer_sha, d.prev_sha AS older_sha, d.committed_at AS newer_at, p.committed_at AS older_at, d.log_ordinal
    FROM deltas d JOIN commits p ON p.repo_slug = d.repo_slug AND p.sha = d.prev_sha""",
    "," + DELTAS_SQL,
)
_orders(
    "d5_cycle_stats_by_bucket",
    lambda c: deltas.cycle_stats_by_bucket(c, BUCKET),
    f"""SELECT repo_slug, bucket, arg_min(period_month, n) AS period_month, {_STATS} FROM (
      SELECT *, n // {BUCKET} AS bucket FROM (
        SELECT d.*, row_number() OVER (PARTITION BY d.repo_slug ORDER BY d.committed_at, a.author_ord, d.log_ordinal) - 1 AS n
        FROM deltas d JOIN (SELECT repo_slug, author_ref, min(log_ordinal) AS author_ord FROM commits GROUP BY ALL) a USING (repo_slug, author_ref)))
    GROUP BY repo_slug, bucket HAVING count(*) >= 2""",
    "," + DELTAS_SQL,
)
_orders("d6_cycle_stats_by_month", deltas.cycle_stats_by_month, f"SELECT repo_slug, period_month, {_STATS} FROM deltas GROUP BY ALL HAVING count(*) >= 2", "," + DELTAS_SQL)
_orders(
    "d7_cycle_chart_series",
    deltas.cycle_chart_series,
    f"SELECT *, p75_minutes / 1440 AS p75_days, std_minutes / 1440 AS std_days FROM (SELECT repo_slug, period_month, {_STATS} FROM deltas GROUP BY ALL HAVING count(*) >= 2)",
    "," + DELTAS_SQL,
)
_orders(
    "d8_cycle_time_between_commits_by_author",
    deltas.cycle_time_between_commits_by_author,
    _sql["d5_cycle_stats_by_bucket"].split(" SELECT repo_slug, bucket,", 1)[1].join(["SELECT repo_slug, bucket,", ""]).replace(f"n // {BUCKET}", "n // 1000"),
    "," + DELTAS_SQL,
)

# a zone with clock changes; DuckDB's own zones may be missing, so the rule of those years stands here: the first Sunday of April to the last of October
_ZONE = "America/Los_Angeles"
_ZONED = """, edge AS (SELECT DISTINCT year(local.at) AS y FROM local),
summer AS (SELECT y, make_timestamp(y, 4, 1, 10, 0, 0) + INTERVAL 1 DAY * ((7 - dayofweek(make_date(y, 4, 1))) % 7) AS begins, make_timestamp(y, 10, 31, 9, 0, 0) - INTERVAL 1 DAY * dayofweek(make_date(y, 10, 31)) AS ends FROM edge),
zoned AS (SELECT l.* EXCLUDE ("at", period_month, period_week, monday), l.at - INTERVAL 1 HOUR * CASE WHEN l.at >= begins AND l.at < ends THEN 7 ELSE 8 END AS wall FROM local l JOIN summer ON y = year(l.at))"""
_orders(
    "d6_cycle_stats_in_a_zone",
    lambda c: deltas.cycle_stats_by_month(c, _ZONE),
    f"""SELECT repo_slug, period_month, {_STATS} FROM (
      SELECT repo_slug, strftime(wall, '%Y-%m') AS period_month, round((epoch(wall) - epoch(lag(wall) OVER (PARTITION BY repo_slug, author_ref ORDER BY log_ordinal DESC))) / 60, 2)::DOUBLE AS cycle_minutes FROM zoned)
    WHERE cycle_minutes IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
    _ZONED,
)
_orders(
    "a6_active_developers_in_a_zone",
    lambda c: activity.active_developers_weekly(c, 4, _ZONE),
    """SELECT w.repo_slug, w.period_week, 4 AS weeks_back, any_value(w.n) AS commit_count, count(DISTINCT a.author_ref) AS active_developers
    FROM (SELECT repo_slug, strftime(wall, '%G-W%V') AS period_week, date_trunc('week', wall)::TIMESTAMP AS monday, count(*) AS n FROM zoned GROUP BY ALL) w
    JOIN zoned a ON a.repo_slug = w.repo_slug AND a.wall >= w.monday - INTERVAL '28 days' AND a.wall <= w.monday + INTERVAL '7 days' GROUP BY ALL""",
    _ZONED,
)
_orders(
    "e4_week_bounds_in_a_zone",
    lambda c: c.select("repo_slug", "sha", *(v.alias(k) for k, v in t.week_bounds(F.col("committed_at"), _ZONE).items())),
    """SELECT repo_slug, sha, strftime(wall, '%G-W%V') AS period_week, CAST(epoch(m) AS BIGINT) + 3600 * CASE WHEN m > a.begins - INTERVAL 8 HOUR AND m <= a.ends - INTERVAL 7 HOUR THEN 7 ELSE 8 END AS week_monday_unix,
      CAST(epoch(n) AS BIGINT) + 3600 * CASE WHEN n > b.begins - INTERVAL 8 HOUR AND n <= b.ends - INTERVAL 7 HOUR THEN 7 ELSE 8 END AS week_end_unix
    FROM (SELECT *, date_trunc('week', wall)::TIMESTAMP AS m, date_trunc('week', wall)::TIMESTAMP + INTERVAL 7 DAY AS n FROM zoned) z JOIN summers a ON a.y = year(m) JOIN summers b ON b.y = year(n)""",
    _ZONED + """, summers AS (SELECT y, make_timestamp(y, 4, 1, 10, 0, 0) + INTERVAL 1 DAY * ((7 - dayofweek(make_date(y, 4, 1))) % 7) AS begins, make_timestamp(y, 10, 31, 9, 0, 0) - INTERVAL 1 DAY * dayofweek(make_date(y, 10, 31)) AS ends
      FROM (SELECT unnest(range(min(y) - 1, max(y) + 2)) AS y FROM edge))""",
)

# counts and rates
_COUNTS = "count(*) AS commit_count, count(DISTINCT author_ref) AS unique_authors"
_orders("a2_throughput_monthly", metrics.throughput_monthly, f"SELECT repo_slug, period_month, {_COUNTS} FROM local GROUP BY ALL")
_events("a3_throughput_weekly", metrics.throughput_weekly, f"SELECT repo_slug, period_week, {_COUNTS} FROM local GROUP BY ALL")
_orders("a4_throughput_rate_monthly", metrics.throughput_rate_monthly, "SELECT repo_slug, period_month, count(*) / count(DISTINCT author_ref) AS commits_per_author FROM local GROUP BY ALL")
_orders("a5_active_developers_monthly", metrics.active_developers_monthly, "SELECT repo_slug, period_month, count(DISTINCT author_ref) AS unique_authors FROM local GROUP BY ALL")
_WINDOW = f"""
weeks AS (SELECT DISTINCT repo_slug, period_week, monday FROM local),
window_authors AS (
  SELECT DISTINCT w.repo_slug, w.period_week, c.author_ref FROM weeks w JOIN local c ON c.repo_slug = w.repo_slug
    AND c.at >= w.monday - INTERVAL '{WEEKS_BACK * 7} days' AND c.at <= w.monday + INTERVAL '7 days'
)"""
_events(
    "a6_active_developers_weekly",
    lambda c: activity.active_developers_weekly(c, WEEKS_BACK),
    f"""SELECT l.repo_slug, l.period_week, {WEEKS_BACK} AS weeks_back, count(*) AS commit_count,
      (SELECT count(*) FROM window_authors a WHERE a.repo_slug = l.repo_slug AND a.period_week = l.period_week) AS active_developers
    FROM local l GROUP BY ALL""",
    "," + _WINDOW,
)
_orders(
    "a6_active_developers_in_a_year",
    lambda c: activity.active_developers_weekly(c.filter("author_ref != 'dev7' or o_orderkey % 7 = 0"), 52),
    """SELECT w.repo_slug, w.period_week, 52 AS weeks_back, any_value(w.n) AS commit_count, count(DISTINCT a.author_ref) AS active_developers
    FROM (SELECT repo_slug, period_week, monday, count(*) AS n FROM thinned GROUP BY ALL) w
    JOIN (SELECT DISTINCT repo_slug, author_ref, local.at AS seen FROM thinned AS local) a ON a.repo_slug = w.repo_slug AND a.seen >= w.monday - INTERVAL '364 days' AND a.seen <= w.monday + INTERVAL '7 days' GROUP BY ALL""",
    ", thinned AS (SELECT * FROM local WHERE author_ref <> 'dev7' OR o_orderkey % 7 = 0)",
)
_events(
    "a7_throughput_per_active_dev_weekly",
    lambda c: activity.throughput_per_active_dev_weekly(c, WEEKS_BACK),
    f"""SELECT l.repo_slug, l.period_week, {WEEKS_BACK} AS weeks_back, count(*) AS commit_count, count(DISTINCT a.author_ref) AS active_authors,
      CASE WHEN count(DISTINCT a.author_ref) > 0 THEN count(*) / count(DISTINCT a.author_ref) ELSE 0 END AS commits_per_author
    FROM local l LEFT JOIN window_authors a USING (repo_slug, period_week, author_ref) GROUP BY ALL""",
    "," + _WINDOW,
)
_orders(
    "a8_throughput_per_active_dev_monthly",
    lambda c: activity.throughput_per_active_dev_monthly(c, WEEKS_BACK),
    f"""SELECT l.repo_slug, l.period_month, {WEEKS_BACK} AS weeks_back, count(*) AS commit_count, count(DISTINCT l.author_ref) FILTER (active) AS active_authors,
      CASE WHEN count(DISTINCT l.author_ref) FILTER (active) > 0 THEN count(*) / count(DISTINCT l.author_ref) FILTER (active) ELSE 0 END AS commits_per_author
    FROM (SELECT m.*, EXISTS (SELECT 1 FROM local p WHERE p.repo_slug = m.repo_slug AND p.author_ref = m.author_ref
      AND p.at <= date_trunc('month', m.at) AND p.at >= date_trunc('month', m.at) - INTERVAL '{WEEKS_BACK * 7} days') AS active FROM local m) l GROUP BY ALL""",
)
_events(
    "a9_active_authors_recent",
    lambda c: metrics.active_authors_recent(c, F.lit(AS_OF), 1),
    f"SELECT DISTINCT repo_slug, author_ref FROM local WHERE committed_at >= {AS_OF} - 604800",
)
_FAILURE = """SELECT *, round_even(100.0::DOUBLE * fix_like_commits / total_commits, 1) AS failure_rate FROM (
  SELECT repo_slug, period_month, count(*) AS total_commits, count(*) FILTER ({}) AS fix_like_commits FROM local GROUP BY ALL)"""
_EITHER = _FAILURE.format("subject_has_keywords = 1 OR body_has_keywords = 1")
_orders("a10_change_failure_monthly", metrics.change_failure_monthly, _EITHER)
_orders("a10_change_failure_monthly_squash", lambda c: metrics.change_failure_monthly(c, s.SQUASH), _FAILURE.format("subject_has_keywords = 1"))
_orders("p4_change_failure_from_messages", metrics.change_failure_from_messages, _EITHER)
_orders("p5_change_failure_from_first_lines", lambda c: metrics.change_failure_from_messages(c, s.SQUASH), _FAILURE.format("subject_has_keywords = 1"))
_orders("a11_author_commit_totals", metrics.author_commit_totals, "SELECT repo_slug, author_ref, count(*) AS commit_count FROM commits GROUP BY ALL")
_orders(
    "w4_author_commit_percentiles",
    metrics.author_commit_percentiles,
    """SELECT *, cume_dist() OVER (PARTITION BY repo_slug ORDER BY commit_count) * 100 AS percentile FROM (
      SELECT repo_slug, author_ref, count(*) AS commit_count FROM commits GROUP BY ALL)""",
)
_orders(
    "a12_repo_summary",
    metrics.repo_summary,
    """SELECT repo_slug, count(*) AS total_commits, count(DISTINCT author_ref) AS unique_authors, strftime(min(local.at), '%Y-%m-%dT%H:%M:%S') AS first_commit,
      strftime(max(local.at), '%Y-%m-%dT%H:%M:%S') AS last_commit FROM local GROUP BY ALL""",
)
_orders(
    "a13_avg_p75",
    lambda c: metrics.avg_p75(deltas.cycle_stats_by_month(c)),
    f"SELECT repo_slug, avg(p75_minutes) AS avg_p75_minutes FROM (SELECT repo_slug, period_month, {_STATS} FROM deltas GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL",
    "," + DELTAS_SQL,
)
_orders("a13_avg_rate", lambda c: metrics.avg_rate(metrics.change_failure_monthly(c)).withColumn("avg_failure_rate", F.round("avg_failure_rate", 6)), f"SELECT repo_slug, round(avg(failure_rate), 6) AS avg_failure_rate FROM ({_EITHER}) GROUP BY ALL")
_RUNS = """
marked AS (SELECT *, CASE WHEN author_ref = lag(author_ref) OVER w THEN 0 ELSE 1 END AS new FROM local
  WINDOW w AS (PARTITION BY repo_slug, period_week ORDER BY committed_at, log_ordinal)),
runs AS (SELECT repo_slug, period_week AS week, run, any_value(author_ref) AS author_ref, count(*) AS commits, min(committed_at) AS started_at FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY repo_slug, period_week ORDER BY committed_at, log_ordinal) AS BIGINT) AS run FROM marked) GROUP BY ALL)"""
_events("a15_commit_runs", metrics.commit_runs, "SELECT * FROM runs", "," + _RUNS)


# merges and edges
def _edged(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None, ctes: str = "") -> None:
    """A query on commits and edges, both stored: they come from row numbers, and what follows reads them several times."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        commits = stored(views.commits_orders(spark, d))
        return f(commits, stored(views.edges_orders(commits)))

    _add(name, query, sql and f"WITH RECURSIVE {ORDERS_SQL}, {EDGES_SQL}{ctes} {sql}")


def _tips(commits: DataFrame, at: int = 0) -> DataFrame:
    return commits.filter(F.col("log_ordinal") == at).select("repo_slug", F.col("sha").alias("tip_sha"))


_PARENTS = """
lists AS (SELECT repo_slug, child_sha AS sha, CAST(count(*) AS INTEGER) AS parent_count, string_agg(parent_sha, ' ' ORDER BY parent_ord) AS parent_shas FROM edges GROUP BY ALL),
parented AS (SELECT c.*, coalesce(l.parent_count, 0) AS parent_count, coalesce(l.parent_shas, '') AS parent_shas FROM local c LEFT JOIN lists l USING (repo_slug, sha))"""
_edged("e3_build_parent_edges", lambda c, e: graph.build_parent_edges(graph.with_parents(c, e)), "SELECT repo_slug, child_sha, CAST(row_number() OVER (PARTITION BY repo_slug, child_sha ORDER BY parent_ord) - 1 AS INTEGER) AS parent_ord, parent_sha FROM edges")
_edged("a16_parent_count_share", lambda c, e: metrics.parent_count_share(graph.with_parents(c, e)), "SELECT *, commits / sum(commits) OVER (PARTITION BY repo_slug) AS share FROM (SELECT repo_slug, parent_count, count(*) AS commits FROM parented GROUP BY ALL)", "," + _PARENTS)
_edged("a17_edge_count", lambda c, e: metrics.edge_count(e), "SELECT repo_slug, count(*) AS edges FROM edges GROUP BY ALL")
_edged("g1_link_children", graph.link_children, "SELECT c.repo_slug, c.sha, count(e.child_sha) AS children FROM commits c LEFT JOIN edges e ON e.repo_slug = c.repo_slug AND e.parent_sha = c.sha GROUP BY ALL")
_edged(
    "g2_reachable_from",
    lambda c, e: graph.reachable_from(_tips(c), c, e),
    "SELECT repo_slug, sha FROM reach",
    """, reach AS (SELECT repo_slug, sha FROM commits WHERE log_ordinal = 0
      UNION SELECT r.repo_slug, e.parent_sha FROM reach r JOIN edges e ON e.repo_slug = r.repo_slug AND e.child_sha = r.sha)""",
)


def _squash(c: DataFrame, e: DataFrame) -> DataFrame:
    refs = _tips(c, 1).withColumn("ref_name", F.lit("main")).unionByName(_tips(c, 0).withColumn("ref_name", F.lit("topic")))
    return metrics.change_failure_monthly(graph.squash_commits(refs, c, e), s.SQUASH)


_edged(
    "p13_squash_change_failure",
    _squash,
    _FAILURE.format("subject_has_keywords = 1").replace("FROM local", "FROM local SEMI JOIN reach USING (repo_slug, sha)"),
    """, reach AS (SELECT repo_slug, sha FROM commits WHERE log_ordinal = 1
      UNION SELECT r.repo_slug, e.parent_sha FROM reach r JOIN edges e ON e.repo_slug = r.repo_slug AND e.child_sha = r.sha)""",
)
_edged(
    "p14_no_default_branch",
    lambda c, e: graph.without_default_branch(
        c.filter("log_ordinal < 2").select("repo_slug", F.when(F.col("repo_slug") == "repo1", "topic").when(F.col("repo_slug") == "repo2", "refs/heads/master").otherwise("main").alias("ref_name"), F.when(F.col("repo_slug") == "repo3", "gone").otherwise(F.col("sha")).alias("tip_sha")), c
    ),
    "SELECT DISTINCT repo_slug FROM commits WHERE repo_slug IN ('repo1', 'repo3')",
)


def _walk_sql(strategy: str) -> str:
    """CTEs lines and members: a walk of one commit a step, with what has been claimed as bits and the lines that wait as a list. Commits are numbered as in the log."""
    key = f"CASE w.key WHEN '' THEN '' ELSE w.key || '.' END || {'-' if strategy == 'reverse' else ''}w.pos || '.1'"
    sub = f"CASE WHEN u.second IS NULL THEN [] ELSE [{{'merge': w.here, 'start': u.second, 'key': {key}}}] END"
    subs = {"stop": "w.subs", "reverse": f"{sub} || w.subs"}.get(strategy, f"w.subs || {sub}")
    queue = "w.waiting || w.subs" if strategy == "narrow" else "w.subs || w.waiting"
    pending = "STRUCT(merge BIGINT, start BIGINT, key VARCHAR)[]"
    return f""",
ends AS (SELECT e.repo_slug, e.child_sha AS sha, e.parent_ord, p.log_ordinal AS idx FROM edges e JOIN commits p ON p.repo_slug = e.repo_slug AND p.sha = e.parent_sha),
up AS (SELECT c.repo_slug, c.log_ordinal AS idx, c.sha, max(e.idx) FILTER (parent_ord = 0) AS first, max(e.idx) FILTER (parent_ord = 1) AS second
  FROM commits c LEFT JOIN ends e ON e.repo_slug = c.repo_slug AND e.sha = c.sha GROUP BY ALL),
walk AS (
  SELECT repo_slug, 0::BIGINT AS here, true AS fresh, NULL::BIGINT AS merge, 0::BIGINT AS start, '' AS key, 0::BIGINT AS pos, []::{pending} AS waiting, []::{pending} AS subs, repeat('0', count(*)::INT)::BIT AS seen
  FROM commits GROUP BY repo_slug
  UNION ALL
  SELECT repo_slug, here, here IS NOT NULL AND get_bit(seen, coalesce(here, 0)::INT) = 0 AS fresh, merge, start, key, pos, waiting, subs, seen FROM (
    SELECT w.repo_slug, CASE WHEN w.fresh THEN u.first ELSE q[1].start END AS here, CASE WHEN w.fresh THEN w.merge ELSE q[1].merge END AS merge, CASE WHEN w.fresh THEN w.start ELSE q[1].start END AS start,
      CASE WHEN w.fresh THEN w.key ELSE q[1].key END AS key, CASE WHEN w.fresh THEN w.pos + 1 ELSE 0 END AS pos, CASE WHEN w.fresh THEN w.waiting ELSE q[2:] END AS waiting,
      CASE WHEN w.fresh THEN {subs} ELSE [] END AS subs, CASE WHEN w.fresh THEN set_bit(w.seen, w.here::INT, 1) ELSE w.seen END AS seen
    FROM (SELECT *, CASE WHEN fresh THEN [] ELSE {queue} END AS q FROM walk w) w LEFT JOIN up u ON u.repo_slug = w.repo_slug AND u.idx = w.here AND w.fresh
    WHERE w.fresh OR len(q) > 0)
),
named AS (
  SELECT w.*, c.sha, m.sha AS merge_sha, s.sha AS start_sha, CASE WHEN w.merge IS NULL THEN 0 ELSE 1 END AS ord,
    sha256(concat_ws(chr(10), '{strategy}', w.repo_slug, coalesce(m.sha, ''), CASE WHEN w.merge IS NULL THEN 0 ELSE 1 END, s.sha)) AS line_id
  FROM walk w LEFT JOIN up c ON c.repo_slug = w.repo_slug AND c.idx = w.here LEFT JOIN up m ON m.repo_slug = w.repo_slug AND m.idx = w.merge LEFT JOIN up s ON s.repo_slug = w.repo_slug AND s.idx = w.start
),
members AS (SELECT repo_slug, line_id, sha, pos FROM named WHERE fresh),
lines AS (
  SELECT n.repo_slug, n.line_id, n.merge_sha AS merge, n.start_sha AS start, d.sha AS departure, coalesce(m.k, 0) AS commit_count, n.key FROM named n
  LEFT JOIN (SELECT line_id, count(*) AS k, arg_max(sha, pos) AS last FROM members GROUP BY ALL) m USING (line_id)
  LEFT JOIN ends e ON e.repo_slug = n.repo_slug AND e.sha = m.last AND e.parent_ord = 0 LEFT JOIN up d ON d.repo_slug = n.repo_slug AND d.idx = e.idx
  WHERE n.pos = 0
)"""


_TOP = _walk_sql("top")
_PHASES = """,
phases AS (
  SELECT *, least(d_at, lo, m_at) AS start_at, lo - d_at AS ramp_seconds, hi - lo AS work_seconds, m_at - hi AS close_seconds,
    CASE WHEN k + (d_at IS NOT NULL)::INT + (m_at IS NOT NULL)::INT > 1 THEN greatest(d_at, hi, m_at) - least(d_at, lo, m_at) END AS total_seconds
  FROM (SELECT l.*, d.committed_at AS d_at, m.committed_at AS m_at FROM lines l LEFT JOIN commits d ON d.repo_slug = l.repo_slug AND d.sha = l.departure LEFT JOIN commits m ON m.repo_slug = l.repo_slug AND m.sha = l.merge)
  LEFT JOIN (SELECT line_id, min(committed_at) AS lo, max(committed_at) AS hi, count(*) AS k FROM members JOIN commits USING (repo_slug, sha) GROUP BY ALL) USING (line_id)
)"""
_FIVE = "start_at, ramp_seconds, work_seconds, close_seconds, total_seconds"
for _strategy in graph.STRATEGIES:
    _edged(f"g3_branch_lines_{_strategy}", lambda c, e, k=_strategy: graph.branch_lines(c, e, _tips(c), k)[0].withColumn("key", F.concat_ws(".", F.transform("key", lambda x: x.cast("string")))), "SELECT * FROM lines", _walk_sql(_strategy))
_MATERIAL = f"""SELECT repo_slug, 'default' AS dataset_id, sha256('top' || chr(10) || coalesce(merge, '') || chr(10) || start) AS branch_line_id, 'top' AS strategy, merge AS merge_sha, start AS root_sha,
  departure AS departure_sha, commit_count, {_FIVE} FROM phases"""
_edged("g9_materialize_branch_lines", lambda c, e: graph.materialize_branch_lines(c, e, _tips(c)), _MATERIAL, _TOP + _PHASES)
_MEASURES = [(name, f.format(c), c) for name, f in (("p50", "median({})"), ("p75", "quantile_cont({}, 0.75)"), ("avg", "avg({})"), ("std", "stddev_samp({})")) for c in ("commits", "cycle", "close", "work")]
_BUCKETS = f""",
spans AS (SELECT *, row_number() OVER (PARTITION BY repo_slug ORDER BY {", ".join(f"{c} NULLS FIRST" for c in _FIVE.split(", "))}, branch_line_id) - 1 AS rn, count(*) OVER (PARTITION BY repo_slug) AS n
  FROM ({_MATERIAL}) WHERE commit_count > 0 AND ramp_seconds <> 0),
days AS (SELECT repo_slug, rn // greatest(1, n // 12) AS bucket, start_at, commit_count, commit_count * 100 AS commits, floor(round(ramp_seconds / 864) / 200)::BIGINT * 100 AS half,
  coalesce(round(total_seconds / 864), 0)::BIGINT - half AS cycle, round(close_seconds / 864)::BIGINT AS close, half + coalesce(round(work_seconds / 864), 0)::BIGINT AS work FROM spans),
summary AS (SELECT repo_slug, bucket, min(start_at) AS interval_start, count(*) AS branches, sum(commit_count)::BIGINT AS total_commits,
  {", ".join(f"round({f}) / 100 AS {name}_{c}" for name, f, c in _MEASURES)} FROM days GROUP BY ALL)"""
_edged("a14_branch_cycle_summary", lambda c, e: graph.branch_cycle_summary(graph.materialize_branch_lines(c, e, _tips(c))), "SELECT * FROM summary", _TOP + _PHASES + _BUCKETS)


def _lines(f: Callable[..., DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda c, e: f(*graph.branch_lines(c, e, _tips(c)), c, e)


_edged("g4_branch_phases", _lines(lambda lines, members, c, e: graph.branch_phases(lines, members, c)), f"SELECT repo_slug, line_id, merge, departure, {_FIVE} FROM phases", _TOP + _PHASES)
_edged(
    "g5_line_order",
    _lines(lambda lines, members, c, e: graph.line_order(lines, "top").drop("key")),
    """SELECT * EXCLUDE (key, k), (len(k) // 2)::INT AS depth, row_number() OVER (PARTITION BY repo_slug ORDER BY len(k), k) - 1 AS place
    FROM (SELECT *, CASE key WHEN '' THEN [] ELSE string_split(key, '.')::BIGINT[] END AS k FROM lines)""",
    _TOP,
)
_edged(
    "g7_line_nodes",
    _lines(lambda lines, members, c, e: graph.line_nodes(lines, members)),
    """SELECT repo_slug, line_id, 'merge' AS role, -1::BIGINT AS pos, merge AS sha FROM lines WHERE merge IS NOT NULL UNION ALL SELECT repo_slug, line_id, 'commit', pos, sha FROM members
    UNION ALL SELECT repo_slug, line_id, 'departure', commit_count, departure FROM lines WHERE departure IS NOT NULL""",
    _TOP,
)
_edged(
    "g8_commits_until_first_merge",
    lambda c, e: graph.line_commits_until_first_merge(graph.branch_lines(c, e, _tips(c), "reverse")[1], graph.link_children(c, e), "reverse"),
    """SELECT repo_slug, line_id, sha, pos FROM (SELECT m.*, max(pos) FILTER (n > 1) OVER (PARTITION BY line_id) AS cut FROM members m
      LEFT JOIN (SELECT repo_slug, parent_sha AS sha, count(*) AS n FROM edges GROUP BY ALL) USING (repo_slug, sha)) WHERE pos >= coalesce(cut, 0)""",
    _walk_sql("reverse"),
)
_edged(
    "g11_hidden_run_compression",
    _lines(lambda lines, members, c, e: graph.hidden_run_compression(lines, members)),
    """SELECT repo_slug, line_id, sha AS from_sha, to_sha, pos - to_pos - 1 AS hidden FROM (SELECT *, lead(sha) OVER w AS to_sha, lead(pos) OVER w AS to_pos FROM shown WINDOW w AS (PARTITION BY line_id ORDER BY pos DESC)) WHERE to_sha IS NOT NULL
    UNION ALL SELECT l.repo_slug, l.line_id, departure, arg_max(m.sha, m.pos), 0 FROM lines l JOIN members m USING (line_id) WHERE departure IS NOT NULL GROUP BY ALL
    UNION ALL SELECT l.repo_slug, l.line_id, arg_min(m.sha, m.pos), merge, 0 FROM lines l JOIN members m USING (line_id) WHERE merge IS NOT NULL GROUP BY ALL
    UNION ALL SELECT repo_slug, line_id, departure, merge, 0 FROM lines WHERE commit_count = 0 AND merge IS NOT NULL AND departure IS NOT NULL""",
    _TOP + """,
full_lines AS (SELECT * FROM lines WHERE commit_count > 0),
marked AS (SELECT repo_slug, merge AS sha FROM full_lines WHERE merge IS NOT NULL UNION SELECT repo_slug, departure FROM full_lines WHERE departure IS NOT NULL),
shown AS (SELECT m.* FROM members m JOIN full_lines l USING (line_id) WHERE m.pos IN (0, l.commit_count - 1) OR EXISTS (SELECT 1 FROM marked k WHERE k.repo_slug = m.repo_slug AND k.sha = m.sha))""",
)
_edged(
    "o5_longest_branch_lines",
    _lines(lambda lines, members, c, e: graph.longest_branch_lines(lines).drop("key")),
    "SELECT * EXCLUDE (key), commit_count + 2 AS line_size FROM (SELECT *, row_number() OVER (PARTITION BY repo_slug ORDER BY commit_count DESC, line_id)::INT AS rank FROM lines) WHERE rank <= 6",
    _TOP,
)

# builders and readers, through tables and files that Spark makes from the orders
_WEEK = """period_week, CAST(epoch(monday) AS BIGINT) AS week_monday_unix, CAST(epoch(monday) AS BIGINT) + 604800 AS week_end_unix"""


def _log(c: DataFrame) -> DataFrame:
    return c.select("repo_slug", "sha", F.col("author_ref").alias("author_email"), "committed_at", "log_ordinal")


def _messages(c: DataFrame) -> DataFrame:
    return c.select("sha", "subject", "body", F.concat(F.lit("  "), F.col("message"), F.lit("\n")).alias("raw"))


_edged(
    "e1_build_commits_export",
    lambda c, e: export.build_commits_export(_log(c), _messages(c), e),
    f"""SELECT repo_slug, sha, parent_shas, parent_count, committed_at, {_WEEK}, log_ordinal, CAST(NULL AS VARCHAR) AS committer_tz_offset, 'none' AS pii_protection_profile,
      author_ref, CAST(NULL AS VARCHAR) AS author_label_pii, subject_has_keywords, body_has_keywords, nullif(regexp_extract(subject, '^(feat|chore):', 1), '') AS conventional_type,
      CASE WHEN regexp_matches(subject, '^(feat|chore):') THEN 'subject' END AS conventional_type_scope, 3 AS schema_version, CAST(NULL AS VARCHAR) AS tenant_id FROM parented""",
    "," + _PARENTS,
)
_orders(
    "e2_build_lake_commits",
    lambda c: export.build_lake_commits(_log(c), _messages(c)),
    """SELECT sha, author_ref AS author_email, committed_at AS committed_date, repo_slug AS _raw_data_params,
      CASE WHEN body = '' THEN subject ELSE subject || chr(10) || chr(10) || body END AS message, log_ordinal FROM commits""",
)
_orders("e4_week_bounds", lambda c: c.select("repo_slug", "sha", *(v.alias(k) for k, v in t.week_bounds(F.col("committed_at")).items())), f"SELECT repo_slug, sha, {_WEEK} FROM local")
_orders("e5_keyword_flags", lambda c: c.select("repo_slug", "sha", *(v.alias(k) for k, v in s.keyword_flags(F.col("subject"), F.col("body")).items())), "SELECT repo_slug, sha, subject_has_keywords, body_has_keywords FROM commits")
_HMAC_KEY = b"a key for tests"
_pad = lambda x: bytes(b ^ x for b in _HMAC_KEY.ljust(64, b"\0")).hex()
_orders(
    "e6_pseudonymize_authors",
    lambda c: c.select("repo_slug", "author_ref").distinct().select("repo_slug", F.col("author_ref").alias("email"), s.pseudonymize("pseudonym_hmac_strict", _HMAC_KEY, F.lit("t1"), F.col("repo_slug"), F.col("author_ref"), F.lit(None))["author_ref"].alias("author_ref")),
    f"""SELECT repo_slug, author_ref AS email, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || CAST('t:t1|r:' || repo_slug || '|e:' || author_ref AS BLOB)))) AS author_ref
    FROM (SELECT DISTINCT repo_slug, author_ref FROM commits)""",
)
_orders("e7_conventional_type", lambda c: c.select("repo_slug", "sha", s.conventional_type(F.col("subject")).alias("kind")), "SELECT repo_slug, sha, nullif(regexp_extract(subject, '^(feat|chore):', 1), '') AS kind FROM commits")


def _in_path() -> Column:
    """The repository of a partitioned file."""
    return F.regexp_extract("file", "repo_slug=([^/]+)", 1)


def _text_files(rows: DataFrame, order: str) -> str:
    """Writes (repo_slug, line, order) as one ordered text file for each repository."""
    path = graph.new_path(rows.sparkSession)
    rows.repartition("repo_slug").sortWithinPartitions("repo_slug", order).select("repo_slug", "line").write.partitionBy("repo_slug").text(path)
    return path


def _git_log(spark: SparkSession, d: str) -> DataFrame:
    c = views.commits_orders(spark, d)
    line = F.concat_ws("|", F.col("committed_at").cast("string"), "sha", F.lit("tree"), F.lit("p1 p2"), "author_ref", F.concat(F.lit("A|"), "author_ref"))
    path = _text_files(c.select("repo_slug", line.alias("line"), "log_ordinal"), "log_ordinal")
    return readers.read_git_log(spark, path, _in_path()).withColumn("parents", F.size("parents")).drop("tree")


_add(
    "s1_read_git_log",
    _git_log,
    f"WITH {ORDERS_SQL} SELECT repo_slug, sha, 2 AS parents, author_ref AS author_email, 'A|' || author_ref AS author_name, committed_at, log_ordinal FROM commits",
)


def _message_file(spark: SparkSession, d: str) -> DataFrame:
    c = views.commits_orders(spark, d)
    path = graph.new_path(spark)
    c.select(F.concat_ws("\x1f", F.lpad("sha", 40, "0"), "subject", "body", "message").alias("value")).write.option("lineSep", "\0").text(path)
    return readers.read_commit_messages(spark, path)


_add(
    "s2_read_commit_messages",
    _message_file,
    f"WITH {ORDERS_SQL} SELECT lpad(sha, 40, '0') AS sha, subject, body, CASE WHEN body = '' THEN subject ELSE subject || chr(10) || chr(10) || body END AS raw FROM commits",
)


def _edge_file(spark: SparkSession, d: str) -> DataFrame:
    c = views.commits_orders(spark, d)
    rows = graph.with_parents(c, views.edges_orders(c))
    path = _text_files(rows.select("repo_slug", F.concat_ws(" ", "sha", "parent_shas").alias("line"), "log_ordinal"), "log_ordinal")
    return readers.read_parent_edges(spark, path, _in_path())


_add("s3_read_parent_edges", _edge_file, f"WITH {ORDERS_SQL}, {EDGES_SQL} SELECT repo_slug, child_sha, CAST(row_number() OVER (PARTITION BY repo_slug, child_sha ORDER BY parent_ord) - 1 AS INTEGER) AS parent_ord, parent_sha FROM edges")


def _ref_file(spark: SparkSession, d: str) -> DataFrame:
    c = views.commits_orders(spark, d)
    line = F.concat_ws(" ", F.concat(F.lit("t"), F.floor(F.col("log_ordinal") / 3)), F.lit("commit"), F.concat(F.lit("refs/heads/b "), "log_ordinal"))
    return readers.refs_by_tip(readers.read_refs(spark, _text_files(c.select("repo_slug", line.alias("line"), "log_ordinal"), "log_ordinal"), _in_path()))


_add("s4_read_refs", _ref_file, f"WITH {ORDERS_SQL} SELECT repo_slug, 't' || (log_ordinal // 3) AS tip_sha, 'refs/heads/b ' || max(log_ordinal) AS ref_name FROM commits GROUP BY repo_slug, log_ordinal // 3")


def _object_file(spark: SparkSession, d: str) -> DataFrame:
    c = views.commits_orders(spark, d)
    return readers.read_object_ids(spark, _text_files(c.select("repo_slug", F.concat_ws(" ", "author_ref", "sha").alias("line"), "log_ordinal"), "log_ordinal"), _in_path())


_add("s5_read_object_ids", _object_file, f"WITH {ORDERS_SQL} SELECT repo_slug, author_ref AS object_id, min(log_ordinal) AS ordinal FROM commits GROUP BY ALL")


def _config_files(spark: SparkSession, d: str) -> DataFrame:
    """Configurations of 200 customers each; a third of them have one entry without a place, which spoils the file."""
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("part", F.floor(F.col("c_custkey") / 200))
    place = F.when((F.col("part") % 3 != 1) | (F.col("c_custkey") % 200 != 7), F.concat(F.lit("/srv/"), "c_name"))
    entry = F.struct(F.col("c_name").alias("name"), place.alias("path_or_url"), F.when(F.col("c_custkey") % 2 == 0, "main").alias("branch"))
    path = graph.new_path(spark)
    files = c.groupBy("part").agg(F.to_json(F.struct(F.collect_list(entry).alias("repositories"))).alias("value"))
    files.repartition("part").write.partitionBy("part").text(path)
    return readers.read_repo_config(spark, path)


_add(
    "s6_read_repo_config",
    _config_files,
    """SELECT c_name AS name, '/srv/' || c_name AS path_or_url, CASE WHEN c_custkey % 2 = 0 THEN 'main' END AS branch, CAST(NULL AS VARCHAR) AS description
    FROM customer QUALIFY count(*) FILTER (c_custkey // 200 % 3 = 1 AND c_custkey % 200 = 7) OVER (PARTITION BY c_custkey // 200) = 0""",
)


def _export_scan(spark: SparkSession, d: str) -> DataFrame:
    path = graph.new_path(spark)
    views.commits_orders(spark, d).select("repo_slug", "sha", "committed_at").write.partitionBy("repo_slug").parquet(path)
    return readers.read_commits_export(spark, path, "repo1").select("repo_slug", "sha", "committed_at")


_add("s10_commits_export_scan", _export_scan, f"WITH {ORDERS_SQL} SELECT repo_slug, sha, committed_at FROM commits WHERE repo_slug = 'repo1'")
_orders("s11_lake_commits_scan", lambda c: readers.from_lake(export.build_lake_commits(_log(c), _messages(c)), "repo2").drop("message"), "SELECT repo_slug, sha, author_ref, committed_at, log_ordinal FROM commits WHERE repo_slug = 'repo2'")


def _devlake(c: DataFrame, e: DataFrame) -> DataFrame:
    lake = c.select("sha", F.col("author_ref").alias("author_email"), F.timestamp_seconds("committed_at").alias("committed_date"), F.col("repo_slug").alias("_raw_data_params"), "message")
    parents = e.select(F.col("child_sha").alias("commit_sha"), F.col("parent_sha").alias("parent_commit_sha"), "parent_ord")
    refs = _tips(c).select(F.col("repo_slug").alias("repo_id"), F.lit("main").alias("name"), F.col("tip_sha").alias("commit_sha"))
    commits, edges, _ = readers.from_devlake(lake, parents, refs, ["repo0", "repo3"])
    return commits.groupBy("repo_slug").agg(F.count("*").alias("commits"), F.sum("committed_at").alias("seconds")).join(edges.groupBy("repo_slug").agg(F.count("*").alias("edges")), "repo_slug")


def _devlake_cycle(c: DataFrame, e: DataFrame) -> DataFrame:
    """Pairs of commits of a database that has no log order."""
    lake = c.select("sha", F.col("author_ref").alias("author_email"), F.timestamp_seconds("committed_at").alias("committed_date"), F.col("repo_slug").alias("_raw_data_params"), "message")
    parents = e.select(F.col("child_sha").alias("commit_sha"), F.col("parent_sha").alias("parent_commit_sha"), "parent_ord")
    refs = _tips(c).select(F.col("repo_slug").alias("repo_id"), F.lit("main").alias("name"), F.col("tip_sha").alias("commit_sha"))
    return deltas.delta_events(readers.from_devlake(lake, parents, refs)[0]).drop("log_ordinal")


_edged(
    "s12_devlake_cycle",
    _devlake_cycle,
    """SELECT repo_slug, author_ref, committed_at, sha AS child_sha, prev_sha, round((committed_at - before) / 60.0, 2)::DOUBLE AS cycle_minutes FROM (
      SELECT *, lag(committed_at) OVER w AS before, lag(sha) OVER w AS prev_sha FROM local WINDOW w AS (PARTITION BY repo_slug, author_ref ORDER BY committed_at, sha)) WHERE before IS NOT NULL""",
)
_edged("s12_from_devlake", _devlake, "SELECT c.*, (SELECT count(*) FROM edges e WHERE e.repo_slug = c.repo_slug) AS edges FROM (SELECT repo_slug, count(*) AS commits, CAST(sum(committed_at) AS BIGINT) AS seconds FROM commits WHERE repo_slug IN ('repo0', 'repo3') GROUP BY ALL) c")
_orders("s13_first_repo_id", readers.first_repo_id, "SELECT min(repo_slug) AS repo_slug FROM commits")
_orders("s14_list_repo_ids", readers.list_repo_ids, "SELECT DISTINCT repo_slug FROM commits")


def _interchange(c: DataFrame, e: DataFrame) -> DataFrame:
    """Commits and edges in which each rule is broken by the orders of one remainder of their numbers; the column of the type's scope is absent from a second table."""
    k = F.col("o_orderkey") % 1000
    at = lambda n, bad, name: F.when(k == n, bad).otherwise(F.col(name)).alias(name)
    whole = export.build_commits_export(_log(c), _messages(c), e).join(c.select("repo_slug", "sha", "o_orderkey"), ["repo_slug", "sha"])
    broken = {
        "parent_shas": F.when(k.isin(1, 2), F.concat(F.lit("other"), F.lit(" x").cast("string"))).otherwise(F.col("parent_shas")),
        "parent_count": F.when(k == 3, -1).otherwise(F.col("parent_count")), "author_ref": F.when(k != 4, F.col("author_ref")), "subject_has_keywords": F.when(k == 5, 2).otherwise(F.col("subject_has_keywords")),
        "body_has_keywords": F.when(k == 6, -1).otherwise(F.col("body_has_keywords")), "pii_protection_profile": F.when(k == 7, "plain").otherwise(F.col("pii_protection_profile")),
        "conventional_type_scope": F.when(k == 32, "title").when(k != 33, F.col("conventional_type_scope")), "conventional_type": F.when(k == 32, "feat").otherwise(F.col("conventional_type")),
    }
    times = lambda once, twice: F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).when(once, F.array(F.lit(1))))
    commits = stored(whole.withColumns(broken).withColumn("_time", times(k != 34, k == 35)).drop("o_orderkey", "_time"))
    keyed = e.join(c.select("repo_slug", F.col("sha").alias("child_sha"), "o_orderkey"), ["repo_slug", "child_sha"])
    edges = keyed.select("repo_slug", "child_sha", "parent_sha", F.when(k == 36, F.col("parent_ord") + 5).otherwise(F.col("parent_ord")).alias("parent_ord"), "o_orderkey")
    swapped = edges.withColumn("parent_ord", F.when(k.isin(65, 95), F.lit(1) - F.col("parent_ord")).otherwise(F.col("parent_ord")))
    edges = swapped.withColumn("_time", times(F.lit(True), k == 37)).drop("o_orderkey", "_time")
    found = reconcile.validate_interchange(commits, edges)
    absent = reconcile.validate_interchange(commits.drop("conventional_type_scope", "log_ordinal").limit(0), edges.limit(0))
    return found.unionAll(absent).groupBy("rule", "repo_slug").agg(F.count("*").alias("violations"), F.min("sha").alias("first"))


_RULES = """,
keyed AS (SELECT p.*, o_orderkey % 1000 AS k, nullif(regexp_extract(subject, '^(feat|chore):', 1), '') AS kind FROM parented p),
sent AS (SELECT e.repo_slug, e.child_sha AS sha, e.parent_sha, CASE WHEN k = 36 THEN parent_ord + 5 WHEN k IN (65, 95) THEN 1 - parent_ord ELSE parent_ord END AS parent_ord, k FROM edges e JOIN keyed c ON c.repo_slug = e.repo_slug AND c.sha = e.child_sha),
sent_twice AS (SELECT * FROM sent UNION ALL SELECT * FROM sent WHERE k = 37),
exported AS (
  SELECT repo_slug, sha, k, CASE WHEN k IN (1, 2) THEN 'other x' ELSE parent_shas END AS parent_shas, CASE WHEN k = 3 THEN -1 ELSE parent_count END AS parent_count, CASE WHEN k = 32 THEN 'feat' ELSE kind END AS kind,
    CASE WHEN k = 32 THEN 'title' WHEN k <> 33 AND kind IS NOT NULL THEN 'subject' END AS scope
  FROM keyed WHERE k <> 34 UNION ALL BY NAME SELECT repo_slug, sha, k, parent_shas, parent_count, kind, CASE WHEN kind IS NOT NULL THEN 'subject' END AS scope FROM keyed WHERE k = 35
),
per AS (SELECT repo_slug, sha, count(*) AS n, min(parent_ord) AS lo, max(parent_ord) AS hi, string_agg(parent_ord || ':' || parent_sha, ' ' ORDER BY parent_ord, parent_sha) AS listed FROM sent_twice GROUP BY ALL),
told AS (SELECT x.*, coalesce(p.n, 0) AS n, coalesce(p.listed, '') AS listed,
  coalesce(array_to_string(list_transform(list_filter(string_split(x.parent_shas, ' '), lambda y: y <> ''), lambda y, i: (i - 1) || ':' || y), ' '), '') AS wanted FROM exported x LEFT JOIN per p USING (repo_slug, sha)),
violations AS (
  SELECT 'parent_count >= 0' AS rule, repo_slug, sha FROM exported WHERE k = 3
  UNION ALL SELECT 'not null: author_ref', repo_slug, sha FROM exported WHERE k = 4
  UNION ALL SELECT '0 or 1: subject_has_keywords', repo_slug, sha FROM exported WHERE k = 5
  UNION ALL SELECT '0 or 1: body_has_keywords', repo_slug, sha FROM exported WHERE k = 6
  UNION ALL SELECT 'known profile', repo_slug, sha FROM exported WHERE k = 7
  UNION ALL SELECT 'known scope', repo_slug, sha FROM exported WHERE scope = 'title'
  UNION ALL SELECT 'type and scope together', repo_slug, sha FROM exported WHERE (kind IS NULL) <> (scope IS NULL)
  UNION ALL SELECT 'unique commit', repo_slug, sha FROM exported GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT 'unique edge', repo_slug, sha FROM sent_twice GROUP BY repo_slug, sha, parent_ord HAVING count(*) > 1
  UNION ALL SELECT 'parents in order from 0', repo_slug, sha FROM per WHERE lo <> 0 OR hi <> n - 1
  UNION ALL SELECT 'edge of a known commit', repo_slug, sha FROM per ANTI JOIN exported USING (repo_slug, sha)
  UNION ALL SELECT 'edges match parent_count', repo_slug, sha FROM told WHERE n <> parent_count
  UNION ALL SELECT 'edges match parent_shas', repo_slug, sha FROM told WHERE listed <> wanted
  UNION ALL SELECT 'column: ' || c, NULL, NULL FROM (VALUES ('conventional_type_scope'), ('log_ordinal')) v(c)
)"""
_edged("r13_validate_interchange", _interchange, "SELECT rule, repo_slug, count(*) AS violations, min(sha) AS first FROM violations GROUP BY ALL", "," + _PARENTS + _RULES)

# shas, names and labels
_SHAS = "shas AS (SELECT repo_slug, md5(sha) AS sha, log_ordinal FROM commits)"
_shas = lambda c: c.select("repo_slug", F.md5("sha").alias("sha"), "log_ordinal")
_orders(
    "f15_short_sha",
    lambda c: export.short_sha(_shas(c)),
    """SELECT repo_slug, sha, CAST(min(k) AS INTEGER) AS length FROM (
      SELECT repo_slug, sha, k, count(*) OVER (PARTITION BY repo_slug, k, sha[:k]) AS same FROM shas, range(4, 33) r(k)) WHERE same = 1 GROUP BY ALL""",
    ", " + _SHAS,
)
_orders(
    "j10_resolve_sha_prefix",
    lambda c: export.resolve_sha_prefix(_shas(c).select("repo_slug", F.left("sha", F.lit(4)).alias("prefix")).distinct(), _shas(c).select("repo_slug", F.col("sha").alias("object_id"), F.col("log_ordinal").alias("ordinal"))),
    "SELECT repo_slug, sha[:4] AS prefix, arg_min(sha, log_ordinal) AS object_id FROM shas GROUP BY ALL",
    ", " + _SHAS,
)
_any_prefix = lambda c: _shas(c).select("repo_slug", F.explode(F.array(*(F.left("sha", F.lit(n)) for n in (1, 2, 3, 5, 32)), F.concat(F.lit("x"), F.left("sha", F.lit(2))), F.concat("sha", F.lit("0")))).alias("prefix")).distinct()
_orders(
    "j10_resolve_any_prefix",
    lambda c: export.resolve_sha_prefix(_any_prefix(c), _shas(c).select("repo_slug", F.col("sha").alias("object_id"), F.col("log_ordinal").alias("ordinal"))),
    """SELECT p.repo_slug, p.prefix, h.object_id FROM (SELECT DISTINCT repo_slug, unnest([sha[:1], sha[:2], sha[:3], sha[:5], sha, 'x' || sha[:2], sha || '0']) AS prefix FROM shas) p
    LEFT JOIN (SELECT repo_slug, sha[:n] AS prefix, arg_min(sha, log_ordinal) AS object_id FROM shas, (VALUES (1), (2), (3), (5), (32)) v(n) GROUP BY ALL) h USING (repo_slug, prefix)""",
    ", " + _SHAS,
)
_add(
    "f13_repo_names",
    lambda spark, d: spark.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", *(f(F.concat(F.when(F.col("c_custkey") % 2 == 0, "https://host/team/").otherwise("/srv/"), "c_name", F.when(F.col("c_custkey") % 3 == 0, ".git").otherwise(""))).alias(n) for f, n in ((s.repo_name_from_url, "name"), (s.is_remote, "remote")))
    ).withColumn("repo_id", s.repo_id(F.col("name"))),
    "SELECT c_custkey, c_name AS name, c_custkey % 2 = 0 AS remote, 'local:' || c_name AS repo_id FROM customer",
)
_orders(
    "f7_week_labels",
    lambda c: c.select(t.period_week(t.to_local(F.col("committed_at"))).alias("week")).distinct().select("week", F.date_format(t.week_label_to_monday(F.col("week")), "yyyy-MM-dd").alias("monday"), t.week_tick(F.col("week")).alias("tick")),
    "SELECT DISTINCT period_week AS week, strftime(monday, '%Y-%m-%d') AS monday, strftime(monday, '%m/%d') AS tick FROM local",
)
_orders(
    "f8_normalize_date",
    lambda c: c.select("sha", t.normalize_date(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.year(t.to_local(F.col("committed_at"))), F.lit("-"), F.month(t.to_local(F.col("committed_at"))))).when(F.col("o_orderkey") % 3 == 1, F.date_format(t.to_local(F.col("committed_at")), "EEE MMM dd HH:mm:ss yyyy")).otherwise(F.concat(F.lit("x"), "sha"))).alias("month")),
    "SELECT sha, CASE WHEN o_orderkey % 3 = 2 THEN 'x' || sha ELSE period_month END AS month FROM local",
)
_orders("f6_month_start_unix", lambda c: c.select("sha", t.month_start_unix(F.col("committed_at")).alias("start")), "SELECT sha, CAST(epoch(date_trunc('month', local.at)) AS BIGINT) AS start FROM local")
_orders("f3_local_days_shift", lambda c: c.select("sha", t.local_days_shift(F.col("committed_at"), -28).alias("shifted")), "SELECT sha, committed_at - 2419200 AS shifted FROM local")
_orders("f16_branch_line_id", lambda c: c.select("sha", s.branch_line_id("top", F.lit(None), F.col("sha")).alias("id")), "SELECT sha, sha256('top' || chr(10) || chr(10) || sha) AS id FROM commits")
_orders("f17_cohort_id", lambda c: c.agg(s.cohort_id(F.col("repo_slug")).alias("cohort_id")), "SELECT sha256(string_agg(repo_slug, chr(10) ORDER BY repo_slug))[:24] AS cohort_id FROM (SELECT DISTINCT repo_slug FROM commits)")
_orders("f19_commit_type", lambda c: c.select("sha", s.commit_type(F.split("body", " ")).alias("kind")), "SELECT sha, CASE WHEN body = '' THEN '<' ELSE '<<' END AS kind FROM commits")
_orders("w2_rank_in_period", lambda c: series.period_ranks(metrics.throughput_monthly(c).withColumn("v", F.col("commit_count") * 1000 + F.month(F.concat("period_month", F.lit("-01")))), ["repo_slug", F.left("period_month", F.lit(4))], "v").drop("v"),
    """SELECT repo_slug, period_month, commit_count, unique_authors, CAST(row_number() OVER (PARTITION BY repo_slug, period_month[:4] ORDER BY commit_count, period_month) AS INTEGER) AS rank_in_period
    FROM (SELECT repo_slug, period_month, count(*) AS commit_count, count(DISTINCT author_ref) AS unique_authors FROM local GROUP BY ALL)""")

_orders("w2_rank_with_ties", lambda c: series.period_ranks(metrics.throughput_monthly(c), [F.left("period_month", F.lit(4))], "unique_authors"),
    """SELECT *, CAST(row_number() OVER (PARTITION BY period_month[:4] ORDER BY unique_authors, commit_count, period_month, repo_slug) AS INTEGER) AS rank_in_period
    FROM (SELECT repo_slug, period_month, count(*) AS commit_count, count(DISTINCT author_ref) AS unique_authors FROM local GROUP BY ALL)""")

# roll-ups
_MONTHLY = f"cycle AS (SELECT repo_slug, period_month, {_STATS} FROM deltas GROUP BY ALL HAVING count(*) >= 2)"
_near = lambda df, *names: df.withColumns({n: F.round(n, 6) for n in names})
_orders("r3_aggregate_cycle_time", lambda c: _near(rollup.aggregate_cycle_time(deltas.cycle_stats_by_month(c)), *rollup.CYCLE),
    "SELECT period_month, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in rollup.CYCLE) + " FROM cycle GROUP BY ALL", f", {DELTAS_SQL}, {_MONTHLY}")
_orders("r4_aggregate_failure_rate", lambda c: _near(rollup.aggregate_failure_rate(metrics.change_failure_monthly(c)), "failure_rate"), f"SELECT period_month, round(avg(failure_rate), 6) AS failure_rate FROM ({_EITHER}) GROUP BY ALL")
_orders("r5_aggregate_active_developers", lambda c: rollup.aggregate_active_developers(metrics.authors_by_month(c)), "SELECT period_month, count(DISTINCT author_ref) AS unique_authors FROM local GROUP BY ALL")
_orders("r6_aggregate_throughput", lambda c: rollup.aggregate_throughput(metrics.throughput_monthly(c)), "SELECT period_month, count(*) AS commit_count FROM local GROUP BY ALL")
_COMBINED = """SELECT period_week, commit_count, active_authors, commit_count / active_authors AS commits_per_author FROM (SELECT period_week, count(*) AS commit_count FROM local GROUP BY ALL)
  JOIN (SELECT period_week, count(DISTINCT author_ref) AS active_authors FROM window_authors GROUP BY ALL) USING (period_week)"""
_events("r7_aggregate_throughput_per_active_dev", lambda c: series.tpad_weekly_combined(c, WEEKS_BACK), _COMBINED, "," + _WINDOW)
_events("v6_active_devs_weekly_combined", lambda c: series.active_devs_weekly_combined(c, WEEKS_BACK), f"SELECT period_week, active_authors, commit_count FROM ({_COMBINED})", "," + _WINDOW)
_long = lambda name, key, value, source: f"SELECT '{name}' AS metric_name, {key} AS period_key, round({value}, 6)::DOUBLE AS value_real FROM ({source})"
_events(
    "r8_cohort_rows",
    lambda c: _near(rollup.cohort_rows_of(c, WEEKS_BACK), "value_real").drop("value_json"),
    "SELECT 'default' AS batch_id, 'all' AS cohort_id, * FROM ("
    + " UNION ALL ".join(
        [
            *(_long(name, "period_month", k, f"SELECT period_month, avg({k}) AS {k} FROM cycle GROUP BY ALL") for k, name in rollup.CYCLE.items()),
            _long(rollup.FAILURE, "period_month", "r", f"SELECT period_month, avg(failure_rate) AS r FROM ({_EITHER}) GROUP BY ALL"),
            _long(rollup.AUTHORS, "period_month", "n", "SELECT period_month, count(DISTINCT author_ref) AS n FROM local GROUP BY ALL"),
            _long(rollup.THROUGHPUT, "period_month", "n", "SELECT period_month, count(*) AS n FROM local GROUP BY ALL"),
            _long(rollup.PER_ACTIVE_DEV, "period_week", "commits_per_author", _COMBINED),
        ]
    )
    + ")",
    f", {DELTAS_SQL}, {_MONTHLY}, {_WINDOW}",
)
_SUMMARY = """SELECT repo_slug, count(*) AS n, count(DISTINCT author_ref) AS k, min(local.at) AS lo, max(local.at) AS hi FROM local GROUP BY ALL"""
_orders(
    "r9_summary_report",
    rollup.summary_report,
    f"""SELECT count(*) AS repositories, CAST(sum(n) AS BIGINT) AS total_commits, (SELECT count(DISTINCT author_ref) FROM commits) AS unique_authors, strftime(min(lo), '%Y-%m-%dT%H:%M:%S') AS first_commit,
      strftime(max(hi), '%Y-%m-%dT%H:%M:%S') AS last_commit, avg(n) AS commits_per_repo, avg(k) AS authors_per_repo FROM ({_SUMMARY})""",
)
_orders(
    "r10_reconcile",
    lambda c: reconcile.reconcile_metric("change_failure_monthly", stored(metrics.change_failure_monthly(c)), stored(metrics.change_failure_monthly(c.filter("o_orderkey % 50 > 0"), s.SQUASH)), ["repo_slug", "period_month"]).groupBy("repo_slug", "problem", "column").agg(F.count("*").alias("n")),
    """SELECT repo_slug, d.p AS problem, d.c AS "column", count(*) AS n FROM (
      SELECT coalesce(a.repo_slug, b.repo_slug) AS repo_slug, unnest(CASE WHEN b.repo_slug IS NULL THEN [{'p': 'only left', 'c': NULL}] WHEN a.repo_slug IS NULL THEN [{'p': 'only right', 'c': NULL}] ELSE list_filter([
        CASE WHEN a.total_commits <> b.total_commits THEN {'p': 'value mismatch', 'c': 'total_commits'} END, CASE WHEN a.fix_like_commits <> b.fix_like_commits THEN {'p': 'value mismatch', 'c': 'fix_like_commits'} END,
        CASE WHEN abs(a.failure_rate - b.failure_rate) > 0.05 THEN {'p': 'value mismatch', 'c': 'failure_rate'} END], lambda x: x IS NOT NULL) END) AS d
      FROM (""" + _EITHER + ") a FULL JOIN (" + _FAILURE.format("subject_has_keywords = 1").replace("FROM local", "FROM local WHERE o_orderkey % 50 > 0") + ") b USING (repo_slug, period_month)) GROUP BY ALL",
)
_events("r11_audit_line", lambda c: reconcile.audit_line(metrics.with_month(c), "period_month", "author_ref"), "SELECT count(*) AS row_count, min(period_month) AS first_period, max(period_month) AS last_period, count(DISTINCT author_ref) AS authors FROM local")
#: Key and value of each metric's rows.
_SHOWN = {
    "cycle_time_monthly": ("period_month", "p75_minutes"), "cycle_time_delta_events": ("child_sha", "cycle_minutes"), "change_failure_monthly": ("period_month", "failure_rate"),
    "throughput_monthly": ("period_month", "commit_count"), "active_developers_monthly": ("period_month", "unique_authors"), "active_developers_weekly": ("period_week", "active_developers"),
    "throughput_per_active_developer_weekly": ("period_week", "commits_per_author"), "throughput_per_active_developer_monthly": ("period_month", "commits_per_author"), "author_commit_percentiles": ("author_ref", "percentile"),
}


def _long_rows(found: dict[str, DataFrame]) -> DataFrame:
    """All rows of all metrics: metric, repo_slug, key, value."""
    parts = [df.select(F.lit(n).alias("metric"), "repo_slug", F.col(_SHOWN[n][0]).alias("key"), F.round(F.col(_SHOWN[n][1]).cast("double"), 6).alias("value")) for n, df in found.items()]
    return reduce(DataFrame.unionAll, parts)


_rows = lambda name, source: f"SELECT '{name}' AS metric, repo_slug, {_SHOWN[name][0]} AS key, round({_SHOWN[name][1]}::DOUBLE, 6) AS value FROM ({source})"
_body = lambda name, start: _sql[name][_sql[name].index(start) :]
_orders(
    "r12_run_metrics",
    lambda c: _long_rows(registry.run_metrics(c, weeks_back=WEEKS_BACK)),
    " UNION ALL ".join([
        _rows("cycle_time_monthly", "SELECT * FROM cycle"), _rows("cycle_time_delta_events", "SELECT * FROM deltas"), _rows("change_failure_monthly", _EITHER),
        _rows("throughput_monthly", f"SELECT repo_slug, period_month, {_COUNTS} FROM local GROUP BY ALL"), _rows("active_developers_monthly", f"SELECT repo_slug, period_month, {_COUNTS} FROM local GROUP BY ALL"),
        _rows("active_developers_weekly", "SELECT repo_slug, period_week, count(*) AS active_developers FROM window_authors GROUP BY ALL"),
        _rows("throughput_per_active_developer_weekly", _body("a7_throughput_per_active_dev_weekly", "SELECT l.repo_slug")), _rows("throughput_per_active_developer_monthly", _body("a8_throughput_per_active_dev_monthly", "SELECT l.repo_slug")),
        _rows("author_commit_percentiles", _body("w4_author_commit_percentiles", "SELECT *, cume_dist()")),
    ]),
    f", {DELTAS_SQL}, {_MONTHLY}, {_WINDOW}",
)

# series
_TREND = "regr_slope({v}, x) OVER w AS slope, regr_intercept({v}, x) OVER w AS cut, max(x) OVER w AS last"
_trended = lambda v, source: f"""SELECT * EXCLUDE (x, slope, cut, last), round(cut + slope * x, 6) AS trend, round(cut + slope * last, 6) AS trend_end FROM (
  SELECT *, {_TREND.format(v=v)} FROM (SELECT *, row_number() OVER (PARTITION BY repo_slug ORDER BY period_month) - 1 AS x FROM ({source})) WINDOW w AS (PARTITION BY repo_slug))"""  # noqa: E731
_orders("v1_cycle_time_series", lambda c: _near(series.cycle_time_series(c), "trend", "trend_end"),
    _trended("p75_days", "SELECT repo_slug, period_month, p75_minutes / 1440 AS p75_days, std_minutes / 1440 AS std_days, p75_minutes / 1440 - std_minutes / 1440 AS band_low, p75_minutes / 1440 + std_minutes / 1440 AS band_high FROM cycle"), f", {DELTAS_SQL}, {_MONTHLY}")
_orders("v2_failure_rate_series", lambda c: _near(series.failure_rate_series(c), "trend", "trend_end"), _trended("failure_rate", f"SELECT repo_slug, period_month, failure_rate, failure_rate > 10 AS above_10pct FROM ({_EITHER})"))
_orders("v3_active_dev_series", series.active_dev_series, "SELECT period_month, repo_slug, count(DISTINCT author_ref) AS value FROM local GROUP BY ALL")
_orders("v3_throughput_series", series.throughput_series, "SELECT period_month, repo_slug, count(*) AS value FROM local GROUP BY ALL")
_PER_DEV = "SELECT strftime(l.monday, '%Y-%m-%d') AS week_monday, l.repo_slug, count(*) / count(DISTINCT author_ref) AS value FROM local l GROUP BY ALL"
_events("v4_tpad_weekly_series", lambda c: series.tpad_weekly_series(c, WEEKS_BACK), _PER_DEV)
_events("v5_tpad_stacked_matrix", lambda c: _near(series.tpad_stacked_matrix(c, WEEKS_BACK), "total", "base"),
    f"""SELECT w.week_monday, r.repo_slug, coalesce(p.value, 0) AS value, round(sum(coalesce(p.value, 0)) OVER (PARTITION BY w.week_monday), 6) AS total,
      round(coalesce(sum(coalesce(p.value, 0)) OVER (PARTITION BY w.week_monday ORDER BY r.repo_slug ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS base
    FROM (SELECT DISTINCT week_monday FROM per_dev) w CROSS JOIN (SELECT DISTINCT repo_slug FROM per_dev) r LEFT JOIN per_dev p USING (week_monday, repo_slug)""", f", per_dev AS ({_PER_DEV})")
_events("v7_active_devs_weekly_comparison", lambda c: series.active_devs_weekly_comparison(c, WEEKS_BACK),
    """SELECT strftime(w.monday, '%Y-%m-%d') AS week_monday, w.repo_slug, (SELECT count(*) FROM window_authors a WHERE a.repo_slug = w.repo_slug AND a.period_week = w.period_week) AS value FROM weeks w""", "," + _WINDOW)
_orders("v8_repository_summary", lambda c: _near(series.repository_summary(c), "avg_p75_days", "avg_failure_rate"),
    f"""SELECT repo_slug, n AS total_commits, k AS unique_authors, round((SELECT avg(p75_minutes) FROM cycle c WHERE c.repo_slug = s.repo_slug) / 1440, 6) AS avg_p75_days,
      round((SELECT avg(failure_rate) FROM ({_EITHER}) f WHERE f.repo_slug = s.repo_slug), 6) AS avg_failure_rate FROM ({_SUMMARY}) s""", f", {DELTAS_SQL}, {_MONTHLY}")


def _categories(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM").alias("Month"), "o_orderstatus")
    wide = o.groupBy("Month").agg(*(F.count_if(F.col("o_orderstatus") == k).alias(k) for k in "FOP"), F.count("*").alias("Total"))
    return series.work_category_stack(wide)


_add("v9_work_category_stack", _categories, """WITH n AS (SELECT strftime(o_orderdate, '%Y-%m') AS "Month", k AS category, count(*) FILTER (o_orderstatus = k)::DOUBLE AS value FROM orders, (VALUES ('F'), ('O'), ('P')) v(k) GROUP BY ALL)
  SELECT *, coalesce(sum(value) OVER (PARTITION BY "Month" ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n""")


def _sprints(spark: SparkSession, d: str) -> DataFrame:
    e = views.commits_events(spark, d)
    weeks = metrics.with_week(e).groupBy(F.col("period_week").alias("Week")).agg(F.count("*").cast("double").alias("Committed"), F.count_if(F.col("log_ordinal") % 5 > 0).cast("double").alias("Completed"))
    return series.sprint_completion_series(weeks.withColumn("Percentage Completed", F.round(F.col("Completed") / F.col("Committed") * 100, 3)))


_add("v10_sprint_completion_series", _sprints, f"""WITH {EVENTS_SQL} SELECT *, "Percentage Completed" < 80 AS below_target FROM (SELECT *, round("Completed" / "Committed" * 100, 3) AS "Percentage Completed" FROM (
  SELECT period_week AS "Week", count(*)::DOUBLE AS "Committed", count(*) FILTER (log_ordinal % 5 > 0)::DOUBLE AS "Completed" FROM local GROUP BY ALL))""")
_events("v11_commit_trend_rows", series.commit_trend_rows, "SELECT week AS date, commits, author_ref AS author, repo_slug FROM runs", "," + _RUNS)


# writers, read back
#: Names that paths would have to escape.
_ODD_NAMES = {"repo0": "c++", "repo1": "é", "repo2": "a,b", "repo3": "x:y/z"}


def _metric_table(c: DataFrame) -> DataFrame:
    """A second snapshot replaces the first, one without rows empties it, and others stay."""
    spark, path = c.sparkSession, graph.new_path(c.sparkSession)
    odd = F.create_map(*(F.lit(x) for pair in _ODD_NAMES.items() for x in pair))
    found = sinks.with_lineage(deltas.cycle_stats_by_month(c), "all", AS_OF).withColumn("repo_slug", odd[F.col("repo_slug")])
    sinks.write_metric_table(found.withColumn("sample_count", F.lit(-1).cast("long")).unionByName(found.withColumn("dataset_id", F.lit("old"))), path)
    sinks.write_metric_table(found.filter("repo_slug != 'é'"), path, [("é", "all"), *((n, "old") for n in _ODD_NAMES.values() if n != "a,b")])
    return read_rows(spark, path).select("repo_slug", "dataset_id", "period_month", "sample_count", "sum_minutes", "p75_minutes", "computed_at")


def _replaced_export(c: DataFrame, e: DataFrame) -> DataFrame:
    """Interchange rows of all repositories; then one is written again with fewer, and one is emptied."""
    path = graph.new_path(c.sparkSession)
    rows = export.build_commits_export(_log(c), _messages(c), e)
    sinks.write_commits_export(rows, path)
    sinks.write_commits_export(rows.filter("repo_slug = 'repo1' and log_ordinal % 2 = 0"), path, ["repo2"])
    return read_rows(c.sparkSession, path).select("repo_slug", "sha", "parent_shas", "committed_at", "log_ordinal")


_edged("e1_replace_repository", _replaced_export, "SELECT repo_slug, sha, parent_shas, committed_at, log_ordinal FROM parented WHERE repo_slug IN ('repo0', 'repo3') OR repo_slug = 'repo1' AND log_ordinal % 2 = 0", "," + _PARENTS)
_orders(
    "k1_write_metric_table",
    _metric_table,
    f"""SELECT n.name AS repo_slug, d AS dataset_id, period_month, sample_count, sum_minutes, p75_minutes, {AS_OF}::BIGINT AS computed_at
    FROM cycle JOIN (VALUES {", ".join(str(x) for x in _ODD_NAMES.items())}) n(repo_slug, name) USING (repo_slug), (VALUES ('all'), ('old')) v(d) WHERE CASE d WHEN 'all' THEN n.name <> 'é' ELSE n.name = 'a,b' END""",
    f", {DELTAS_SQL}, {_MONTHLY}",
)


def _csv_back(write: Callable[[DataFrame, str], None], schema: str) -> Callable[[DataFrame], DataFrame]:
    def query(df: DataFrame) -> DataFrame:
        path = graph.new_path(df.sparkSession)
        write(df, path)
        return df.sparkSession.read.csv(path, header=True, schema=f"{schema}, repo_slug string")

    return query


_orders("k3_write_cycle_csv", lambda c: _csv_back(sinks.write_cycle_csv, "`INTERVAL START` string, SUM double, AVERAGE double, `p75 CYCLE TIME (minutes)` long, `std CYCLE TIME` long")(deltas.cycle_stats_by_month(c)).withColumn("AVERAGE", F.round("AVERAGE", 1)),
    """SELECT repo_slug, period_month AS "INTERVAL START", sum_minutes AS "SUM", round(round(avg_minutes, 2), 1) AS "AVERAGE", p75_minutes AS "p75 CYCLE TIME (minutes)", std_minutes AS "std CYCLE TIME" FROM cycle""", f", {DELTAS_SQL}, {_MONTHLY}")
_orders("k4_write_failure_csv", lambda c: _csv_back(sinks.write_failure_csv, "Month string, `Change Failure Rate (%)` double")(metrics.change_failure_monthly(c)),
    f"""SELECT repo_slug, period_month AS "Month", failure_rate AS "Change Failure Rate (%)" FROM ({_EITHER})""")
_orders("k5_write_authors_csv", lambda c: _csv_back(sinks.write_authors_csv, "Month string, `Unique Authors` long")(metrics.active_developers_monthly(c)),
    """SELECT repo_slug, period_month AS "Month", count(DISTINCT author_ref) AS "Unique Authors" FROM local GROUP BY ALL""")


def _canonical_back(df: DataFrame) -> DataFrame:
    path = graph.new_path(df.sparkSession)
    sinks.write_canonical_csv(df, path)
    return df.sparkSession.read.csv(path, header=True, schema="repo_slug string, period_month string, sample_count long, sum_minutes double, avg_minutes double, p75_minutes long, std_minutes long", enforceSchema=False)


_orders("k10_write_canonical_csv", lambda c: _canonical_back(deltas.cycle_stats_by_month(c)),
    "SELECT repo_slug, period_month, sample_count, sum_minutes, avg_minutes, p75_minutes, std_minutes FROM cycle", f", {DELTAS_SQL}, {_MONTHLY}")


def _aggregate_back(c: DataFrame) -> DataFrame:
    path = graph.new_path(c.sparkSession)
    rows = stored(rollup.cohort_rows_of(c, WEEKS_BACK))
    for batch in ("b1", "default", "default"):  # a batch that is written again replaces itself
        sinks.write_multi_repo_aggregate(rows.withColumn("batch_id", F.lit(batch)), path)
    found = sinks.read_multi_repo_aggregate(read_rows(c.sparkSession, path), "default", "all")
    return _near(found, "value_real").select("batch_id", "cohort_id", "metric_name", "period_key", "value_real")


_events("k2_write_multi_repo_aggregate", _aggregate_back)
_sql["k2_write_multi_repo_aggregate"] = _sql["r8_cohort_rows"]
_orders("k6_write_throughput_csv", lambda c: _csv_back(sinks.write_throughput_csv, "Month string, `Commits Per Unique Developer` double")(metrics.throughput_rate_monthly(c)).withColumn("Commits Per Unique Developer", F.round("Commits Per Unique Developer", 1)),
    """SELECT repo_slug, period_month AS "Month", round(round(count(*) / count(DISTINCT author_ref), 2), 1) AS "Commits Per Unique Developer" FROM local GROUP BY ALL""")


def _saved_series(c: DataFrame) -> DataFrame:
    folder = graph.new_path(c.sparkSession)
    sinks.save_metrics_csv(deltas.cycle_stats_by_month(c), metrics.change_failure_monthly(c), folder, "x_")
    cycle, failure = readers.read_metrics_csv(c.sparkSession, folder, "x_")
    return failure.join(cycle.drop("Average"), ["repo_slug", "Month"], "left")


_orders("k7_save_metrics_csv", _saved_series,
    f"""SELECT repo_slug, period_month AS "Month", failure_rate AS "Rate", sum_minutes AS "Sum", p75_minutes::DOUBLE AS p75, std_minutes::DOUBLE AS std
    FROM ({_EITHER}) f LEFT JOIN cycle USING (repo_slug, period_month)""", f", {DELTAS_SQL}, {_MONTHLY}")


def _saved_runs(c: DataFrame, part: str, schema: str) -> DataFrame:
    folder = graph.new_path(c.sparkSession)
    sinks.save_author_runs(metrics.commit_runs(c), metrics.author_commit_percentiles(c), folder)
    return c.sparkSession.read.csv(f"{folder}/{part}", header=True, schema=f"{schema}, repo_slug string")


_events("k8_save_author_runs", lambda c: _saved_runs(c, "authors", "Author string, Date string, Commits long"), """SELECT repo_slug, author_ref AS "Author", week AS "Date", commits AS "Commits" FROM runs""", "," + _RUNS)
_events("k8_save_author_percentiles", lambda c: _near(_saved_runs(c, "percentiles", "Author string, Percentile double"), "Percentile"),
    """SELECT repo_slug, author_ref AS "Author", round(cume_dist() OVER (PARTITION BY repo_slug ORDER BY n) * 100, 6) AS "Percentile" FROM (SELECT repo_slug, author_ref, count(*) AS n FROM commits GROUP BY ALL)""")


def _categories_file(spark: SparkSession, d: str) -> DataFrame:
    folder = graph.new_path(spark)
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM").alias("Month"), "o_orderstatus")
    wide = o.groupBy("Month").agg(*(F.count_if(F.col("o_orderstatus") == k).alias(k) for k in "FOP"), F.count("*").alias("Total"))
    wide.write.csv(folder, header=True)
    return series.work_category_stack(readers.read_work_categories(spark, folder).withColumn("Month", F.date_format("Month", "yyyy-MM")))


_add("s9_read_work_categories", _categories_file, _sql["v9_work_category_stack"])


def _saved_aggregates(c: DataFrame) -> DataFrame:
    """All five aggregates, written and read back as long rows."""
    folder = graph.new_path(c.sparkSession)
    m = rollup.repo_metrics(c, WEEKS_BACK)
    weekly = rollup.aggregate_throughput_per_active_dev(m["throughput_per_active_dev"], m["window_authors"])
    parts = {
        "throughput": (rollup.aggregate_throughput(m["throughput"]), "commit_count long"),
        "failure": (rollup.aggregate_failure_rate(m["change_failure"]), "failure_rate double"),
        "cycle": (rollup.aggregate_cycle_time(m["cycle_time"]).select("period_month", "p75_minutes"), "p75_minutes double"),
        "developers": (rollup.aggregate_active_developers(m["authors_by_month"]), "unique_authors long"),
        "per_developer": (weekly.select("period_week", "commits_per_author"), "commits_per_author double"),
    }
    sinks.save_aggregates({k: df for k, (df, _) in parts.items()}, rollup.summary_report(c), folder)
    back = [c.sparkSession.read.csv(f"{folder}/{k}", header=True, schema=f"period string, {column}").select(F.lit(k).alias("name"), "period", F.round(F.col(column.split()[0]).cast("double"), 6).alias("value")) for k, (_, column) in parts.items()]
    return reduce(DataFrame.unionAll, back)


_named = lambda name, key, value, source: f"SELECT '{name}' AS name, {key} AS period, round({value}::DOUBLE, 6) AS value FROM ({source})"
_events(
    "k9_save_aggregates",
    _saved_aggregates,
    " UNION ALL ".join([
        _named("throughput", "period_month", "n", "SELECT period_month, count(*) AS n FROM local GROUP BY ALL"),
        _named("failure", "period_month", "r", f"SELECT period_month, avg(failure_rate) AS r FROM ({_EITHER}) GROUP BY ALL"),
        _named("cycle", "period_month", "p", "SELECT period_month, avg(p75_minutes) AS p FROM cycle GROUP BY ALL"),
        _named("developers", "period_month", "n", "SELECT period_month, count(DISTINCT author_ref) AS n FROM local GROUP BY ALL"),
        _named("per_developer", "period_week", "commits_per_author", _COMBINED),
    ]),
    f", {DELTAS_SQL}, {_MONTHLY}, {_WINDOW}",
)


def _saved_json(c: DataFrame) -> DataFrame:
    path = graph.new_path(c.sparkSession)
    sinks.save_repo_json(metrics.repo_summary(c), path)
    return c.sparkSession.read.json(path, schema="total_commits long, unique_authors long, first_commit string, last_commit string, repo_slug string")


_orders("k9_save_repo_json", _saved_json, _sql["a12_repo_summary"].split("AS monday\n  FROM commits\n)", 1)[1])


def _sprint_file(spark: SparkSession, d: str) -> DataFrame:
    path = graph.new_path(spark)
    _sprints(spark, d).drop("below_target").write.csv(path, header=True)
    return series.sprint_completion_series(readers.read_sprint_completion(spark, path))


_add("s9_read_sprint_completion", _sprint_file, _sql["v10_sprint_completion_series"])
_orders(
    "j9_branch_label",
    lambda c: graph.branch_label(c.select("repo_slug", "sha"), c.filter("o_orderkey % 3 = 0").select("repo_slug", F.concat(F.lit("refs/heads/"), "author_ref").alias("ref_name"), F.col("sha").alias("tip_sha"))),
    "SELECT repo_slug, sha, CASE WHEN o_orderkey % 3 = 0 THEN 'refs/heads/' || author_ref END AS ref_name FROM commits",
)
_orders("f21_value_json", lambda c: c.select("sha", s.value_json(F.struct("author_ref", "committed_at")).alias("value_json")), """SELECT sha, '{"author_ref":"' || author_ref || '","committed_at":' || committed_at || '}' AS value_json FROM commits""")
_events("v5_tpad_pivot", lambda c: _near(series.tpad_pivot(c, [f"repo{i}" for i in range(4)], WEEKS_BACK), *(f"repo{i}" for i in range(4))),
    "SELECT week_monday, " + ", ".join(f"round(coalesce(max(value) FILTER (repo_slug = 'repo{i}'), 0), 6) AS repo{i}" for i in range(4)) + f" FROM ({_PER_DEV}) GROUP BY ALL")
_NAMES = {"commits": "COMMITS", "cycle": "CYCLETIME", "close": "QA", "work": "WORKTIME"}


def _branch_report(c: DataFrame, e: DataFrame) -> DataFrame:
    """The report's files, read back."""
    path = graph.new_path(c.sparkSession)
    sinks.write_branch_cycle_csv(graph.branch_cycle_summary(graph.materialize_branch_lines(c, e, _tips(c))), path)
    measures = ", ".join(f"`{n} {_NAMES[k]}` double" for n, _, k in _MEASURES)
    return c.sparkSession.read.csv(path, header=True, schema=f"`INTERVAL START` string, BRANCHES long, COMMITS long, {measures}, repo_slug string")


_edged(
    "k12_branch_cycle_csv",
    _branch_report,
    """SELECT repo_slug, strftime(make_timestamp(interval_start * 1000000), '%a %b %d %H:%M:%S %Y') AS "INTERVAL START", branches AS "BRANCHES", total_commits AS "COMMITS", """
    + ", ".join(f'{n}_{c} AS "{n} {_NAMES[c]}"' for n, _, c in _MEASURES)
    + " FROM summary",
    _TOP + _PHASES + _BUCKETS,
)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
