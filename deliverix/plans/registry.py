"""Metrics by name, in a fixed order, over one interchange table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from deliverix.operators import activity, deltas, graph, metrics, rollup

#: Fixed value: the order in which all metrics run.
METRICS: dict[str, Callable[..., DataFrame]] = {
    "cycle_time_monthly": lambda c, **o: deltas.cycle_stats_by_month(c, o["tz"]),
    "cycle_time_delta_events": lambda c, **o: deltas.delta_events(c, o["tz"]),
    "change_failure_monthly": lambda c, **o: metrics.change_failure_monthly(c, o["work_style"], o["tz"]),
    "throughput_monthly": lambda c, **o: metrics.throughput_monthly(c, o["tz"]),
    "active_developers_monthly": lambda c, **o: metrics.active_developers_monthly(c, o["tz"]),
    "active_developers_weekly": lambda c, **o: activity.active_developers_weekly(c, o["weeks_back"], o["tz"]),
    "throughput_per_active_developer_weekly": lambda c, **o: activity.throughput_per_active_dev_weekly(c, o["weeks_back"], o["tz"]),
    "throughput_per_active_developer_monthly": lambda c, **o: activity.throughput_per_active_dev_monthly(c, o["weeks_back"], o["tz"]),
    "author_commit_percentiles": lambda c, **o: metrics.author_commit_percentiles(c),
}
#: Those that need single commits in order; the others also take author days.
PAIRED = ("cycle_time_monthly", "cycle_time_delta_events")
#: Only run when named.
OPT_IN = ("cycle_time_by_branches",)


def choose(names: str | list[str] = "all") -> list[str]:
    asked = list(METRICS) if names == "all" else [names] if isinstance(names, str) else list(names)
    known = [*METRICS, *OPT_IN]
    for n in asked:
        if n not in known:
            raise ValueError(f"unknown metric {n!r}; one of {', '.join(known)}")
    return [n for n in known if n in asked]


def run_metrics(
    commits: DataFrame, names: str | list[str] = "all", edges: DataFrame | None = None, roots: DataFrame | None = None, tz: str = "UTC", weeks_back: int = 4,
    work_style: str = "all-branches", strategy: str = "top", on_metric: Callable[[str, DataFrame], None] | None = None,
) -> dict[str, DataFrame]:
    """The chosen metrics, in the fixed order; where several run, the commits are read once and stored in narrow rows and author days. on_metric is told of each."""
    chosen = choose(names)
    rows = days = commits
    if len(chosen) > 1:
        rows, days = rollup.lattice(commits, tz)
    out = {}
    for n in chosen:
        if n in METRICS:
            out[n] = METRICS[n](rows if n in PAIRED else days, tz=tz, weeks_back=weeks_back, work_style=work_style)
        else:
            if edges is None or roots is None:
                raise ValueError("cycle_time_by_branches needs commit_parent_edges and roots")
            out[n] = graph.materialize_branch_lines(commits, edges, roots, strategy)
        if on_metric:
            on_metric(n, out[n])
    return out
