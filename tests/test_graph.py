"""Branch lines against a sequential walk of random graphs, phases, reachability and displays."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from deliverix.operators import graph

COMMITS = "repo_slug string, sha string, committed_at long, log_ordinal long"
EDGES = "repo_slug string, child_sha string, parent_sha string, parent_ord int"


def random_graph(seed):
    r = random.Random(seed)
    n = r.randint(2, 30)
    parents = {}
    for i in range(n):
        older = list(range(max(0, i - 6), i))
        parents[i] = r.sample(older, min(len(older), r.choice([1, 1, 1, 2, 2, 3])))
    return n, parents


def walk(root, parents, strategy):
    """Lines (merge, ord, start, commits, departure) as one pass after the other would find them."""
    seen, lines = set(), []

    sys.setrecursionlimit(100_000)

    def line(merge, ord_, start):
        commits, at = [], start
        while at is not None and at not in seen:
            seen.add(at)
            commits.append(at)
            at = parents[at][0] if parents[at] else None
        lines.append((merge, ord_, start, tuple(commits), at if commits else None))
        return [(c, k, p) for c in commits for k, p in enumerate(parents[c]) if k > 0]

    def deep(merge, ord_, start):
        subs = line(merge, ord_, start)
        if strategy == "reverse":
            order = sorted({c for c, _, _ in subs}, key=lambda c: [x for x, _, _ in subs].index(c), reverse=True)
            subs = [s for c in order for s in subs if s[0] == c]
        for c, k, p in subs:
            deep(c, k, p)

    if strategy == "narrow":
        level = [(None, 0, root)]
        while level:
            level = [s for x in level for s in line(*x)]
    elif strategy == "stop":
        line(None, 0, root)
    else:
        deep(None, 0, root)
    return sorted(lines, key=str)


@pytest.fixture(scope="module")
def graphs(spark):
    made = {f"r{i}": random_graph(i) for i in range(25)}
    commits = [(r, str(i), 1000 * i, n - 1 - i) for r, (n, _) in made.items() for i in range(n)]
    edges = [(r, str(c), str(p), k) for r, (_, ps) in made.items() for c, qs in ps.items() for k, p in enumerate(qs)]
    roots = [(r, str(n - 1)) for r, (n, _) in made.items()]
    return made, spark.createDataFrame(commits, COMMITS), spark.createDataFrame(edges, EDGES), spark.createDataFrame(roots, "repo_slug string, tip_sha string")


def found_lines(lines, members, number=lambda v: None if v is None else int(v)):
    """Lines of each repository as walk() has them."""
    got, own = {}, {}
    for m in members.collect():
        own.setdefault((m.repo_slug, m.line_id), {})[m.pos] = number(m.sha)
    for x in lines.collect():
        c = own.get((x.repo_slug, x.line_id), {})
        got.setdefault(x.repo_slug, []).append((number(x.merge), (x.key[-1] if x.key else 0), number(x.start), tuple(c[i] for i in range(len(c))), number(x.departure)))
    return got


@pytest.mark.parametrize(("strategy", "chunk"), [*((k, 1 << 18) for k in graph.STRATEGIES), *((k, 3) for k in graph.STRATEGIES)])
def test_branch_lines(graphs, monkeypatch, strategy, chunk):
    made, commits, edges, roots = graphs
    monkeypatch.setattr(graph, "CHUNK", chunk)
    walked = []
    got = found_lines(*graph.branch_lines(commits, edges, roots, strategy, watch=walked.append))
    for r, (n, parents) in made.items():
        assert sorted(got[r], key=str) == walk(n - 1, parents, strategy), (r, strategy)
    assert walked[-1] < walked[0] or len(walked) == 1  # rounds walk what has changed


def test_unknown_strategy(graphs):
    _, commits, edges, roots = graphs
    with pytest.raises(ValueError):
        graph.branch_lines(commits, edges, roots, "sideways")


@pytest.mark.parametrize("strategy", graph.STRATEGIES)
def test_branch_lines_of_the_given_tables(spark, monkeypatch, strategy):
    """All commits of sf0.01, in 16 chunks, against the sequential walk."""
    from deliverix import catalog
    from deliverix.plans import views

    monkeypatch.setattr(graph, "CHUNK", 1000)
    commits = views.commits_orders(spark, "/root/testdata/sf0.01")
    edges = views.edges_orders(commits)
    parents = {}
    for c in commits.select("repo_slug", "sha").collect():
        parents.setdefault(c.repo_slug, {})[c.sha] = []
    for e in sorted(edges.collect(), key=lambda e: e.parent_ord):
        known = parents[e.repo_slug][e.child_sha]
        known += [None] * (e.parent_ord - len(known)) + [e.parent_sha]  # the first parent may be beyond the end of the history
    walked = []
    lines, members = graph.branch_lines(commits, edges, catalog._tips(commits), strategy, watch=walked.append)
    got = found_lines(lines, members, number=lambda v: v)
    for tip in catalog._tips(commits).collect():
        assert sorted(got[tip.repo_slug], key=str) == walk(tip.tip_sha, parents[tip.repo_slug], strategy)
    assert sum(walked) < 3 * 16 and walked[-1] <= walked[0]


def test_deeply_nested_lines(spark):
    """100,000 commits, 1,000 levels: each line is merged into the line before it."""
    levels, size = 1000, 100
    name = lambda level, k: f"{level}_{k}"
    commits = [("r", name(v, k), 0, v * size + k) for v in range(levels) for k in range(size)]
    edges = [("r", name(v, k), name(v, k + 1), 0) for v in range(levels) for k in range(size - 1)]
    edges += [("r", name(v, 3), name(v + 1, 0), 1) for v in range(levels - 1)]
    frame = spark.createDataFrame(commits, COMMITS)
    lines, members = graph.branch_lines(frame, spark.createDataFrame(edges, EDGES), spark.createDataFrame([("r", name(0, 0))], "repo_slug string, tip_sha string"))
    got = {x.start: (x.commit_count, len(x.key)) for x in lines.collect()}
    assert got == {name(v, 0): (size, 2 * v) for v in range(levels)} and members.count() == levels * size


def test_passes_do_not_grow_with_the_history(spark, monkeypatch):
    """A straight history of 256 chunks is reached by way of three skeletons."""
    monkeypatch.setattr(graph, "CHUNK", 8)
    n, passes = 2048, []
    monkeypatch.setattr(graph, "_by_chunk", lambda *a, run=graph._by_chunk: passes.append(a) or run(*a))
    commits = spark.createDataFrame([("r", str(i), 0, i) for i in range(n)], COMMITS)
    edges = spark.createDataFrame([("r", str(i), str(i + 1), 0) for i in range(n - 1)], EDGES)
    tips = spark.createDataFrame([("r", "5")], "repo_slug string, tip_sha string")
    assert {int(x.sha) for x in graph.reachable_from(tips, commits, edges).collect()} == set(range(5, n))
    assert len(passes) <= 7


@pytest.mark.parametrize("chunk", [1 << 18, 4])
def test_reachable(graphs, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    made, commits, edges, roots = graphs
    got = {}
    for x in graph.reachable_from(roots, commits, edges).collect():
        got.setdefault(x.repo_slug, set()).add(int(x.sha))
    for r, (n, parents) in made.items():
        seen, todo = set(), [n - 1]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo += parents[c]
        assert got[r] == seen


@pytest.mark.parametrize(
    ("departure", "commits", "merge", "expected"),
    [
        (100, [200, 300], 400, (100, 100, 100, 100, 300)),
        (None, [200, 300], 400, (200, None, 100, 100, 200)),
        (100, [200, 300], None, (100, 100, 100, None, 200)),
        (None, [200], None, (200, None, 0, None, None)),
        (100, [], 400, (100, None, None, None, 300)),
        (500, [200, 300], 250, (200, -300, 100, -50, 300)),
        (None, [], None, (None, None, None, None, None)),
        (7, [], None, (7, None, None, None, None)),
    ],
)
def test_phases(spark, departure, commits, merge, expected):
    row = [(departure, min(commits, default=None), max(commits, default=None), len(commits), merge)]
    df = spark.createDataFrame(row, "d long, f long, l long, k long, m long")
    got = graph.phases_of(df, F.col("d"), F.col("f"), F.col("l"), F.col("k"), F.col("m")).first()
    assert (got.start_at, got.ramp_seconds, got.work_seconds, got.close_seconds, got.total_seconds) == expected


def test_linear_and_no_edges(spark):
    commits = spark.createDataFrame([("r", f"c{i}", i, 2 - i) for i in range(3)], COMMITS)
    edges = spark.createDataFrame([("r", "c2", "c1", 0), ("r", "c1", "c0", 0)], EDGES)
    out = graph.materialize_branch_lines(commits, edges, spark.createDataFrame([("r", "c2")], "repo_slug string, tip_sha string")).collect()
    assert [(x.commit_count, x.work_seconds, x.ramp_seconds, x.merge_sha) for x in out] == [(3, 2, None, None)]
    from deliverix.operators.metrics import require_edges

    with pytest.raises(ValueError, match="commit_parent_edges"):
        require_edges(edges, "other")


def test_default_branch(spark):
    refs = spark.createDataFrame([("a", "master", "1"), ("a", "main", "2"), ("b", "master", "3"), ("c", "origin/HEAD", "4"), ("d", "topic", "5")], "repo_slug string, ref_name string, tip_sha string")
    assert {r.repo_slug: r.tip_sha for r in graph.default_branch(refs).collect()} == {"a": "2", "b": "3", "c": "4"}


def test_hidden_runs(spark):
    lines = spark.createDataFrame([("r", "L", "m", "c5", "d", 6)], "repo_slug string, line_id string, merge string, start string, departure string, commit_count long")
    members = spark.createDataFrame([("r", "L", f"c{5 - i}", i) for i in range(6)], "repo_slug string, line_id string, sha string, pos long")
    got = {(x.from_sha, x.to_sha, x.hidden) for x in graph.hidden_run_compression(lines, members).collect()}
    assert got == {("c0", "c5", 4), ("d", "c0", 0), ("c5", "m", 0)}


def test_a_round_reads_the_edges_of_its_chunks_alone(spark, monkeypatch):
    """100 commits in ten chunks: ten rounds, each of which reads a folder of one chunk; departures come from the walk, and lines and members are stored."""
    monkeypatch.setattr(graph, "CHUNK", 10)
    commits = spark.createDataFrame([("r", str(i), i, 99 - i) for i in range(100)], COMMITS)
    rows = [("r", str(i), str(i - 1), 0) for i in range(1, 100)] + [("r", str(i), str(i - 2), 1) for i in range(2, 100, 9)] + [("r", "0", "gone", 0)]
    read, by_chunk = [], graph._by_chunk

    def watched(entries, links, *more):
        assert "PartitionFilters: []" not in links._jdf.queryExecution().executedPlan().toString()
        read.append({r[0] for r in links.select("chunk").distinct().collect()})
        return by_chunk(entries, links, *more)

    monkeypatch.setattr(graph, "_by_chunk", watched)
    lines, members = graph.branch_lines(commits, spark.createDataFrame(rows, EDGES), spark.createDataFrame([("r", "99")], "repo_slug string, tip_sha string"))
    assert read == [{i} for i in range(10)]
    for df in (lines, members):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((x.merge or "", x.start, x.departure, x.commit_count) for x in lines.collect()) == sorted([("", "99", None, 100)] + [(str(i), str(i - 2), None, 0) for i in range(2, 100, 9)])
    assert members.count() == 100


@pytest.mark.parametrize("chunk", [1, 3])
def test_hidden_runs_over_chunks(graphs, chunk):
    """A long line is cut into chunks of places; what is next to each other at their borders is found all the same."""
    _, commits, edges, roots = graphs
    lines, members = graph.branch_lines(commits, edges, roots)
    shown = {(x.repo_slug, s) for x in lines.filter("commit_count > 0").collect() for s in (x.merge, x.departure) if s}
    want, own = [], {}
    for m in sorted(members.collect(), key=lambda m: -m.pos):
        own.setdefault((m.repo_slug, m.line_id), []).append(m)
    for x in lines.collect():
        rows = own.get((x.repo_slug, x.line_id), [])
        kept = [m for m in rows if m.pos in (0, len(rows) - 1) or (x.repo_slug, m.sha) in shown]
        want += [(x.line_id, a.sha, b.sha, a.pos - b.pos - 1) for a, b in zip(kept, kept[1:])]
        ends = [s for s in ([x.departure] + ([rows[0].sha, rows[-1].sha] if rows else []) + [x.merge])]
        want += [(x.line_id, a, b, 0) for a, b in ([(ends[0], ends[1]), (ends[-2], ends[-1])] if rows else [tuple(ends)]) if a and b]
    got = [(x.line_id, x.from_sha, x.to_sha, x.hidden) for x in graph.hidden_run_compression(lines, members, chunk).collect()]
    assert sorted(got) == sorted(want)


def test_a_summary_reads_the_phases_once(spark, tmp_path):
    names = "repo_slug string, branch_line_id string, commit_count long, start_at long, ramp_seconds long, work_seconds long, close_seconds long, total_seconds long"
    rows = [("r", f"l{i}", 1 + i % 3, 1000 * i, 86400 * (i % 5), 900 * i, 70 * i, 86400 * i) for i in range(40)]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/phases")
    found = graph.branch_cycle_summary(spark.read.parquet(f"{tmp_path}/phases"), 4)
    assert found.inputFiles() and not any("/phases/" in f for f in found.inputFiles())
    assert [x.branches for x in found.orderBy("bucket").collect()] == [4] * 8


def test_phases_join_commits_by_sha(graphs, spark):
    """No join gathers the commits of a line, which may be half of a repository's; a line's own merge and departure are no commits of it."""
    _, commits, edges, roots = graphs
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.branch_phases(*graph.branch_lines(commits, edges, roots), commits)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_line = [x for x in plan.splitlines() if "MergeJoin [repo_slug" in x and x.split("MergeJoin [")[1].split("]")[0].split("#")[1].endswith("line_id") and x.split("MergeJoin [")[1].split("]")[0].count("#") == 2]
    assert len(by_line) == 1  # the lines with the spans, a row for each line
    lines = spark.createDataFrame([("r", "l", "m", "d")], "repo_slug string, line_id string, merge string, departure string")
    members = spark.createDataFrame([("r", "l", s, i) for i, s in enumerate("mabd")], "repo_slug string, line_id string, sha string, pos long")
    times = spark.createDataFrame([("r", "m", 90), ("r", "a", 60), ("r", "b", 40), ("r", "d", 10)], "repo_slug string, sha string, committed_at long")
    x = graph.branch_phases(lines, members, times).first()
    assert (x.start_at, x.ramp_seconds, x.work_seconds, x.close_seconds, x.total_seconds) == (10, 30, 20, 30, 80)
