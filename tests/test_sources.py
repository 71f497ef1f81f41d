"""Readers, builders and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from deliverix.operators import graph, reconcile
from deliverix.sources import export, readers, sinks, snapshots


def put(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_log_messages_edges_refs(spark, top):
    a, b = "a" * 40, "b" * 40
    log = readers.read_git_log(spark, put(top, "app.log", f"200|{a}|t|{b} c|x@y|Ann|e\n100|{b}|t||x@y|Bo\nbroken line\n"))
    rows = {r.sha: r for r in log.collect()}
    assert rows[a].author_name == "Ann|e" and rows[a].parents == [b, "c"] and rows[a].log_ordinal == 0 and rows[a].repo_slug == "app"
    assert rows[b].parents == [] and rows[b].committed_at == 100
    m = readers.read_commit_messages(spark, put(top, "messages", f"{a}\x1ffix: s\x1fbody\x1fraw\0\n{b}\x1fonly subject\0short\x1fx\0lonely\0\0"))
    assert {(r.sha, r.subject, r.body) for r in m.collect()} == {(a, "fix: s", "body"), (b, "only subject", "")}
    e = readers.read_parent_edges(spark, put(top, "app.edges", f"{a} {b} c\n{b}\n"))
    assert {(r.child_sha, r.parent_sha, r.parent_ord) for r in e.collect()} == {(a, b, 0), (a, "c", 1)}
    refs = readers.read_refs(spark, put(top, "app.refs", f"{a} commit refs/heads/z z\n{a} commit refs/heads/a\n{b} commit refs/heads/b\n"))
    assert {(r.tip_sha, r.ref_name) for r in readers.refs_by_tip(refs).collect()} == {(a, "refs/heads/a"), (b, "refs/heads/b")}
    o = readers.read_object_ids(spark, put(top, "app.objects", "x path\ny\nx again\n"))
    assert {(r.object_id, r.ordinal) for r in o.collect()} == {("x", 0), ("y", 1)}

    out = export.build_commits_export(log.withColumnRenamed("author_name", "_n"), m, e)
    got = {r.sha: r for r in out.collect()}
    assert (got[a].parent_count, got[a].parent_shas, got[a].subject_has_keywords, got[a].conventional_type) == (2, f"{b} c", 1, "fix")
    assert got[b].parent_shas == "" and got[b].author_ref == "x@y" and got[b].schema_version == 3
    assert reconcile.validate_interchange(out, e).count() == 0
    bad = out.withColumn("subject_has_keywords", F.lit(2)).withColumn("pii_protection_profile", F.lit("?"))
    assert {r.rule for r in reconcile.validate_interchange(bad.unionAll(bad), e.filter("parent_ord = 1")).collect()} == {"0 or 1: subject_has_keywords", "known profile", "unique commit", "edges match parent_count", "edges match parent_shas", "parents in order from 0"}
    lake = export.build_lake_commits(log, m)
    assert {r.message for r in lake.collect()} == {"raw", None}


def test_repeated_commits_keep_the_last(spark):
    log = spark.createDataFrame([("r", "s", "e", 5, 0), ("r", "s", "e", 6, 1)], "repo_slug string, sha string, author_email string, committed_at long, log_ordinal long")
    m = spark.createDataFrame([], "sha string, subject string, body string, raw string")
    e = spark.createDataFrame([], "repo_slug string, child_sha string, parent_sha string, parent_ord int")
    assert [(r.committed_at, r.log_ordinal) for r in export.build_commits_export(log, m, e).collect()] == [(6, 1)]


def test_config_and_csv(spark, top):
    good = put(top, "good.json", json.dumps({"repositories": [{"name": "a", "path_or_url": "/a"}, {"name": "b", "path_or_url": "git@h:b", "branch": "main"}]}))
    bad = put(top, "bad.json", json.dumps({"repositories": [{"name": "a"}]}))
    assert [r.name for r in readers.read_repo_config(spark, good).collect()] == ["a", "b"]
    assert readers.read_repo_config(spark, bad).count() == 0
    cycle, failure = readers.read_metrics_csv(spark, f"{top}/nowhere")
    assert cycle.count() == failure.count() == 0


def test_short_and_resolved_shas(spark):
    shas = spark.createDataFrame([("r", "abcdef1234"), ("r", "abcdef5678"), ("r", "ffff000000")], "repo_slug string, sha string")
    assert {r.sha: r.length for r in export.short_sha(shas).collect()} == {"abcdef1234": 7, "abcdef5678": 7, "ffff000000": 4}
    objects = shas.select("repo_slug", F.col("sha").alias("object_id"), F.monotonically_increasing_id().alias("ordinal"))
    p = spark.createDataFrame([("r", x) for x in ("abcdef5678", "abcdef", "0000", "a", "ab", "abc", "f", "", "abcdef12345", None)] + [("q", "a")], "repo_slug string, prefix string")
    rows = export.resolve_sha_prefix(p, objects).collect()
    got = {r.prefix: r.object_id for r in rows if r.repo_slug == "r"}
    assert len(rows) == 11 and {r.object_id for r in rows if r.repo_slug == "q"} == {None}
    assert got == {"abcdef5678": "abcdef5678", "0000": None, "f": "ffff000000", "abcdef12345": None, None: None, "": "abcdef1234"} | dict.fromkeys(("abcdef", "a", "ab", "abc"), "abcdef1234")
    two = spark.createDataFrame([("r", "abcdef12", 5), ("r", "abd00000", 1), ("r", "ab", 9)], "repo_slug string, object_id string, ordinal long")
    assert {r.prefix: r.object_id for r in export.resolve_sha_prefix(p, two).collect() if r.repo_slug == "r" and r.prefix in ("a", "ab", "abc")} == {"a": "abd00000", "ab": "ab", "abc": "abcdef12"}
    assert export.resolve_sha_prefix(p, two.limit(0)).filter("object_id is not null").count() == 0 and export.resolve_sha_prefix(p.limit(0), two).count() == 0


def test_metric_table_is_replaced_by_snapshot(spark, top):
    schema = "repo_slug string, period_month string, n long"
    a = sinks.with_lineage(spark.createDataFrame([("r1", "2024-01", 1), ("r2", "2024-01", 2)], schema), "d", 7)
    sinks.write_metric_table(a, f"{top}/m")
    sinks.write_metric_table(a.filter("repo_slug = 'r1'").withColumn("n", F.lit(9).cast("long")), f"{top}/m")
    got = {r.repo_slug: r.n for r in snapshots.read_rows(spark, f"{top}/m").collect()}
    assert got == {"r1": 9, "r2": 2}
    sinks.write_metric_table(a.filter("repo_slug = 'r2'"), f"{top}/m", [("r1", "d"), ("r2", "d"), ("r3", "d")])
    assert {r.repo_slug: r.n for r in snapshots.read_rows(spark, f"{top}/m").collect()} == {"r2": 2}


def test_a_batch_replaces_itself(spark, top):
    df = spark.createDataFrame([("b", "c", "m", "2024-01", 1.0)], "batch_id string, cohort_id string, metric_name string, period_key string, value_real double")
    for cohort in ("c", "d", "c"):
        sinks.write_multi_repo_aggregate(df.withColumn("cohort_id", F.lit(cohort)), f"{top}/agg")
    rows = snapshots.read_rows(spark, f"{top}/agg")
    assert sinks.read_multi_repo_aggregate(rows, "b", "c").count() == 1 and rows.count() == 2


NAMES = ["c++", "é", "a,b", "x:y/z", "a=b", " ", "100%", "..", None]


def test_readers_see_the_old_or_the_new_rows(spark, top, monkeypatch):
    """A write that breaks off between its rows and the switch, before it and in it; then the same write whole."""
    table = lambda n: spark.createDataFrame([(r, i, n) for i, r in enumerate(NAMES)], "repo_slug string, i int, n int")
    seen = lambda: {r.repo_slug: r.n for r in snapshots.read_rows(spark, f"{top}/t").collect()}
    with pytest.raises(ValueError, match="no snapshot"):
        seen()
    sinks.write_commits_export(table(1), f"{top}/t")
    assert seen() == dict.fromkeys(NAMES, 1)

    def stop(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_switch", stop)
        with pytest.raises(RuntimeError):
            sinks.write_commits_export(table(2), f"{top}/t")
    assert seen() == dict.fromkeys(NAMES, 1)
    with monkeypatch.context() as m:  # a manifest without its marker
        m.setattr(snapshots, "_switch", lambda df, path, number: df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/manifests/{number:012d}.part") or stop())
        with pytest.raises(RuntimeError):
            sinks.write_commits_export(table(3), f"{top}/t")
    assert seen() == dict.fromkeys(NAMES, 1)
    sinks.write_commits_export(table(4).filter("i < 3"), f"{top}/t", ["x:y/z", "a=b", "nobody"])
    want = dict.fromkeys(NAMES[:3], 4) | dict.fromkeys(NAMES[5:], 1)
    assert seen() == want
    assert len(snapshots.vacuum(spark, f"{top}/t")) == 2 and seen() == want and snapshots.vacuum(spark, f"{top}/t") == []
    sinks.write_commits_export(table(5).limit(0), f"{top}/t", [n for n in NAMES if n])
    assert seen() == {None: 1}
    snapshots.replace_rows(table(5).limit(0), f"{top}/t", ["repo_slug"], table(5))
    with pytest.raises(ValueError, match="no rows"):
        seen()
    assert snapshots.read_rows(spark, f"{top}/t", table(1).schema).count() == 0


def test_two_writers_from_one_manifest(spark, top, monkeypatch):
    df = spark.createDataFrame([("r", 1)], "repo_slug string, n int")
    sinks.write_commits_export(df, f"{top}/t")
    monkeypatch.setattr(snapshots, "_current", lambda *_: 0)  # what the slower one has read
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_commits_export(df, f"{top}/t")


def test_rules_of_an_interchange(spark):
    """Absent columns, parents that are swapped, and gaps in their numbers."""
    full = spark.createDataFrame([("r", "a", "p q", 2)], "repo_slug string, sha string, parent_shas string, parent_count int")
    edges = lambda *rows: spark.createDataFrame([("r", "a", p, o) for p, o in rows], "repo_slug string, child_sha string, parent_sha string, parent_ord int")
    rules = lambda c, e: {r.rule for r in reconcile.validate_interchange(c, e).collect() if not r.rule.startswith("column: ")}
    assert rules(full, edges(("p", 0), ("q", 1))) == set()
    assert rules(full, edges(("q", 0), ("p", 1))) == {"edges match parent_shas"}
    assert rules(full, edges(("p", 0), ("q", 5))) == {"edges match parent_shas", "parents in order from 0"}
    assert rules(full, edges(("p", 0), ("q", 1), ("q", 1))) == {"unique edge", "edges match parent_count", "edges match parent_shas", "parents in order from 0"}
    gone = {r.rule for r in reconcile.validate_interchange(full.drop("parent_shas"), edges(("p", 0), ("q", 1))).collect()}
    assert "column: parent_shas" in gone and "column: log_ordinal" in gone and "column: sha" not in gone and len(gone) == len(reconcile.REQUIRED) + 2 - 3
    assert {r.rule for r in reconcile.validate_interchange(full.drop("sha"), edges(("p", 0))).collect()} >= {"column: sha"}


def test_aggregates_and_author_runs(spark, top):
    df = spark.createDataFrame([("2024-01", 1)], "period_month string, n long")
    assert sinks.save_aggregates({"full": df, "empty": df.limit(0)}, df, f"{top}/agg") == ["full", "summary"]
    runs = spark.createDataFrame([("r", "a", "2024-W01", 3)], "repo_slug string, author_ref string, week string, commits long")
    per = spark.createDataFrame([("r", "a", 100.0)], "repo_slug string, author_ref string, percentile double")
    sinks.save_author_runs(runs, per, f"{top}/runs")
    assert spark.read.csv(f"{top}/runs/authors", header=True).count() == 1


def test_branch_report_has_nineteen_columns(spark):
    rows = [("r", f"l{i}", i + 1, 1000 * i, 86400, 86400 * i, 86400, 86400 * (i + 2)) for i in range(8)]
    phases = spark.createDataFrame(rows, "repo_slug string, branch_line_id string, commit_count long, start_at long, ramp_seconds long, work_seconds long, close_seconds long, total_seconds long")
    s = graph.branch_cycle_summary(phases, 4)
    first = s.filter("bucket = 0").first()
    assert (first.branches, first.total_commits, first.p50_commits, first.p50_cycle, first.p75_work, first.std_close) == (4, 10, 2.5, 3.5, 2.25, 0.0)
    assert len(sinks.branch_cycle_csv(s).drop("repo_slug").columns) == 19


def test_devlake(spark):
    c = spark.createDataFrame([("s1", "e", "2024-01-01 00:00:00", "r1", "m"), ("s2", "e", "2024-01-01 00:00:10", "r2", "m")], "sha string, author_email string, committed_date string, _raw_data_params string, message string").withColumn("committed_date", F.to_timestamp("committed_date"))
    p = spark.createDataFrame([("s1", "p2"), ("s1", "p1")], "commit_sha string, parent_commit_sha string")
    r = spark.createDataFrame([("r1", "main", "s1")], "repo_id string, name string, commit_sha string")
    commits, edges, refs = readers.from_devlake(c, p, r, ["r1"])
    assert [x.committed_at for x in commits.collect()] == [1704067200] and edges.count() == 2 and refs.first().tip_sha == "s1"
    from deliverix.operators import deltas

    five = spark.createDataFrame([("r", f"s{i}", "e", 172_800 * i, None) for i in (3, 0, 4, 1, 2)], "repo_slug string, sha string, author_ref string, committed_at long, log_ordinal long")
    assert [x.cycle_minutes for x in deltas.delta_events(five).orderBy("committed_at").collect()] == [2880.0] * 4
    assert deltas.cycle_stats_by_month(five).first().sample_count == 4 and deltas.cycle_stats_by_bucket(five, 2).count() == 2
    assert readers.first_repo_id(commits).first()[0] == "r1" and readers.first_repo_id(commits.limit(0)).first()[0] is None
    with pytest.raises(ValueError, match="unsupported"):
        export.build_commits_export(spark.createDataFrame([("r", "s", "e", 5, 0)], "repo_slug string, sha string, author_email string, committed_at long, log_ordinal long"), spark.createDataFrame([], "sha string, subject string, body string, raw string"), spark.createDataFrame([], "repo_slug string, child_sha string, parent_sha string, parent_ord int"), profile="encrypted_identity")
