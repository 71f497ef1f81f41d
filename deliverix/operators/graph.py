"""The commit graph: reachability, branch lines, their phases and summaries.

Edges are (repo_slug, child_sha, parent_sha, parent_ord). Commits and edges of all repositories advance
together; loops are over rounds, not rows, and each round is a stored table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from heapq import heappop, heappush
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverix.functions.scalars import branch_line_id
from deliverix.operators.ordering import CHUNK, SECONDS, number_rows, with_older
from deliverix.operators.selection import counts_by_value, joined, percentiles
from deliverix.operators.steps import new_path, stored  # noqa: F401

STRATEGIES = ("top", "reverse", "narrow", "stop")
#: Chunks of a skeleton that are one chunk of the next.
WIDER = 16


def build_parent_edges(lines: DataFrame) -> DataFrame:
    """From commits(repo_slug, sha, parent_shas separated by spaces): an edge for each parent, in order from 0."""
    parents = F.filter(F.split(F.coalesce("parent_shas", F.lit("")), " +"), lambda x: x != "")
    return lines.select("repo_slug", F.col("sha").alias("child_sha"), F.posexplode(parents).alias("parent_ord", "parent_sha"))


def with_parents(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """Commits with parent_count and parent_shas of their edges."""
    lists = edges.groupBy("repo_slug", F.col("child_sha").alias("sha")).agg(
        F.count("*").cast("int").alias("parent_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("parent_ord", "parent_sha"))), lambda x: x.parent_sha), " ").alias("parent_shas")
    )  # a commit's own parents, which are few
    return commits.drop("parent_count", "parent_shas").join(lists, ["repo_slug", "sha"], "left").fillna({"parent_count": 0, "parent_shas": ""})


def link_children(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_slug, sha, children for each commit; parents that aren't commits of the snapshot are left out."""
    n = edges.groupBy("repo_slug", F.col("parent_sha").alias("sha")).agg(F.count("*").alias("children"))
    return commits.select("repo_slug", "sha").join(n, ["repo_slug", "sha"], "left").fillna({"children": 0})


def default_branch(refs: DataFrame) -> DataFrame:
    """repo_slug, ref_name, tip_sha: main, else master, else the branch that origin/HEAD is at."""
    name = F.regexp_replace("ref_name", "^refs/heads/", "")
    order = F.when(name == "main", 0).when(name == "master", 1).when(name.isin("origin/HEAD", "refs/remotes/origin/HEAD"), 2)
    found = refs.withColumn("_order", order).filter("_order is not null").groupBy("repo_slug").agg(F.min_by(F.struct("ref_name", "tip_sha"), "_order").alias("r"))
    return found.select("repo_slug", "r.ref_name", "r.tip_sha")


def _placed(commits: DataFrame) -> DataFrame:
    """repo_slug, sha and chunk of each commit: of its log ordinal, else of its time, the newest having the least."""
    place = [F.floor(F.col("log_ordinal") / CHUNK)] if "log_ordinal" in commits.columns else []
    return stored(commits.select("repo_slug", "sha", F.coalesce(*place, -F.floor(F.col("committed_at") / SECONDS)).alias("chunk")).dropDuplicates(["repo_slug", "sha"]))


def _links(known: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between commits of the snapshot, with the chunks of both ends: repo_slug, chunk, sha, parent_sha, parent_ord, to. A folder for each chunk number."""
    ends = known.select("repo_slug", F.col("sha").alias("parent_sha"), F.col("chunk").alias("to"))
    links = edges.select("repo_slug", F.col("child_sha").alias("sha"), "parent_sha", "parent_ord").join(ends, ["repo_slug", "parent_sha"]).join(known, ["repo_slug", "sha"])
    return stored(links.select("repo_slug", "chunk", "sha", "parent_sha", "parent_ord", "to").repartition("repo_slug", "chunk"), "chunk")


def _by_chunk(entries: DataFrame, links: DataFrame, walk: Callable[..., pa.Table], schema: str) -> DataFrame:
    """walk(key, entries, links) for every chunk that has entries, a task each."""
    inner = links.join(entries.select("repo_slug", "chunk").distinct(), ["repo_slug", "chunk"], "left_semi")
    return stored(entries.groupBy("repo_slug", "chunk").cogroup(inner.groupBy("repo_slug", "chunk")).applyInArrow(walk, schema))


def _parents(inner: pa.Table) -> dict[str, list[tuple[str, int]]]:
    parents: dict[str, list[tuple[str, int]]] = {}
    for sha, parent, to in zip(*(inner.column(c).to_pylist() for c in ("sha", "parent_sha", "to"))):
        parents.setdefault(sha, []).append((parent, to))
    return parents


def _filled(key: tuple, entries: pa.Table, inner: pa.Table) -> pa.Table:
    """All commits of a chunk that its entries reach within it."""
    own, parents = key[1].as_py(), _parents(inner)
    seen = set(todo := entries.column("sha").to_pylist())
    while todo:
        new = [p for p, to in parents.get(todo.pop(), ()) if to == own and p not in seen]
        seen.update(new)
        todo += new
    return pa.table({"repo_slug": pa.array([key[0].as_py()] * len(seen), pa.string()), "sha": pa.array(list(seen), pa.string())})


def _skeleton(key: tuple, entries: pa.Table, inner: pa.Table) -> pa.Table:
    """The next entries, of this or other chunks, that each entry of a chunk reaches without passing another."""
    own, parents = key[1].as_py(), _parents(inner)
    stops = set(entries.column("sha").to_pylist())
    rows = []
    for entry in stops:
        seen, todo, next_ = {entry}, [entry], set()
        while todo:
            for p, to in parents.get(todo.pop(), ()):
                if to != own or p in stops:
                    next_.add((p, to))
                elif p not in seen:
                    seen.add(p)
                    todo.append(p)
        rows += [(entry, p, to) for p, to in next_ if p != entry]
    sha, parent, to = zip(*rows) if rows else ((), (), ())
    n = len(rows)
    columns = {"repo_slug": pa.array([key[0].as_py()] * n, pa.string()), "chunk": pa.array([own] * n, pa.int64())}
    return pa.table(columns | {"sha": pa.array(sha, pa.string()), "parent_sha": pa.array(parent, pa.string()), "to": pa.array(to, pa.int64())})


def _reach(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(repo_slug, sha) that seeds(repo_slug, sha, chunk) reach by links(repo_slug, chunk, sha, parent_sha, to)."""
    crossing = links.filter("to != chunk")
    if crossing.isEmpty():
        return _by_chunk(seeds, links, _filled, "repo_slug string, sha string")
    entries = stored(seeds.unionByName(crossing.select("repo_slug", F.col("parent_sha").alias("sha"), F.col("to").alias("chunk"))).distinct())
    inner = _by_chunk(entries, links, _skeleton, "repo_slug string, chunk long, sha string, parent_sha string, to long")
    wide = lambda df, *names: df.withColumns({n: F.floor(F.col(n) / WIDER) for n in names})
    reached = _reach(wide(inner, "chunk", "to"), wide(seeds, "chunk"))
    return _by_chunk(stored(entries.join(reached, ["repo_slug", "sha"], "left_semi")), links, _filled, "repo_slug string, sha string")


def reachable_from(tips: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_slug, sha) of the commits of the snapshot that tips(repo_slug, tip_sha) reach by any parents.

    A repository's log is cut into chunks. One pass over the chunks, a task each, makes a skeleton: the commits at which chunks are entered, and
    which of them follow each other. The skeleton has wider chunks and is reduced in the same way, until nothing crosses chunks; then
    the way back fills each chunk from those of its entries that are reached. So the passes grow with the logarithm of the
    chunks of the longest history; a repository of one chunk takes one.
    """
    known = _placed(commits)
    seeds = stored(tips.select("repo_slug", F.col("tip_sha").alias("sha")).distinct().join(known, ["repo_slug", "sha"]).select("repo_slug", "sha", "chunk"))
    return _reach(_links(known, edges), seeds)


def without_default_branch(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """repo_slug of the repositories with commits of which no ref is a default branch, or whose default branch is at a commit that isn't in the snapshot; they have no squash results."""
    tips = default_branch(refs).select("repo_slug", F.col("tip_sha").alias("sha"))
    known = tips.join(commits.select("repo_slug", "sha"), ["repo_slug", "sha"], "left_semi")
    return commits.select("repo_slug").distinct().join(known, "repo_slug", "left_anti")


def squash_commits(refs: DataFrame, commits: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """The commits of squashed work: those that the default branch reaches. Where strict, a repository without a default branch is an error."""
    if strict:
        lost = [r[0] for r in without_default_branch(refs, commits).limit(5).collect()]
        if lost:
            raise ValueError(f"no default branch: {', '.join(map(str, lost))}{', ...' if len(lost) == 5 else ''}")
    return commits.join(reachable_from(default_branch(refs), commits, edges), ["repo_slug", "sha"], "left_semi")


_LINE = "merge string, ord int, start string, key array<long>"
_FOUND = f"repo_slug string, chunk long, what string, sha string, {_LINE}, at long, to long, next string"


def _claimer(strategy: str) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Walks the lines of a chunk in order of their keys, so that each commit goes to the line that comes to it first."""

    def walk(key: tuple, entries: pa.Table, inner: pa.Table) -> pa.Table:
        repo, own = key[0].as_py(), key[1].as_py()
        first: dict[str, tuple[str, int]] = {}
        further: dict[str, list[tuple[int, str, int]]] = {}
        for sha, parent, ord_, to in zip(*(inner.column(c).to_pylist() for c in ("sha", "parent_sha", "parent_ord", "to"))):
            if ord_ == 0:
                first[sha] = (parent, to)
            elif strategy != "stop":
                further.setdefault(sha, []).append((ord_, parent, to))
        sign = -1 if strategy == "reverse" else 1
        waiting: list[tuple] = []
        number = count()

        def wait(line: tuple[str, int, str], order: tuple[int, ...], at: int, sha: str) -> None:
            heappush(waiting, (len(order) if strategy == "narrow" else 0, order, at, next(number), line, sha))

        for row in entries.select(["merge", "ord", "start", "key", "at", "sha"]).to_pylist():
            wait((row["merge"], row["ord"], row["start"]), tuple(row["key"]), row["at"], row["sha"])
        owner: dict[str, tuple] = {}
        out: list[tuple] = []
        while waiting:
            _, order, at, _, line, sha = heappop(waiting)
            while sha not in owner:
                owner[sha] = line
                after = first.get(sha)
                out.append(("claim", sha, *line, None, at, own, after and after[0]))
                for ord_, parent, to in further.get(sha, ()):
                    below, sub = (*order, sign * at, ord_), (sha, ord_, parent)
                    out.append(("line", parent, *sub, below, 0, to, None))
                    if to == own:
                        wait(sub, below, 0, parent)
                if after is None:
                    break
                sha, at = after[0], at + 1
                if after[1] != own:
                    out.append(("on", sha, *line, order, at, after[1], None))
                    break
        n = len(out)
        columns = zip(*out) if out else [()] * 9
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        names = ["what", "sha", "merge", "ord", "start", "key", "at", "to", "next"]
        found = {k: pa.array(c, kind) for k, c, kind in zip(names, columns, kinds)}
        table = pa.table({"repo_slug": pa.array([repo] * n, pa.string()), "chunk": pa.array([own] * n, pa.int64())} | found)
        return table

    return walk


def _walk(known: DataFrame, links: DataFrame, roots: DataFrame, strategy: str, watch: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines (merge, ord, start, key) and claims (sha, merge, ord, start, i, next), next being the commit's first parent.

    Chunks of the log are walked, a task each, from the lines that enter them. A line that goes on in another chunk, or starts there, is an entry of that.
    A round walks the chunks whose entries have changed, and reads the edges of no others, until none has. What a chunk finds follows from lines with lesser keys alone
    (or from newer parts of the same line), so that there is one end, and it is that of the walk of one line after the other; how deeply
    lines are nested adds no rounds, but for lines that pass to and fro between chunks.
    """
    lines = roots.select("repo_slug", F.lit("").alias("merge"), F.lit(0).alias("ord"), F.col("tip_sha").alias("start"), F.array().cast("array<long>").alias("key"))
    tips = known.withColumnRenamed("sha", "start")
    columns = ["repo_slug", "source", "chunk", "sha", "merge", "ord", "start", "key", "at"]
    entries = stored(lines.join(tips, ["repo_slug", "start"]).withColumns({"source": F.lit(None).cast("long"), "sha": F.col("start"), "at": F.lit(0).cast("long")}).select(*columns))
    todo = entries.select("repo_slug", "chunk").distinct()
    rounds: list[DataFrame] = []
    ran: list[DataFrame] = []
    while not (todo := stored(todo)).isEmpty():
        chunks = [r[0] for r in todo.filter("chunk is not null").select("chunk").distinct().collect()]  # as many as the longest log has
        if watch:
            watch(todo.count())
        ran.append(todo.withColumn("round", F.lit(len(ran))))
        found = _by_chunk(entries.join(todo, ["repo_slug", "chunk"], "left_semi"), links.filter(F.col("chunk").isin(chunks)), _claimer(strategy), _FOUND)
        rounds.append(found.withColumn("round", F.lit(len(rounds))))
        source = todo.withColumnRenamed("chunk", "source")
        before = entries.join(source, ["repo_slug", "source"], "left_semi").select(*columns)
        now = found.filter("what != 'claim' and to != chunk").select("repo_slug", F.col("chunk").alias("source"), F.col("to").alias("chunk"), *columns[3:])
        signed = now.withColumn("sign", F.lit(1)).unionAll(before.withColumn("sign", F.lit(-1)))
        todo = signed.groupBy(*columns).agg(F.sum("sign").alias("sign")).filter("sign != 0").select("repo_slug", "chunk").distinct()
        entries = stored(entries.join(source, ["repo_slug", "source"], "left_anti").select(*columns).unionAll(now))
    if not rounds:
        return lines, known.limit(0).select("repo_slug", "sha", F.lit("").alias("merge"), F.lit(0).alias("ord"), F.col("sha").alias("start"), F.col("chunk").alias("i"), F.col("sha").alias("next"))
    last = reduce(DataFrame.unionAll, ran).groupBy("repo_slug", "chunk").agg(F.max("round").alias("round"))
    every = reduce(DataFrame.unionAll, rounds).join(last, ["repo_slug", "chunk", "round"], "left_semi")
    lines = lines.unionAll(every.filter("what = 'line'").select("repo_slug", "merge", "ord", "start", "key"))
    return lines, every.filter("what = 'claim'").select("repo_slug", "sha", "merge", "ord", "start", F.col("at").alias("i"), "next")


def branch_lines(commits: DataFrame, edges: DataFrame, roots: DataFrame, strategy: str = "top", watch: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """All lines of the trees below roots(repo_slug, tip_sha), and their commits.

    A line starts at the root, or at a further parent of a merge that another line claims, and follows first
    parents as far as nobody has claimed them; its departure is the first commit that was. Returns
    lines (repo_slug, line_id, merge, start, departure, commit_count, key) and commits (repo_slug, line_id,
    sha, pos), pos 0 being the newest. Line order is that of the key: arrays for top and reverse, level first for narrow. A key has the
    place of the merge in its line (negative for reverse) and the parent's number, for each level. Both are stored. watch is told how many chunks each round walks.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    placed = _placed(commits)
    found, claims = _walk(placed, _links(placed, edges), roots, strategy, watch)
    keys = ["repo_slug", "merge", "ord", "start"]
    ends = claims.groupBy(*keys).agg(F.count("*").alias("commit_count"), F.max_by("next", "i").alias("departure"))
    lines = found.join(ends, keys, "left").fillna({"commit_count": 0})
    line_id = F.sha2(F.concat_ws("\n", F.lit(strategy), "repo_slug", "merge", F.col("ord").cast("string"), "start"), 256)
    lines = lines.withColumn("line_id", line_id)
    members = stored(claims.withColumn("line_id", line_id).select("repo_slug", "line_id", "sha", F.col("i").alias("pos")))
    return stored(lines.select("repo_slug", "line_id", F.nullif("merge", F.lit("")).alias("merge"), "start", "departure", "commit_count", "key")), members


def branch_phases(lines: DataFrame, members: DataFrame, commits: DataFrame) -> DataFrame:
    """start, ramp, work, close, total (seconds) of each line; what isn't known stays null, clock skew gives negatives."""
    when = commits.select("repo_slug", "sha", F.col("committed_at").alias("t"))
    at = lambda name: when.select("repo_slug", F.col("sha").alias(name), F.col("t").alias(f"{name}_at"))
    ends = lines.select("repo_slug", "line_id", "merge", "departure").join(at("merge"), ["repo_slug", "merge"], "left").join(at("departure"), ["repo_slug", "departure"], "left")
    borders = lines.select("repo_slug", "line_id", F.explode(F.array("merge", "departure")).alias("sha")).filter("sha is not null")
    own = members.join(borders, ["repo_slug", "line_id", "sha"], "left_anti")  # by commit, as a line may have very many
    spans = own.join(when, ["repo_slug", "sha"]).groupBy("repo_slug", "line_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("t").alias("k"))
    j = ends.join(spans, ["repo_slug", "line_id"], "left")
    return phases_of(j, F.col("departure_at"), F.col("first"), F.col("last"), F.coalesce("k", F.lit(0)), F.col("merge_at")).drop("merge_at", "departure_at", "first", "last", "k")


def phases_of(df: DataFrame, departure: Column, first: Column, last: Column, commits: Column, merge: Column) -> DataFrame:
    """Adds the five phases from boundary times."""
    known = commits + departure.isNotNull().cast("int") + merge.isNotNull().cast("int")
    low, high = F.least(departure, first, merge), F.greatest(departure, last, merge)
    return df.withColumns(
        {"start_at": low, "ramp_seconds": first - departure, "work_seconds": last - first, "close_seconds": merge - last, "total_seconds": F.when(known > 1, high - low)}
    )


def materialize_branch_lines(commits: DataFrame, edges: DataFrame, roots: DataFrame, strategy: str = "top", dataset_id: str = "default") -> DataFrame:
    """One row for each line, in the shape of the branch metric table."""
    lines, members = branch_lines(commits, edges, roots, strategy)
    phases = branch_phases(lines, members, commits).drop("merge", "departure")
    out = lines.join(phases, ["repo_slug", "line_id"])
    return out.select(
        "repo_slug", F.lit(dataset_id).alias("dataset_id"), branch_line_id(strategy, F.col("merge"), F.col("start")).alias("branch_line_id"), F.lit(strategy).alias("strategy"),
        F.col("merge").alias("merge_sha"), F.col("start").alias("root_sha"), F.col("departure").alias("departure_sha"), "commit_count", "start_at", "ramp_seconds", "work_seconds", "close_seconds", "total_seconds",
    )


def line_order(lines: DataFrame, strategy: str) -> DataFrame:
    """Lines with depth and a place within the repository, level by level."""
    size = F.size("key")
    chunk = F.struct(size.alias("level"), F.slice("key", 1, 2).alias("head"))
    return number_rows(lines.withColumn("depth", (size / 2).cast("int")), ["repo_slug"], chunk, [size, F.col("key")], "place")


def longest_branch_lines(lines: DataFrame, k: int = 6) -> DataFrame:
    """The k lines with most nodes (commits and both ends) of each repository: of k candidates from each of its parts."""
    first = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("commit_count"), "line_id"))).filter(F.col("rank") <= k)
    parts = first(lines.withColumn("_part", F.pmod(F.xxhash64("line_id"), F.lit(64))), "repo_slug", "_part").drop("_part", "rank")
    return first(parts, "repo_slug").withColumn("line_size", F.col("commit_count") + 2)


def line_nodes(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of each line in order: merge, commits newest first, departure."""
    ends = lambda c, role, pos: lines.filter(F.col(c).isNotNull()).select("repo_slug", "line_id", F.lit(role).alias("role"), pos.alias("pos"), F.col(c).alias("sha"))
    own = members.select("repo_slug", "line_id", F.lit("commit").alias("role"), F.col("pos").cast("long").alias("pos"), "sha")
    return ends("merge", "merge", F.lit(-1).cast("long")).unionAll(own).unionAll(ends("departure", "departure", F.col("commit_count").cast("long")))


def line_commits_until_first_merge(members: DataFrame, children: DataFrame, strategy: str) -> DataFrame | None:
    """narrow and top: all commits; reverse: the oldest ones up to the first with more than one child; stop: None."""
    if strategy in ("narrow", "top"):
        return members
    if strategy != "reverse":
        return None
    j = members.join(children, ["repo_slug", "sha"])
    cut = j.filter("children > 1").groupBy("repo_slug", "line_id").agg(F.max("pos").alias("cut"))
    return j.join(cut, ["repo_slug", "line_id"], "left").filter(F.col("pos") >= F.coalesce("cut", F.lit(0))).select("repo_slug", "line_id", "sha", "pos")


def hidden_run_compression(lines: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (from_sha, to_sha, hidden) of each line from old to new: its ends and commits that are merges or departures of non-empty lines stay, runs of others become counts.

    Commits are joined by sha, and next to each other in chunks of places, so that no task holds a long line. Lines and members are read several times.
    """
    full = lines.filter("commit_count > 0")
    shown = full.select("repo_slug", F.col("merge").alias("sha")).unionAll(full.select("repo_slug", F.col("departure").alias("sha"))).filter("sha is not null")
    columns = ["repo_slug", "line_id", "sha", "pos"]
    newest = members.filter("pos = 0").select(*columns)
    oldest = stored(members.groupBy("repo_slug", "line_id").agg(F.max_by("sha", "pos").alias("sha"), F.max("pos").alias("pos")))
    seen = members.join(shown, ["repo_slug", "sha"], "left_semi").select(*columns)
    kept = newest.unionAll(oldest.select(*columns)).unionAll(seen).distinct()
    older = with_older(kept.withColumns({"log_ordinal": -F.col("pos"), "committed_at": F.lit(0)}), ["repo_slug", "line_id"], ["sha", "pos"], chunk)
    inner = older.filter("older is not null").select("repo_slug", "line_id", F.col("sha").alias("from_sha"), F.col("older.sha").alias("to_sha"), (F.col("pos") - F.col("older.pos") - 1).alias("hidden"))
    leave = lines.filter("departure is not null and commit_count > 0").join(oldest, ["repo_slug", "line_id"]).select("repo_slug", "line_id", F.col("departure").alias("from_sha"), F.col("sha").alias("to_sha"), F.lit(0).cast("long").alias("hidden"))
    come = lines.filter("merge is not null and commit_count > 0").join(newest, ["repo_slug", "line_id"]).select("repo_slug", "line_id", F.col("sha").alias("from_sha"), F.col("merge").alias("to_sha"), F.lit(0).cast("long").alias("hidden"))
    empty = lines.filter("commit_count = 0 and merge is not null and departure is not null").select("repo_slug", "line_id", F.col("departure").alias("from_sha"), F.col("merge").alias("to_sha"), F.lit(0).cast("long").alias("hidden"))
    return inner.select("repo_slug", "line_id", "from_sha", "to_sha", F.col("hidden").cast("long").alias("hidden")).unionAll(leave).unionAll(come).unionAll(empty)


def branch_label(shas: DataFrame, refs: DataFrame) -> DataFrame:
    """Commits with the name of the ref whose tip they are; of several, the last in ref order."""
    tips = refs.groupBy("repo_slug", F.col("tip_sha").alias("sha")).agg(F.max("ref_name").alias("ref_name"))
    return shas.join(tips, ["repo_slug", "sha"], "left")


def branch_cycle_summary(phases: DataFrame, bucket_size: int | None = None) -> DataFrame:
    """Buckets of lines in order of their phases, with median, inclusive 75th percentile, mean and deviation of commits, cycle, close and work days.

    The phases are read once, and their rows are stored with and without their buckets. Lines without commits or without ramp are left out. Half of the ramp, in whole days, counts as work; the rest is taken off the total.
    """
    order = ["start_at", "ramp_seconds", "work_seconds", "close_seconds", "total_seconds", "branch_line_id"]
    spans = stored(phases.filter((F.col("commit_count") > 0) & (F.col("ramp_seconds") != 0)).select("repo_slug", "commit_count", *order))
    numbered = number_rows(spans, ["repo_slug"], F.coalesce(F.floor(F.col("start_at") / 86400), F.lit(-(1 << 40))), [F.col(c) for c in order], "_rn")
    step = F.lit(bucket_size) if bucket_size else F.greatest(F.lit(1), F.floor(F.count("*") / 12))
    rows = numbered.join(spans.groupBy("repo_slug").agg(step.alias("_step")), "repo_slug").withColumn("bucket", F.floor(F.col("_rn") / F.col("_step")))
    day = lambda c: F.round(F.col(c) / 864).cast("long")  # noqa: E731  hundredths, in which medians and percentiles are exact
    half = F.floor(day("ramp_seconds") / 200) * 100
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"commits": F.col("commit_count") * 100, "cycle": F.coalesce(day("total_seconds"), zero) - half, "close": day("close_seconds"), "work": half + F.coalesce(day("work_seconds"), zero)})
    names = ("commits", "cycle", "close", "work")
    keys = ["repo_slug", "bucket"]
    rows = stored(rows.select(*keys, "start_at", "commit_count", *names))
    counts = stored(counts_by_value(rows.select(*keys, *names).unpivot(keys, list(names), "measure", "days"), [*keys, "measure"], "days"))
    ranked = percentiles(counts, [*keys, "measure"], {"p50": 0.5, "p75": 0.75}, 100_000)
    wide = ranked.groupBy(*keys).agg(*((F.round(F.max(F.when(F.col("measure") == c, F.col(p)))) / 100).alias(f"{p}_{c}") for p in ("p50", "p75") for c in names))
    means = [(F.round(f(c)) / 100).alias(f"{n}_{c}") for n, f in (("avg", F.avg), ("std", F.stddev_samp)) for c in names]
    found = rows.groupBy(*keys).agg(F.min("start_at").alias("interval_start"), F.count("*").alias("branches"), F.sum("commit_count").alias("total_commits"), *means)
    return joined(found, wide, keys).select(*keys, "interval_start", "branches", "total_commits", *(f"{m}_{c}" for m in ("p50", "p75", "avg", "std") for c in names))
