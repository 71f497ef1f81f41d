"""Readers of exported history: logs, messages, edges, refs, objects, configuration and result files."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): lines of each file with their place. Files are split by size; the place is a byte-order number, dense within a file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    from pyspark.sql import Window as W

    within = F.row_number().over(W.partitionBy("file", "block").orderBy("id")) - 1
    counts = text.groupBy("file", "block").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", "block", before.alias("before"))
    return text.withColumn("within", within).join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("within")).alias("n"), F.col("value").alias("line"))


def _repo(repo_slug: Column | str | None) -> Column:
    """A given repository, or the name of the file without its ending."""
    if repo_slug is None:
        return F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return F.lit(repo_slug) if isinstance(repo_slug, str) else repo_slug


def read_git_log(spark: SparkSession, path: str, repo_slug: Column | str | None = None) -> DataFrame:
    """Log files, newest first, of `epoch|sha|tree|parents|email|name`; the name may hold bars. A file is a repository."""
    p = F.split("line", r"\|", 6)
    rows = _lines(spark, path).filter(F.size(p) == 6)
    return rows.select(
        _repo(repo_slug).alias("repo_slug"), p[1].alias("sha"), p[2].alias("tree"), F.filter(F.split(p[3], " +"), lambda x: x != "").alias("parents"),
        p[4].alias("author_email"), p[5].alias("author_name"), p[0].cast("long").alias("committed_at"), F.col("n").alias("log_ordinal"),
    )


def read_commit_messages(spark: SparkSession, path: str) -> DataFrame:
    """Records ended by NUL of sha, subject, body and raw message, set apart by the unit separator; ones without a 40-character sha are skipped."""
    p = F.split("value", "\x1f", 4)
    rows = spark.read.option("lineSep", "\0").text(path).filter(F.trim("value") != "").select(p.alias("p")).filter(F.size("p") >= 2)
    part = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    out = rows.select(F.trim(F.translate(part(0), "\n\r\t", "   ")).alias("sha"), part(1).alias("subject"), part(2).alias("body"), part(3).alias("raw"))
    return out.filter(F.length("sha") == 40)


def read_parent_edges(spark: SparkSession, path: str, repo_slug: Column | str | None = None) -> DataFrame:
    """Lines `child parent parent ...`: an edge for each parent, in order from 0."""
    p = F.filter(F.split("line", " +"), lambda x: x != "")
    rows = _lines(spark, path).select(_repo(repo_slug).alias("repo_slug"), p.alias("p")).filter(F.size("p") > 1)
    return rows.select("repo_slug", F.col("p")[0].alias("child_sha"), F.posexplode(F.slice("p", 2, 1_000_000)).alias("parent_ord", "parent_sha"))


def read_refs(spark: SparkSession, path: str, repo_slug: Column | str | None = None) -> DataFrame:
    """Lines `object type ref`, with their place."""
    p = F.split("line", " ", 3)
    rows = _lines(spark, path).filter(F.size(p) == 3)
    return rows.select(_repo(repo_slug).alias("repo_slug"), p[0].alias("tip_sha"), p[1].alias("object_type"), p[2].alias("ref_name"), F.col("n").alias("line_no"))


def refs_by_tip(refs: DataFrame) -> DataFrame:
    """One ref for each tip: the last that was listed."""
    return refs.groupBy("repo_slug", "tip_sha").agg(F.max_by("ref_name", "line_no").alias("ref_name"))


def read_object_ids(spark: SparkSession, path: str, repo_slug: Column | str | None = None) -> DataFrame:
    """First word of each line, once each, with the place where it was first seen."""
    rows = _lines(spark, path).select(_repo(repo_slug).alias("repo_slug"), F.split(F.trim("line"), " +")[0].alias("object_id"), "n").filter("object_id != ''")
    return rows.groupBy("repo_slug", "object_id").agg(F.min("n").alias("ordinal"))


REPO_CONFIG = T.StructType([T.StructField("repositories", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "path_or_url", "branch", "description")])))])


def read_repo_config(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of a JSON configuration; one without name or place spoils its file, which then gives none."""
    files = spark.read.option("multiLine", True).schema(REPO_CONFIG).json(path)
    sound = F.forall("repositories", lambda r: r["name"].isNotNull() & r["path_or_url"].isNotNull())
    return files.filter(sound).select(F.explode("repositories").alias("r")).select("r.*")


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header, or no rows where the path doesn't exist."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_metrics_csv(spark: SparkSession, folder: str, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Saved cycle time and change failure series of all repositories; repo_slug is null in files of one."""
    cycle = _csv(spark, f"{folder}/{prefix}cycle_time_data.csv", "Month string, Sum double, Average double, p75 double, std double, repo_slug string")
    return cycle, _csv(spark, f"{folder}/{prefix}change_failure_data.csv", "Month string, Rate double, repo_slug string")


def read_work_categories(spark: SparkSession, path: str) -> DataFrame:
    """Month and one column for each category, whatever they are called."""
    wide = spark.read.csv(path, header=True)  # all text, so that the file is read once
    return wide.select(*(F.col(f"`{c}`") if c == "Month" else F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns))


def read_sprint_completion(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "Week string, Committed double, Completed double, `Percentage Completed` double")


def read_commits_export(spark: SparkSession, path: str, repo_slug: str | None = None) -> DataFrame:
    """The interchange table, a folder for each repository; a repository reads its folder only."""
    df = spark.read.parquet(path)
    return df if repo_slug is None else df.filter(F.col("repo_slug") == repo_slug)


def from_lake(lake: DataFrame, repo: str | None = None) -> DataFrame:
    """Lake commits as operators expect them."""
    df = lake if repo is None else lake.filter(F.col("_raw_data_params") == repo)
    return df.select(F.col("_raw_data_params").alias("repo_slug"), "sha", F.col("author_email").alias("author_ref"), F.col("committed_date").alias("committed_at"), "message", "log_ordinal")


def from_devlake(commits: DataFrame, parents: DataFrame, refs: DataFrame, repo_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits, edges and refs from a DevLake database's tables; it has no log order, so pairs are made by time. Without parent_ord (the usual tables have none)
    nobody knows the first parent: parents are numbered by sha, which does for reachability and counts, and not for branch lines."""
    warnings.warn("no log ordinals: commits are paired by time", stacklevel=2)
    if "parent_ord" not in parents.columns:
        warnings.warn("no order of parents: first parents, and so branch lines, are arbitrary", stacklevel=2)
    mine = commits if repo_ids is None else commits.filter(F.col("_raw_data_params").isin(*repo_ids))
    c = mine.select(F.col("_raw_data_params").alias("repo_slug"), "sha", F.col("author_email").alias("author_ref"), F.unix_timestamp("committed_date").alias("committed_at"), "message", F.lit(None).cast("long").alias("log_ordinal"))
    order = F.col("parent_ord") if "parent_ord" in parents.columns else F.row_number().over(_by_child()) - 1
    e = parents.join(c.select(F.col("sha").alias("commit_sha"), "repo_slug"), "commit_sha").select("repo_slug", F.col("commit_sha").alias("child_sha"), F.col("parent_commit_sha").alias("parent_sha"), order.cast("int").alias("parent_ord"))
    r = refs if repo_ids is None else refs.filter(F.col("repo_id").isin(*repo_ids))
    return c, e, r.select(F.col("repo_id").alias("repo_slug"), F.col("name").alias("ref_name"), F.col("commit_sha").alias("tip_sha"))


def _by_child():
    from pyspark.sql import Window as W

    return W.partitionBy("repo_slug", "commit_sha").orderBy("parent_commit_sha")


def read_devlake(spark: SparkSession, url: str, properties: dict[str, str], repo_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = lambda name: spark.read.jdbc(url, name, properties=properties)
    return from_devlake(t("commits"), t("commit_parents"), t("refs"), repo_ids)


def first_repo_id(commits: DataFrame, column: str = "repo_slug") -> DataFrame:
    """One row: the smallest repository, null for an empty table."""
    return commits.agg(F.min(column).alias("repo_slug"))


def list_repo_ids(refs: DataFrame, column: str = "repo_slug") -> DataFrame:
    return refs.select(F.col(column).alias("repo_slug")).distinct()
