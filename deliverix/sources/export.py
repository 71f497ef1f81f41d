"""Builders of the interchange and lake tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverix.functions import scalars as s
from deliverix.functions.time import week_bounds
from deliverix.operators.graph import with_parents

SCHEMA_VERSION = 3


def _one_of_each(df: DataFrame) -> DataFrame:
    """Of rows with one repository and sha, the last of the log."""
    w = W.partitionBy("repo_slug", "sha").orderBy(F.desc("log_ordinal"))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def build_commits_export(log: DataFrame, messages: DataFrame, edges: DataFrame, tz: str = "UTC", profile: str = "none", key: bytes = b"", tenant: str | None = None) -> DataFrame:
    """The interchange rows of a log, its messages (empty where missing) and its edges."""
    joined = _one_of_each(log.drop("parents")).join(messages.dropDuplicates(["sha"]), "sha", "left").fillna({"subject": "", "body": ""})
    who = s.pseudonymize(profile, key, F.lit(tenant), F.col("repo_slug"), F.col("author_email"), F.lit(None).cast("string"))
    if profile == "none":
        who["author_ref"] = F.col("author_email")
    kind = s.conventional_type(F.col("subject"))
    rows = joined.withColumns({**who, **week_bounds(F.col("committed_at"), tz), **s.keyword_flags(F.col("subject"), F.col("body"))})
    rows = rows.withColumns({
        "committer_tz_offset": F.lit(None).cast("string"), "pii_protection_profile": F.lit(profile), "conventional_type": kind,
        "conventional_type_scope": F.when(kind.isNotNull(), "subject"), "schema_version": F.lit(SCHEMA_VERSION), "tenant_id": F.lit(tenant).cast("string"),
    })
    return with_parents(rows, edges).select(
        "repo_slug", "sha", "parent_shas", "parent_count", "committed_at", "period_week", "week_monday_unix", "week_end_unix", "log_ordinal", "committer_tz_offset", "pii_protection_profile",
        "author_ref", "author_label_pii", "subject_has_keywords", "body_has_keywords", "conventional_type", "conventional_type_scope", "schema_version", "tenant_id",
    )


def build_lake_commits(log: DataFrame, messages: DataFrame) -> DataFrame:
    """Lake rows; a message is stripped, and null when nothing is left."""
    raw: Column = F.nullif(F.regexp_replace(F.coalesce("raw", F.lit("")), r"^\s+|\s+$", ""), F.lit(""))
    joined = _one_of_each(log.select("repo_slug", "sha", "author_email", "committed_at", "log_ordinal")).join(messages.dropDuplicates(["sha"]).select("sha", "raw"), "sha", "left")
    return joined.select("sha", "author_email", F.col("committed_at").alias("committed_date"), F.col("repo_slug").alias("_raw_data_params"), raw.alias("message"), "log_ordinal")


def short_sha(shas: DataFrame, least: int = 4) -> DataFrame:
    """Length of the shortest prefix that is unique in the repository, at least 4. Neighbours in sorted order decide; shas are sorted within their first four characters, and those alone need no more."""
    w = W.partitionBy("repo_slug", F.left("sha", F.lit(4))).orderBy("sha")
    common = lambda other: F.coalesce(F.length(F.regexp_extract(F.concat("sha", F.lit("\n"), other), r"(?s)^(.*).*\n\1", 1)), F.lit(0))
    distinct = shas.select("repo_slug", "sha").distinct().withColumn("_lag", F.lag("sha").over(w)).withColumn("_lead", F.lead("sha").over(w))
    return distinct.select("repo_slug", "sha", F.greatest(F.lit(least), common(F.col("_lag")) + 1, common(F.col("_lead")) + 1).alias("length"))


def resolve_sha_prefix(prefixes: DataFrame, objects: DataFrame) -> DataFrame:
    """prefixes(repo_slug, prefix), of any length, with the object that is it, else the first in the list that starts with it, else null.

    Objects are brought down to the first of the list for each head of a length that occurs among the prefixes (at most as many as an id
    has characters). That is partial in the tasks that read them, so that short prefixes, which many objects have, are no hot keys.
    """
    longest = objects.agg(F.max(F.length("object_id"))).first()[0] or 0
    size = F.least(F.length("prefix"), F.lit(longest + 1))  # longer ones are no object's
    lengths = [r[0] for r in prefixes.select(size).distinct().collect() if r[0] is not None and r[0] <= longest]
    if not lengths:
        return prefixes.withColumn("object_id", F.lit(None).cast("string"))
    cut = F.explode(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("object_id")))
    place = F.struct((F.length("object_id") != F.col("n")).alias("longer"), F.col("ordinal"), F.col("object_id"))
    heads = objects.select("repo_slug", "object_id", "ordinal", cut.alias("n")).groupBy("repo_slug", F.left("object_id", F.col("n")).alias("prefix")).agg(F.min(place).alias("_first"))
    return prefixes.join(heads, ["repo_slug", "prefix"], "left").select(*prefixes.columns, F.col("_first.object_id").alias("object_id"))
