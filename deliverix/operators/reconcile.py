"""Comparison of result tables, and rules that a commit interchange must keep."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliverix.operators.steps import stored

#: Absolute tolerances by metric and column; columns not named compare exactly.
TOLERANCES = {
    "cycle_time_monthly": {"sum_minutes": 2.0, "avg_minutes": 2.0, "p75_minutes": 2.0, "std_minutes": 2.0},
    "cycle_time_delta_events": {"cycle_minutes": 0.02},
    "change_failure_monthly": {"failure_rate": 0.05},
    "throughput_per_active_developer_weekly": {"commits_per_author": 1e-9},
    "throughput_per_active_developer_monthly": {"commits_per_author": 1e-9},
    "author_commit_percentiles": {"percentile": 1e-9},
    "multi_repo_aggregate": {"value_real": 1e-9},
}
RELATIVE = {"multi_repo_aggregate": 1e-9}


#: Ranges of the hash of a key, for each value of the first key column.
RANGES = 256


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_range", F.pmod(F.xxhash64(*keys), F.lit(RANGES)))


def unequal_ranges(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(first key column, _range) of the ranges of keys whose rows differ in the common columns, by digests that don't depend on the rows' order.

    A digest is the rows' number with an exclusive or and a sum of their hashes; the tables are read once for it, and a row for each range is shuffled.
    """
    common = [c for c in left.columns if c in right.columns]
    h = F.xxhash64(*common)
    part = lambda df: _ranged(df, keys).groupBy(F.col(keys[0]).alias("_key"), "_range").agg(F.struct(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).alias("digest"))
    both = part(left).withColumn("_left", F.lit(1)).unionAll(part(right).withColumn("_left", F.lit(0)))
    sides = both.groupBy("_key", "_range").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    return sides.filter("n < 2 or lo != hi").select(F.col("_key").alias(keys[0]), "_range")


def rows_of_ranges(df: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of df whose keys lie in the ranges."""
    few = ranges.withColumnsRenamed({keys[0]: "_key", "_range": "_of"})
    return _ranged(df, keys).join(few, F.col(keys[0]).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")), "left_semi").drop("_range")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerances: dict[str, float] | None = None, relative: float = 0.0) -> DataFrame:
    """Rows that differ: keys, column, problem ('only left', 'only right', 'value mismatch') and both values as text.

    Ranges of keys with equal digests are left out of the join. Both tables are read twice, so they should be stored ones.
    """
    tolerances = tolerances or {}
    ranges = unequal_ranges(left, right, keys)
    left, right = (rows_of_ranges(df, ranges, keys) for df in (left, right))
    columns = [c for c in left.columns if c not in keys and c in right.columns]
    a = left.select(*keys, *(F.col(c).alias(f"l_{c}") for c in columns), F.lit(True).alias("_l")).alias("a")
    b = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in columns), F.lit(True).alias("_r")).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    j = a.join(b, same, "full_outer")

    def differs(c: str) -> Column:
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        if c in tolerances:
            apart = F.abs(x - y) > F.greatest(F.lit(tolerances[c]), relative * F.greatest(F.abs(x), F.abs(y)))
            return F.coalesce(apart, ~x.eqNullSafe(y))
        return ~x.eqNullSafe(y)

    found = F.when(F.col("_r").isNull(), F.array(_problem("only left"))).when(F.col("_l").isNull(), F.array(_problem("only right")))
    values = [F.when(differs(c), _problem("value mismatch", c)) for c in columns]
    each = found.otherwise(F.filter(F.array(*values), lambda x: x.isNotNull()) if values else F.array().cast("array<struct<problem:string,name:string,left:string,right:string>>"))
    out = j.select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys), F.explode(each).alias("d"))
    return out.select(*keys, F.col("d.problem").alias("problem"), F.col("d.name").alias("column"), F.col("d.left").alias("left_value"), F.col("d.right").alias("right_value"))


def _problem(kind: str, c: str | None = None) -> Column:
    text = lambda side: F.col(f"{side}_{c}").cast("string") if c else F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("problem"), F.lit(c).cast("string").alias("name"), text("l").alias("left"), text("r").alias("right"))


def reconcile_metric(metric: str, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return reconcile(left, right, keys, TOLERANCES.get(metric), RELATIVE.get(metric, 0.0))


def audit_line(df: DataFrame, period: str, author: str | None = None) -> DataFrame:
    """One row: rows, first and last period, distinct authors."""
    people = F.countDistinct(author) if author else F.lit(None).cast("long")
    return df.agg(F.count("*").alias("row_count"), F.min(period).cast("string").alias("first_period"), F.max(period).cast("string").alias("last_period"), people.alias("authors"))


#: The texts that enumerations may hold.
PROFILES = ("none", "pseudonym_hmac", "pseudonym_hmac_strict", "encrypted_identity")
SCOPES = ("subject", "body", "subject_and_body", "subject_or_body_subject", "subject_or_body_body")
REQUIRED = (
    "repo_slug", "sha", "parent_shas", "parent_count", "committed_at", "period_week", "week_monday_unix", "week_end_unix", "log_ordinal",
    "pii_protection_profile", "author_ref", "subject_has_keywords", "body_has_keywords", "schema_version",
)


def _ordered(ord_: Column, sha: Column) -> Column:
    """A parent with its place; the exclusive or of all a commit's parents is its digest."""
    return F.xxhash64(ord_.cast("int"), sha)


def validate_interchange(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, repo_slug, sha) for every violation; an absent column is one row without repository and sha, and its rules are not looked at.

    A commit's parents are compared by a digest of (place, sha) of each, made of the edges and of parent_shas, so that their order counts and
    no list is gathered. A parent may be missing from the snapshot. Edges are read once, commits twice (their keys alone the second time), so
    commits that cost much should be stored ones.
    """
    has = set(commits.columns)
    rules: dict[str, Column] = {f"not null: {c}": F.col(c).isNull() for c in REQUIRED if c in has}
    if "parent_count" in has:
        rules["parent_count >= 0"] = F.col("parent_count") < 0
    for c in ("subject_has_keywords", "body_has_keywords"):
        if c in has:
            rules[f"0 or 1: {c}"] = ~F.col(c).isin(0, 1)
    if "pii_protection_profile" in has:
        rules["known profile"] = ~F.col("pii_protection_profile").isin(*PROFILES)
    if "conventional_type_scope" in has:
        rules["known scope"] = ~F.col("conventional_type_scope").isin(*SCOPES)
        if "conventional_type" in has:
            rules["type and scope together"] = F.col("conventional_type").isNull() != F.col("conventional_type_scope").isNull()
    missing = [("column: " + c,) for c in (*REQUIRED, "conventional_type", "conventional_type_scope") if c not in has]
    missing += [("column: edges." + c,) for c in ("repo_slug", "child_sha", "parent_sha", "parent_ord") if c not in edges.columns]
    nobody = [F.lit(None).cast("string").alias(c) for c in ("repo_slug", "sha")]
    absent = commits.sparkSession.createDataFrame(missing, "rule string").select("rule", *nobody)
    if not {"repo_slug", "sha"} <= has:
        return absent
    named_rules = lambda rules: F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    exploded = lambda df, broken: df.select(F.explode(broken).alias("rule"), "repo_slug", "sha")
    several = commits.groupBy("repo_slug", "sha").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("unique commit").alias("rule"), "repo_slug", "sha")
    parts = [absent, several]
    if not {"repo_slug", "child_sha", "parent_sha", "parent_ord"} <= set(edges.columns):
        return reduce(DataFrame.unionAll, [*parts, exploded(commits, named_rules(rules))])
    by_place = (
        edges.select("repo_slug", F.col("child_sha").alias("sha"), "parent_ord", _ordered(F.col("parent_ord"), F.col("parent_sha")).alias("digest")).repartition("repo_slug", "sha")
        .groupBy("repo_slug", "sha", "parent_ord").agg(F.count("*").alias("n"), F.bit_xor("digest").alias("digest"))
    )
    per = stored(
        by_place.groupBy("repo_slug", "sha").agg(
            F.sum("n").alias("edges"), F.min("parent_ord").alias("lo"), F.max("parent_ord").alias("hi"), F.bit_xor("digest").alias("digest"), F.count_if(F.col("n") > 1).cast("int").alias("twice")
        )
    )
    disordered = F.when((F.col("lo") != 0) | (F.col("hi") != F.col("edges") - 1), F.array(F.lit("parents in order from 0"))).otherwise(F.array().cast("array<string>"))
    parts.append(exploded(per.filter((F.col("twice") > 0) | (F.col("lo") != 0) | (F.col("hi") != F.col("edges") - 1)), F.concat(F.array_repeat(F.lit("unique edge"), F.col("twice")), disordered)))
    own, n, matches = {"broken": named_rules(rules)}, F.coalesce("edges", F.lit(0)), {}
    if "parent_count" in has:
        own["parent_count"] = F.col("parent_count")
        matches["edges match parent_count"] = n != F.col("parent_count")
    if "parent_shas" in has:
        listed = F.filter(F.split("parent_shas", " +"), lambda x: x != "")
        own["listed"] = F.size(listed)
        own["listed_digest"] = F.aggregate(F.transform(listed, lambda x, i: _ordered(i, x)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
        matches["edges match parent_shas"] = (F.col("listed") != n) | (F.col("listed_digest") != F.coalesce("digest", F.lit(0)))
    sides = commits.select("repo_slug", "sha", *(v.alias(k) for k, v in own.items()), F.lit(True).alias("_known")).join(per.select("repo_slug", "sha", "edges", "digest"), ["repo_slug", "sha"], "full_outer")
    told = F.concat("broken", named_rules(matches)) if matches else F.col("broken")
    parts.append(exploded(sides, F.when(F.col("_known"), told).otherwise(F.array(F.lit("edge of a known commit")))))
    return reduce(DataFrame.unionAll, parts)
