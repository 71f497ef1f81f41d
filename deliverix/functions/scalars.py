"""Scalar expressions on commits, repositories and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a commit as a fix, looked for as substrings.
KEYWORDS = ("revert", "hotfix", "bugfix", "bug", "fix", "problem", "issue")
#: Commit types of a conventional subject.
CONVENTIONAL = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "revert")

ALL_BRANCHES, SQUASH = "all-branches", "squash"
WORK_STYLES = (ALL_BRANCHES, SQUASH)


def require_work_style(work_style: str) -> str:
    if work_style not in WORK_STYLES:
        raise ValueError(f"unknown work style {work_style!r}; one of {', '.join(WORK_STYLES)}")
    return work_style


def has_keywords(text: Column) -> Column:
    """Whether lower-cased text holds a keyword; null text holds none."""
    return F.coalesce(F.lower(text).rlike("|".join(KEYWORDS)), F.lit(False))


def keyword_flags(subject: Column, body: Column) -> dict[str, Column]:
    return {"subject_has_keywords": has_keywords(subject).cast("int"), "body_has_keywords": has_keywords(body).cast("int")}


def fix_like(work_style: str = ALL_BRANCHES) -> Column:
    """From the flags: either one, or the subject's alone for squashed work."""
    subject, body = F.col("subject_has_keywords") == 1, F.col("body_has_keywords") == 1
    return subject | body if require_work_style(work_style) == ALL_BRANCHES else subject


def first_line(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def fix_like_message(message: Column, work_style: str = ALL_BRANCHES) -> Column:
    """From the raw message: all of it, or its first line for squashed work."""
    return has_keywords(message if require_work_style(work_style) == ALL_BRANCHES else first_line(message))


def half_even(x: Column) -> Column:
    """Whole number, ties to even."""
    return F.bround(x, 0).cast("long")


def minutes_to_days(x: Column) -> Column:
    return x / 1440


def is_remote(path: Column) -> Column:
    return path.rlike("^(https?://|git@|ssh://)")


def repo_name_from_url(url: Column, directory: Column | None = None) -> Column:
    """Last part of a URL without .git; else the directory's name, else 'repo'."""
    name = F.nullif(F.regexp_extract(F.regexp_replace(F.trim(url), "/+$", ""), r"([^/:]+?)(\.git)?$", 1), F.lit(""))
    from_directory = F.nullif(F.regexp_extract(directory, r"([^/]+)/*$", 1), F.lit("")) if directory is not None else F.lit(None).cast("string")
    return F.coalesce(name, from_directory, F.lit("repo"))


def repo_id(name: Column) -> Column:
    return F.concat(F.lit("local:"), name)


def commit_type(parents: Column) -> Column:
    """'<<' for a merge, else '<'."""
    return F.when(F.size(parents) > 1, "<<").otherwise("<")


def branch_line_id(strategy: str, merge: Column, root: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(strategy), F.coalesce(merge, F.lit("")), root), 256)


def cohort_id(paths: Column) -> Column:
    """Aggregate: first 24 digits of the hash of the distinct, sorted paths, one a line."""
    return F.left(F.sha2(F.array_join(F.array_sort(F.collect_set(paths)), "\n"), 256), F.lit(24))


def value_json(value: Column) -> Column:
    return F.to_json(value)


def conventional_type(subject: Column) -> Column:
    """Type of a conventional subject ('feat(api)!: ...'), else null."""
    found = F.regexp_extract(F.lower(subject), rf"^({'|'.join(CONVENTIONAL)})(\([^)]*\))?!?:", 1)
    return F.nullif(found, F.lit(""))


def canonical_author(tenant: Column, repo: Column, email: Column) -> Column:
    return F.concat(F.lit("t:"), tenant, F.lit("|r:"), repo, F.lit("|e:"), F.lower(F.trim(email)))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of text, by built-in hashes; only the padded keys are made here."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def pseudonymize(profile: str, key: bytes, tenant: Column, repo: Column, email: Column, label: Column) -> dict[str, Column]:
    """author_ref and author_label_pii under a protection profile."""
    if profile == "none":
        return {"author_ref": F.lower(F.trim(email)), "author_label_pii": label}
    if profile not in ("pseudonym_hmac", "pseudonym_hmac_strict"):
        raise ValueError(f"unsupported protection profile {profile!r}")
    strict = profile.endswith("strict")
    return {
        "author_ref": hmac_sha256(key, canonical_author(F.coalesce(tenant, F.lit("")), repo, email)),
        "author_label_pii": F.lit(None).cast("string") if strict else label,
    }
