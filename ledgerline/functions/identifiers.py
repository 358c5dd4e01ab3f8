"""Ids, URLs and keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_id(kind: Column, repo_id: Column, number: Column) -> Column:
    """svn:<repo>:<revision>, git:<repo>:<sha> or mr:<repo>:<iid>."""
    return F.concat_ws(":", kind, repo_id.cast("string"), number.cast("string"))


def parse_source_id(value: Column) -> Column:
    """(kind, repo_id, number, valid): git numbers are hexadecimal, the others decimal."""
    parts = F.split(value, ":", 3)
    valid = value.rlike(r"^(svn|mr):[0-9]+:[0-9]+$") | value.rlike(r"^git:[0-9]+:[0-9a-fA-F]{7,40}$")
    return F.struct(F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).try_cast("long").alias("repo_id"), F.get(parts, F.lit(2)).alias("number"), F.coalesce(valid, F.lit(False)).alias("valid"))


def normalize_url(url: Column) -> Column:
    """Trimmed, without slashes at the end."""
    return F.rtrim(F.trim(url), F.lit("/"))


def repo_url(instance: Column, project: Column) -> Column:
    return F.concat(normalize_url(instance), F.lit("/"), F.trim(project, F.lit("/")))


def instance_key(url: Column) -> Column:
    """The host in small letters, without user, path and the ports 80 and 443; null for nothing."""
    rest = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(rest, r"[/?#].*$", ""), r"^.*@", "")
    return F.nullif(F.regexp_replace(host, r":(80|443)$", ""), F.lit(""))


def tenant_id(payload: Column, project: Column) -> Column:
    """The payload's tenant_id, else the first part of a project path that has several; null for neither."""
    first = F.when(project.contains("/"), F.nullif(F.trim(F.split_part(project, F.lit("/"), F.lit(1))), F.lit("")))
    return F.coalesce(F.nullif(F.trim(F.get_json_object(payload, "$.tenant_id")), F.lit("")), first)


#: Logical job types and what carries them out for each kind of repository.
JOB_TYPES = {("git", "commits"): "gitlab_commits", ("git", "mrs"): "gitlab_mrs", ("git", "reviews"): "gitlab_reviews", ("svn", "commits"): "svn"}
LOGICAL_TYPES = ("commits", "mrs", "reviews")
#: Logical types that a kind of repository has no physical job for.
UNSUPPORTED = {("svn", "mrs"), ("svn", "reviews")}


def physical_job_type(repo_type: Column, logical: Column) -> Column:
    """(job_type, reason): null with a reason where the pair is not possible."""
    out = None
    for (kind, name), job in JOB_TYPES.items():
        hit = (repo_type == kind) & (logical == name)
        out = F.when(hit, F.lit(job)) if out is None else out.when(hit, F.lit(job))
    reason = F.when(~logical.isin(*LOGICAL_TYPES), "unknown_job_type").when(~repo_type.isin("git", "svn"), "unknown_repo_type").when(out.isNull(), "unsupported_for_repo_type")
    return F.struct(out.alias("job_type"), reason.alias("reason"))


def logical_job_type(physical: Column) -> Column:
    out = F.when(physical == "svn", "commits")
    for (_, name), job in JOB_TYPES.items():
        out = out.when(physical == job, F.lit(name))
    return out


def breaker_key(project: Column, scope: Column, name: Column) -> Column:
    """project:scope[:id]."""
    return F.concat_ws(":", project, scope, F.nullif(name, F.lit("")))


def parse_breaker_key(key: Column) -> Column:
    """(project, scope, id); a key of one part is a global breaker, and ids may hold colons."""
    parts = F.split(key, ":", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("project"), F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.lit("global")).alias("scope"), F.get(parts, F.lit(2)).alias("id"))


def legacy_breaker_keys(key: Column) -> Column:
    """Keys under which older versions kept a breaker, in the order in which they are asked: the scope, its bare name, then the key itself."""
    rest = F.regexp_extract(key, "^[^:]*:(.*)$", 1)
    named = F.regexp_extract(rest, "^(?:pool|instance|tenant):(.*)$", 1)
    scoped = F.when(rest == "global", F.array(F.lit("global"))).when(rest.rlike("^(pool|instance|tenant):"), F.array(rest, named)).otherwise(F.array().cast("array<string>"))
    own = F.when(key.contains(":") & ~key.startswith("worker:"), F.array(key)).otherwise(F.array().cast("array<string>"))
    return F.when(key.contains(":"), F.concat(scoped, own)).otherwise(F.array().cast("array<string>"))


def space_kind(space: Column) -> Column:
    return F.split_part(space, F.lit(":"), F.lit(1))
