"""Schemas and integrity rules of the ledger's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"long": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def _struct(columns: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


TABLES: dict[str, StructType] = {
    name: _struct(ddl)
    for name, ddl in {
        "items": "item_id long, item_type string, title string, project_key string, scope_json string, status string, owner_user_id string, created_at timestamp, updated_at timestamp",
        "item_events": "event_id long, item_id long, event_type string, status_from string, status_to string, payload_json string, actor_user_id string, source string, created_at timestamp",
        "attachments": "attachment_id long, item_id long, kind string, uri string, sha256 string, size_bytes long, meta_json string, created_at timestamp",
        "kv": "namespace string, key string, value_json string, updated_at timestamp",
        "outbox": "outbox_id long, item_id long, target_space string, payload_md string, payload_sha string, status string, retry_count int, next_attempt_at timestamp, locked_at timestamp, locked_by string, last_error string, created_at timestamp, updated_at timestamp",
        "repos": "repo_id long, repo_type string, url string, project_key string, default_branch string, created_at timestamp",
        "patch_blobs": "blob_id long, source_type string, source_id string, uri string, evidence_uri string, sha256 string, size_bytes long, format string, chunking_version string, meta_json string, created_at timestamp, updated_at timestamp",
        "knowledge": "candidate_id long, run_id long, kind string, title string, content_md string, confidence string, evidence_refs_json string, promote_suggested boolean, created_at timestamp",
        "write_audit": "audit_id long, actor_user_id string, target_space string, action string, reason string, payload_sha string, evidence_refs_json string, correlation_id string, status string, created_at timestamp, updated_at timestamp",
        "sync_runs": "run_id string, repo_id long, job_type string, mode string, started_at timestamp, finished_at timestamp, counts string, error_summary_json string, status string, synced_count int",
        "sync_locks": "lock_id long, repo_id long, job_type string, locked_by string, locked_at timestamp, lease_seconds int, updated_at timestamp, created_at timestamp",
        "sync_jobs": "job_id string, repo_id long, job_type string, mode string, priority int, payload_json string, status string, attempts int, max_attempts int, not_before timestamp, locked_by string, locked_at timestamp, lease_seconds int, last_error string, instance string, tenant_id string, created_at timestamp, updated_at timestamp",
        "object_store_events": "provider string, event_ts timestamp, bucket string, object_key string, operation string, status_code int, request_id string, principal string, remote_ip string, raw string",
    }.items()
}

#: Keys that make a write repeatable.
KEYS: dict[str, list[str]] = {
    "attachments": ["item_id", "kind", "sha256"],
    "kv": ["namespace", "key"],
    "repos": ["repo_type", "url"],
    "patch_blobs": ["source_type", "source_id", "sha256"],
    "sync_locks": ["repo_id", "job_type"],
    "items": ["item_id"],
    "item_events": ["event_id"],
    "outbox": ["outbox_id"],
    "sync_runs": ["run_id"],
    "sync_jobs": ["job_id"],
    "write_audit": ["audit_id"],
}

#: What must hold of each row.
CHECKS: dict[str, dict[str, str]] = {
    "repos": {"repo_type": "repo_type in ('git', 'svn')"},
    "patch_blobs": {"sha256": "sha256 rlike '^[0-9a-f]{64}$'"},
    "write_audit": {"action": "action in ('allow', 'redirect', 'reject')", "status": "status in ('pending', 'success', 'failed', 'redirected')"},
    "outbox": {"status": "status in ('pending', 'sent', 'dead')", "retry_count": "retry_count >= 0"},
    "sync_runs": {"status": "status in ('running', 'completed', 'failed', 'no_data')"},
    "sync_jobs": {"status": "status in ('pending', 'running', 'completed', 'failed', 'dead')", "attempts": "attempts >= 0"},
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that break a rule of the table, once for each rule, with the rule's name; a null result breaks it."""
    rules = CHECKS.get(table, {})
    broken = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    found = F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")
    return df.withColumn("violates", F.explode(found))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def schema_drift(df: DataFrame, table: str) -> list[tuple[str, str, str]]:
    """(column, expected, found) where df differs from the table's schema; missing is ''."""
    want, have = dict((f.name, f.dataType.simpleString()) for f in TABLES[table]), dict(df.dtypes)
    return [(c, want.get(c, ""), have.get(c, "")) for c in sorted({*want, *have}) if want.get(c) != have.get(c)]


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns and types, in its order; what is missing is null."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]])


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, together; true for none."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)
