"""Integrity, health and garbage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.joins import normalized_key, orphan_locks, resolve_evidence
from ledgerline.operators.lookups import expired_jobs, missing_dimensions
from ledgerline.operators.state import HEALTH, pause_rows, pauses
from ledgerline.registry import query
from ledgerline.schemas import duplicates, violations
from ledgerline.sources.ledger import EVENTS_NOW, ORDERS_NOW, Ledger, age, seconds, ts


def check_blobs(blobs: DataFrame, attachments: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Blobs with a fault, the first that holds: no evidence uri, one of a wrong form, one that leads to nothing, a file (path, sha256) that is missing or differs."""
    uri = F.coalesce("evidence_uri", F.lit(""))
    rows = resolve_evidence(blobs, blobs, attachments.select("attachment_id", "sha256")) if "resolution" not in blobs.columns else blobs
    rows = rows.withColumnRenamed("resolution", "_r").drop("sha256", "kind").join(blobs.select("blob_id", "sha256"), "blob_id")
    fault = F.when(uri == "", "missing_evidence_uri").when(F.col("_r") == "invalid", "invalid_evidence_uri").when(F.col("_r") == "not_found", "not_found").when(F.col("_r") == "hash_mismatch", "sha_mismatch")
    if files is not None:
        held = files.select(normalized_key(F.col("path")).alias("_key"), F.col("sha256").alias("_file_sha"))
        rows = rows.withColumn("_key", normalized_key(F.col("uri"))).join(held, "_key", "left")
        fault = F.coalesce(fault, F.when(F.col("uri").isNotNull() & F.col("_file_sha").isNull(), "file_missing").when(F.col("_file_sha") != F.col("sha256"), "file_differs"))
    return rows.withColumn("fault", fault).where("fault is not null").select("blob_id", "evidence_uri", "fault")


def check_invariants(jobs: DataFrame, locks: DataFrame, kv: DataFrame, jobs_now: Column, kv_now: Column, grace: int = 60) -> DataFrame:
    """(name, severity, n) of five checks; the ledger is healthy when no critical one counts anything."""
    parts = [
        ("expired_running_jobs", "critical", expired_jobs(jobs, jobs_now, grace)), ("orphan_locks", "warning", orphan_locks(locks, jobs)), ("gitlab_jobs_missing_dimensions", "warning", missing_dimensions(jobs)),
        ("expired_pauses", "info", pauses(kv, kv_now, expired=True)), ("circuit_breaker_inconsistencies", "warning", breaker_faults(kv)),
    ]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), "n") for name, severity, df in parts]
    return reduce(DataFrame.unionByName, counts)


def healthy(invariants: DataFrame) -> DataFrame:
    """One row: healthy, and how many of the checks passed and failed."""
    return invariants.agg((F.count_if((F.col("severity") == "critical") & (F.col("n") > 0)) == 0).alias("healthy"), F.count_if(F.col("n") == 0).alias("passed"), F.count_if(F.col("n") > 0).alias("failed"))


def breaker_faults(kv: DataFrame) -> DataFrame:
    """Breakers (key-value rows of the health namespace) that are open without a failure or success to go by."""
    said = lambda c: F.coalesce(F.get_json_object("value_json", f"$.{c}").try_cast("int"), F.lit(0))
    rows = kv.where(F.col("namespace") == HEALTH).withColumns({"state": F.coalesce(F.get_json_object("value_json", "$.state"), F.lit("closed")), "failure_count": said("failure_count"), "success_count": said("success_count")})
    return rows.where((F.col("state") == "open") & (F.col("failure_count") + F.col("success_count") == 0)).select("key", F.lit("circuit_open_no_samples").alias("issue"), "state", "failure_count", "success_count")


def collect_garbage(files: DataFrame, references: DataFrame, now: Column, min_age: int = 86400, prefix: str | None = None) -> DataFrame:
    """files (path, size, modified_at) with state: outside, referenced, too_young or candidate. Temporary files (*.tmp) need no reference, only age."""
    used = references.where(F.col("uri").isNotNull() & (F.col("uri") != "") & ~F.col("uri").startswith("memory://")).select(normalized_key(F.col("uri")).alias("_key"), F.lit(True).alias("_used")).distinct()
    rows = files.withColumn("_key", normalized_key(F.col("path"))).join(used, "_key", "left")
    outside = F.lit(False) if prefix is None else ~F.col("_key").startswith(prefix)
    state = F.when(outside, "outside").when(F.col("_used") & ~F.col("path").endswith(".tmp"), "referenced").when(age(now, F.col("modified_at")) < min_age, "too_young").otherwise("candidate")
    return rows.withColumn("state", state).drop("_used", "_key")


def audit_artifacts(rows: DataFrame, files: DataFrame, head_only: bool = False) -> DataFrame:
    """rows (uri, sha256) against files (path, content or sha256, and error if some can't be read): missing, also where the uri is null or empty; error; ok,
    also where there is no hash to compare with; else mismatch. With head_only no content is read, and what is there is head_only."""
    digest = F.lit(None).cast("string") if head_only else F.sha2("content", 256) if "content" in files.columns else F.col("sha256")
    error = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    held = files.select(normalized_key(F.col("path")).alias("_key"), digest.alias("_sha"), error.alias("_error"), F.lit(True).alias("_there"))
    out = rows.withColumn("_key", F.when(F.col("uri") != "", normalized_key(F.col("uri")))).join(held, "_key", "left")
    known = F.coalesce("sha256", F.lit("")) != ""
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("_error"), "error")
    state = state.otherwise("head_only") if head_only else state.when(~known | (F.lower("_sha") == F.lower("sha256")), "ok").otherwise("mismatch")
    return out.withColumn("audit", state).drop("_key", "_sha", "_error", "_there")


def migrated(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """rows with the uris of one root under another: the next state of what migration_preview() lists."""
    root = old.rstrip("/") + "/"
    moved = F.concat(F.lit(new.rstrip("/") + "/"), F.substr(F.col(column), F.lit(len(root) + 1)))
    return rows.withColumn(column, F.when(F.col(column).startswith(root), moved).otherwise(F.col(column)))


def migration_preview(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Rows whose uri moves from one root to another, with the new uri. Only what really changes is listed."""
    moved = F.concat(F.lit(new.rstrip("/") + "/"), F.substr(F.col(column), F.lit(len(old.rstrip("/")) + 2)))
    return rows.where(F.col(column).startswith(old.rstrip("/") + "/")).withColumn("new_uri", moved)


@query("blob_faults", "SELECT blob_id, evidence_uri, CASE WHEN coalesce(evidence_uri, '') = '' THEN 'missing_evidence_uri' ELSE 'invalid_evidence_uri' END AS fault FROM patch_blobs WHERE blob_id % 5 <> 0")
def _blobs(db: Ledger):
    return check_blobs(db.patch_blobs(), db.attachments())


def _kept_state(db: Ledger) -> DataFrame:
    """Pauses and breakers as key-value rows, the last of each key."""
    last = db._events().groupBy("user_id", "event_type").agg(F.max_by(F.struct("ts", "k", "event_id"), F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", "m.*")
    held = last.select(F.col("user_id").alias("repo_id"), F.col("event_type").alias("job_type"), seconds(F.date_trunc("second", "ts"), F.col("k") * 3600).alias("paused_until"), F.lit("r").alias("reason"), F.col("ts").alias("updated_at"))
    k = F.col("k")
    value = F.to_json(F.struct(F.when(k % 3 == 0, "open").when(k % 3 == 1, "closed").alias("state"), F.when(k % 2 == 0, k % 8).alias("failure_count"), F.when(k % 5 == 0, 0).otherwise(k % 4).cast("string").alias("success_count")))
    return pause_rows(held).unionByName(last.select(F.lit(HEALTH).alias("namespace"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), value.alias("value_json"), F.col("ts").alias("updated_at")))


#: The last event of each user and type, as the key-value state above is made of it.
_KEPT = """, lk AS (SELECT user_id, event_type, ts, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM l_e) WHERE rn = 1)
"""


@query("invariants", _KEPT + f"""SELECT 'expired_running_jobs' AS name, 'critical' AS severity, count(*) AS n FROM sync_jobs WHERE status = 'running' AND locked_at IS NOT NULL AND locked_at + to_seconds(lease_seconds + 60) < TIMESTAMP '{ORDERS_NOW}'
UNION ALL SELECT 'orphan_locks', 'warning', count(*) FROM sync_locks l WHERE locked_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sync_jobs j WHERE j.repo_id = l.repo_id AND j.job_type = l.job_type AND j.status = 'running')
UNION ALL SELECT 'gitlab_jobs_missing_dimensions', 'warning', count(*) FROM sync_jobs WHERE status IN ('pending', 'running') AND job_type LIKE 'gitlab_%' AND (coalesce(instance, '') = '' OR coalesce(tenant_id, '') = '')
UNION ALL SELECT 'expired_pauses', 'info', count(*) FROM lk WHERE date_trunc('second', ts) + to_seconds(k * 3600) <= TIMESTAMP '{EVENTS_NOW}'
UNION ALL SELECT 'circuit_breaker_inconsistencies', 'warning', count(*) FROM lk WHERE k % 3 = 0 AND CASE WHEN k % 2 = 0 THEN k % 8 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0 ELSE k % 4 END = 0""")
def _invariants(db: Ledger):
    return check_invariants(db.sync_jobs(), db.sync_locks(), _kept_state(db), ts(ORDERS_NOW), ts(EVENTS_NOW))


@query("ledger_health", _KEPT + f"""SELECT count(*) FILTER (critical AND n > 0) = 0 AS healthy, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0) AS failed FROM (
  SELECT true AS critical, count(*) AS n FROM sync_jobs WHERE status = 'running' AND locked_at + to_seconds(lease_seconds + 60) < TIMESTAMP '1990-01-01' UNION ALL SELECT false, count(*) FROM sync_locks l WHERE locked_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sync_jobs j WHERE j.repo_id = l.repo_id AND j.job_type = l.job_type AND j.status = 'running')
  UNION ALL SELECT false, count(*) FROM sync_jobs WHERE status IN ('pending', 'running') AND job_type LIKE 'gitlab_%' AND coalesce(tenant_id, '') = '' UNION ALL SELECT false, count(*) FROM lk WHERE date_trunc('second', ts) + to_seconds(k * 3600) <= TIMESTAMP '{EVENTS_NOW}' UNION ALL SELECT false, count(*) FROM lk WHERE k % 3 = 0 AND CASE WHEN k % 2 = 0 THEN k % 8 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0 ELSE k % 4 END = 0)""")
def _ledger_health(db: Ledger):
    """Before any lease ended: warnings alone leave the ledger healthy."""
    return healthy(check_invariants(db.sync_jobs(), db.sync_locks(), _kept_state(db), ts("1990-01-01"), ts(EVENTS_NOW)))


@query("breaker_faults", _KEPT + "SELECT user_id || ':' || event_type AS key, 'circuit_open_no_samples' AS issue, 'open' AS state, 0 AS failure_count, 0 AS success_count FROM lk WHERE k % 3 = 0 AND CASE WHEN k % 2 = 0 THEN k % 8 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0 ELSE k % 4 END = 0")
def _breaker_faults(db: Ledger):
    return breaker_faults(_kept_state(db))


@query("garbage", "SELECT state, count(*) AS files, sum(size)::bigint AS bytes FROM (SELECT size, CASE WHEN used THEN 'referenced' WHEN epoch_us(TIMESTAMP '2024-01-01 12:00:00') - epoch_us(created_at) < 14400000000 THEN 'too_young' ELSE 'candidate' END AS state FROM (SELECT sha256, max(size_bytes) AS size, min(created_at) AS created_at, bool_or(blob_id % 3 <> 0) AS used FROM patch_blobs GROUP BY 1)) GROUP BY 1")
def _garbage(db: Ledger):
    """A file for each content; blobs that name it by their uri refer to it."""
    from ledgerline.operators.aggregates import gc_summary

    blobs = db.patch_blobs()
    files = blobs.groupBy(F.concat(F.lit("scm/1/git/"), "sha256", F.lit(".diff")).alias("path")).agg(F.max("size_bytes").alias("size"), F.min("created_at").alias("modified_at"))
    return gc_summary(collect_garbage(files, blobs.select("uri"), ts("2024-01-01 12:00:00"), 14400))


@query("artifacts_audited", "SELECT blob_id, CASE WHEN blob_id % 3 <> 1 THEN 'missing' WHEN blob_id % 11 = 0 THEN 'error' WHEN blob_id % 13 = 0 THEN 'ok' WHEN blob_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS audit, CASE WHEN blob_id % 3 <> 1 THEN 'missing' WHEN blob_id % 11 = 0 THEN 'error' ELSE 'head_only' END AS seen FROM patch_blobs")
def _audited(db: Ledger):
    """Every blob, with and without its content: some have no file, some files can't be read, some are others', and some blobs have no hash to compare with."""
    n = F.col("blob_id")
    blobs = db.patch_blobs().withColumns({"uri": F.when(n % 3 != 0, F.concat(F.lit("scm/"), n, F.lit(".diff"))), "sha256": F.when(n % 13 != 0, F.col("sha256"))})
    files = blobs.where(n % 3 == 1).select(F.col("uri").alias("path"), F.when(n % 7 == 0, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"), F.when(n % 11 == 0, "unreadable").alias("error"))
    return audit_artifacts(blobs, files).join(audit_artifacts(blobs, files, head_only=True).select("blob_id", F.col("audit").alias("seen")), "blob_id").select("blob_id", "audit", "seen")


@query("artifacts_audited_all", "SELECT blob_id, CASE WHEN blob_id % 3 <> 1 THEN 'missing' WHEN blob_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS audit FROM patch_blobs")
def _audited_all(db: Ledger):
    """Every blob: of three, one has a file (each seventh of these another one's), one a uri only, one no uri."""
    n = F.col("blob_id")
    blobs = db.patch_blobs().withColumn("uri", F.when(n % 3 != 0, F.concat(F.lit("scm/"), n, F.lit(".diff"))))
    files = blobs.where(n % 3 == 1).select(F.col("uri").alias("path"), F.when(n % 7 == 0, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return audit_artifacts(blobs, files).select("blob_id", "audit")


@query("uris_migrated", "SELECT blob_id, 'gs://new/' || sha256 AS new_uri FROM patch_blobs WHERE evidence_uri LIKE 's3://bucket/%'")
def _migrated(db: Ledger):
    return migration_preview(db.patch_blobs(), "evidence_uri", "s3://bucket", "gs://new").select("blob_id", "new_uri")


@query("rule_violations", "SELECT 'repos' AS name, 0::bigint AS n UNION ALL SELECT 'sync_jobs', 0 UNION ALL SELECT 'duplicate_blobs', count(*) FROM (SELECT sha256 FROM patch_blobs GROUP BY 1 HAVING count(*) > 1)")
def _rules(db: Ledger):
    parts = {"repos": violations(db.repos(), "repos"), "sync_jobs": violations(db.sync_jobs(), "sync_jobs"), "duplicate_blobs": duplicates(db.patch_blobs(), ["sha256"])}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("uris_after_migration", "SELECT blob_id, CASE WHEN evidence_uri LIKE 's3://bucket/%' THEN 'gs://new/' || sha256 ELSE evidence_uri END AS evidence_uri FROM patch_blobs")
def _migrated_all(db: Ledger):
    return migrated(db.patch_blobs(), "evidence_uri", "s3://bucket", "gs://new").select("blob_id", "evidence_uri")
