"""Filters, lookups and top-k lists of the ledger. Every order ends with the key, and every `now` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.registry import query
from ledgerline.schemas import all_of
from ledgerline.sources.ledger import EVENTS_NOW, ORDERS_NOW, Ledger, age, seconds, ts


def given(column: str, value) -> Column | None:
    """column = value, or no condition for None."""
    return None if value is None else F.col(column) == value


def newest(df: DataFrame, when: str, key: str, limit: int | None = None) -> DataFrame:
    """df in descending order of time, nulls first, then of key; at most `limit` rows."""
    out = df.orderBy(F.col(when).desc_nulls_first(), F.col(key).desc())
    return out if limit is None else out.limit(limit)


def by_key(df: DataFrame, **keys) -> DataFrame:
    """The rows with the given key values."""
    return df.where(all_of(*[F.col(c) == v for c, v in keys.items()]))


def list_events(events: DataFrame, item_id=None, event_type=None, actor=None, since=None, limit: int = 100) -> DataFrame:
    condition = all_of(given("item_id", item_id), given("event_type", event_type), given("actor_user_id", actor), None if since is None else F.col("created_at") >= ts(since))
    return newest(events.where(condition), "created_at", "event_id", limit)


def list_attachments(attachments: DataFrame, item_id=None, kind=None, limit: int = 100) -> DataFrame:
    return newest(attachments.where(all_of(given("item_id", item_id), given("kind", kind))), "created_at", "attachment_id", limit)


def search_knowledge(candidates: DataFrame, keyword: str, limit: int = 10, evidence: str | None = None) -> DataFrame:
    """Candidates with the keyword in title or content, whatever the case, newest first. % and _ in the keyword are wildcards."""
    pattern = f"%{keyword}%"
    hit = F.col("title").ilike(pattern) | F.col("content_md").ilike(pattern)
    return newest(candidates.where(all_of(hit, None if evidence is None else F.col("evidence_refs_json").ilike(f"%{evidence}%"))), "created_at", "candidate_id", limit)


def list_audit(audit: DataFrame, since=None, actor=None, action=None, space=None, reason_prefix=None, correlation_id=None, status=None, limit: int = 100) -> DataFrame:
    """Audit rows newest first, 1,000 at most; % and _ in the prefix are wildcards."""
    condition = all_of(
        None if since is None else F.col("created_at") >= ts(since), given("actor_user_id", actor), given("action", action), given("target_space", space),
        None if reason_prefix is None else F.col("reason").like(f"{reason_prefix}%"), given("correlation_id", correlation_id), given("status", status),
    )
    return newest(audit.where(condition), "created_at", "audit_id", min(limit, 1000))


def dedup_hits(requests: DataFrame, outbox: DataFrame) -> DataFrame:
    """Requests (target_space, payload_sha) whose payload was sent to the same space before."""
    return requests.join(outbox.where("status = 'sent'").select("target_space", "payload_sha").distinct(), ["target_space", "payload_sha"], "left_semi")


def due_outbox(outbox: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    out = outbox.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "created_at", "outbox_id")
    return out if limit is None else out.limit(limit)


def outbox_window(outbox: DataFrame, now: Column, hours: int, status: str | None = None, limit: int = 1000) -> DataFrame:
    return newest(outbox.where(all_of(F.col("updated_at") >= seconds(now, F.lit(-3600 * hours)), given("status", status))), "updated_at", "outbox_id", limit)


def referenced_outbox(audit: DataFrame) -> DataFrame:
    """audit with ref_outbox_id, the outbox row that its JSON names; null where that is no number."""
    return audit.withColumn("ref_outbox_id", F.get_json_object("evidence_refs_json", "$.outbox_id").try_cast("long"))


def expired_jobs(jobs: DataFrame, now: Column, grace: int = 60) -> DataFrame:
    """Running jobs whose lease ended more than `grace` seconds ago."""
    return jobs.where((F.col("status") == "running") & (seconds(F.col("locked_at"), F.col("lease_seconds") + grace) < now)).orderBy("locked_at", F.col("job_id").cast("long"))


def expired_runs(runs: DataFrame, now: Column, longest: int = 1800) -> DataFrame:
    return runs.where((F.col("status") == "running") & (seconds(F.col("started_at"), F.lit(longest)) < now)).orderBy("started_at", F.col("run_id").cast("long"))


def expired_locks(locks: DataFrame, now: Column) -> DataFrame:
    return locks.where(F.col("locked_by").isNotNull() & (seconds(F.col("locked_at"), F.col("lease_seconds")) < now)).orderBy("locked_at", "lock_id")


def missing_dimensions(jobs: DataFrame) -> DataFrame:
    """Active jobs of a git host without instance or tenant; _ in the pattern is a wildcard."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return jobs.where(F.col("status").isin("pending", "running") & F.col("job_type").like("gitlab_%") & (empty("instance") | empty("tenant_id")))


def pending_blobs(blobs: DataFrame, statuses: tuple[str, ...] = ("pending", "failed"), most: int = 3, limit: int = 100) -> DataFrame:
    """Blobs without a uri whose state in meta_json is one of `statuses`, tried fewer than `most` times."""
    state = F.coalesce(F.get_json_object("meta_json", "$.materialize_status"), F.lit("pending"))
    tries = F.coalesce(F.get_json_object("meta_json", "$.attempts").try_cast("int"), F.lit(0))
    return blobs.where((F.col("uri").isNull() | (F.col("uri") == "")) & state.isin(*statuses) & (tries < most)).orderBy("blob_id").limit(limit)


def blobs_without_evidence(blobs: DataFrame, limit: int = 100) -> DataFrame:
    return blobs.where(F.col("evidence_uri").isNull() | (F.col("evidence_uri") == "")).orderBy("blob_id").limit(limit)


def chunking_outdated(df: DataFrame, version: str) -> DataFrame:
    """Rows with another chunking version, or none."""
    return df.where(~F.col("chunking_version").eqNullSafe(version))


def latest_per(df: DataFrame, keys: list[str], when: str, key: str) -> DataFrame:
    """The newest row of each group, by an aggregate of one row a group rather than a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(when), F.col(key))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def active_pairs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("pending", "running")).select("repo_id", "job_type").distinct()


def sampled(df: DataFrame, uri: str, prefix: str | None = None, one_in: int = 1) -> DataFrame:
    """Rows under a prefix, one in `one_in` of them by the MD5 of the uri, so that a rerun takes the same."""
    return df.where(all_of(None if prefix is None else F.col(uri).startswith(prefix), None if one_in == 1 else F.conv(F.substring(F.md5(uri), 1, 8), 16, 10).cast("long") % one_in == 0))


def blobs_of_attachments(attachments: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs with an attachment's content."""
    return attachments.select("attachment_id", "sha256").join(blobs, "sha256")


def ordered(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns)


@query("item_by_id", "SELECT item_id, item_type, title, status FROM items WHERE item_id = 7")
def _item(db: Ledger):
    return by_key(db.items(), item_id=7).select("item_id", "item_type", "title", "status")


@query("events_filtered", "SELECT event_id, item_id, created_at FROM item_events WHERE event_type = '1-URGENT' AND created_at >= TIMESTAMP '1998-01-01' ORDER BY created_at DESC, event_id DESC LIMIT 50")
def _events(db: Ledger):
    return list_events(db.item_events(), event_type="1-URGENT", since="1998-01-01", limit=50).select("event_id", "item_id", "created_at")


@query("attachments_by_kind", "SELECT attachment_id, uri FROM attachments WHERE kind = 'patch' ORDER BY created_at DESC, attachment_id DESC LIMIT 100")
def _attachments(db: Ledger):
    return list_attachments(db.attachments(), kind="patch").select("attachment_id", "uri")


@query("knowledge_search", "SELECT candidate_id, title, created_at FROM knowledge WHERE title ILIKE '%token%' OR content_md ILIKE '%token%' ORDER BY created_at DESC, candidate_id DESC LIMIT 10")
def _search(db: Ledger):
    return search_knowledge(db.knowledge(), "token").select("candidate_id", "title", "created_at")


@query("audit_filtered", "SELECT audit_id, reason, created_at FROM write_audit WHERE action = 'allow' AND reason LIKE 'policy:%' AND status = 'success' AND created_at >= TIMESTAMP '2024-01-10' ORDER BY created_at DESC, audit_id DESC LIMIT 200")
def _audit(db: Ledger):
    return list_audit(db.write_audit(), since="2024-01-10", action="allow", reason_prefix="policy:", status="success", limit=200).select("audit_id", "reason", "created_at")


@query("audit_by_correlation", "SELECT audit_id, correlation_id, action FROM write_audit WHERE correlation_id = 'corr-17' ORDER BY created_at DESC, audit_id DESC LIMIT 100")
def _correlation(db: Ledger):
    return list_audit(db.write_audit(), correlation_id="corr-17").select("audit_id", "correlation_id", "action")


@query("outbox_dedup_hits", "SELECT outbox_id, payload_sha FROM outbox o WHERE status = 'pending' AND EXISTS (SELECT 1 FROM outbox s WHERE s.status = 'sent' AND s.target_space = o.target_space AND s.payload_sha = o.payload_sha)")
def _dedup(db: Ledger):
    box = db.outbox()
    return dedup_hits(box.where("status = 'pending'"), box).select("outbox_id", "payload_sha")


@query("outbox_due", f"SELECT outbox_id, target_space, next_attempt_at FROM outbox WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '{ORDERS_NOW}' ORDER BY next_attempt_at, created_at, outbox_id LIMIT 100")
def _due(db: Ledger):
    return due_outbox(db.outbox(), ts(ORDERS_NOW), 100).select("outbox_id", "target_space", "next_attempt_at")


@query("outbox_window", f"SELECT outbox_id, status, updated_at FROM outbox WHERE updated_at >= TIMESTAMP '{ORDERS_NOW}' - INTERVAL 72 HOUR ORDER BY updated_at DESC, outbox_id DESC LIMIT 1000")
def _window(db: Ledger):
    return outbox_window(db.outbox(), ts(ORDERS_NOW), 72).select("outbox_id", "status", "updated_at")


@query("audit_by_outbox_id", "SELECT audit_id, ref_outbox_id, reason FROM write_audit WHERE reason LIKE 'outbox_flush_%' AND ref_outbox_id = 45")
def _by_outbox(db: Ledger):
    return referenced_outbox(db.write_audit()).where(F.col("reason").like("outbox_flush_%") & (F.col("ref_outbox_id") == 45)).select("audit_id", "ref_outbox_id", "reason")


@query("jobs_expired", f"SELECT job_id, locked_at, lease_seconds FROM sync_jobs WHERE status = 'running' AND locked_at + to_seconds(lease_seconds + 60) < TIMESTAMP '{ORDERS_NOW}'")
def _expired_jobs(db: Ledger):
    return expired_jobs(db.sync_jobs(), ts(ORDERS_NOW)).select("job_id", "locked_at", "lease_seconds")


@query("runs_expired", f"SELECT run_id, repo_id, started_at FROM sync_runs WHERE status = 'running' AND started_at + to_seconds(1800) < TIMESTAMP '{EVENTS_NOW}'")
def _expired_runs(db: Ledger):
    return expired_runs(db.sync_runs(), ts(EVENTS_NOW)).select("run_id", "repo_id", "started_at")


@query("locks_expired", f"SELECT lock_id, repo_id, job_type, locked_by FROM sync_locks WHERE locked_by IS NOT NULL AND locked_at + to_seconds(lease_seconds) < TIMESTAMP '{EVENTS_NOW}'")
def _expired_locks(db: Ledger):
    return expired_locks(db.sync_locks(), ts(EVENTS_NOW)).select("lock_id", "repo_id", "job_type", "locked_by")


@query("jobs_missing_dimensions", "SELECT job_id, job_type, tenant_id FROM sync_jobs WHERE status IN ('pending', 'running') AND job_type LIKE 'gitlab_%' AND (coalesce(instance, '') = '' OR coalesce(tenant_id, '') = '')")
def _missing(db: Ledger):
    return missing_dimensions(db.sync_jobs()).select("job_id", "job_type", "tenant_id")


@query("blobs_pending", "SELECT blob_id, sha256 FROM patch_blobs WHERE coalesce(uri, '') = '' AND coalesce(materialize_status, 'pending') IN ('pending', 'failed') AND attempts < 3 ORDER BY blob_id LIMIT 100")
def _pending(db: Ledger):
    return pending_blobs(db.patch_blobs()).select("blob_id", "sha256")


@query("blobs_without_evidence", "SELECT blob_id, source_id FROM patch_blobs WHERE coalesce(evidence_uri, '') = '' ORDER BY blob_id LIMIT 100")
def _no_evidence(db: Ledger):
    return blobs_without_evidence(db.patch_blobs()).select("blob_id", "source_id")


@query("blobs_chunking_outdated", "SELECT blob_id, chunking_version FROM patch_blobs WHERE chunking_version IS DISTINCT FROM 'v2'")
def _chunking(db: Ledger):
    return chunking_outdated(db.patch_blobs(), "v2").select("blob_id", "chunking_version")


@query("run_latest_per_repo", "SELECT repo_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, run_id::bigint DESC) AS rn FROM sync_runs) WHERE rn = 1")
def _latest_run(db: Ledger):
    return latest_per(db.sync_runs().withColumn("n", F.col("run_id").cast("long")), ["repo_id"], "started_at", "n").select("repo_id", "run_id", "status")


@query("kv_latest", "SELECT namespace, key, value_json, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY updated_at DESC, event_id DESC) AS rn FROM kv_changes) WHERE rn = 1")
def _kv(db: Ledger):
    return latest_per(db.kv_changes(), ["namespace", "key"], "updated_at", "event_id").select("namespace", "key", "value_json", "updated_at")


@query("jobs_active_pairs", "SELECT DISTINCT repo_id, job_type FROM sync_jobs WHERE status IN ('pending', 'running')")
def _pairs(db: Ledger):
    return active_pairs(db.sync_jobs())


@query("jobs_by_worker", "SELECT job_id, locked_by, priority FROM sync_jobs WHERE locked_by = 'w2' AND status = 'running' ORDER BY priority, created_at, job_id::bigint LIMIT 100")
def _worker(db: Ledger):
    return by_key(db.sync_jobs(), locked_by="w2", status="running").orderBy("priority", "created_at", F.col("job_id").cast("long")).limit(100).select("job_id", "locked_by", "priority")


@query("repos_for_scheduling", "SELECT repo_id, repo_type, url FROM repos WHERE repo_type = 'git' ORDER BY repo_id LIMIT 100")
def _repos(db: Ledger):
    return by_key(db.repos(), repo_type="git").orderBy("repo_id").limit(100).select("repo_id", "repo_type", "url")


@query("blobs_of_attachments", "SELECT attachment_id, blob_id FROM attachments JOIN patch_blobs USING (sha256)")
def _shared_content(db: Ledger):
    return blobs_of_attachments(db.attachments(), db.patch_blobs()).select("attachment_id", "blob_id")
