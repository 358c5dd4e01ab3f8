"""Statistics of the ledger. All are conditional aggregates: one pass over the table, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.payloads import COUNTERS
from ledgerline.registry import query
from ledgerline.sources.ledger import EVENTS_NOW, ORDERS_NOW, Ledger, age, seconds, ts

#: The categories of audit reasons in reports.
REASON_CATEGORIES = ("policy", "openmemory_write_failed", "outbox_flush_success", "dedup_hit", "other")


def count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, at most 1; 0 where there is no whole."""
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(part, F.when(whole > 0, whole))), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 2)


def outbox_stats(outbox: DataFrame, now: Column) -> DataFrame:
    """Totals by state, the mean of retries, and the age of the oldest pending row in seconds (0 for none)."""
    status = F.col("status")
    oldest = age(now, F.min(F.when(status == "pending", F.col("created_at"))))
    return outbox.agg(
        F.count(F.lit(1)).alias("total"), count_if(status == "pending", "pending"), count_if(status == "sent", "sent"), count_if(status == "dead", "dead"),
        F.coalesce(F.avg("retry_count"), F.lit(0.0)).alias("avg_retry_count"), F.coalesce(oldest, F.lit(0.0)).alias("oldest_pending_age_seconds"),
    )


def audit_stats(audit: DataFrame, now: Column) -> DataFrame:
    action = F.col("action")
    return audit.agg(
        F.count(F.lit(1)).alias("total"), count_if(action == "allow", "allow"), count_if(action == "redirect", "redirect"), count_if(action == "reject", "reject"),
        count_if(F.col("created_at") > seconds(now, F.lit(-86400)), "recent_24h"),
    )


def reason_category(reason: Column) -> Column:
    """The category of a reason in reports; retries, dead letters and outbox duplicates are `other`."""
    return F.when(reason.startswith("policy:"), "policy").when(reason.like("openmemory_write_failed:%"), "openmemory_write_failed").when(reason == "outbox_flush_success", "outbox_flush_success").when(reason == "dedup_hit", "dedup_hit").otherwise("other")


def audits_by_reason(audit: DataFrame) -> DataFrame:
    """One row for every category, with 0 where there is none."""
    every = audit.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in REASON_CATEGORIES])).alias("reason_category"))
    found = audit.groupBy(reason_category(F.col("reason")).alias("reason_category")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "reason_category", "left").select("reason_category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def intercept_stats(audit: DataFrame, now: Column) -> DataFrame:
    """Rejected writes whose reason names a diff, a log or both."""
    diff, log = F.col("reason").contains("diff"), F.col("reason").contains("log")
    return audit.where("action = 'reject'").agg(
        count_if(diff & ~log, "diff_reject"), count_if(log & ~diff, "log_reject"), count_if(diff & log, "diff_log_reject"), count_if(diff | log, "total_intercept"),
        count_if((diff | log) & (F.col("created_at") > seconds(now, F.lit(-86400))), "recent_24h"),
    )


def evidence_modes(audit: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Strict, compatible and v2 evidence among the audits of the last days, from their JSON; no mode counts as compatible."""
    refs = F.col("evidence_refs_json")
    mode = F.coalesce(F.get_json_object(refs, "$.gateway_event.policy.mode"), F.get_json_object(refs, "$.mode"))
    filled = lambda path: F.coalesce(F.json_array_length(F.get_json_object(refs, path)), F.lit(0)) > 0
    v2 = filled("$.patches") | filled("$.attachments") | F.get_json_object(refs, "$.v2_evidence").isNotNull()
    return audit.where(F.col("created_at") > seconds(now, F.lit(-86400 * days))).agg(F.count(F.lit(1)).alias("total"), count_if(mode == "strict", "strict_mode_count"), count_if((mode == "compat") | mode.isNull(), "compat_mode_count"), count_if(v2, "with_v2_evidence"))


#: Schemes that a report accepts for evidence. The canonical memory:// is not among them, which the report keeps; the corrected count has it.
REPORT_SCHEMES = ("s3://", "file://", "http://", "https://")


def evidence_coverage(blobs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Rows with an evidence uri in each table and in all, invalid ones as reports count them, and without memory:// among the invalid."""
    uri = F.col("evidence_uri")
    other = attachments if "evidence_uri" in attachments.columns else attachments.withColumn("evidence_uri", F.lit(None).cast("string"))
    both = blobs.select(F.lit(True).alias("blob"), uri).unionByName(other.select(F.lit(False).alias("blob"), uri))
    has = uri.isNotNull() & (uri != "")
    bad = has
    for scheme in REPORT_SCHEMES:
        bad = bad & ~uri.startswith(scheme)
    out = both.agg(
        F.count_if("blob").alias("blobs_total"), F.count_if(F.col("blob") & has).alias("blobs_with_uri"), F.count_if(~F.col("blob")).alias("attachments_total"), F.count_if(~F.col("blob") & has).alias("attachments_with_uri"),
        F.count_if(bad).alias("invalid_count"), F.count_if(bad & ~uri.startswith("memory://")).alias("invalid_corrected_count"),
    )
    whole, part = F.col("blobs_total") + F.col("attachments_total"), F.col("blobs_with_uri") + F.col("attachments_with_uri")
    return out.withColumns({"blobs_pct": percent(F.col("blobs_with_uri"), F.col("blobs_total")), "coverage_pct": percent(part, whole)})


def sync_status(repos: DataFrame, runs: DataFrame, jobs: DataFrame, locks: DataFrame, kv: DataFrame, runs_now: Column) -> DataFrame:
    """(metric, label, n) in long form: repositories by type, runs of a day and jobs by status, active and expired locks, cursors."""
    counted = lambda df, metric, label: df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "label", "n")
    held = locks.where("locked_by is not null")
    ended = seconds(F.col("locked_at"), F.col("lease_seconds")) < runs_now
    parts = [
        counted(repos, "repos", F.col("repo_type")),
        counted(runs.where(F.col("started_at") > seconds(runs_now, F.lit(-86400))), "runs_24h", F.col("status")),
        counted(jobs, "jobs", F.col("status")),
        counted(held, "locks", F.when(ended, "expired").otherwise("active")),
        counted(kv.select("namespace", "key").distinct(), "cursors", F.lit("all")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counter(name: str) -> Column:
    return F.coalesce(F.get_json_object("counts", f"$.{name}").try_cast("long"), F.lit(0))


def with_counts(runs: DataFrame) -> DataFrame:
    """runs with the numbers of their JSON counts as columns; timeouts under either name."""
    return runs.withColumns({"hits_429": _counter("total_429_hits"), "timeouts": F.greatest(_counter("total_timeout_count"), _counter("timeout_count")), "requests": _counter("total_requests")})


def health_stats(runs: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Runs of a window: counts by result, sums of what their JSON counts, and rates with 0 for nothing."""
    status = F.col("status")
    out = with_counts(runs.where(F.col("started_at") >= seconds(now, F.lit(-60 * minutes)))).agg(
        F.count(F.lit(1)).alias("total_runs"), count_if(status == "failed", "failed_runs"), count_if(status == "completed", "completed_runs"), count_if(status == "no_data", "no_data_runs"),
        F.coalesce(F.sum("hits_429"), F.lit(0)).alias("hits_429"), F.coalesce(F.sum("timeouts"), F.lit(0)).alias("timeouts"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
    )
    return out.withColumns({"failed_rate": F.round(rate(F.col("failed_runs"), F.col("total_runs")), 6), "rate_limit_rate": F.round(rate(F.col("hits_429"), F.col("requests")), 6), "timeout_rate": F.round(rate(F.col("timeouts"), F.col("requests")), 6)})


def budget(jobs: DataFrame, by: str | None = None, payload_key: str | None = None) -> DataFrame:
    """Running, pending and active jobs, in all or by instance or tenant; a null group is left out. Where the column is null, payload_key of payload_json stands for it."""
    active = jobs.where(F.col("status").isin("pending", "running"))
    if by is not None and payload_key is not None:
        active = active.withColumn(by, F.coalesce(by, F.get_json_object("payload_json", f"$.{payload_key}")))
    parts = [count_if(F.col("status") == "running", "running"), count_if(F.col("status") == "pending", "pending"), F.count(F.lit(1)).alias("active")]
    return active.agg(*parts) if by is None else active.where(F.col(by).isNotNull()).groupBy(by).agg(*parts)


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def pause_snapshot(pauses: DataFrame, now: Column) -> DataFrame:
    """Pauses that hold (repo_id, job_type, reason, paused_until), by reason; none is `unknown`."""
    return pauses.where(F.col("paused_until") > now).groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.countDistinct("repo_id", "job_type").alias("pairs"))


def breaker_summary(breakers: DataFrame) -> DataFrame:
    """Circuit breakers (key project:scope[:id], state, failures, successes) by scope."""
    scope = F.coalesce(F.nullif(F.split_part(F.col("key"), F.lit(":"), F.lit(2)), F.lit("")), F.lit("global"))
    return breakers.groupBy(scope.alias("scope")).agg(*[count_if(F.col("state") == s, s) for s in ("open", "half_open", "closed")], F.sum("failures").alias("failures"), F.sum("successes").alias("successes"))


def merged_results(chunks: DataFrame, by: str) -> DataFrame:
    """Results of chunks together: all counters of their JSON summed, and a state: skipped without chunks that ran, failed if all failed, partial if some did, else success."""
    failed = F.count_if(F.col("status") == "failed")
    ran = F.count_if(F.col("status") != "running")
    return chunks.groupBy(by).agg(F.coalesce(F.sum("synced_count"), F.lit(0)).alias("synced_count"), *[F.sum(_counter(c)).alias(c) for c in COUNTERS if c != "synced_count"], F.count(F.lit(1)).alias("chunks"), failed.alias("failed_chunks"), F.when(ran == 0, "skipped").when(failed == ran, "failed").when(failed > 0, "partial").otherwise("success").alias("state"))


def request_stats(runs: DataFrame) -> DataFrame:
    """Requests, 429s, timeouts and times of runs that ended, by job type."""
    took = age(F.col("finished_at"), F.col("started_at"))
    return with_counts(runs.where("finished_at is not null")).groupBy("job_type").agg(F.sum("requests").alias("requests"), F.sum("hits_429").alias("hits_429"), F.sum("timeouts").alias("timeouts"), F.min(took).alias("min_s"), F.round(F.avg(took), 6).alias("avg_s"), F.max(took).alias("max_s"))


def gc_summary(files: DataFrame) -> DataFrame:
    """Counts and bytes of files (state, size) by what a collection would do with them."""
    return files.groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def reconcile_totals(outbox: DataFrame, missing: DataFrame) -> DataFrame:
    """Of each outbox state: rows, rows without an audit, and of those the ones that a reconciliation has fixed (fixed, false where there is none)."""
    fixed = F.coalesce("fixed", F.lit(False)) if "fixed" in missing.columns else F.lit(False)
    lost = missing.groupBy(F.col("status").alias("_s")).agg(F.count(F.lit(1)).alias("missing"), F.count_if(fixed).alias("fixed"))
    return outbox.groupBy("status").agg(F.count(F.lit(1)).alias("rows")).join(lost, F.col("status") == F.col("_s"), "left").select("status", "rows", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("fixed", F.lit(0)).alias("fixed"))


#: Bits that a sketch keeps of a value: a kept value is at most 1 / 2**BITS below the true one, relative to itself.
BITS = 6


def latency_sketch(requests: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, low, n, total, least, most) of requests: the counts of values whose first BITS + 1 binary digits are those of low, with their sum, least and most.

    Values are whole numbers from 0; null and negative ones are left out. A group has at most 64 * 2**BITS rows, however many requests it has, and
    sketches add up: see merged_sketch().
    """
    x = F.col(value).cast("long")
    shift = F.greatest(F.length(F.bin(x)) - 1 - BITS, F.lit(0))
    low = F.expr("shiftleft(shiftright(_x, _s), _s)")
    rows = requests.where(x >= 0).withColumn("_x", x).withColumn("_s", shift).withColumn("low", low)
    return rows.groupBy(*by, "low").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("total"), F.min("_x").alias("least"), F.max("_x").alias("most"))


def merged_sketch(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of coarser groups, of those of finer ones: over runs, hours, or instances."""
    return sketch.groupBy(*by, "low").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def latency_stats(sketch: DataFrame, by: list[str], percentiles: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(by, n, least, mean, most, p50, ...) of a sketch: exact but for the percentiles, of which each is the low of the value at that rank, so at most 1 / 2**BITS below it."""
    so_far = F.sum("n").over(Window.partitionBy(*by).orderBy("low"))
    every = F.sum("n").over(Window.partitionBy(*by))
    rows = sketch.withColumns({"_at": so_far, "_all": every})
    rank = lambda p: F.ceil(F.col("_all") * p / 100)
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"), *[F.min(F.when(F.col("_at") >= rank(p), F.col("low"))).alias(f"p{p}") for p in percentiles])


def evidence_summary(refs: Column) -> Column:
    """Of an array of structs (uri, sha256): count, whether any has a hash, the first five uris."""
    return F.struct(F.size(refs).alias("count"), F.exists(refs, lambda r: r["sha256"].isNotNull() & (r["sha256"] != "")).alias("has_strong"), F.slice(F.transform(refs, lambda r: r["uri"]), 1, 5).alias("uris"))


@query("outbox_stats", f"SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'dead') AS dead, coalesce(avg(retry_count), 0)::double AS avg_retry_count, coalesce((epoch_us(TIMESTAMP '{ORDERS_NOW}') - epoch_us(min(created_at) FILTER (status = 'pending'))) / 1000000.0::double, 0.0) AS oldest_pending_age_seconds FROM outbox")
def _outbox(db: Ledger):
    return outbox_stats(db.outbox(), ts(ORDERS_NOW))


@query("audit_stats", f"SELECT count(*) AS total, count(*) FILTER (action = 'allow') AS allow, count(*) FILTER (action = 'redirect') AS redirect, count(*) FILTER (action = 'reject') AS reject, count(*) FILTER (created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR) AS recent_24h FROM write_audit")
def _audit(db: Ledger):
    return audit_stats(db.write_audit(), ts(EVENTS_NOW))


@query("audit_by_reason", "SELECT c AS reason_category, count(audit_id) AS n FROM (SELECT unnest(['policy', 'openmemory_write_failed', 'outbox_flush_success', 'dedup_hit', 'other']) AS c) LEFT JOIN (SELECT audit_id, CASE WHEN reason LIKE 'policy:%' THEN 'policy' WHEN reason LIKE 'openmemory_write_failed:%' THEN 'openmemory_write_failed' WHEN reason IN ('outbox_flush_success', 'dedup_hit') THEN reason ELSE 'other' END AS rc FROM write_audit) ON c = rc GROUP BY 1")
def _reasons(db: Ledger):
    return audits_by_reason(db.write_audit())


@query("content_intercepts", f"SELECT count(*) FILTER (reason LIKE '%diff%' AND reason NOT LIKE '%log%') AS diff_reject, count(*) FILTER (reason LIKE '%log%' AND reason NOT LIKE '%diff%') AS log_reject, count(*) FILTER (reason LIKE '%diff%' AND reason LIKE '%log%') AS diff_log_reject, count(*) FILTER (reason LIKE '%diff%' OR reason LIKE '%log%') AS total_intercept, count(*) FILTER ((reason LIKE '%diff%' OR reason LIKE '%log%') AND created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR) AS recent_24h FROM write_audit WHERE action = 'reject'")
def _intercepts(db: Ledger):
    return intercept_stats(db.write_audit(), ts(EVENTS_NOW))


@query("evidence_modes", f"SELECT count(*) AS total, count(*) FILTER (ref_mode = 'strict') AS strict_mode_count, count(*) FILTER (ref_mode = 'compat' OR ref_mode IS NULL) AS compat_mode_count, count(*) FILTER (ref_patches > 0) AS with_v2_evidence FROM write_audit WHERE created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY")
def _modes(db: Ledger):
    return evidence_modes(db.write_audit(), ts(EVENTS_NOW))


@query("evidence_coverage", "SELECT *, round(blobs_with_uri * 100.0::double / blobs_total, 2) AS blobs_pct, round(blobs_with_uri * 100.0::double / (blobs_total + attachments_total), 2) AS coverage_pct FROM (SELECT count(*) AS blobs_total, count(*) FILTER (evidence_uri <> '') AS blobs_with_uri, (SELECT count(*) FROM attachments) AS attachments_total, 0::bigint AS attachments_with_uri, count(*) FILTER (evidence_uri LIKE 'memory://%' OR evidence_uri = 'notes/readme') AS invalid_count, count(*) FILTER (evidence_uri = 'notes/readme') AS invalid_corrected_count FROM patch_blobs)")
def _coverage(db: Ledger):
    return evidence_coverage(db.patch_blobs(), db.attachments())


@query("sync_status", f"SELECT 'repos' AS metric, repo_type AS label, count(*) AS n FROM repos GROUP BY 2 UNION ALL SELECT 'runs_24h', status, count(*) FROM sync_runs WHERE started_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR GROUP BY 2 UNION ALL SELECT 'jobs', status, count(*) FROM sync_jobs GROUP BY 2 UNION ALL SELECT 'locks', CASE WHEN locked_at + to_seconds(lease_seconds) < TIMESTAMP '{EVENTS_NOW}' THEN 'expired' ELSE 'active' END, count(*) FROM sync_locks WHERE locked_by IS NOT NULL GROUP BY 2 UNION ALL SELECT 'cursors', 'all', count(*) FROM (SELECT DISTINCT namespace, key FROM kv_changes)")
def _status(db: Ledger):
    return sync_status(db.repos(), db.sync_runs(), db.sync_jobs(), db.sync_locks(), db.kv_changes(), ts(EVENTS_NOW))


@query("health_stats", f"SELECT *, round(coalesce(least(1.0::double, failed_runs / nullif(total_runs, 0)), 0), 6) AS failed_rate, round(coalesce(least(1.0::double, hits_429 / nullif(requests, 0)), 0), 6) AS rate_limit_rate, round(coalesce(least(1.0::double, timeouts / nullif(requests, 0)), 0), 6) AS timeout_rate FROM (SELECT count(*) AS total_runs, count(*) FILTER (status = 'failed') AS failed_runs, count(*) FILTER (status = 'completed') AS completed_runs, count(*) FILTER (status = 'no_data') AS no_data_runs, coalesce(sum(hits_429), 0)::bigint AS hits_429, coalesce(sum(timeouts), 0)::bigint AS timeouts, coalesce(sum(requests), 0)::bigint AS requests FROM sync_runs WHERE started_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 1440 MINUTE)")
def _health(db: Ledger):
    return health_stats(db.sync_runs(), ts(EVENTS_NOW), 1440)


@query("budget_total", "SELECT count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS pending, count(*) AS active FROM sync_jobs WHERE status IN ('pending', 'running')")
def _budget(db: Ledger):
    return budget(db.sync_jobs())


@query("budget_by_tenant", "SELECT tenant_id, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS pending, count(*) AS active FROM sync_jobs WHERE status IN ('pending', 'running') AND tenant_id IS NOT NULL GROUP BY 1")
def _tenants(db: Ledger):
    return budget(db.sync_jobs(), "tenant_id")


@query("budget_by_instance", "SELECT instance, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS pending, count(*) AS active FROM sync_jobs WHERE status IN ('pending', 'running') AND instance IS NOT NULL GROUP BY 1")
def _instances(db: Ledger):
    return budget(db.sync_jobs(), "instance")


@query("jobs_by_status", "SELECT status, count(*) AS n FROM sync_jobs GROUP BY 1")
def _jobs(db: Ledger):
    return count_by(db.sync_jobs(), "status")


@query("pause_snapshot", f"SELECT coalesce(reason, 'unknown') AS reason, count(DISTINCT (repo_id, job_type)) AS pairs FROM (SELECT repo_id, job_type, CASE WHEN lock_id % 3 = 0 THEN NULL ELSE locked_by END AS reason, locked_at + to_seconds(lease_seconds) AS paused_until FROM sync_locks) WHERE paused_until > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 5 DAY GROUP BY 1")
def _pauses(db: Ledger):
    pauses = db.sync_locks().select("repo_id", "job_type", F.when(F.col("lock_id") % 3 != 0, F.col("locked_by")).alias("reason"), seconds(F.col("locked_at"), F.col("lease_seconds")).alias("paused_until"))
    return pause_snapshot(pauses, seconds(ts(EVENTS_NOW), F.lit(-5 * 86400)))


@query("breaker_summary", "SELECT scope, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'half_open') AS half_open, count(*) FILTER (state = 'closed') AS closed, sum(failures)::bigint AS failures, sum(successes)::bigint AS successes FROM (SELECT CASE lock_id % 3 WHEN 0 THEN 'tenant' WHEN 1 THEN 'instance' ELSE 'global' END AS scope, CASE job_type WHEN 'error' THEN 'open' WHEN 'click' THEN 'half_open' ELSE 'closed' END AS state, lock_id % 7 AS failures, lock_id % 5 AS successes FROM sync_locks) GROUP BY 1")
def _breakers(db: Ledger):
    k = F.col("lock_id")
    key = F.when(k % 3 == 0, F.concat(F.lit("p:tenant:"), F.col("repo_id"))).when(k % 3 == 1, F.concat(F.lit("p:instance:"), F.col("repo_id"))).otherwise(F.lit("p"))
    state = F.when(F.col("job_type") == "error", "open").when(F.col("job_type") == "click", "half_open").otherwise("closed")
    return breaker_summary(db.sync_locks().select(key.alias("key"), state.alias("state"), (k % 7).alias("failures"), (k % 5).alias("successes")))


@query("chunk_results", "SELECT repo_id, coalesce(sum(synced_count), 0)::bigint AS synced_count, sum(hits_429)::bigint AS total_429_hits, sum(timeouts)::bigint AS timeout_count, sum(requests)::bigint AS total_requests, 0::bigint AS diff_count, count(*) AS chunks, count(*) FILTER (status = 'failed') AS failed_chunks, CASE WHEN count(*) FILTER (status <> 'running') = 0 THEN 'skipped' WHEN count(*) FILTER (status = 'failed') = count(*) FILTER (status <> 'running') THEN 'failed' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'success' END AS state FROM sync_runs GROUP BY 1")
def _chunks(db: Ledger):
    return merged_results(db.sync_runs(), "repo_id").drop("bulk_count", "degraded_count", "skipped_count")


@query("request_stats", "SELECT job_type, sum(requests)::bigint AS requests, sum(hits_429)::bigint AS hits_429, sum(timeouts)::bigint AS timeouts, min(t) AS min_s, round(avg(t), 6) AS avg_s, max(t) AS max_s FROM (SELECT *, (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0::double AS t FROM sync_runs WHERE finished_at IS NOT NULL) GROUP BY 1")
def _requests(db: Ledger):
    return request_stats(db.sync_runs())


@query("reconcile_totals", "SELECT status, count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM write_audit a WHERE a.ref_outbox_id = o.outbox_id AND CASE o.status WHEN 'sent' THEN a.reason IN ('outbox_flush_success', 'outbox_flush_dedup_hit') ELSE a.reason LIKE 'outbox_flush_dead%' END)) AS missing, count(*) FILTER (outbox_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM write_audit a WHERE a.ref_outbox_id = o.outbox_id AND CASE o.status WHEN 'sent' THEN a.reason IN ('outbox_flush_success', 'outbox_flush_dedup_hit') ELSE a.reason LIKE 'outbox_flush_dead%' END)) AS fixed FROM outbox o WHERE status <> 'pending' GROUP BY 1")
def _reconcile(db: Ledger):
    from ledgerline.operators.joins import unaudited

    box = db.outbox().where("status != 'pending'")
    return reconcile_totals(box, unaudited(box, db.write_audit()).withColumn("fixed", F.col("outbox_id") % 2 == 0))


@query("request_latencies", """, lt AS (SELECT l_suppkey AS repo_id, floor(l_extendedprice)::bigint AS x FROM lineitem),
lr AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY x) AS rn, count(*) OVER (PARTITION BY repo_id) AS c, greatest(floor(log2(greatest(x, 1)))::int - 6, 0) AS s FROM lt)
SELECT repo_id, count(*) AS n, min(x) AS least, sum(x)::double / count(*) AS mean, max(x) AS most, min(CASE WHEN rn = ceil(c * 50 / 100) THEN (x >> s) << s END) AS p50, min(CASE WHEN rn = ceil(c * 95 / 100) THEN (x >> s) << s END) AS p95, min(CASE WHEN rn = ceil(c * 99 / 100) THEN (x >> s) << s END) AS p99 FROM lr GROUP BY 1""")
def _latencies(db: Ledger):
    """Prices of lines stand for latencies: sketches of a repository's runs, one a return flag, merged."""
    requests = db.raw("lineitem").select(F.col("l_suppkey").alias("repo_id"), F.col("l_returnflag").alias("run"), F.floor("l_extendedprice").cast("long").alias("micros"))
    return latency_stats(merged_sketch(latency_sketch(requests, ["repo_id", "run"], "micros"), ["repo_id"]), ["repo_id"])
