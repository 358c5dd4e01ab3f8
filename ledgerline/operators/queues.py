"""Queues, leases and locks: (state, commands, now) -> next state, with one writer a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.errors import backoff_seconds, classify_last_error
from ledgerline.functions.text import redact
from ledgerline.operators.windows import first_per
from ledgerline.operators.writes import hashed
from ledgerline.registry import query
from ledgerline.schemas import all_of
from ledgerline.sources.ledger import EVENTS_NOW, ORDERS_NOW, Ledger, seconds, ts


def taken(claimable: DataFrame, limit: int, *order) -> DataFrame:
    """The first `limit` rows in order: a top-k, so no sort of the whole table."""
    return claimable.orderBy(*order).limit(limit)


def outbox_claimable(now: Column, lease: int) -> Column:
    free = F.col("locked_at").isNull() | (F.col("locked_at") < seconds(now, F.lit(-lease)))
    return (F.col("status") == "pending") & (F.col("next_attempt_at") <= now) & free


def claim_outbox(outbox: DataFrame, worker: str, now: Column, limit: int = 10, lease: int = 120) -> DataFrame:
    """outbox after a worker took due rows that are free or whose lease ended; `claimed` marks them."""
    got = taken(outbox.where(outbox_claimable(now, lease)), limit, "next_attempt_at", "created_at", "outbox_id").select("outbox_id", F.lit(True).alias("claimed"))
    out = outbox.join(got, "outbox_id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return out.withColumns({"locked_by": F.when(F.col("claimed"), F.lit(worker)).otherwise(F.col("locked_by")), "locked_at": F.when(F.col("claimed"), now).otherwise(F.col("locked_at"))})


def _guarded(state: DataFrame, commands: DataFrame, key: str, status: str, owner: bool) -> tuple[DataFrame, Column]:
    """state with its command's columns under _c, and whether the command may act: right status and, if asked, the lock's owner."""
    rest = [c for c in commands.columns if c != key]
    joined = state.join(commands.select(key, F.struct(F.lit(True).alias("given"), *rest).alias("_c")), key, "left")
    may = F.col("_c").isNotNull() & (F.col("status") == status)
    return joined, F.coalesce(may & (F.col("locked_by") == F.col("_c.worker")) if owner else may, F.lit(False))


def settle_outbox(outbox: DataFrame, commands: DataFrame, now: Column, max_retries: int = 5, owner: bool = True) -> DataFrame:
    """outbox after commands (outbox_id, worker, result: sent, retry or dead, backoff in seconds, error).

    They act on pending rows, with `owner` only for the worker that holds the lock. A retry counts, clears the lock and waits; at
    max_retries it is dead. What acts sets the row's updated_at, and its last_error to the command's (null for sent ones without a note). `conflict`
    marks commands that could not act.
    """
    rows, may = _guarded(outbox, commands, "outbox_id", "pending", owner)
    result = F.col("_c.result")
    again = may & (result == "retry")
    dead = may & ((result == "dead") | ((result == "retry") & (F.col("retry_count") + 1 >= max_retries)))
    changes = (
        {
            "status": F.when(may & (result == "sent"), "sent").when(dead, "dead").otherwise(F.col("status")),
            "next_attempt_at": F.when(again & ~dead, seconds(now, F.col("_c.backoff"))).otherwise(F.col("next_attempt_at")),
            "locked_by": F.when(may, F.lit(None).cast("string")).otherwise(F.col("locked_by")), "locked_at": F.when(may, F.lit(None).cast("timestamp")).otherwise(F.col("locked_at")),
            "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")), "conflict": F.col("_c").isNotNull() & ~may,
        }
    )
    told = {"last_error": F.col("_c.error"), "updated_at": now}
    return rows.withColumns(changes | {c: F.when(may, v).otherwise(F.col(c)) for c, v in told.items() if c in rows.columns}).drop("_c")


def renew_leases(state: DataFrame, commands: DataFrame, key: str, status: str, now: Column) -> DataFrame:
    """state with locked_at = now for commands (key, worker) of the lock's owner."""
    rows, may = _guarded(state, commands, key, status, True)
    return rows.withColumn("locked_at", F.when(may, now).otherwise(F.col("locked_at"))).drop("_c")


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that are added: the first of each (repo, type, mode) that has no active job."""
    key = ["repo_id", "job_type", "mode"]
    active = jobs.where(F.col("status").isin("pending", "running")).select(*key).distinct()
    return first_per(new.join(active, key, "left_anti"), key, "priority", F.col("job_id").cast("long"))


def enqueue_results(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """A result for each row of new: added, or existing, the id of the active job (the least) or of the row of new before it (first is false) that stands in its way."""
    key = ["repo_id", "job_type", "mode"]
    active = jobs.where(F.col("status").isin("pending", "running")).groupBy(*key).agg(F.min(F.col("job_id").cast("long")).cast("string").alias("_active"))
    best = new.groupBy(*key).agg(F.min_by("job_id", F.struct("priority", F.col("job_id").cast("long"))).alias("_best"))
    out = new.join(best, key).join(active, key, "left")
    first = F.col("job_id") == F.col("_best")
    return out.withColumns({"first": first, "added": first & F.col("_active").isNull(), "existing": F.coalesce("_active", F.when(~first, F.col("_best")))}).drop("_best", "_active")


def job_claimable(now: Column) -> Column:
    status = F.col("status")
    due = F.col("not_before") <= now
    over = seconds(F.col("locked_at"), F.col("lease_seconds")) < now
    return ((status == "pending") & due) | ((status == "running") & over) | ((status == "failed") & due & (F.col("attempts") < F.col("max_attempts")))


def claim_jobs(jobs: DataFrame, worker: str, now: Column, limit: int = 1, types: list[str] | None = None, instances: list[str] | None = None, tenants: list[str] | None = None, fair: bool = False) -> DataFrame:
    """jobs after a worker took claimable ones in order of priority and age; allow lists let rows without a value pass; fair: the best of each tenant first."""
    allowed = lambda c, xs: None if xs is None else F.col(c).isNull() | F.col(c).isin(*xs)
    free = jobs.where(all_of(job_claimable(now), None if types is None else F.col("job_type").isin(*types), allowed("instance", instances), allowed("tenant_id", tenants)))
    order = ["priority", "created_at", F.col("job_id").cast("long")]
    if fair:
        free = first_per(free.withColumn("_t", F.coalesce("tenant_id", F.lit(""))), ["_t"], *order)
    got = taken(free, limit, *order).select("job_id", F.lit(True).alias("claimed"))
    out = jobs.join(got, "job_id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    won = F.col("claimed")
    return out.withColumns({"status": F.when(won, "running").otherwise(F.col("status")), "attempts": F.when(won, F.col("attempts") + 1).otherwise(F.col("attempts")), "locked_by": F.when(won, F.lit(worker)).otherwise(F.col("locked_by")), "locked_at": F.when(won, now).otherwise(F.col("locked_at"))})


def settle_jobs(jobs: DataFrame, commands: DataFrame, now: Column) -> DataFrame:
    """jobs after commands (job_id, worker, result, backoff, error) on running jobs of the worker.

    ack: completed. fail: dead at max_attempts, else failed until now + backoff. dead: dead. requeue: pending, one attempt given back.
    """
    rows, may = _guarded(jobs, commands, "job_id", "running", True)
    result = F.col("_c.result")
    spent = F.col("attempts") >= F.col("max_attempts")
    status = F.when(result == "ack", "completed").when(result == "dead", "dead").when(result == "requeue", "pending").otherwise(F.when(spent, "dead").otherwise("failed"))
    waits = may & result.isin("fail", "requeue") & (status != "dead")
    return rows.withColumns(
        {
            "not_before": F.when(waits, seconds(now, F.col("_c.backoff"))).otherwise(F.col("not_before")),
            "attempts": F.when(may & (result == "requeue"), F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")),
            "last_error": F.when(may & (result != "ack"), F.col("_c.error")).otherwise(F.col("last_error")), "status": F.when(may, status).otherwise(F.col("status")),
            "locked_by": F.when(may, F.lit(None).cast("string")).otherwise(F.col("locked_by")), "locked_at": F.when(may, F.lit(None).cast("timestamp")).otherwise(F.col("locked_at")),
            "conflict": F.col("_c").isNotNull() & ~may,
        }
    ).drop("_c")


def reset_dead(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Dead jobs as pending ones without attempts, lock and error; with a limit the oldest of them."""
    dead = jobs.where("status = 'dead'")
    chosen = (dead if limit is None else dead.orderBy("created_at", "job_id").limit(limit)).select("job_id", F.lit(True).alias("_hit"))
    none = lambda c, t: F.when(F.col("_hit"), F.lit(None).cast(t)).otherwise(F.col(c))
    return jobs.join(chosen, "job_id", "left").withColumns({"status": F.when(F.col("_hit"), "pending").otherwise(F.col("status")), "attempts": F.when(F.col("_hit"), 0).otherwise(F.col("attempts")), "locked_by": none("locked_by", "string"), "locked_at": none("locked_at", "timestamp"), "last_error": none("last_error", "string")}).drop("_hit")


def claim_locks(locks: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests (repo_id, job_type, worker, requested_at) with `granted`: the first of a pair gets a lock that is not there, free or over."""
    key = ["repo_id", "job_type"]
    held = locks.where(F.col("locked_by").isNotNull() & (seconds(F.col("locked_at"), F.col("lease_seconds")) >= now)).select(*key, F.lit(True).alias("_held"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("requested_at", "worker")) == 1
    return requests.withColumn("_first", first).join(held, key, "left").withColumn("granted", F.col("_first") & F.col("_held").isNull()).drop("_first", "_held")


def claimed_locks(locks: DataFrame, requests: DataFrame, now: Column, lease: int = 60) -> DataFrame:
    """locks after requests: what claim_locks() grants is held by its worker from now, with a new row and id where there was none."""
    key = ["repo_id", "job_type"]
    won = claim_locks(locks, requests, now).where("granted").select(*key, F.col("worker").alias("_worker"))
    out = locks.join(won, key, "full")
    got = F.col("_worker").isNotNull()
    out = out.withColumns({"locked_by": F.when(got, F.col("_worker")).otherwise(F.col("locked_by")), "locked_at": F.when(got, now).otherwise(F.col("locked_at")), "lease_seconds": F.when(got, F.lit(lease)).otherwise(F.col("lease_seconds"))})
    fresh = hashed(out.where("lock_id is null").drop("lock_id"), locks, "lock_id", *key)
    return out.where("lock_id is not null").select(*locks.columns).unionByName(fresh.select(*locks.columns))


def release_locks(locks: DataFrame, commands: DataFrame, force: bool = False) -> DataFrame:
    """locks after commands (lock_id, worker): free where the worker is the owner, or with force."""
    rows = locks.join(commands.select("lock_id", F.col("worker").alias("_w")), "lock_id", "left")
    free = F.col("_w").isNotNull() if force else F.coalesce(F.col("locked_by") == F.col("_w"), F.lit(False))
    return rows.withColumns({"locked_at": F.when(free, F.lit(None).cast("timestamp")).otherwise(F.col("locked_at")), "locked_by": F.when(free, F.lit(None).cast("string")).otherwise(F.col("locked_by"))}).drop("_w")


#: Fixed values of the ledger's contract: what a reaper writes.
REAPED = {"permanent": "Reaped: permanent error", "transient": "Reaped: transient error", "spent": "Reaped: job expired after max attempts", "over": "Reaped: job lock expired"}
REAPED_RUN = '{"error_type":"lease_lost","error_category":"timeout","message":"Reaped: sync run timed out"}'


def reap(jobs: DataFrame, now: Column, grace: int = 60, to_pending: bool = False, retry_delay: int = 60, multiplier: float = 1.0, longest: int = 1800) -> DataFrame:
    """Running jobs whose lease is over, with what becomes of them: new_status, retry_in, category and error.

    In order: a permanent error is dead; a transient one fails and waits by its category, attempts and the multiplier, whatever its attempts; spent
    attempts are dead, where 0 is no limit; all others are pending, or fail and wait the flat delay.
    """
    over = jobs.where((F.col("status") == "running") & (seconds(F.col("locked_at"), F.col("lease_seconds") + grace) < now))
    out = over.withColumn("_k", classify_last_error(F.col("last_error")))
    tries, most = F.coalesce("attempts", F.lit(0)), F.coalesce("max_attempts", F.lit(0))
    case = F.when(F.col("_k.permanent"), "permanent").when(F.col("_k.transient"), "transient").when((most != 0) & (tries >= most), "spent").otherwise("over")
    out = out.withColumn("_case", case)
    status = F.when(F.col("_case").isin("permanent", "spent"), "dead").when(F.col("_case") == "transient", "failed").otherwise("pending" if to_pending else "failed")
    wait = F.when(F.col("_case") == "transient", F.floor(backoff_seconds(F.col("_k.category"), tries + 1, F.col("last_error"), longest) * multiplier)).when(status == "failed", F.lit(retry_delay)).otherwise(F.lit(0))
    said = F.coalesce(*[F.when(F.col("_case") == c, F.lit(text)) for c, text in REAPED.items()])
    kind = F.when(F.col("_case").isin("permanent", "transient") & (F.col("_k.category") != ""), F.concat(F.lit(" ("), "_k.category", F.lit(")"))).otherwise(F.lit(""))
    before = F.when(F.coalesce("last_error", F.lit("")) != "", F.concat(F.lit(": "), "last_error")).otherwise(F.lit(""))
    error = F.when(status == "pending", F.col("last_error")).otherwise(redact(F.concat(said, kind, before)))
    return out.withColumns({"new_status": status, "retry_in": wait.cast("long"), "category": F.col("_k.category"), "error": error}).drop("_k", "_case")


def reaped_jobs(jobs: DataFrame, now: Column, **options) -> DataFrame:
    """jobs after a reaper's round: what is over has its new state, error and time, and no lock; attempts stay."""
    done = reap(jobs, now, **options).select("job_id", F.struct("new_status", "retry_in", "error").alias("_r"))
    hit, r = F.col("_r").isNotNull(), lambda c: F.col(f"_r.{c}")
    free = lambda c: F.when(~hit, F.col(c)).alias(c)
    changes = {"status": F.when(hit, r("new_status")).otherwise(F.col("status")), "last_error": F.when(hit, r("error")).otherwise(F.col("last_error")), "not_before": F.when(hit & (r("new_status") == "failed"), seconds(now, r("retry_in"))).otherwise(F.col("not_before")), "locked_by": free("locked_by"), "locked_at": free("locked_at")}
    if "updated_at" in jobs.columns:
        changes["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return jobs.join(done, "job_id", "left").withColumns(changes).select(*jobs.columns)


def reaped_runs(runs: DataFrame, now: Column, longest: int = 1800) -> DataFrame:
    """runs after a reaper's round: running ones that began more than `longest` seconds ago have failed now, with the reason."""
    over = (F.col("status") == "running") & F.coalesce(seconds(F.col("started_at"), F.lit(longest)) < now, F.lit(False))
    return runs.withColumn("_over", over).withColumns({"status": F.when(F.col("_over"), "failed").otherwise(F.col("status")), "finished_at": F.when(F.col("_over"), now).otherwise(F.col("finished_at")), "error_summary_json": F.when(F.col("_over"), F.lit(REAPED_RUN)).otherwise(F.col("error_summary_json") if "error_summary_json" in runs.columns else F.lit(None).cast("string"))}).drop("_over")


def reaped_locks(locks: DataFrame, now: Column) -> DataFrame:
    """locks after a reaper's round: what is held beyond its lease is free."""
    over = F.col("locked_by").isNotNull() & F.coalesce(seconds(F.col("locked_at"), F.col("lease_seconds")) < now, F.lit(False))
    return locks.withColumn("_over", over).withColumns({"locked_by": F.when(~F.col("_over"), F.col("locked_by")), "locked_at": F.when(~F.col("_over"), F.col("locked_at"))}).drop("_over")


def worker_outcomes(outbox: DataFrame, sent: DataFrame, stored: DataFrame, max_retries: int = 5) -> DataFrame:
    """What a worker does with claimed rows: a payload sent before is a duplicate; else by `stored` (outbox_id, ok): success, retry or dead; with the audit's action."""
    known = sent.where("status = 'sent'").select("target_space", "payload_sha", F.lit(True).alias("_dup")).distinct()
    rows = outbox.join(known, ["target_space", "payload_sha"], "left").join(stored, "outbox_id", "left")
    outcome = F.when(F.col("_dup"), "dedup_hit").when(F.col("ok"), "success").when(F.col("retry_count") + 1 < max_retries, "retry").otherwise("dead")
    action = F.when(outcome.isin("dedup_hit", "success"), "allow").when(outcome == "retry", "redirect").otherwise("reject")
    return rows.withColumns({"outcome": outcome, "action": action, "reason": F.concat(F.lit("outbox_flush_"), outcome)}).drop("_dup", "ok")


@query("outbox_claimed", f"SELECT outbox_id, 'me' AS locked_by, TIMESTAMP '{ORDERS_NOW}' AS locked_at FROM outbox WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '{ORDERS_NOW}' AND (locked_at IS NULL OR locked_at < TIMESTAMP '{ORDERS_NOW}' - INTERVAL 120 SECOND) ORDER BY next_attempt_at, created_at, outbox_id LIMIT 25")
def _claim(db: Ledger):
    return claim_outbox(db.outbox(), "me", ts(ORDERS_NOW), 25).where("claimed").select("outbox_id", "locked_by", "locked_at")


@query("outbox_settled", f"SELECT outbox_id, CASE WHEN NOT may THEN status WHEN outbox_id % 3 = 0 THEN 'sent' WHEN outbox_id % 3 = 2 OR retry_count + 1 >= 5 THEN 'dead' ELSE status END AS status, CASE WHEN may AND outbox_id % 3 = 1 THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN NOT may THEN last_error WHEN outbox_id % 3 = 0 THEN NULL ELSE 'x' END AS last_error, CASE WHEN may THEN TIMESTAMP '{ORDERS_NOW}' ELSE updated_at END AS updated_at, given AND NOT may AS conflict FROM (SELECT *, outbox_id % 2 = 0 AS given, coalesce(outbox_id % 2 = 0 AND status = 'pending' AND locked_by = 'w1', false) AS may FROM outbox)")
def _settle(db: Ledger):
    box = db.outbox()
    k = F.col("outbox_id")
    commands = box.where(k % 2 == 0).select("outbox_id", F.lit("w1").alias("worker"), F.when(k % 3 == 0, "sent").when(k % 3 == 1, "retry").otherwise("dead").alias("result"), F.lit(60).alias("backoff"), F.when(k % 3 != 0, "x").alias("error"))
    return settle_outbox(box, commands, ts(ORDERS_NOW)).select("outbox_id", "status", "retry_count", "last_error", "updated_at", "conflict")


@query("jobs_enqueued", "SELECT job_id, repo_id, existing IS NULL AS added, existing FROM (SELECT n.*, row_number() OVER (PARTITION BY n.repo_id, n.job_type, n.mode ORDER BY priority, job_id::bigint) AS rn, (SELECT min(a.job_id::bigint)::varchar FROM sync_jobs a WHERE a.status IN ('pending', 'running') AND a.repo_id = n.repo_id AND a.job_type = n.job_type AND a.mode = n.mode) AS existing FROM (SELECT * REPLACE (job_id::bigint % 1000 AS repo_id) FROM sync_jobs WHERE status = 'failed') n) WHERE rn = 1")
def _enqueue(db: Ledger):
    """Failed jobs again, for other repositories: the first of each key, added or with the active job that stands in its way."""
    jobs = db.sync_jobs()
    new = jobs.where("status = 'failed'").withColumn("repo_id", F.col("job_id").cast("long") % 1000)
    out = enqueue_results(jobs, new)
    return out.where("first").select("job_id", "repo_id", "added", F.col("existing").alias("existing"))


_CLAIMABLE = f"((status = 'pending' AND not_before <= TIMESTAMP '{ORDERS_NOW}') OR (status = 'running' AND locked_at + to_seconds(lease_seconds) < TIMESTAMP '{ORDERS_NOW}') OR (status = 'failed' AND not_before <= TIMESTAMP '{ORDERS_NOW}' AND attempts < max_attempts))"


@query("jobs_claimed", f"SELECT job_id, 'running' AS status, attempts + 1 AS attempts, 'me' AS locked_by FROM sync_jobs WHERE {_CLAIMABLE} AND job_type IN ('gitlab_commits', 'svn') AND (tenant_id IS NULL OR tenant_id IN ('tenant-1', 'tenant-2')) ORDER BY priority, created_at, job_id::bigint LIMIT 20")
def _claim_jobs(db: Ledger):
    return claim_jobs(db.sync_jobs(), "me", ts(ORDERS_NOW), 20, types=["gitlab_commits", "svn"], tenants=["tenant-1", "tenant-2"]).where("claimed").select("job_id", "status", "attempts", "locked_by")


@query("jobs_claimed_fair", f"SELECT job_id, tenant_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(tenant_id, '') ORDER BY priority, created_at, job_id::bigint) AS rn FROM sync_jobs WHERE {_CLAIMABLE}) WHERE rn = 1 ORDER BY priority, created_at, job_id::bigint LIMIT 10")
def _claim_fair(db: Ledger):
    return claim_jobs(db.sync_jobs(), "me", ts(ORDERS_NOW), 10, fair=True).where("claimed").select("job_id", "tenant_id")


@query("jobs_settled", "SELECT job_id, CASE WHEN NOT may THEN status WHEN k % 4 = 0 THEN 'completed' WHEN k % 4 = 1 THEN CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'failed' END WHEN k % 4 = 2 THEN 'dead' ELSE 'pending' END AS status, CASE WHEN may AND k % 4 = 3 THEN greatest(0, attempts - 1) ELSE attempts END AS attempts, NOT may AS conflict FROM (SELECT *, job_id::bigint // 3 AS k, coalesce(status = 'running' AND locked_by = 'w1', false) AS may FROM sync_jobs)")
def _settle_jobs(db: Ledger):
    jobs = db.sync_jobs()
    k = F.floor(F.col("job_id").cast("long") / 3)
    commands = jobs.select("job_id", F.lit("w1").alias("worker"), F.when(k % 4 == 0, "ack").when(k % 4 == 1, "fail").when(k % 4 == 2, "dead").otherwise("requeue").alias("result"), F.lit(30).alias("backoff"), F.lit("boom").alias("error"))
    return settle_jobs(jobs, commands, ts(ORDERS_NOW)).select("job_id", "status", "attempts", "conflict")


@query("locks_granted", "SELECT job_id, (rn = 1 AND NOT EXISTS (SELECT 1 FROM sync_locks l WHERE l.repo_id = j.repo_id AND l.job_type = j.t AND locked_by IS NOT NULL AND locked_at + to_seconds(lease_seconds) >= TIMESTAMP '2024-01-29')) AS granted FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, t ORDER BY created_at, job_id) AS rn FROM (SELECT *, CASE job_id::bigint % 2 WHEN 0 THEN 'click' ELSE 'view' END AS t FROM sync_jobs)) j")
def _locks(db: Ledger):
    requests = db.sync_jobs().select("job_id", "repo_id", F.when(F.col("job_id").cast("long") % 2 == 0, "click").otherwise("view").alias("job_type"), F.col("job_id").alias("worker"), F.col("created_at").alias("requested_at"))
    return claim_locks(db.sync_locks(), requests, ts("2024-01-29")).select("job_id", "granted")


@query("locks_after_claims", """, rq AS (SELECT repo_id, job_type, worker FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, job_type ORDER BY created_at, worker) AS rn FROM (SELECT repo_id, CASE job_id::bigint % 2 WHEN 0 THEN 'click' ELSE 'view' END AS job_type, job_id AS worker, created_at FROM sync_jobs)) WHERE rn = 1),
lj AS (SELECT repo_id, job_type, lock_id, locked_by, locked_at, worker, worker IS NOT NULL AND (locked_by IS NULL OR locked_at + to_seconds(lease_seconds) < TIMESTAMP '2024-01-29') AS got FROM sync_locks FULL JOIN rq USING (repo_id, job_type))
SELECT repo_id, job_type, CASE WHEN got THEN worker ELSE locked_by END AS locked_by, CASE WHEN got THEN TIMESTAMP '2024-01-29' ELSE locked_at END AS locked_at, lock_id IS NULL AS added FROM lj""")
def _claimed_locks(db: Ledger):
    locks = db.sync_locks()
    requests = db.sync_jobs().select("repo_id", F.when(F.col("job_id").cast("long") % 2 == 0, "click").otherwise("view").alias("job_type"), F.col("job_id").alias("worker"), F.col("created_at").alias("requested_at"))
    out = claimed_locks(locks, requests, ts("2024-01-29")).withColumnRenamed("lock_id", "_id")
    known = locks.select("repo_id", "job_type", F.lit(False).alias("_new"))
    return out.join(known, ["repo_id", "job_type"], "left").select("repo_id", "job_type", "locked_by", "locked_at", F.coalesce("_new", F.lit(True)).alias("added"))


#: The reaper's rules as SQL, in the order in which they are asked.
_REAPED = f""", rk AS (SELECT *, CASE last_error WHEN 'HTTP 429 Too Many Requests' THEN 'rate_limit' WHEN 'read timed out' THEN 'timeout' WHEN '502 Bad Gateway' THEN 'server_error' WHEN 'connection reset by peer' THEN 'network' WHEN '401 Unauthorized' THEN 'auth_error' WHEN '403 Forbidden' THEN 'permission_denied' WHEN '404 project not found' THEN 'repo_not_found' WHEN 'repo_not_found' THEN 'repo_not_found' ELSE '' END AS category,
  coalesce(status = 'running' AND locked_at + to_seconds(lease_seconds + 60) < TIMESTAMP '{ORDERS_NOW}', false) AS over FROM sync_jobs),
rc AS (SELECT *, CASE WHEN category IN ('auth_error', 'permission_denied', 'repo_not_found') THEN 'permanent' WHEN category <> '' THEN 'transient' WHEN max_attempts <> 0 AND attempts >= max_attempts THEN 'spent' ELSE 'over' END AS reaped_as FROM rk),
rr AS (SELECT *, CASE WHEN reaped_as IN ('permanent', 'spent') THEN 'dead' ELSE 'failed' END AS new_status, CASE reaped_as WHEN 'transient' THEN least(1800, CASE category WHEN 'rate_limit' THEN 120 WHEN 'timeout' THEN 30 WHEN 'server_error' THEN 90 ELSE 60 END * power(2, attempts))::bigint WHEN 'over' THEN 60 ELSE 0 END AS retry_in,
  CASE reaped_as WHEN 'permanent' THEN 'Reaped: permanent error (' || category || ')' WHEN 'transient' THEN 'Reaped: transient error (' || category || ')' WHEN 'spent' THEN 'Reaped: job expired after max attempts' ELSE 'Reaped: job lock expired' END || CASE WHEN last_error <> '' THEN ': ' || last_error ELSE '' END AS error FROM rc)
"""


@query("jobs_reaped", _REAPED + "SELECT job_id, new_status, retry_in, category, error FROM rr WHERE over")
def _reap(db: Ledger):
    return reap(db.sync_jobs(), ts(ORDERS_NOW)).select("job_id", "new_status", "retry_in", "category", "error")


@query("jobs_after_reaper", _REAPED + f"SELECT job_id, CASE WHEN over THEN new_status ELSE status END AS status, attempts, CASE WHEN over THEN error ELSE last_error END AS last_error, CASE WHEN over AND new_status = 'failed' THEN TIMESTAMP '{ORDERS_NOW}' + to_seconds(retry_in) ELSE not_before END AS not_before, CASE WHEN NOT over THEN locked_by END AS locked_by FROM rr")
def _reaped(db: Ledger):
    return reaped_jobs(db.sync_jobs(), ts(ORDERS_NOW)).select("job_id", "status", "attempts", "last_error", "not_before", "locked_by")


@query("runs_after_reaper", f"SELECT run_id, CASE WHEN over THEN 'failed' ELSE status END AS status, CASE WHEN over THEN TIMESTAMP '{EVENTS_NOW}' ELSE finished_at END AS finished_at, CASE WHEN over THEN 'lease_lost' END AS error_type FROM (SELECT *, status = 'running' AND started_at + to_seconds(1800) < TIMESTAMP '{EVENTS_NOW}' AS over FROM sync_runs)")
def _reaped_runs(db: Ledger):
    return reaped_runs(db.sync_runs(), ts(EVENTS_NOW)).select("run_id", "status", "finished_at", F.get_json_object("error_summary_json", "$.error_type").alias("error_type"))


@query("locks_after_reaper", f"SELECT lock_id, CASE WHEN NOT over THEN locked_by END AS locked_by, CASE WHEN NOT over THEN locked_at END AS locked_at FROM (SELECT *, coalesce(locked_by IS NOT NULL AND locked_at + to_seconds(lease_seconds) < TIMESTAMP '{EVENTS_NOW}', false) AS over FROM sync_locks)")
def _reaped_locks(db: Ledger):
    return reaped_locks(db.sync_locks(), ts(EVENTS_NOW)).select("lock_id", "locked_by", "locked_at")


@query("outbox_outcomes", "SELECT outbox_id, CASE WHEN EXISTS (SELECT 1 FROM outbox s WHERE s.status = 'sent' AND s.target_space = o.target_space AND s.payload_sha = o.payload_sha) THEN 'dedup_hit' WHEN outbox_id % 2 = 0 THEN 'success' WHEN retry_count + 1 < 5 THEN 'retry' ELSE 'dead' END AS outcome FROM outbox o WHERE status = 'pending'")
def _outcomes(db: Ledger):
    box = db.outbox()
    pending = box.where("status = 'pending'")
    return worker_outcomes(pending, box, pending.select("outbox_id", (F.col("outbox_id") % 2 == 0).alias("ok"))).select("outbox_id", "outcome")


def reconcile(outbox: DataFrame, audit: DataFrame, now: Column, stale_seconds: int = 600, reschedule: bool = False) -> tuple[DataFrame, DataFrame]:
    """What a reconciliation adds and changes: audit rows for states without one, and the outbox, in which stale rows may be set free and due."""
    from ledgerline.operators.joins import unaudited

    missing = unaudited(outbox, audit, now, stale_seconds)
    state = F.col("audit_state")
    action = F.when(state == "sent", "allow").when(state == "dead", "reject").otherwise("redirect")
    reason = F.when(state == "sent", "outbox_flush_success").when(state == "dead", "outbox_flush_dead").otherwise("outbox_stale")
    rows = missing.select("target_space", action.alias("action"), reason.alias("reason"), F.to_json(F.struct("outbox_id")).alias("evidence_refs_json"), F.lit("success").alias("status"), now.alias("created_at"))
    stale = missing.where(state == "stale").select("outbox_id", F.lit(True).alias("_stale"))
    if not reschedule:
        return rows, outbox
    out = outbox.join(stale, "outbox_id", "left")
    free = lambda c, t: F.when(F.col("_stale"), F.lit(None).cast(t)).otherwise(F.col(c))
    return rows, out.withColumns({"locked_by": free("locked_by", "string"), "locked_at": free("locked_at", "timestamp"), "next_attempt_at": F.when(F.col("_stale"), now).otherwise(F.col("next_attempt_at"))}).drop("_stale")
