"""The scheduler's round as one batch job: candidates by joins, fair turns by windows, and a fold over what can be enqueued."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.identifiers import instance_key, LOGICAL_TYPES, logical_job_type, physical_job_type, tenant_id
from ledgerline.operators.policy import _STATES, SchedulerConfig, bucket_penalty, job_priority, repo_health, repo_states
from ledgerline.registry import query
from ledgerline.sources.ledger import EVENTS_NOW, Ledger, seconds, ts



def candidates(states: DataFrame, active: DataFrame, paused: DataFrame, now: Column, config: SchedulerConfig = SchedulerConfig(), buckets: DataFrame | None = None, skip_paused_buckets: bool = False, job_types: Sequence[str] = LOGICAL_TYPES) -> DataFrame:
    """Jobs that could be enqueued, with priority: each due repository with each logical job type, less the pairs (repo_id, job_type) that are active or paused.

    These pairs may name logical or physical types. A type that the repository's kind does not have is left out by build_jobs() only, as it takes
    a place of the caps before. buckets (instance, paused, tokens, burst): the bucket of an instance makes its jobs wait, by a penalty on the priority, or
    with skip_paused_buckets stops them.
    """
    rows = repo_health(states, now, config).where("should_schedule")
    wanted = [t for t in job_types if config.mvp_job_types is None or t in config.mvp_job_types]
    rows = rows.withColumn("job_type", F.explode(F.array(*[F.lit(t) for t in wanted]).cast("array<string>")))
    pairs = active.select("repo_id", "job_type").unionByName(paused.select("repo_id", "job_type"))
    skip = pairs.select("repo_id", F.coalesce(logical_job_type(F.col("job_type")), "job_type").alias("job_type")).distinct()
    rows = rows.join(skip, ["repo_id", "job_type"], "left_anti")
    rows = rows.withColumns({"instance": instance_key(F.col("url")), "tenant_id": tenant_id(F.lit("{}"), F.col("project_key"))})
    penalty = F.struct(F.lit(0).alias("penalty"), F.lit(None).cast("string").alias("reason"))
    if buckets is not None:
        rows = rows.join(buckets.select("instance", F.col("paused").alias("_paused"), F.col("tokens").alias("_tokens"), F.col("burst").alias("_burst")), "instance", "left")
        rows = rows.where(~F.coalesce("_paused", F.lit(False))) if skip_paused_buckets else rows
        penalty = bucket_penalty(F.col("_paused"), F.col("_tokens"), F.col("_burst"), config)
    base = job_priority(F.col("job_type"), F.col("adjustment"), F.col("failure_rate"), F.col("rate_limit_rate"), config)
    rows = rows.withColumn("_p", penalty)
    return rows.withColumns({"priority": (base + F.col("_p.penalty")).cast("int"), "bucket_reason": F.col("_p.reason"), "created_at": F.lit(None).cast("timestamp"), "job_id": F.col("repo_id").cast("string")}).drop("_p", "_paused", "_tokens", "_burst")


def admit(rows: Iterable[dict], by_instance: dict, by_tenant: dict, config: SchedulerConfig, running: int = 0, depth: int = 0) -> list[dict]:
    """The rows that the caps let in, one after the other: what select_jobs() gives, said row by row. running and depth: running and pending jobs.

    A row that its tenant's cap stops has already used a place of its instance; one that its instance's cap stops has used none of its tenant's.
    """
    instance, tenant, out = dict(by_instance), dict(by_tenant), []
    room = 0 if running >= config.max_running else min(config.max_enqueue_per_scan, config.max_queue_depth - running - depth)
    for row in rows:
        if len(out) >= room:
            break
        i, t = row["instance"], row["tenant_id"]
        if i is not None:
            if instance.get(i, 0) >= config.per_instance:
                continue
            instance[i] = instance.get(i, 0) + 1
        if t is not None:
            if tenant.get(t, 0) >= config.per_tenant:
                continue
            tenant[t] = tenant.get(t, 0) + 1
        out.append(row)
    return out


def ranked(rows: DataFrame, config: SchedulerConfig = SchedulerConfig()) -> DataFrame:
    """Candidates with turn: by priority, or where tenants take turns by round, then the tenant's best job, then the place; ties by repository and type."""
    kind = F.array_position(F.array(*[F.lit(t) for t in LOGICAL_TYPES]), F.col("job_type")).cast("int")
    if not config.tenant_fairness or config.max_per_tenant_per_round <= 0:
        return rows.withColumn("turn", F.struct("priority", "repo_id", kind.alias("kind"), "job_type"))
    tenant = F.coalesce("tenant_id", F.lit(""))
    own = rows.withColumn("_key", F.struct("priority", "repo_id", kind.alias("kind"), "job_type")).withColumn("_t", tenant)
    place = F.row_number().over(Window.partitionBy("_t").orderBy("_key"))
    best = F.min("_key").over(Window.partitionBy("_t"))
    own = own.withColumns({"place": place, "_best": best}).withColumn("round", F.floor((F.col("place") - 1) / config.max_per_tenant_per_round))
    return own.withColumn("turn", F.struct("round", "_best", "place")).drop("_key", "_t")


def _let_in(rows: DataFrame, by: str, used: DataFrame, most: int) -> DataFrame:
    """The first rows of each group that its cap still has room for; rows without a group stay, each a group of its own."""
    group = F.coalesce(F.concat(F.lit("in:"), F.col(by)), F.concat_ws(":", F.lit("alone"), F.col("repo_id").cast("string"), F.col("job_type")))
    first = rows.withColumn("_g", group).withColumn("_k", F.row_number().over(Window.partitionBy("_g").orderBy("turn"))).where(F.col("_k") <= max(1, most))  # a rank limit, which Spark applies before the shuffle too
    return first.join(used, by, "left").where(F.col(by).isNull() | (F.col("_k") <= most - F.coalesce("_used", F.lit(0)))).select(*rows.columns)


def select_jobs(rows: DataFrame, jobs: DataFrame, config: SchedulerConfig = SchedulerConfig()) -> DataFrame:
    """The jobs of a round: what admit() lets in of the candidates in turn, without a list of them on the driver.

    Each row that reaches its instance's cap uses a place there, whatever its tenant's cap says after that. So an instance lets in its first rows in
    turn, whichever tenants they have; of these, a tenant lets in its first ones, as only they use its places; and of those the round takes
    the first that it has room for. That is one rank a cap and a top-k, and equals the rows one after the other.
    """
    active = jobs.where(F.col("status").isin("pending", "running"))
    used = lambda c: active.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_used"))
    running = F.count_if(F.col("status") == "running")
    room = active.agg(F.when(running >= config.max_running, 0).otherwise(F.least(F.lit(config.max_enqueue_per_scan), config.max_queue_depth - F.count(F.lit(1)))).alias("_room"))
    got = _let_in(_let_in(ranked(rows, config), "instance", used("instance"), config.per_instance), "tenant_id", used("tenant_id"), config.per_tenant)
    first = got.orderBy("turn").limit(config.max_enqueue_per_scan).withColumn("_k", F.row_number().over(Window.orderBy("turn")))  # of a round's rows at most
    return first.join(F.broadcast(room)).where("_k <= _room").select("repo_id", "job_type", "priority", "instance", "tenant_id", "reason")


def build_jobs(chosen: DataFrame, states: DataFrame, breakers: DataFrame, now: Column, probe: bool = False, backfill_only: bool = False, batch: int | None = None, diff_mode: str | None = None, probe_types: tuple[str, ...] = ("commits",)) -> tuple[DataFrame, DataFrame]:
    """(jobs, skipped): rows for the queue of chosen logical jobs (repo_id, job_type, priority, reason), and those that are left out, with the first reason that holds.

    Reasons: state_not_found, tenant_circuit_open and instance_circuit_open by breakers (scope, id, allow_sync, wait_seconds), of which a half open one lets
    jobs pass, and invalid_job_type_combination. The global breaker's decision gives the mode, probe before backfill, and what the payload suggests.
    """
    known = states.select("repo_id", F.col("repo_type").alias("_type"), F.col("instance").alias("_instance"), F.col("tenant_id").alias("_tenant"))
    of = lambda scope, name: breakers.where(F.col("scope") == scope).select(F.col("id").alias(name), (~F.col("allow_sync")).alias(f"{name}_stopped"), F.col("wait_seconds").alias(f"{name}_wait"))
    rows = chosen.select("repo_id", "job_type", "priority", "reason").join(known, "repo_id", "left").join(of("tenant", "_tenant"), "_tenant", "left").join(of("instance", "_instance"), "_instance", "left")
    rows = rows.withColumn("_physical", physical_job_type(F.col("_type"), F.col("job_type")))
    tenant, instance = F.coalesce("_tenant_stopped", F.lit(False)), F.coalesce("_instance_stopped", F.lit(False))
    skip = F.when(F.col("_type").isNull(), "state_not_found").when(tenant, "tenant_circuit_open").when(instance, "instance_circuit_open").when(F.col("_physical.job_type").isNull(), "invalid_job_type_combination")
    rows = rows.withColumn("_skip", skip)
    mode = F.lit("probe" if probe else "backfill" if backfill_only else "incremental")
    suggested = [F.lit(batch).cast("int").alias("suggested_batch_size"), F.lit(diff_mode).cast("string").alias("suggested_diff_mode")] if probe or backfill_only else []
    probing = [F.lit(True).alias("is_probe_mode"), F.array(*[F.lit(x) for x in probe_types]).alias("probe_job_types_allowlist")] if probe else []
    payload = F.to_json(F.struct(F.lit("v2").alias("version"), mode.alias("mode"), F.col("reason").alias("reason"), F.col("job_type").alias("logical_job_type"), F.col("_instance").alias("gitlab_instance"), F.col("_tenant").alias("tenant_id"), *suggested, *probing))
    jobs = rows.where("_skip is null").select("repo_id", F.col("_physical.job_type").alias("job_type"), mode.alias("mode"), "priority", payload.alias("payload_json"), F.lit("pending").alias("status"), now.alias("not_before"))
    wait = F.when(F.col("_skip") == "tenant_circuit_open", F.col("_tenant_wait")).when(F.col("_skip") == "instance_circuit_open", F.col("_instance_wait"))
    return jobs, rows.where("_skip is not null").select("repo_id", "job_type", F.col("_skip").alias("reason"), wait.alias("wait_seconds"))


def new_jobs(chosen: DataFrame, breakers: DataFrame, now: Column) -> DataFrame:
    """Rows for the queue: those whose tenant and instance have no open breaker (scope, id, state), with their payload."""
    stopped = breakers.where("state = 'open'")
    out = chosen.join(stopped.where("scope = 'tenant'").select(F.col("id").alias("tenant_id")), "tenant_id", "left_anti").join(stopped.where("scope = 'instance'").select(F.col("id").alias("instance")), "instance", "left_anti")
    payload = F.to_json(F.struct(F.lit("v2").alias("version"), F.lit("incremental").alias("mode"), F.col("instance").alias("gitlab_instance"), F.col("tenant_id").alias("tenant_id"), F.col("reason").alias("reason")))
    return out.select("repo_id", "job_type", F.lit("incremental").alias("mode"), "priority", payload.alias("payload_json"), F.lit("pending").alias("status"), now.alias("not_before"))


_TYPED = """, sc AS (SELECT repo_id, t AS job_type, reason, 'gl' || (repo_id % 4) || '.example.com' AS instance, split_part(project_key, '/', 1) AS tenant_id, (CASE t WHEN 'commits' THEN 100 WHEN 'mrs' THEN 200 ELSE 300 END + adjustment + trunc(failure_rate * 100) + trunc(rate_limit_rate * 200))::int AS base
  FROM rh JOIN repos r USING (repo_id), (SELECT unnest(['commits', 'mrs', 'reviews']) AS t) WHERE should_schedule
"""
#: The logical type of a queued job.
_LOGICAL = "CASE j.job_type WHEN 'gitlab_mrs' THEN 'mrs' WHEN 'gitlab_reviews' THEN 'reviews' ELSE 'commits' END"


@query("schedule_candidates", _STATES.rstrip() + _TYPED + f""" AND NOT EXISTS (SELECT 1 FROM sync_jobs j WHERE j.status = 'running' AND j.repo_id = rh.repo_id AND {_LOGICAL} = t) AND NOT (repo_id % 10 = 3 AND t = 'mrs'))
SELECT repo_id, job_type, base + CASE instance WHEN 'gl1.example.com' THEN 1000 WHEN 'gl2.example.com' THEN 200 ELSE 0 END AS priority, instance, tenant_id, reason, CASE instance WHEN 'gl1.example.com' THEN 'bucket_paused' WHEN 'gl2.example.com' THEN 'bucket_low_tokens' END AS bucket_reason FROM sc""")
def _candidates(db: Ledger):
    """All running jobs and some paused pairs are left out; of four instances one's bucket is paused and one's is low."""
    paused = db.repos().where("repo_id % 10 = 3").select("repo_id", F.lit("mrs").alias("job_type"))
    buckets = db.spark.createDataFrame([("gl1.example.com", True, 9.0, 20.0), ("gl2.example.com", False, 3.9, 20.0), ("gl3.example.com", False, 4.0, 20.0)], "instance string, paused boolean, tokens double, burst double")
    rows = candidates(repo_states(db), db.sync_jobs().where("status = 'running'"), paused, ts(EVENTS_NOW), buckets=buckets)
    return rows.select("repo_id", "job_type", "priority", "instance", "tenant_id", "reason", "bucket_reason")


#: When the rounds below look at the queue: jobs that are running then.
_ROUND_AT = "1998-03-01 00:03:00"


def _fold(fair: bool, per_instance: int, per_tenant: int, depth: int, running: int = 5) -> str:
    """SQL of a round: the candidates in turn, each let in or not by what came before it."""
    turn = "place, best, repo_id, kind" if fair else "base, repo_id, kind"
    return _STATES.rstrip() + f""", lv AS (SELECT repo_id, job_type, instance, tenant_id FROM sync_jobs WHERE status = 'running' AND locked_at <= TIMESTAMP '{_ROUND_AT}' AND locked_at + to_seconds(lease_seconds) >= TIMESTAMP '{_ROUND_AT}')
""" + _TYPED.strip() + f""" AND NOT EXISTS (SELECT 1 FROM lv j WHERE j.repo_id = rh.repo_id AND {_LOGICAL} = t)),
tk AS (SELECT *, list_position(['commits', 'mrs', 'reviews'], job_type) AS kind FROM sc),
tr AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY base, repo_id, kind) AS place, min((base, repo_id, kind)) OVER (PARTITION BY tenant_id) AS best FROM tk),
tn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {turn}) AS rn FROM tr),
fo(rn, repo_id, job_type, base, instance, tenant_id, reason, n, room, ui, ut, got) AS (SELECT 0::bigint, NULL::bigint, NULL::varchar, NULL::int, NULL::varchar, NULL::varchar, NULL::varchar, 0, (SELECT CASE WHEN count(*) >= {running} THEN 0 ELSE least(100, {depth} - count(*)) END FROM lv), (SELECT coalesce(list(instance), []) FROM lv), (SELECT coalesce(list(tenant_id) FILTER (tenant_id IS NOT NULL), []) FROM lv), false
  UNION ALL SELECT rn, repo_id, job_type, base, instance, tenant_id, reason, CASE WHEN i AND t THEN n + 1 ELSE n END, room, CASE WHEN i THEN list_append(ui, instance) ELSE ui END, CASE WHEN i AND t THEN list_append(ut, tenant_id) ELSE ut END, i AND t
  FROM (SELECT tn.*, fo.n, fo.room, fo.ui, fo.ut, fo.n < fo.room AND len(list_filter(fo.ui, lambda x: x = tn.instance)) < {per_instance} AS i, len(list_filter(fo.ut, lambda x: x = tn.tenant_id)) < {per_tenant} AS t FROM fo JOIN tn ON tn.rn = fo.rn + 1))
"""


_CHOSEN = "SELECT repo_id, job_type, base AS priority, instance, tenant_id, reason FROM fo WHERE got"


def _round(db: Ledger, config: SchedulerConfig) -> DataFrame:
    at = ts(_ROUND_AT)
    live = db.sync_jobs().where((F.col("status") == "running") & (F.col("locked_at") <= at) & (seconds(F.col("locked_at"), F.col("lease_seconds")) >= at))
    return select_jobs(candidates(repo_states(db), live, live.where("false"), ts(EVENTS_NOW), config), live, config)


@query("schedule_selected", _fold(True, 4, 2, 12, 20) + _CHOSEN)
def _selected(db: Ledger):
    """A round in which tenants take turns, over what is queued at a stated time, with small caps."""
    return _round(db, SchedulerConfig(per_instance=4, per_tenant=2, max_queue_depth=12, max_running=20, tenant_fairness=True))


@query("schedule_by_priority", _fold(False, 20, 6, 70, 20) + _CHOSEN)
def _by_priority(db: Ledger):
    """A round by priority alone, with wide caps."""
    return _round(db, SchedulerConfig(per_instance=20, per_tenant=6, max_queue_depth=70, max_running=20))


@query("schedule_round", _fold(True, 20, 9, 60, 20) + """SELECT repo_id, CASE WHEN job_type = 'commits' AND repo_type = 'svn' THEN 'svn' ELSE 'gitlab_' || job_type END AS job_type, base AS priority, 'incremental' AS mode, job_type AS logical, instance, reason FROM fo JOIN repos USING (repo_id) WHERE got AND NOT (repo_type = 'svn' AND job_type <> 'commits') AND tenant_id NOT IN ('group3')""")
def _whole_round(db: Ledger):
    """A whole round: candidates, what the caps let in, and the rows for the queue, but for a tenant whose breaker is open."""
    chosen = _round(db, SchedulerConfig(per_instance=20, per_tenant=9, max_queue_depth=60, max_running=20, tenant_fairness=True))
    states = db.repos().select("repo_id", "repo_type", instance_key(F.col("url")).alias("instance"), tenant_id(F.lit("{}"), F.col("project_key")).alias("tenant_id"))
    breakers = db.spark.createDataFrame([("tenant", "group3", False, 30.0)], "scope string, id string, allow_sync boolean, wait_seconds double")
    jobs = build_jobs(chosen, states, breakers, ts(EVENTS_NOW))[0]
    said = lambda c: F.get_json_object("payload_json", f"$.{c}")
    return jobs.select("repo_id", "job_type", "priority", "mode", said("logical_job_type").alias("logical"), said("gitlab_instance").alias("instance"), said("reason").alias("reason"))


_BUILT = """, ch AS (SELECT l_suppkey AS repo_id, CASE l_suppkey % 4 WHEN 0 THEN 'commits' WHEN 1 THEN 'mrs' WHEN 2 THEN 'reviews' ELSE 'x' END AS logical FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
bj AS (SELECT ch.*, r.repo_type, split_part(project_key, '/', 1) AS tenant, 'gl' || (repo_id % 4) || '.example.com' AS instance, CASE WHEN logical = 'commits' THEN CASE r.repo_type WHEN 'git' THEN 'gitlab_commits' ELSE 'svn' END WHEN r.repo_type = 'git' AND logical = 'mrs' THEN 'gitlab_mrs' WHEN r.repo_type = 'git' AND logical = 'reviews' THEN 'gitlab_reviews' END AS job_type
  FROM ch LEFT JOIN (SELECT * FROM repos WHERE repo_id % 7 <> 5) r USING (repo_id)),
bs AS (SELECT *, CASE WHEN repo_type IS NULL THEN 'state_not_found' WHEN tenant IN ('group3', 'group11') THEN 'tenant_circuit_open' WHEN repo_id % 4 = 2 THEN 'instance_circuit_open' WHEN job_type IS NULL THEN 'invalid_job_type_combination' END AS skip FROM bj)
"""


def _built(db: Ledger, **decision) -> tuple[DataFrame, DataFrame]:
    k = F.col("l_suppkey")
    chosen = db.raw("lineitem").select(k).distinct().select(k.alias("repo_id"), F.when(k % 4 == 0, "commits").when(k % 4 == 1, "mrs").when(k % 4 == 2, "reviews").otherwise("x").alias("job_type"), F.lit(5).alias("priority"), F.lit("due").alias("reason"))
    states = db.repos().where("repo_id % 7 != 5").select("repo_id", "repo_type", instance_key(F.col("url")).alias("instance"), tenant_id(F.lit("{}"), F.col("project_key")).alias("tenant_id"))
    breakers = db.spark.createDataFrame([("tenant", "group3", False, 30.0), ("tenant", "group11", False, 30.0), ("tenant", "group5", True, 0.0), ("instance", "gl2.example.com", False, 60.0)], "scope string, id string, allow_sync boolean, wait_seconds double")
    return build_jobs(chosen, states, breakers, ts(EVENTS_NOW), **decision)


@query("jobs_built", _BUILT + "SELECT repo_id, job_type, 'probe' AS mode, logical, 10 AS batch FROM bs WHERE skip IS NULL")
def _jobs_built(db: Ledger):
    jobs = _built(db, probe=True, backfill_only=True, batch=10, diff_mode="none")[0]
    said = lambda c: F.get_json_object("payload_json", f"$.{c}")
    return jobs.select("repo_id", "job_type", "mode", said("logical_job_type").alias("logical"), said("suggested_batch_size").cast("int").alias("batch"))


@query("jobs_not_built", _BUILT + "SELECT repo_id, logical AS job_type, skip AS reason, CASE skip WHEN 'tenant_circuit_open' THEN 30.0::double WHEN 'instance_circuit_open' THEN 60.0::double END AS wait_seconds FROM bs WHERE skip IS NOT NULL")
def _jobs_not_built(db: Ledger):
    return _built(db)[1]
