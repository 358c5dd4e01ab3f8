"""Decisions of the ledger as chains of conditions, the first that holds deciding."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.registry import query
from ledgerline.sources.ledger import EVENTS_NOW, Ledger, age, ts


@dataclass(frozen=True)
class WritePolicy:
    """What a team space accepts; the defaults are the ledger's."""

    team_write_enabled: bool = True
    allowlist_users: tuple[str, ...] = ()
    allowed_kinds: tuple[str, ...] = ()
    require_evidence: bool = True
    max_chars: int = 1200
    bulk_mode: str = "very_short"
    bulk_max_chars: int = 200


def with_settings(requests: DataFrame, settings: DataFrame, default: WritePolicy = WritePolicy()) -> DataFrame:
    """requests with _policy, what their project's settings (project_key, team_write_enabled, policy_json) accept; what those do not say is the default, and no team space is open without settings."""
    said = lambda c, kind: F.get_json_object("policy_json", f"$.{c}").try_cast(kind)
    names = lambda c, xs: F.coalesce(F.from_json(F.get_json_object("policy_json", f"$.{c}"), "array<string>"), F.array(*[F.lit(x) for x in xs]).cast("array<string>")).alias(c)
    policy = F.struct(
        F.col("team_write_enabled").alias("team_write_enabled"), names("allowlist_users", default.allowlist_users), names("allowed_kinds", default.allowed_kinds), F.coalesce(said("require_evidence", "boolean"), F.lit(default.require_evidence)).alias("require_evidence"),
        F.coalesce(said("max_chars", "int"), F.lit(default.max_chars)).alias("max_chars"), F.coalesce(said("bulk_mode", "string"), F.lit(default.bulk_mode)).alias("bulk_mode"), F.coalesce(said("bulk_max_chars", "int"), F.lit(default.bulk_max_chars)).alias("bulk_max_chars"),
    )
    own = settings.select("project_key", policy.alias("_own"))
    return requests.join(own, "project_key", "left").withColumn("_policy", F.coalesce("_own", _literal(replace(default, team_write_enabled=False)))).drop("_own")


def _literal(policy: WritePolicy) -> Column:
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.struct(*[(names(v) if isinstance(v, tuple) else F.lit(v)).alias(k) for k, v in asdict(policy).items()])


def decide_writes(requests: DataFrame, policy: WritePolicy = WritePolicy()) -> DataFrame:
    """requests (target_space, actor_user_id, payload_md, kind, has_evidence, is_bulk) with action, reason and final_space, by the policy, or by that of each row's project: with_settings()."""
    rows = requests if "_policy" in requests.columns else requests.withColumn("_policy", _literal(policy))
    space, actor, kind, p = F.col("target_space"), F.col("actor_user_id"), F.col("kind"), lambda c: F.col(f"_policy.{c}")
    n = F.length("payload_md")
    private = F.concat(F.lit("private:"), F.coalesce(F.nullif(actor, F.lit("")), F.lit("unknown")))
    outside = lambda c, x: (F.size(p(c)) > 0) & ~F.coalesce(F.array_contains(p(c), x), F.lit(False))
    bulk = F.coalesce("is_bulk", F.lit(False))
    rules = [
        (space.startswith("private:"), "allow", F.lit("private_space")),
        (~(space.startswith("team:") | space.startswith("org:")), "reject", F.lit("unknown_space_type")),
        (~p("team_write_enabled"), "redirect", F.lit("team_write_disabled")),
        (outside("allowlist_users", actor), "redirect", F.lit("user_not_in_allowlist")),
        ((kind != "") & outside("allowed_kinds", kind), "redirect", F.concat(F.lit("kind_not_allowed:"), kind)),
        (p("require_evidence") & ~F.coalesce("has_evidence", F.lit(False)), "redirect", F.lit("missing_evidence")),
        (n > p("max_chars"), "redirect", F.concat(F.lit("exceeds_max_chars:"), n.cast("string"), F.lit(">"), p("max_chars").cast("string"))),
        (bulk & (p("bulk_mode") == "very_short") & (n > p("bulk_max_chars")), "redirect", F.lit("bulk_too_long")),
        (bulk & (p("bulk_mode") == "reject"), "redirect", F.lit("bulk_not_allowed")),
    ]
    value = lambda action, reason: F.struct(F.lit(action).alias("action"), reason.alias("reason"))
    verdict = F.when(rules[0][0], value(*rules[0][1:]))
    for condition, action, reason in rules[1:]:
        verdict = verdict.when(F.coalesce(condition, F.lit(False)), value(action, reason))
    out = rows.withColumn("_v", verdict.otherwise(value("allow", F.lit("policy_passed"))))
    return out.withColumns({"action": F.col("_v.action"), "reason": F.col("_v.reason"), "final_space": F.when(F.col("_v.action") == "redirect", private).otherwise(space)}).drop("_v", "_policy")


def validate_actors(requests: DataFrame, users: DataFrame, mode: str = "reject") -> DataFrame:
    """requests with actor_state and the space they go to, for unknown users by mode: reject, degrade (to the private space of nobody) or create (see created_users())."""
    known = users.select(F.col("user_id").alias("actor_user_id"), F.lit(True).alias("_known")).distinct()
    out = requests.join(known, "actor_user_id", "left")
    unknown = F.col("_known").isNull() & (F.coalesce("actor_user_id", F.lit("")) != "")
    state = {"reject": "actor_unknown:reject", "degrade": "actor_unknown:degrade", "create": "actor_autocreated"}[mode]
    space = F.when(unknown & F.lit(mode == "degrade"), F.lit("private:unknown")).otherwise(F.col("target_space"))
    return out.withColumns({"actor_state": F.when(unknown, F.lit(state)).otherwise("ok"), "target_space": space}).drop("_known")


def created_users(users: DataFrame, validated: DataFrame) -> DataFrame:
    """users with those that validate_actors() creates, named like their id."""
    fresh = validated.where("actor_state = 'actor_autocreated'").select(F.col("actor_user_id").alias("user_id")).distinct()
    return users.unionByName(fresh.withColumn("display_name", F.col("user_id")).select(*[c for c in users.columns if c in ("user_id", "display_name")]), allowMissingColumns=True)


def store_decisions(requests: DataFrame, users: DataFrame, sent: DataFrame, policy: WritePolicy = WritePolicy(), mode: str = "degrade", settings: DataFrame | None = None) -> DataFrame:
    """The whole way of a write: actor, duplicate, policy. `outcome` is rejected, duplicate, redirected or stored; audit_action and audit_reason go into the audit.

    An unknown actor's write that is degraded counts as redirected, for that reason, and goes to the private space of nobody.
    """
    rows = validate_actors(requests, users, mode)
    dup = sent.where("status = 'sent'").select("target_space", "payload_sha", F.lit(True).alias("_dup")).distinct()
    rows = decide_writes(rows if settings is None else with_settings(rows, settings, policy), policy).withColumn("payload_sha", F.sha2("payload_md", 256)).join(dup, ["target_space", "payload_sha"], "left")
    stopped, lowered = F.col("actor_state") == "actor_unknown:reject", F.col("actor_state") == "actor_unknown:degrade"
    outcome = F.when(stopped, "rejected").when(F.col("_dup"), "duplicate").when(lowered, "redirected").when(F.col("action") == "reject", "rejected").when(F.col("action") == "redirect", "redirected").otherwise("stored")
    reason = F.when(stopped, F.col("actor_state")).when(F.col("_dup"), "dedup_hit").when(lowered, F.col("actor_state")).otherwise(F.concat(F.lit("policy:"), "reason"))
    action = F.when(outcome.isin("stored", "duplicate"), "allow").when(outcome == "redirected", "redirect").otherwise("reject")
    return rows.withColumns({"outcome": outcome, "audit_action": action, "audit_reason": reason}).drop("_dup")


@dataclass(frozen=True)
class SchedulerConfig:
    """Limits of the scheduler; the defaults are the ledger's. Job types are logical ones; with mvp_job_types, none but these are scheduled."""

    error_budget_threshold: float = 0.3
    cursor_age_threshold_seconds: int = 3600
    rate_limit_hit_threshold: float = 0.1
    max_running: int = 5
    max_queue_depth: int = 10
    max_enqueue_per_scan: int = 100
    per_instance: int = 3
    per_tenant: int = 5
    max_per_tenant_per_round: int = 1
    tenant_fairness: bool = False
    job_type_priority: dict = field(default_factory=lambda: {"commits": 1, "mrs": 2, "reviews": 3})
    mvp_job_types: tuple[str, ...] | None = None
    bucket_paused_penalty: int = 1000
    bucket_low_penalty: int = 200
    bucket_low_share: float = 0.2


def rates(df: DataFrame) -> DataFrame:
    """df with failure_rate and rate_limit_rate of its recent counts, at most 1, 0 for nothing."""
    share = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(F.lit(0.0))
    return df.withColumns({"failure_rate": share("recent_failed_count", "recent_run_count"), "rate_limit_rate": share("recent_429_hits", "recent_total_requests")})


def repo_health(states: DataFrame, now: Column, config: SchedulerConfig = SchedulerConfig()) -> DataFrame:
    """states with should_schedule, reason and adjustment: an overrun error budget stops; an old cursor schedules, sooner the older;
    many 429s schedule later; else nothing is due."""
    rows = rates(states)
    old = F.when(F.col("cursor_updated_at").isNull(), F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), age(now, F.col("cursor_updated_at"))))
    fails, never = F.col("failure_rate") >= config.error_budget_threshold, F.col("cursor_updated_at").isNull()
    stale, limited = old >= config.cursor_age_threshold_seconds, F.col("rate_limit_rate") >= config.rate_limit_hit_threshold
    percent = lambda c: F.concat(F.format_string("%.2f", F.col(c) * 100), F.lit("%"))
    reason = F.when(fails, F.concat(F.lit("error_budget_exceeded:"), percent("failure_rate"))).when(never, "never_synced").when(stale, F.concat(F.lit("cursor_age="), F.format_string("%.0f", F.rint(old)), F.lit("s")))
    reason = reason.when(limited, F.concat(F.lit("rate_limited:"), percent("rate_limit_rate"))).otherwise("within_threshold")
    adjustment = F.when(fails, 0).when(never, -100).when(stale, -F.floor(F.least(old / 3600, F.lit(24.0))).cast("int")).when(limited, 50).otherwise(0)
    return rows.withColumns({"cursor_age": old, "should_schedule": ~fails & (stale | limited), "reason": reason, "adjustment": adjustment.cast("int")})


def job_priority(job_type: Column, adjustment: Column, failure_rate: Column, rate_limit_rate: Column, config: SchedulerConfig = SchedulerConfig()) -> Column:
    """type * 100 + adjustment + 100 * failures + 200 * 429s, fractions cut off; lower goes first."""
    base = None
    for name, p in config.job_type_priority.items():
        base = F.when(job_type == name, p) if base is None else base.when(job_type == name, p)
    return (base.otherwise(10) * 100 + adjustment + (failure_rate * 100).cast("int") + (rate_limit_rate * 200).cast("int")).cast("int")


def bucket_penalty(paused: Column, tokens: Column, burst: Column, config: SchedulerConfig = SchedulerConfig()) -> Column:
    """(penalty, reason) of an instance's bucket; 0 and null where there is none."""
    low = (burst > 0) & (tokens / burst < config.bucket_low_share)
    return F.when(F.coalesce(paused, F.lit(False)), F.struct(F.lit(config.bucket_paused_penalty).alias("penalty"), F.lit("bucket_paused").alias("reason"))).when(F.coalesce(low, F.lit(False)), F.struct(F.lit(config.bucket_low_penalty).alias("penalty"), F.lit("bucket_low_tokens").alias("reason"))).otherwise(F.struct(F.lit(0).alias("penalty"), F.lit(None).cast("string").alias("reason")))


def wants_backfill(breaker_state: Column, lag_seconds: Column, repair_window_seconds: int) -> Column:
    return breaker_state.isin("open", "half_open") | (lag_seconds > repair_window_seconds)


def repo_states(db: Ledger, last: int = 20) -> DataFrame:
    """The state of each repository that the scheduler decides on, by joins of its statistics and its cursor."""
    from ledgerline.operators.windows import repo_stats

    stats = repo_stats(db.sync_runs(), last)
    repos = db.repos().select("repo_id", "repo_type", "url", "project_key")
    return repos.join(stats, "repo_id", "left").select(
        "repo_id", "repo_type", "url", "project_key", F.col("last_run_at").alias("cursor_updated_at"), F.coalesce("recent_runs", F.lit(0)).alias("recent_run_count"), F.coalesce("failed", F.lit(0)).alias("recent_failed_count"),
        F.coalesce("hits_429", F.lit(0)).alias("recent_429_hits"), F.coalesce("requests", F.lit(0)).alias("recent_total_requests"),
    )


_STATES = """, rs AS (SELECT r.repo_id, repo_type, max(started_at) AS cur, count(run_id) AS runs, count(*) FILTER (status = 'failed') AS failed, coalesce(sum(hits_429), 0)::bigint AS hits, coalesce(sum(requests), 0)::bigint AS reqs FROM repos r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, run_id::bigint DESC) AS rn FROM sync_runs) s ON s.repo_id = r.repo_id AND rn <= 20 GROUP BY 1, 2),
rr AS (SELECT *, CASE WHEN runs > 0 THEN least(1.0::double, failed / runs) ELSE 0.0::double END AS failure_rate, CASE WHEN reqs > 0 THEN least(1.0::double, hits / reqs) ELSE 0.0::double END AS rate_limit_rate, greatest(0.0::double, (epoch_us(TIMESTAMP '%s') - epoch_us(cur)) / 1000000.0::double) AS a FROM rs),
rh AS (SELECT *, NOT failure_rate >= 0.3 AND (cur IS NULL OR a >= 3600 OR rate_limit_rate >= 0.1) AS should_schedule, CASE WHEN failure_rate >= 0.3 THEN 'error_budget_exceeded:' || printf('%%.2f', failure_rate * 100) || '%%' WHEN cur IS NULL THEN 'never_synced' WHEN a >= 3600 THEN 'cursor_age=' || round_even(a, 0)::bigint || 's' WHEN rate_limit_rate >= 0.1 THEN 'rate_limited:' || printf('%%.2f', rate_limit_rate * 100) || '%%' ELSE 'within_threshold' END AS reason, CASE WHEN failure_rate >= 0.3 THEN 0 WHEN cur IS NULL THEN -100 WHEN a >= 3600 THEN -floor(least(a / 3600, 24))::int WHEN rate_limit_rate >= 0.1 THEN 50 ELSE 0 END AS adjustment FROM rr)
""" % EVENTS_NOW


@query("repo_health", _STATES + "SELECT repo_id, should_schedule, reason, adjustment FROM rh")
def _health(db: Ledger):
    return repo_health(repo_states(db), ts(EVENTS_NOW)).select("repo_id", "should_schedule", "reason", "adjustment")


@query("job_priorities", _STATES + "SELECT repo_id, t AS job_type, (CASE t WHEN 'commits' THEN 100 WHEN 'mrs' THEN 200 WHEN 'reviews' THEN 300 ELSE 1000 END + adjustment + trunc(failure_rate * 100) + trunc(rate_limit_rate * 200))::int AS priority FROM rh, (SELECT unnest(['commits', 'mrs', 'reviews', 'svn']) AS t)")
def _priorities(db: Ledger):
    """Of each logical type, and of a name that is none."""
    rows = repo_health(repo_states(db), ts(EVENTS_NOW)).withColumn("job_type", F.explode(F.array(*[F.lit(t) for t in ("commits", "mrs", "reviews", "svn")])))
    return rows.select("repo_id", "job_type", job_priority(F.col("job_type"), F.col("adjustment"), F.col("failure_rate"), F.col("rate_limit_rate")).alias("priority"))


def _requests(db: Ledger) -> DataFrame:
    k = F.col("doc_id")
    space = F.when(k % 4 == 0, "private:me").when(k % 4 == 1, "team:p").when(k % 4 == 2, "org:shared").otherwise("other")
    return db.raw("documents").select(k.alias("request_id"), space.alias("target_space"), F.concat(F.lit("u"), k % 7).alias("actor_user_id"), F.col("text").alias("payload_md"), F.when(k % 3 == 0, "FACT").when(k % 3 == 1, "REVIEW_GUIDE").alias("kind"), (k % 5 != 0).alias("has_evidence"), (k % 2 == 0).alias("is_bulk"))


@query("write_decisions", """SELECT request_id, CASE WHEN s = 'private:me' THEN 'allow' WHEN s = 'other' THEN 'reject' WHEN r = 'policy_passed' THEN 'allow' ELSE 'redirect' END AS action, CASE WHEN s = 'private:me' THEN 'private_space' WHEN s = 'other' THEN 'unknown_space_type' ELSE r END AS reason, CASE WHEN s IN ('private:me', 'other') OR r = 'policy_passed' THEN s ELSE 'private:u' || (request_id % 7) END AS final_space FROM (SELECT doc_id AS request_id, ['private:me', 'team:p', 'org:shared', 'other'][doc_id % 4 + 1] AS s,
  CASE WHEN doc_id % 7 NOT IN (1, 2, 3, 4, 5) THEN 'user_not_in_allowlist' WHEN doc_id % 3 = 1 THEN 'kind_not_allowed:REVIEW_GUIDE' WHEN doc_id % 5 = 0 THEN 'missing_evidence' WHEN length(text) > 1200 THEN 'exceeds_max_chars:' || length(text) || '>1200' WHEN doc_id % 2 = 0 AND length(text) > 200 THEN 'bulk_too_long' ELSE 'policy_passed' END AS r FROM documents)""")
def _decisions(db: Ledger):
    policy = WritePolicy(allowlist_users=("u1", "u2", "u3", "u4", "u5"), allowed_kinds=("FACT", "DECISION"))
    return decide_writes(_requests(db), policy).select("request_id", "action", "reason", "final_space")


@query("write_outcomes", """SELECT outcome, audit_action, audit_reason, count(*) AS n FROM (SELECT CASE WHEN lost THEN 'redirected' WHEN s = 3 THEN 'rejected' WHEN s = 0 OR r = 'policy_passed' THEN 'stored' ELSE 'redirected' END AS outcome, CASE WHEN lost THEN 'redirect' WHEN s = 3 THEN 'reject' WHEN s = 0 OR r = 'policy_passed' THEN 'allow' ELSE 'redirect' END AS audit_action,
  CASE WHEN lost THEN 'actor_unknown:degrade' ELSE 'policy:' || CASE s WHEN 3 THEN 'unknown_space_type' WHEN 0 THEN 'private_space' ELSE r END END AS audit_reason
  FROM (SELECT doc_id % 4 AS s, doc_id % 7 = 6 AS lost, CASE WHEN doc_id % 5 = 0 THEN 'missing_evidence' WHEN length(text) > 1200 THEN 'exceeds_max_chars:' || length(text) || '>1200' WHEN doc_id % 2 = 0 AND length(text) > 200 THEN 'bulk_too_long' ELSE 'policy_passed' END AS r FROM documents)) GROUP BY ALL""")
def _outcomes(db: Ledger):
    users = db.spark.createDataFrame([(f"u{i}",) for i in range(6)], "user_id string")
    return store_decisions(_requests(db), users, db.outbox()).groupBy("outcome", "audit_action", "audit_reason").agg(F.count(F.lit(1)).alias("n"))


@query("write_decisions_by_project", """SELECT request_id, CASE WHEN s = 0 THEN 'allow' WHEN s = 3 THEN 'reject' WHEN r = 'policy_passed' THEN 'allow' ELSE 'redirect' END AS action, CASE s WHEN 0 THEN 'private_space' WHEN 3 THEN 'unknown_space_type' ELSE r END AS reason FROM (SELECT doc_id AS request_id, doc_id % 4 AS s,
  CASE WHEN doc_id % 9 IN (0, 8) THEN 'team_write_disabled' WHEN doc_id % 9 = 1 AND doc_id % 7 <> 1 THEN 'user_not_in_allowlist' WHEN doc_id % 9 = 2 AND doc_id % 3 = 0 THEN 'kind_not_allowed:FACT' WHEN doc_id % 9 <> 3 AND doc_id % 5 = 0 THEN 'missing_evidence' WHEN length(text) > CASE WHEN doc_id % 9 = 4 THEN 50 ELSE 1200 END THEN 'exceeds_max_chars:' || length(text) || '>' || CASE WHEN doc_id % 9 = 4 THEN 50 ELSE 1200 END
    WHEN doc_id % 9 = 5 AND doc_id % 2 = 0 THEN 'bulk_not_allowed' WHEN doc_id % 9 <> 6 AND doc_id % 2 = 0 AND length(text) > CASE WHEN doc_id % 9 = 7 THEN 400 ELSE 200 END THEN 'bulk_too_long' ELSE 'policy_passed' END AS r FROM documents)""")
def _by_project(db: Ledger):
    """Nine projects: one closed, one without settings, and one for each thing that settings can say."""
    said = ["{}", '{"allowlist_users": ["u1"]}', '{"allowed_kinds": ["REVIEW_GUIDE", "DECISION"]}', '{"require_evidence": false}', '{"max_chars": 50}', '{"bulk_mode": "reject"}', '{"bulk_mode": "any"}', '{"bulk_max_chars": 400}']
    settings = db.spark.createDataFrame([(f"p{i}", i > 0, j) for i, j in enumerate(said)], "project_key string, team_write_enabled boolean, policy_json string")
    requests = _requests(db).withColumn("project_key", F.concat(F.lit("p"), F.col("request_id") % 9))
    return decide_writes(with_settings(requests, settings)).select("request_id", "action", "reason")


@query("users_created", "SELECT actor_user_id AS user_id FROM (SELECT DISTINCT 'u' || doc_id % 7 AS actor_user_id FROM documents) UNION SELECT 'u0' UNION SELECT 'ux'")
def _created(db: Ledger):
    users = db.spark.createDataFrame([("u0",), ("ux",)], "user_id string")
    return created_users(users, validate_actors(_requests(db), users, "create")).select("user_id")
