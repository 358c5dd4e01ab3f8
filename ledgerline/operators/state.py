"""State that the ledger keeps as key-value rows: pauses, cursors, breakers, buckets, settings, chunking versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.identifiers import legacy_breaker_keys
from ledgerline.operators.lookups import latest_per
from ledgerline.operators.writes import merged_json, upsert
from ledgerline.registry import query
from ledgerline.schemas import KEYS
from ledgerline.sources.ledger import EVENTS_NOW, Ledger, age, seconds, ts


#: Fixed values of the ledger's contract: namespaces of key-value rows.
PAUSES, HEALTH, BUCKETS, CURSORS = "scm.sync_pauses", "scm.sync_health", "scm.rate_limit", "scm.sync"


def kv_set(kv: DataFrame, rows: DataFrame, order: Column | None = None) -> DataFrame:
    """kv with rows (namespace, key, value_json, updated_at) set; the last of a key wins."""
    return upsert(kv, rows, KEYS["kv"], order=F.col("updated_at") if order is None else order)


def kv_delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select(*KEYS["kv"]).distinct(), KEYS["kv"], "left_anti")


def pause_rows(pauses: DataFrame) -> DataFrame:
    """pauses (repo_id, job_type, paused_until, reason, updated_at) as key-value rows."""
    value = F.to_json(F.struct(F.date_format("paused_until", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("paused_until"), "reason"))
    return pauses.select(F.lit(PAUSES).alias("namespace"), F.concat_ws(":", F.col("repo_id").cast("string"), "job_type").alias("key"), value.alias("value_json"), "updated_at")


#: Fixed values of the ledger's contract: what a breaker keeps, with its type, and the states that it can be in; any other counts as closed.
BREAKER = {"state": "string", "opened_at": "double", "half_open_attempts": "int", "half_open_successes": "int", "last_failure_reason": "string", "smoothed_failure_rate": "double", "smoothed_rate_limit_rate": "double", "smoothed_timeout_rate": "double"}
BREAKER_STATES = ("closed", "open", "half_open")


def breaker_rows(breakers: DataFrame) -> DataFrame:
    """breakers (key, updated_at and what BREAKER names, absent columns being null) as key-value rows."""
    held = [(F.col(c) if c in breakers.columns else F.lit(None)).cast(kind).alias(c) for c, kind in BREAKER.items()]
    return breakers.select(F.lit(HEALTH).alias("namespace"), "key", F.to_json(F.struct(*held, F.col("key").alias("key")), {"ignoreNullFields": "false"}).alias("value_json"), "updated_at")


def loaded_breakers(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """For each of keys (key): found_key and what BREAKER names, from the row of that key, or of the first of its older forms that there is.

    A breaker without a row is closed, without samples, and has no found_key; so is, but for its times, one whose state is unknown.
    """
    asked = keys.select("key").distinct().select("key", F.posexplode(F.concat(F.array("key"), legacy_breaker_keys(F.col("key")))).alias("place", "_k"))
    rows = kv.where(F.col("namespace") == HEALTH).select(F.col("key").alias("_k"), "value_json")
    found = asked.join(rows, "_k").groupBy("key").agg(F.min_by(F.struct("_k", "value_json"), "place").alias("f"))
    said = F.from_json("f.value_json", ", ".join(f"{c} {kind}" for c, kind in BREAKER.items()))
    out = keys.select("key").distinct().join(found, "key", "left").withColumn("_s", said)
    state = F.when(F.col("_s.state").isin(*BREAKER_STATES), F.col("_s.state")).otherwise("closed")
    count = lambda c: F.coalesce(f"_s.{c}", F.lit(0)).alias(c)
    return out.select("key", F.col("f._k").alias("found_key"), state.alias("state"), *[count(c) if kind == "int" else F.col(f"_s.{c}").alias(c) for c, kind in BREAKER.items() if c != "state"])


def pauses(kv: DataFrame, now: Column, expired: bool | None = False) -> DataFrame:
    """(repo_id, job_type, paused_until, reason) of key-value rows: those that hold, those that are over, or all for None."""
    until = F.try_to_timestamp(F.regexp_replace(F.get_json_object("value_json", "$.paused_until"), "Z$", "+00:00"))
    rows = kv.where(F.col("namespace") == PAUSES).select(F.split_part("key", F.lit(":"), F.lit(1)).try_cast("long").alias("repo_id"), F.split_part("key", F.lit(":"), F.lit(2)).alias("job_type"), until.alias("paused_until"), F.get_json_object("value_json", "$.reason").alias("reason"))
    return rows if expired is None else rows.where((F.col("paused_until") <= now) if expired else (F.col("paused_until") > now))


def paused_pairs(kv: DataFrame, now: Column) -> DataFrame:
    return pauses(kv, now).select("repo_id", "job_type").distinct()


def bucket_status(kv: DataFrame, now: Column, rate: float = 10.0, burst: float = 20.0) -> DataFrame:
    """Buckets (value {tokens, last_refill, rate, burst, paused_until}) as they stand at now: paused, tokens, and seconds until one may be taken.

    rate and burst stand for what a bucket does not say itself, and its updated_at for the time of its last refill.
    """
    said = lambda c: F.get_json_object("value_json", f"$.{c}").try_cast("double")
    r, most = F.coalesce(said("rate"), F.lit(rate)), F.coalesce(said("burst"), F.lit(burst))
    at = F.unix_micros(now.cast("timestamp")) / F.lit(1_000_000.0)
    since = F.coalesce(at - said("last_refill"), age(now, F.col("updated_at")))
    tokens = F.least(most, F.coalesce(said("tokens"), most) + since * r)
    left = F.greatest(F.lit(0.0), F.coalesce(said("paused_until") - at, F.lit(0.0)))
    wait = F.when(left > 0, left).otherwise(F.greatest(F.lit(0.0), (1 - tokens) / r))
    return kv.select("namespace", "key", (left > 0).alias("paused"), F.round(tokens, 6).alias("tokens"), F.round(wait, 6).alias("wait_seconds"))


def bucket_rows(buckets: DataFrame) -> DataFrame:
    """buckets (instance, tokens, last_refill in seconds, rate, burst, paused_until in seconds, updated_at) as key-value rows."""
    value = F.to_json(F.struct("tokens", "last_refill", "rate", "burst", "paused_until"))
    return buckets.select(F.lit(BUCKETS).alias("namespace"), F.concat(F.lit("bucket:"), "instance").alias("key"), value.alias("value_json"), "updated_at")


def cursor_rows(cursors: DataFrame) -> DataFrame:
    """cursors (repo_id, job_type, cursor_at, cursor_key, updated_at) as key-value rows of version 2."""
    mark = F.struct(F.date_format("cursor_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_ts"), F.col("cursor_key").alias("last_key"))
    return cursors.select(F.lit(CURSORS).alias("namespace"), F.concat(F.col("job_type"), F.lit("_cursor:"), F.col("repo_id")).alias("key"), F.to_json(F.struct(F.lit(2).alias("version"), mark.alias("watermark"))).alias("value_json"), "updated_at")


def cursor_list(kv: DataFrame) -> DataFrame:
    """(repo_id, job_type, cursor_at, cursor_key) of the key-value rows of cursors."""
    parts = F.split("key", "_cursor:")
    return kv.where((F.col("namespace") == CURSORS) & F.col("key").contains("_cursor:")).select(F.get(parts, 1).try_cast("long").alias("repo_id"), F.get(parts, 0).alias("job_type"), F.try_to_timestamp(F.regexp_replace(F.get_json_object("value_json", "$.watermark.last_ts"), "Z$", "+00:00")).alias("cursor_at"), F.get_json_object("value_json", "$.watermark.last_key").alias("cursor_key"))


def chunking_backfilled(df: DataFrame, version: str) -> DataFrame:
    """df with the chunking version in its column and in meta_json."""
    return df.withColumns({"chunking_version": F.lit(version), "meta_json": merged_json(F.col("meta_json"), F.to_json(F.struct(F.lit(version).alias("chunking_version"))))})


def settings_or_default(projects: DataFrame, settings: DataFrame) -> DataFrame:
    """projects (project_key) with their settings; missing ones get the defaults, with `created` to add them."""
    known = settings.select("project_key", "team_write_enabled", "policy_json", F.lit(True).alias("_there"))
    out = projects.select("project_key").distinct().join(known, "project_key", "left")
    return out.select("project_key", F.coalesce("team_write_enabled", F.lit(False)).alias("team_write_enabled"), F.coalesce("policy_json", F.lit("{}")).alias("policy_json"), F.col("_there").isNull().alias("created"))


def accounts_ensured(users: DataFrame, accounts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """users and accounts after rows (user_id, account_type, account_name): what is missing is added, an account keeps its first user."""
    u = users.unionByName(new.select("user_id").distinct().join(users.select("user_id"), "user_id", "left_anti"), allowMissingColumns=True)
    fresh = new.groupBy("account_type", "account_name").agg(F.min("user_id").alias("user_id")).join(accounts.select("account_type", "account_name"), ["account_type", "account_name"], "left_anti")
    return u, accounts.unionByName(fresh, allowMissingColumns=True)


def _pause_changes(db: Ledger) -> DataFrame:
    e = db._events()
    return e.select(F.col("user_id").alias("repo_id"), F.col("event_type").alias("job_type"), seconds(F.date_trunc("second", "ts"), F.col("k") * 3600).alias("paused_until"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("r"), F.col("k") % 3)).alias("reason"), F.col("ts").alias("updated_at"), "event_id")


_PAUSES = ", pz AS (SELECT user_id AS repo_id, event_type AS job_type, date_trunc('second', ts) + to_seconds(k * 3600) AS paused_until, CASE WHEN k % 3 <> 0 THEN 'r' || (k % 3) END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM l_e) WHERE rn = 1)\n"


@query("pauses_held", _PAUSES + f"SELECT * FROM pz WHERE paused_until > TIMESTAMP '{EVENTS_NOW}'")
def _held(db: Ledger):
    none = db.spark.createDataFrame([], "namespace string, key string, value_json string, updated_at timestamp")
    return pauses(kv_set(none, pause_rows(_pause_changes(db))), ts(EVENTS_NOW))


@query("pauses_expired", _PAUSES + f"SELECT repo_id, job_type FROM pz WHERE paused_until <= TIMESTAMP '{EVENTS_NOW}'")
def _over(db: Ledger):
    none = db.spark.createDataFrame([], "namespace string, key string, value_json string, updated_at timestamp")
    return pauses(kv_set(none, pause_rows(_pause_changes(db))), ts(EVENTS_NOW), expired=True).select("repo_id", "job_type")


@query("kv_after_delete", "SELECT namespace, count(*) AS n FROM (SELECT DISTINCT namespace, key FROM kv_changes) WHERE NOT (namespace = 'error' AND key::int % 2 = 0) GROUP BY 1")
def _deleted(db: Ledger):
    kv = latest_per(db.kv_changes(), KEYS["kv"], "updated_at", "event_id")
    gone = kv.where("namespace = 'error' and cast(key as int) % 2 = 0").select(*KEYS["kv"])
    return kv_delete(kv, gone).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query("buckets_now", f"SELECT namespace, key, k % 4 = 0 AS paused, round(least(20.0::double, k + greatest(0, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(updated_at)) / 1000000.0::double) * 0.0001), 6) AS tokens, round(CASE WHEN k % 4 = 0 THEN 60.0::double ELSE greatest(0.0::double, (1 - least(20.0::double, k + greatest(0, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(updated_at)) / 1000000.0::double) * 0.0001)) / 0.0001) END, 6) AS wait_seconds FROM (SELECT *, try_cast(json_extract_string(value_json, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY namespace, key ORDER BY updated_at DESC, event_id DESC) AS rn FROM kv_changes WHERE updated_at <= TIMESTAMP '{EVENTS_NOW}') WHERE rn = 1")
def _buckets(db: Ledger):
    now = ts(EVENTS_NOW)
    kv = latest_per(db.kv_changes().where(F.col("updated_at") <= now), KEYS["kv"], "updated_at", "event_id")
    k = F.get_json_object("value_json", "$.k").try_cast("int")
    value = F.to_json(F.struct(k.alias("tokens"), F.when(k % 4 == 0, F.unix_micros(now) / F.lit(1_000_000.0) + 60).alias("paused_until")))
    return bucket_status(kv.withColumn("value_json", value), now, rate=0.0001)


@query("settings_ensured", "SELECT 'p' || c_nationkey AS project_key, min(c_nationkey) % 2 = 0 AND min(c_nationkey) < 10 AS team_write_enabled, min(c_nationkey) >= 10 AS created FROM customer GROUP BY 1")
def _settings(db: Ledger):
    n = F.col("n_nationkey")
    known = db.raw("nation").where(n < 10).select(F.concat(F.lit("p"), n).alias("project_key"), (n % 2 == 0).alias("team_write_enabled"), F.lit("{}").alias("policy_json"))
    return settings_or_default(db.items(), known).select("project_key", "team_write_enabled", "created")


@query("leases_renewed", "SELECT job_id, CASE WHEN status = 'running' AND locked_by = 'w1' THEN TIMESTAMP '2001-08-02' ELSE locked_at END AS locked_at FROM sync_jobs")
def _renewed(db: Ledger):
    from ledgerline.operators.queues import renew_leases

    jobs = db.sync_jobs()
    return renew_leases(jobs, jobs.select("job_id", F.lit("w1").alias("worker")), "job_id", "running", ts("2001-08-02")).select("job_id", "locked_at")


@query("outbox_settled_without_owner", "SELECT outbox_id, CASE WHEN status = 'pending' AND outbox_id % 2 = 0 THEN 'sent' ELSE status END AS status, outbox_id % 2 = 0 AND status <> 'pending' AS conflict FROM outbox")
def _unguarded(db: Ledger):
    from ledgerline.operators.queues import settle_outbox

    box = db.outbox()
    commands = box.where("outbox_id % 2 = 0").select("outbox_id", F.lit("x").alias("worker"), F.lit("sent").alias("result"), F.lit(0).alias("backoff"), F.lit("").alias("error"))
    return settle_outbox(box, commands, ts("2001-08-02"), owner=False).select("outbox_id", "status", "conflict")


@query("blobs_chunking_backfilled", "SELECT blob_id, 'v3' AS chunking_version, 'v3' AS meta_version FROM patch_blobs WHERE chunking_version IS DISTINCT FROM 'v2'")
def _chunking(db: Ledger):
    from ledgerline.operators.lookups import chunking_outdated

    out = chunking_backfilled(chunking_outdated(db.patch_blobs(), "v2"), "v3")
    return out.select("blob_id", "chunking_version", F.get_json_object("meta_json", "$.chunking_version").alias("meta_version"))


@query("runs_finished", "SELECT run_id, CASE WHEN status = 'running' AND run_id::bigint % 2 = 0 THEN 'completed' ELSE status END AS status FROM sync_runs")
def _finished(db: Ledger):
    from ledgerline.operators.writes import finished_runs

    runs = db.sync_runs()
    ends = runs.where(F.col("run_id").cast("long") % 2 == 0).select("run_id", F.lit("completed").alias("status"), ts(EVENTS_NOW).alias("finished_at"))
    return finished_runs(runs, ends).select("run_id", "status")


@query("blobs_materialized", "SELECT blob_id, CASE WHEN blob_id % 2 = 0 THEN 'new/' || blob_id ELSE uri END AS uri, CASE WHEN blob_id % 4 = 0 THEN 'done' WHEN blob_id % 4 = 2 THEN 'done' WHEN blob_id % 4 = 1 THEN 'failed' ELSE materialize_status END AS state, CASE WHEN blob_id % 4 = 1 THEN attempts + 1 ELSE attempts END AS attempts FROM patch_blobs")
def _materialized(db: Ledger):
    from ledgerline.operators.writes import materialized

    blobs, k = db.patch_blobs(), F.col("blob_id")
    results = blobs.where(k % 4 != 3).select("blob_id", F.when(k % 2 == 0, F.concat(F.lit("new/"), k)).alias("new_uri"), F.when(k % 2 != 0, F.lit("boom")).alias("error"))
    out = materialized(blobs, results)
    return out.select("blob_id", "uri", F.get_json_object("meta_json", "$.materialize_status").alias("state"), F.get_json_object("meta_json", "$.attempts").cast("int").alias("attempts"))


@query("cursors_listed", "SELECT repo_id, job_type, date_trunc('second', started_at) AS cursor_at, run_id AS cursor_key FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, job_type ORDER BY started_at DESC, run_id::bigint DESC) AS rn FROM sync_runs) WHERE rn = 1")
def _cursors(db: Ledger):
    """Cursors that every run writes, the last of a pair standing, read back."""
    runs = db.sync_runs().select("repo_id", "job_type", F.col("started_at").alias("cursor_at"), F.col("run_id").alias("cursor_key"), F.col("started_at").alias("updated_at"))
    none = db.spark.createDataFrame([], "namespace string, key string, value_json string, updated_at timestamp")
    order = F.struct("updated_at", F.get_json_object("value_json", "$.watermark.last_key").cast("long"))
    return cursor_list(kv_set(none, cursor_rows(runs), order))


@query("rate_limit_buckets", f"""SELECT 'scm.rate_limit' AS namespace, 'bucket:' || user_id || ':' || event_type AS key, k % 4 = 0 AS paused, round(f, 6) AS tokens, round(CASE WHEN k % 4 = 0 THEN 60.0::double ELSE greatest(0.0::double, (1 - f) / r) END, 6) AS wait_seconds
FROM (SELECT *, least(b, k / 10.0::double + (epoch_us(TIMESTAMP '{EVENTS_NOW}') / 1000000.0::double - epoch_us(ts) / 1000000.0::double) * r) AS f FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 0.00001::double ELSE 10.0::double END AS r, CASE WHEN k % 3 = 0 THEN 5.0::double ELSE 20.0::double END AS b, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM l_e) WHERE rn = 1)""")
def _rate_buckets(db: Ledger):
    k = F.col("k")
    last = db._events().groupBy("user_id", "event_type").agg(F.max_by(F.struct("ts", "k"), F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", "m.*")
    at = lambda c: F.unix_micros(c) / F.lit(1_000_000.0)
    buckets = last.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("instance"), (k / 10).alias("tokens"), at(F.col("ts")).alias("last_refill"), F.when(k % 2 == 0, 0.00001).alias("rate"), F.when(k % 3 == 0, 5).alias("burst"), F.when(k % 4 == 0, at(ts(EVENTS_NOW)) + 60).alias("paused_until"), F.col("ts").alias("updated_at"))
    return bucket_status(bucket_rows(buckets), ts(EVENTS_NOW))


@query("breakers_loaded", """SELECT 'p:instance:gl' || u AS key, CASE u % 4 WHEN 0 THEN 'p:instance:gl' || u WHEN 1 THEN 'instance:gl' || u WHEN 2 THEN 'gl' || u END AS found_key, CASE WHEN u % 4 = 3 OR k % 3 = 2 THEN 'closed' WHEN k % 3 = 0 THEN 'open' ELSE 'half_open' END AS state,
  CASE WHEN u % 4 < 3 AND k % 3 = 0 THEN epoch_us(ts) / 1000000.0::double END AS opened_at, CASE WHEN u % 4 < 3 AND k % 3 = 1 THEN k % 5 ELSE 0 END::int AS half_open_attempts, CASE WHEN u % 4 < 3 AND k % 2 = 0 THEN k / 100.0::double END AS smoothed_failure_rate
  FROM (SELECT user_id AS u, ts, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM l_e) WHERE rn = 1)""")
def _breakers(db: Ledger):
    """Breakers that are kept under their key, under two older forms of it, or not at all; where a key and an older form are both there, the key counts."""
    last = db._events().groupBy(F.col("user_id").alias("u")).agg(F.max_by(F.struct("ts", "k"), F.struct("ts", "event_id")).alias("m")).select("u", "m.*")
    u, k, name = F.col("u"), F.col("k"), F.concat(F.lit("gl"), F.col("u").cast("string"))
    key = F.when(u % 4 == 0, F.concat(F.lit("p:instance:"), name)).when(u % 4 == 1, F.concat(F.lit("instance:"), name)).when(u % 4 == 2, name)
    held = last.where(u % 4 < 3).select(key.alias("key"), F.when(k % 3 == 0, "open").when(k % 3 == 1, "half_open").otherwise("strange").alias("state"), F.when(k % 3 == 0, F.unix_micros("ts") / 1_000_000.0).alias("opened_at"), F.when(k % 3 == 1, k % 5).alias("half_open_attempts"), F.when(k % 2 == 0, k / 100.0).alias("smoothed_failure_rate"), F.col("ts").alias("updated_at"))
    older = last.where(u % 4 == 0).select(name.alias("key"), F.lit("open").alias("state"), F.col("ts").alias("updated_at"))
    kv = breaker_rows(held).unionByName(breaker_rows(older))
    return loaded_breakers(kv, last.select(F.concat(F.lit("p:instance:"), name).alias("key"))).select("key", "found_key", "state", "opened_at", "half_open_attempts", "smoothed_failure_rate")
