"""The ledger's tables as views over the driver's tables, and the same mapping as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The present, as a parameter of every query that asks for it.
EVENTS_NOW, ORDERS_NOW = "2024-01-30 00:00:00", "2001-08-02 00:00:00"


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def seconds(when: Column, n: Column) -> Column:
    """when plus n seconds."""
    return F.timestamp_micros(F.unix_micros(when.cast("timestamp")) + n.cast("long") * 1_000_000)


def age(now: Column, when: Column) -> Column:
    """Seconds from when to now, as a double."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / F.lit(1_000_000.0)


class Ledger:
    """Tables of a folder of Parquet files as ledger tables. Nothing is read before a query asks for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _orders(self) -> DataFrame:
        return self.raw("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))

    def _events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))

    def items(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("item_type"), F.col("c_name").alias("title"),
            F.concat(F.lit("p"), F.col("c_nationkey")).alias("project_key"), F.when(F.col("c_acctbal") < 0, "blocked").otherwise("open").alias("status"),
            F.concat(F.lit("u"), F.col("c_custkey") % 50).alias("owner_user_id"), seconds(ts("1995-01-01"), F.col("c_custkey") * 60).alias("created_at"), seconds(ts("1995-01-01"), F.col("c_custkey") * 60 + F.col("c_custkey") % 2500 * 86400).alias("updated_at"),
        )

    def item_events(self) -> DataFrame:
        o = self._orders()
        return o.select(
            F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("event_type"),
            F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("status_to"), F.concat(F.lit("u"), F.col("o_orderkey") % 50).alias("actor_user_id"), F.col("o_orderdate").alias("created_at"),
        )

    def outbox(self) -> DataFrame:
        o, key = self._orders(), F.col("o_orderkey")
        return o.select(
            key.alias("outbox_id"), F.col("o_custkey").alias("item_id"), F.concat(F.lit("team:"), F.col("o_orderpriority")).alias("target_space"),
            F.md5(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority")).alias("payload_sha"),
            F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "sent").otherwise("dead").alias("status"),
            (key % 6).cast("int").alias("retry_count"), seconds(F.col("o_orderdate"), (key % 7) * 3600).alias("next_attempt_at"),
            F.when(key % 5 == 0, seconds(F.col("o_orderdate"), (key % 11) * 60)).alias("locked_at"), F.when(key % 5 == 0, F.concat(F.lit("w"), key % 3)).alias("locked_by"),
            F.col("o_orderdate").alias("created_at"), seconds(F.col("o_orderdate"), (key % 48) * 3600).alias("updated_at"), F.when(key % 4 == 0, F.concat(F.lit("old "), key)).alias("last_error"),
        )

    def sync_runs(self) -> DataFrame:
        e, key = self._events(), F.col("event_id")
        status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "no_data").when(F.col("event_type") == "click", "running").otherwise("completed")
        return e.select(
            key.cast("string").alias("run_id"), F.col("user_id").alias("repo_id"), job_type(key).alias("job_type"), status.alias("status"), F.col("ts").alias("started_at"),
            F.when(F.col("event_type") != "click", seconds(F.col("ts"), F.col("k"))).alias("finished_at"), F.col("k").alias("synced_count"),
            F.to_json(F.struct((F.col("k") % 5).alias("total_429_hits"), (F.col("k") % 3).alias("timeout_count"), (F.col("k") + 1).alias("total_requests"))).alias("counts"),
        )

    def sync_jobs(self) -> DataFrame:
        o, key = self._orders(), F.col("o_orderkey")
        running = F.col("o_orderstatus") == "P"
        errors = F.array(*[F.lit(x) for x in JOB_ERRORS])
        return o.select(
            key.cast("string").alias("job_id"), (F.col("o_custkey") % 120 + 1).alias("repo_id"), job_type(key).alias("job_type"), F.when(key % 2 == 0, "incremental").otherwise("backfill").alias("mode"),
            (F.substring("o_orderpriority", 1, 1).try_cast("int") * 100).alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").when(running, "running").otherwise("failed").alias("status"),
            (key % 4).cast("int").alias("attempts"), F.when(key % 8 == 0, 0).otherwise(3).alias("max_attempts"), seconds(F.col("o_orderdate"), (key % 10) * 86400).alias("not_before"),
            F.when(running, seconds(F.col("o_orderdate"), (key % 13) * 600)).alias("locked_at"), F.when(running, F.concat(F.lit("w"), key % 4)).alias("locked_by"), (300 + (key % 5) * 60).cast("int").alias("lease_seconds"),
            F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("tenant-"), F.col("o_custkey") % 25)).alias("tenant_id"), F.concat(F.lit("gl"), F.col("o_custkey") % 4, F.lit(".example.com")).alias("instance"),
            F.get(errors, (key % len(JOB_ERRORS)).cast("int")).alias("last_error"), F.col("o_orderdate").alias("created_at"),
        )

    def sync_locks(self) -> DataFrame:
        """The last event of each (user, type)."""
        last = self._events().groupBy(F.col("user_id").alias("repo_id"), F.col("event_type").alias("job_type")).agg(F.max(F.struct("ts", "event_id")).alias("m"))
        key = F.col("m.event_id")
        return last.select(key.alias("lock_id"), "repo_id", "job_type", F.when(key % 9 != 0, F.concat(F.lit("w"), key % 7)).alias("locked_by"), F.when(key % 9 != 0, F.col("m.ts")).alias("locked_at"), (3600 * (1 + key % 24)).cast("int").alias("lease_seconds"))

    def kv_changes(self) -> DataFrame:
        return self._events().select(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value_json"), F.col("ts").alias("updated_at"), "event_id")

    def write_audit(self) -> DataFrame:
        e, key = self._events(), F.col("event_id")
        reasons, spaces = F.array(*[F.lit(x) for x in AUDIT_REASONS]), F.array(F.lit("team:p"), F.lit("private:u"), F.lit("org:shared"))
        mode = F.when(key % 4 == 0, F.lit("strict")).when(key % 4 == 1, F.lit("compat"))
        refs = F.to_json(F.struct((key % 15000).alias("outbox_id"), mode.alias("mode"), F.when(key % 3 == 0, F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(F.concat(F.lit("memory://patch_blobs/git/"), i.cast("string")).alias("artifact_uri")))).alias("patches")))
        return e.select(
            key.alias("audit_id"), F.concat(F.lit("u"), F.col("user_id")).alias("actor_user_id"), F.get(spaces, (F.col("user_id") % 3).cast("int")).alias("target_space"),
            F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "view", "redirect").otherwise("allow").alias("action"), F.get(reasons, (key % len(AUDIT_REASONS)).cast("int")).alias("reason"),
            refs.alias("evidence_refs_json"), F.concat(F.lit("corr-"), key % 4000).alias("correlation_id"), F.when(key % 10 == 0, "pending").otherwise("success").alias("status"), F.col("ts").alias("created_at"),
        )

    def knowledge(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(F.col("doc_id").alias("candidate_id"), F.col("source").alias("title"), F.col("text").alias("content_md"), F.col("lang").alias("kind"), seconds(ts("2024-01-01"), F.col("doc_id") * 60).alias("created_at"))

    def patch_blobs(self) -> DataFrame:
        d, key = self.raw("documents"), F.col("doc_id")
        d = d.withColumn("sha256", F.sha2("text", 256))
        source = F.concat(F.lit("git:"), key % 40, F.lit(":"), F.substring("sha256", 1, 12))
        kinds = F.when(key % 5 == 0, F.concat(F.lit("memory://patch_blobs/git/"), source, F.lit("/"), F.col("sha256"))).when(key % 5 == 1, F.concat(F.lit("s3://bucket/"), F.col("sha256"))).when(key % 5 == 2, F.lit("")).when(key % 5 == 3, F.lit("notes/readme"))
        return d.select(
            key.alias("blob_id"), F.lit("git").alias("source_type"), source.alias("source_id"), F.when(key % 3 != 0, F.concat(F.lit("scm/1/git/"), F.col("sha256"), F.lit(".diff"))).alias("uri"), kinds.alias("evidence_uri"), "sha256",
            F.col("n_chars").alias("size_bytes"), F.when(key % 2 == 0, "diff").otherwise("diffstat").alias("format"), F.when(key % 4 == 0, "v1").when(key % 4 == 1, "v2").alias("chunking_version"),
            F.to_json(F.struct(F.when(key % 6 == 0, "failed").when(key % 6 == 1, "done").alias("materialize_status"), (key % 5).cast("int").alias("attempts"))).alias("meta_json"), seconds(ts("2024-01-01"), key * 60).alias("created_at"),
        )

    def attachments(self) -> DataFrame:
        p, key = self.raw("pages"), F.col("page_id")
        return p.select(key.alias("attachment_id"), (key % 100).alias("item_id"), F.when(key % 2 == 0, "page").otherwise("patch").alias("kind"), F.col("url").alias("uri"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size_bytes"), seconds(ts("2024-01-01"), key * 60).alias("created_at"))

    def repos(self) -> DataFrame:
        s, key = self.raw("supplier"), F.col("s_suppkey")
        return s.select(key.alias("repo_id"), F.when(key % 2 == 0, "git").otherwise("svn").alias("repo_type"), F.concat(F.lit("https://gl"), key % 4, F.lit(".example.com:443/group"), F.col("s_nationkey"), F.lit("/"), F.lower("s_name"), F.lit(".git/")).alias("url"), F.concat(F.lit("group"), F.col("s_nationkey"), F.lit("/"), F.lower("s_name")).alias("project_key"))

    def cards(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", "turn", "role", "text")


def job_type(key: Column) -> Column:
    return F.when(key % 3 == 0, "gitlab_commits").when(key % 3 == 1, "gitlab_mrs").otherwise("svn")


#: Error texts of jobs and reasons of audits, one of each kind that the rules tell apart.
JOB_ERRORS = ("HTTP 429 Too Many Requests", "read timed out", "502 Bad Gateway", "connection reset by peer", "401 Unauthorized", "403 Forbidden", "404 project not found", "unexpected value", "repo_not_found", "lease_lost", "")
AUDIT_REASONS = ("policy:policy_passed", "policy:missing_evidence", "openmemory_write_failed:api_error:outbox:7", "outbox_flush_success", "dedup_hit", "outbox_flush_dedup_hit", "outbox_flush_dead", "outbox_stale", "policy:diff_content_removed", "policy:log_content_removed", "policy:diff_or_log", "actor_unknown:degrade")


def _case(values: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{key} % {len(values)} + 1]"


#: The same mapping for SQL engines, as common table expressions.
PRELUDE = f"""
WITH RECURSIVE l_e AS (SELECT *, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events),
items AS (SELECT c_custkey AS item_id, c_mktsegment AS item_type, c_name AS title, 'p' || c_nationkey AS project_key, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE 'open' END AS status, 'u' || (c_custkey % 50) AS owner_user_id, TIMESTAMP '1995-01-01' + to_seconds(c_custkey * 60) AS created_at, TIMESTAMP '1995-01-01' + to_seconds(c_custkey * 60 + c_custkey % 2500 * 86400) AS updated_at FROM customer),
item_events AS (SELECT o_orderkey AS event_id, o_custkey AS item_id, o_orderpriority AS event_type, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status_to, 'u' || (o_orderkey % 50) AS actor_user_id, o_orderdate AS created_at FROM orders),
outbox AS (SELECT o_orderkey AS outbox_id, o_custkey AS item_id, 'team:' || o_orderpriority AS target_space, md5(o_custkey || '|' || o_orderpriority) AS payload_sha, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'sent' ELSE 'dead' END AS status, (o_orderkey % 6)::int AS retry_count, o_orderdate + to_seconds((o_orderkey % 7) * 3600) AS next_attempt_at,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + to_seconds((o_orderkey % 11) * 60) END AS locked_at, CASE WHEN o_orderkey % 5 = 0 THEN 'w' || (o_orderkey % 3) END AS locked_by, o_orderdate AS created_at, o_orderdate + to_seconds((o_orderkey % 48) * 3600) AS updated_at, CASE WHEN o_orderkey % 4 = 0 THEN 'old ' || o_orderkey END AS last_error FROM orders),
sync_runs AS (SELECT event_id::varchar AS run_id, user_id AS repo_id, CASE event_id % 3 WHEN 0 THEN 'gitlab_commits' WHEN 1 THEN 'gitlab_mrs' ELSE 'svn' END AS job_type, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'no_data' WHEN 'click' THEN 'running' ELSE 'completed' END AS status, ts AS started_at,
  CASE WHEN event_type <> 'click' THEN ts + to_seconds(k) END AS finished_at, k AS synced_count, k % 5 AS hits_429, k % 3 AS timeouts, k + 1 AS requests FROM l_e),
sync_jobs AS (SELECT o_orderkey::varchar AS job_id, o_custkey % 120 + 1 AS repo_id, CASE o_orderkey % 3 WHEN 0 THEN 'gitlab_commits' WHEN 1 THEN 'gitlab_mrs' ELSE 'svn' END AS job_type, CASE WHEN o_orderkey % 2 = 0 THEN 'incremental' ELSE 'backfill' END AS mode, substr(o_orderpriority, 1, 1)::int * 100 AS priority,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'failed' END AS status, (o_orderkey % 4)::int AS attempts, CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE 3 END AS max_attempts, o_orderdate + to_seconds((o_orderkey % 10) * 86400) AS not_before, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + to_seconds((o_orderkey % 13) * 600) END AS locked_at,
  CASE WHEN o_orderstatus = 'P' THEN 'w' || (o_orderkey % 4) END AS locked_by, (300 + (o_orderkey % 5) * 60)::int AS lease_seconds, CASE WHEN o_custkey % 11 <> 0 THEN 'tenant-' || (o_custkey % 25) END AS tenant_id, 'gl' || (o_custkey % 4) || '.example.com' AS instance, {_case(JOB_ERRORS, 'o_orderkey')} AS last_error, o_orderdate AS created_at FROM orders),
sync_locks AS (SELECT event_id AS lock_id, user_id AS repo_id, event_type AS job_type, CASE WHEN event_id % 9 <> 0 THEN 'w' || (event_id % 7) END AS locked_by, CASE WHEN event_id % 9 <> 0 THEN ts END AS locked_at, (3600 * (1 + event_id % 24))::int AS lease_seconds FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
kv_changes AS (SELECT event_type AS namespace, user_id::varchar AS key, props AS value_json, ts AS updated_at, event_id FROM events),
write_audit AS (SELECT event_id AS audit_id, 'u' || user_id AS actor_user_id, ['team:p', 'private:u', 'org:shared'][user_id % 3 + 1] AS target_space, CASE event_type WHEN 'error' THEN 'reject' WHEN 'view' THEN 'redirect' ELSE 'allow' END AS action, {_case(AUDIT_REASONS, 'event_id')} AS reason,
  event_id % 15000 AS ref_outbox_id, CASE event_id % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'compat' END AS ref_mode, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS ref_patches, 'corr-' || (event_id % 4000) AS correlation_id, CASE WHEN event_id % 10 = 0 THEN 'pending' ELSE 'success' END AS status, ts AS created_at FROM events),
knowledge AS (SELECT doc_id AS candidate_id, source AS title, text AS content_md, lang AS kind, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS created_at FROM documents),
l_d AS (SELECT *, sha256(text) AS sha256, 'git:' || (doc_id % 40) || ':' || substr(sha256(text), 1, 12) AS source_id FROM documents),
patch_blobs AS (SELECT doc_id AS blob_id, 'git' AS source_type, source_id, CASE WHEN doc_id % 3 <> 0 THEN 'scm/1/git/' || sha256 || '.diff' END AS uri, CASE doc_id % 5 WHEN 0 THEN 'memory://patch_blobs/git/' || source_id || '/' || sha256 WHEN 1 THEN 's3://bucket/' || sha256 WHEN 2 THEN '' WHEN 3 THEN 'notes/readme' END AS evidence_uri, sha256, n_chars AS size_bytes,
  CASE WHEN doc_id % 2 = 0 THEN 'diff' ELSE 'diffstat' END AS format, CASE doc_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' END AS chunking_version, CASE doc_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'done' END AS materialize_status, (doc_id % 5)::int AS attempts, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS created_at FROM l_d),
attachments AS (SELECT page_id AS attachment_id, page_id % 100 AS item_id, CASE WHEN page_id % 2 = 0 THEN 'page' ELSE 'patch' END AS kind, url AS uri, sha256(html) AS sha256, octet_length(encode(html))::bigint AS size_bytes, TIMESTAMP '2024-01-01' + to_seconds(page_id * 60) AS created_at FROM pages),
repos AS (SELECT s_suppkey AS repo_id, CASE WHEN s_suppkey % 2 = 0 THEN 'git' ELSE 'svn' END AS repo_type, 'https://gl' || (s_suppkey % 4) || '.example.com:443/group' || s_nationkey || '/' || lower(s_name) || '.git/' AS url, 'group' || s_nationkey || '/' || lower(s_name) AS project_key FROM supplier)
"""
