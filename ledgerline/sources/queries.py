"""Queries that read what sources parse and sinks render, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import identifiers, payloads, timing, uris
from ledgerline.functions.errors import is_ignored
from ledgerline.functions.text import redact_json
from ledgerline.operators import aggregates, joins, lookups, policy, queues, state, writes
from ledgerline.registry import query
from ledgerline.schemas import schema_drift
from ledgerline.sources import connectors, sinks
from ledgerline.sources.ledger import EVENTS_NOW, ORDERS_NOW, Ledger, ts
from ledgerline.streaming import cursors


# ---- sources


def _answers(db: Ledger, key: str, *fields):
    """Orders of a customer as one API answer: a JSON array of objects."""
    return db._orders().groupBy(F.col("o_custkey").alias(key)).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("value"))


def _id():
    return F.col("o_orderkey").cast("string")


def _at():
    return F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query("commits_read", "SELECT o_custkey AS repo_id, o_orderkey::varchar AS commit_sha, 'git:' || o_custkey || ':' || o_orderkey AS source_id, o_orderstatus || ' <' || o_orderpriority || '>' AS author_raw, date_trunc('second', o_orderdate) AS ts, o_orderkey % 3 = 0 AS is_merge, o_orderkey % 7 AS additions FROM orders")
def _commits(db: Ledger):
    parents = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    raw = _answers(db, "repo_id", _id().alias("id"), F.col("o_orderstatus").alias("author_name"), F.col("o_orderpriority").alias("author_email"), _at().alias("committed_date"), F.lit("m").alias("message"), parents.alias("parent_ids"), F.struct((F.col("o_orderkey") % 7).alias("additions")).alias("stats"))
    return connectors.commits_of(raw).select("repo_id", "commit_sha", "source_id", "author_raw", "ts", "is_merge", F.col("stats.additions").alias("additions"))


@query("diffs_read", "SELECT o_custkey AS repo_id, 'c' AS commit_sha, CASE WHEN o_orderkey % 5 = 0 THEN 'old/' || o_orderkey ELSE 'new/' || o_orderkey END AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'added' WHEN o_orderkey % 4 = 1 THEN 'deleted' WHEN o_orderkey % 4 = 2 THEN 'renamed' ELSE 'modified' END AS change FROM orders")
def _diffs(db: Ledger):
    k = F.col("o_orderkey")
    raw = _answers(db, "repo_id", F.concat(F.lit("old/"), _id()).alias("old_path"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("new/"), _id())).alias("new_path"), (k % 4 == 0).alias("new_file"), (k % 4 == 1).alias("deleted_file"), (k % 4 == 2).alias("renamed_file"), F.lit("@@").alias("diff"))
    return connectors.diffs_of(raw.withColumn("commit_sha", F.lit("c"))).select("repo_id", "commit_sha", "path", "change")


@query("merge_requests_read", "SELECT o_custkey AS repo_id, 'mr:' || o_custkey || ':' || o_orderkey AS source_id, o_orderkey AS iid, o_orderstatus AS status, o_orderpriority AS author, date_trunc('second', o_orderdate) AS updated_at FROM orders")
def _requests(db: Ledger):
    raw = _answers(db, "repo_id", F.col("o_orderkey").alias("iid"), F.lit("t").alias("title"), F.col("o_orderstatus").alias("state"), _at().alias("updated_at"), F.struct(F.col("o_orderpriority").alias("username")).alias("author"))
    return connectors.merge_requests_of(raw).select("repo_id", "source_id", "iid", "status", "author", "updated_at")


@query("review_events_read", "SELECT o_custkey::varchar AS mr_id, 'note:' || o_orderkey AS source_event_id, o_orderpriority AS author, date_trunc('second', o_orderdate) AS ts FROM orders")
def _reviews(db: Ledger):
    raw = _answers(db, "mr_id", _id().alias("id"), F.lit("b").alias("body"), _at().alias("created_at"), F.struct(F.col("o_orderpriority").alias("username")).alias("author"))
    out = connectors.review_events_of(raw.withColumn("mr_id", F.col("mr_id").cast("string")), "note")
    return out.select("mr_id", "source_event_id", F.get_json_object("payload_json", "$.author").alias("author"), "ts")


@query("discussions_read", "SELECT o_custkey::varchar AS mr_id, 'd' || o_orderkey AS discussion_id, 'note:' || o_orderkey || '-' || n AS source_event_id, n = 1 AND o_orderkey % 2 = 0 AS resolved FROM orders, range(2) t(n)")
def _discussions(db: Ledger):
    note = lambda n: F.struct(F.concat(_id(), F.lit(f"-{n}")).alias("id"), F.lit("b").alias("body"), _at().alias("created_at"), F.when(F.lit(n == 1), F.col("o_orderkey") % 2 == 0).alias("resolved"))
    raw = _answers(db, "mr_id", F.concat(F.lit("d"), _id()).alias("id"), F.array(note(0), note(1)).alias("notes"))
    return connectors.discussions_of(raw.withColumn("mr_id", F.col("mr_id").cast("string"))).select("mr_id", "discussion_id", "source_event_id", "resolved")


@query("revisions_read", "SELECT o_custkey AS repo_id, o_orderkey AS rev_num, 'svn:' || o_custkey || ':' || o_orderkey AS source_id, o_orderpriority AS author_raw, date_trunc('second', o_orderdate) AS ts, (o_orderkey % 3)::int AS changed_paths FROM orders")
def _revisions(db: Ledger):
    """A log of each repository in XML, with none, one or two changed paths."""
    k = F.col("o_orderkey")
    path = F.lit('<path action="M" kind="file">/a</path>')
    entry = F.concat(F.lit('<logentry revision="'), k.cast("string"), F.lit('"><author>'), "o_orderpriority", F.lit("</author><date>"), _at(), F.lit("</date><paths>"), F.repeat(path, (k % 3).cast("int")), F.lit("</paths><msg>m</msg></logentry>"))
    raw = db._orders().groupBy(F.col("o_custkey").alias("repo_id")).agg(F.concat(F.lit("<log>"), F.array_join(F.collect_list(entry), ""), F.lit("</log>")).alias("value"))
    return connectors.revisions_of(raw).select("repo_id", "rev_num", "source_id", "author_raw", "ts", F.col("changed_paths").cast("int").alias("changed_paths"))


@query("identities_read", "SELECT 'u' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.md' ELSE '.yaml' END AS path, key, values FROM customer, (SELECT unnest(['name', 'aliases', 'roles']) AS key) k, LATERAL (SELECT CASE key WHEN 'name' THEN [c_name] WHEN 'aliases' THEN ['a' || c_custkey, 'b c'] ELSE ['r1', 'r' || c_nationkey] END AS values)")
def _identities(db: Ledger):
    """A file of each user, YAML or the front matter of Markdown, with all three forms of a value."""
    yaml = F.concat(F.lit('name: "'), "c_name", F.lit('"\naliases: [a'), "c_custkey", F.lit(", 'b c']\nroles:\n  - r1\n  - r"), "c_nationkey", F.lit("\n"))
    even = F.col("c_custkey") % 2 == 0
    raw = db.raw("customer").select(F.concat(F.lit("u"), "c_custkey", F.when(even, ".md").otherwise(".yaml")).alias("path"), F.when(even, F.concat(F.lit("---\n"), yaml, F.lit("---\n# Text\nnot: this\n"))).otherwise(yaml).alias("text"))
    return connectors.identities_of(raw)


@query("users_merged", "SELECT user_id, coalesce(o.name, b.name) AS name, CASE WHEN b.k IS NULL THEN ['x', 'y'] WHEN o.k IS NULL THEN ['a', 'x'] ELSE ['a', 'x', 'y'] END AS aliases FROM (SELECT s_suppkey AS k, 'u' || s_suppkey AS user_id, s_name AS name FROM supplier) b FULL JOIN (SELECT c_custkey AS k, 'u' || c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer WHERE c_custkey > 5) o USING (user_id)")
def _users(db: Ledger):
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    base = db.raw("supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("user_id"), F.col("s_name").alias("name"), names("a", "x").alias("aliases"), names("r").alias("roles"))
    k = F.col("c_custkey")
    over = db.raw("customer").where(k > 5).select(F.concat(F.lit("u"), k).alias("user_id"), F.when(k % 2 == 0, F.col("c_name")).alias("name"), names("x", "y").alias("aliases"), names("r").alias("roles"))
    return connectors.merged_users(base, over).select("user_id", "name", "aliases")


@query("webhooks_read", "SELECT event_id::varchar AS request_id, 'b' || user_id AS bucket, CASE WHEN event_type <> 'view' THEN 'k/' || event_id END AS object_key, event_type AS operation, (200 + event_id % 3 * 150)::int AS status_code, event_id % 3 < 2 AS success, '10.0.0.' || (event_id % 9) AS remote_ip, date_trunc('second', ts) AS event_ts FROM events UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation")
def _webhooks(db: Ledger):
    """An event a line, and some lines that are none."""
    k = F.col("event_id")
    api = F.struct(F.col("event_type").alias("name"), F.concat(F.lit("b"), "user_id").alias("bucket"), F.when(F.col("event_type") != "view", F.concat(F.lit("k/"), k)).alias("object"), (200 + k % 3 * 150).alias("statusCode"))
    lines = db._events().select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), api.alias("api"), k.cast("string").alias("requestID"), F.concat(F.lit("10.0.0."), k % 9, F.lit(":99")).alias("remotehost"))).alias("value"))
    out = connectors.object_store_events(lines.unionByName(db.raw("nation").select(F.concat(F.lit("not json "), "n_name").alias("value"))))
    return out.select("request_id", "bucket", "object_key", "operation", "status_code", "success", "remote_ip", "event_ts")


@query("vectors_near", "SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)), lambda p: p[1]::double * p[2]::double)) AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10")
def _near(db: Ledger):
    vectors = db.raw("embeddings").select("vec_id", "embedding")
    one = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("_query"))
    return connectors.vector_search(F.col("_query"), vectors.join(F.broadcast(one)), "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query("artifacts_sampled", "SELECT blob_id FROM patch_blobs WHERE uri LIKE 'scm/1/%' AND ('0x' || substr(md5(uri), 1, 8))::bigint % 4 = 0")
def _sampled(db: Ledger):
    """A fourth of the artifacts under a prefix, the same each time: the sampling that an audit asks for."""
    return lookups.sampled(db.patch_blobs(), "uri", "scm/1/", 4).select("blob_id")


# ---- sinks


def _listed(db: Ledger):
    k = F.col("item_id")
    return joins.items_with_latest_event(db.items(), db.item_events()).withColumns({"title": F.when(k % 3 == 0, F.concat("title", F.lit(', "q" | x'))).otherwise(F.col("title")), "active_at": F.date_format("active_at", "yyyy-MM-dd")})


_LISTED = """, li AS (SELECT item_id, item_type, CASE WHEN item_id % 3 = 0 THEN title || ', "q" | x' ELSE title END AS title, project_key, status, owner_user_id, event_id, event_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(coalesce(event_at, updated_at), '%Y-%m-%d') AS active_at
  FROM items LEFT JOIN (SELECT item_id, event_id, event_type, created_at AS event_at FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, event_id DESC) AS rn FROM item_events) WHERE rn = 1) USING (item_id))
"""


@query("manifest_rendered", _LISTED + """SELECT item_id, array_to_string([item_id::varchar, item_type, CASE WHEN item_id % 3 = 0 THEN '"' || replace(title, '"', '""') || '"' ELSE title END, project_key, status, owner_user_id, coalesce(event_id::varchar, ''), coalesce(event_type, ''), created_at, active_at], ',') AS line FROM li""")
def _manifest(db: Ledger):
    return sinks.manifest_rows(_listed(db))


@query("index_rendered", _LISTED + r"SELECT item_id, '| ' || array_to_string([item_id::varchar, item_type, replace(title, '|', '\|'), status, active_at], ' | ') || ' |' AS line FROM li")
def _index(db: Ledger):
    return sinks.index_rows(_listed(db))


@query("metrics_rendered", """, mt AS (SELECT status AS label, count(*) AS n FROM sync_jobs GROUP BY 1) SELECT 'ledger_jobs{label="' || label || '"} ' || n AS line FROM mt UNION ALL SELECT '# HELP ledger_jobs jobs' || chr(10) || '# TYPE ledger_jobs gauge'""")
def _metrics(db: Ledger):
    return sinks.prometheus_lines(db.sync_jobs().groupBy(F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("jobs").alias("metric"), "label", "n"))


@query("enveloped", """SELECT '{"ok":true,"code":"OK","rows":[' || string_agg('{"repo_type":"' || repo_type || '","n":' || n || '}', ',' ORDER BY repo_type) || ']}' AS json FROM (SELECT repo_type, count(*) AS n FROM repos GROUP BY 1)""")
def _enveloped(db: Ledger):
    return sinks.envelope(db.repos().groupBy("repo_type").agg(F.count(F.lit(1)).alias("n")).orderBy("repo_type").coalesce(1))


# ---- lists and writes


@query("jobs_listed", "SELECT job_id, status, priority FROM sync_jobs WHERE status = 'running' ORDER BY priority, created_at, job_id::bigint LIMIT 50")
def _jobs(db: Ledger):
    return lookups.by_key(db.sync_jobs(), status="running").orderBy("priority", "created_at", F.col("job_id").cast("long")).limit(50).select("job_id", "status", "priority")


@query("locks_listed", "SELECT lock_id, repo_id, locked_by FROM sync_locks WHERE locked_by IS NOT NULL ORDER BY locked_at DESC, lock_id LIMIT 50")
def _locks(db: Ledger):
    return db.sync_locks().where("locked_by is not null").orderBy(F.desc("locked_at"), "lock_id").limit(50).select("lock_id", "repo_id", "locked_by")


@query("blob_by_key", "SELECT blob_id FROM patch_blobs WHERE source_type = 'git' AND sha256 = (SELECT sha256 FROM patch_blobs WHERE blob_id = 5) AND source_id = (SELECT source_id FROM patch_blobs WHERE blob_id = 5)")
def _blob(db: Ledger):
    blobs = db.patch_blobs()
    return blobs.join(lookups.by_key(blobs, blob_id=5).select("source_type", "source_id", "sha256"), ["source_type", "source_id", "sha256"], "left_semi").select("blob_id")


@query("settings_of_project", "SELECT 'p' || n_nationkey AS project_key, n_nationkey % 2 = 0 AS team_write_enabled FROM nation WHERE n_nationkey = 7")
def _settings(db: Ledger):
    n = F.col("n_nationkey")
    return lookups.by_key(db.raw("nation").select(F.concat(F.lit("p"), n).alias("project_key"), (n % 2 == 0).alias("team_write_enabled")), project_key="p7")


_MR = "SELECT DISTINCT event_id % 500 AS m FROM events"


@query("mrs_upserted", f"SELECT 'm' || coalesce(s.k, c.m) AS mr_id, CASE WHEN c.m IS NULL THEN 'open' WHEN c.m % 2 = 0 THEN 'merged' ELSE 'closed' END AS status, CASE WHEN c.m IS NULL OR c.m % 3 = 0 THEN CASE WHEN s.k IS NOT NULL THEN 'old' END ELSE 'new' END AS author_user_id FROM (SELECT s_suppkey AS k FROM supplier) s FULL JOIN ({_MR}) c ON s.k = c.m")
def _mrs(db: Ledger):
    known = db.raw("supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("mr_id"), F.lit("open").alias("status"), F.lit("old").alias("author_user_id"))
    m = F.col("event_id") % 500
    changes = db.raw("events").select(F.concat(F.lit("m"), m).alias("mr_id"), F.when(m % 2 == 0, "merged").otherwise("closed").alias("status"), F.when(m % 3 != 0, "new").alias("author_user_id"), "event_id")
    return writes.upsert(known, changes, ["mr_id"], keep=["author_user_id"], order=F.col("event_id"))


@query("reviews_inserted", "SELECT 'note:' || m AS source_event_id, min(event_id) AS event_id FROM (SELECT event_id % 700 AS m, event_id FROM events) WHERE m NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def _inserted(db: Ledger):
    known = db.raw("supplier").select(F.concat(F.lit("note:"), "s_suppkey").alias("source_event_id"))
    rows = db.raw("events").select(F.concat(F.lit("note:"), F.col("event_id") % 700).alias("source_event_id"), "event_id")
    return writes.insert_new(known, rows, ["source_event_id"], "event_id")


@query("commits_upserted", "SELECT coalesce(n, k) AS sha, coalesce(m, 'old') AS message FROM (SELECT s_suppkey AS k FROM supplier) s FULL JOIN (SELECT p_partkey % 300 AS n, max(p_name) FILTER (p_partkey = mx) AS m FROM part JOIN (SELECT p_partkey % 300 AS g, max(p_partkey) AS mx FROM part GROUP BY 1) ON g = p_partkey % 300 GROUP BY 1) p ON k = n")
def _commit_rows(db: Ledger):
    known = db.raw("supplier").select(F.col("s_suppkey").alias("sha"), F.lit("old").alias("message"))
    return writes.upsert(known, db.raw("part").select((F.col("p_partkey") % 300).alias("sha"), F.col("p_name").alias("message"), "p_partkey"), ["sha"], order=F.col("p_partkey"))


@query("kv_after_late_changes", "SELECT namespace, key, value_json, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY updated_at DESC) AS rn FROM kv_changes) WHERE rn = 1")
def _late(db: Ledger):
    """Newer changes first, then the older ones, which come late and change nothing that is newer."""
    changes = db.kv_changes().drop("event_id")
    cut = ts("2024-01-15")
    first = state.kv_set(changes.where("false"), changes.where(F.col("updated_at") >= cut))
    return state.kv_set(first, changes.where(F.col("updated_at") < cut))


@query("items_created", "SELECT c_mktsegment AS item_type, c_name AS title, 'open' AS status, '{}' AS scope_json, true AS new_id FROM customer")
def _created(db: Ledger):
    """New items beside those that are there; their ids are new, each once."""
    items = db.items()
    out = writes.create_items(items, db.raw("customer").select(F.col("c_mktsegment").alias("item_type"), F.col("c_name").alias("title")), ts(EVENTS_NOW))
    fresh = out.where(F.col("created_at") == ts(EVENTS_NOW))
    once = fresh.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    top = items.agg(F.max("item_id").alias("_top"))
    return fresh.join(once, "item_id").join(F.broadcast(top)).select("item_type", "title", "status", F.lit("{}").alias("scope_json"), ((F.col("_n") == 1) & (F.col("item_id") > F.col("_top"))).alias("new_id"))


@query("attachments_added", "SELECT count(*) FILTER (ok) AS added, count(*) FILTER (NOT ok) AS refused, (SELECT count(*) FROM pages) AS before FROM (SELECT p_partkey IN (SELECT c_custkey FROM customer) AS ok FROM part)")
def _attached(db: Ledger):
    old = db.attachments()
    new = db.raw("part").select(F.col("p_partkey").alias("item_id"), F.lit("log").alias("kind"), F.concat(F.lit("f/"), "p_partkey").alias("uri"), F.sha2("p_name", 256).alias("sha256"), F.lit(1).cast("long").alias("size_bytes"))
    out, refused = writes.attached(old, new, db.items(), ts(EVENTS_NOW))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(out.join(old, "attachment_id", "left_anti"), "added").join(n(refused, "refused")).join(n(old, "before"))


_EVIDENCE = """, ev AS (SELECT event_id, 'u' || (user_id % 40) AS actor, event_id % 8 AS c FROM events)
"""


@query("audits_inserted", _EVIDENCE + "SELECT event_id, actor AS actor_user_id, CASE c WHEN 1 THEN 'pending' ELSE 'success' END AS status, CASE WHEN c % 2 = 0 THEN 'corr' END AS correlation_id FROM ev WHERE c NOT IN (2, 3, 4, 5, 6)")
def _audits(db: Ledger):
    rows = _new_audits(db)[0].where(F.col("created_at") == ts(EVENTS_NOW))
    return rows.select(F.split_part("reason", F.lit(":"), F.lit(2)).cast("long").alias("event_id"), "actor_user_id", "status", "correlation_id")


@query("audits_refused", _EVIDENCE + "SELECT event_id, CASE c WHEN 2 THEN 'invalid_status' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'patches_not_a_list' WHEN 5 THEN 'invalid_patch' ELSE 'invalid_attachment' END AS fault FROM ev WHERE c IN (2, 3, 4, 5, 6)")
def _refused(db: Ledger):
    return _new_audits(db)[2].select(F.split_part("reason", F.lit(":"), F.lit(2)).cast("long").alias("event_id"), "fault")


@query("audit_users", _EVIDENCE + "SELECT actor AS user_id, actor AS display_name FROM ev WHERE c NOT IN (2, 3, 4, 5, 6) AND actor <> 'u0' UNION SELECT 'u0', 'Zero'")
def _audit_users(db: Ledger):
    return _new_audits(db)[1]


def _new_audits(db: Ledger):
    """Good rows, an unknown state, and evidence of each wrong form."""
    c, sha = F.col("event_id") % 8, "a" * 64
    good = f'{{"patches": [{{"artifact_uri": "memory://patch_blobs/git/1:abc/{sha}", "sha256": "{sha}", "source_id": "1:abc", "source_type": "git", "kind": "patch"}}], "attachments": [{{"artifact_uri": "memory://attachments/7/{sha}", "sha256": "{sha}"}}]}}'
    evidence = F.when(c == 0, good).when(c == 3, "[1]").when(c == 4, '{"patches": {}}').when(c == 5, good.replace(f'"sha256": "{sha}", "source_id"', f'"sha256": "{"b" * 64}", "source_id"')).when(c == 6, good.replace("attachments/7/", "attachments/x/")).when(c == 7, "{}")
    new = db.raw("events").select(F.concat(F.lit("u"), F.col("user_id") % 40).alias("actor_user_id"), F.lit("team:p").alias("target_space"), F.lit("allow").alias("action"), F.concat(F.lit("n:"), "event_id").alias("reason"), evidence.alias("evidence_refs_json"), F.when(c % 2 == 0, "corr").otherwise("").alias("correlation_id"), F.when(c == 1, "pending").when(c == 2, "odd").alias("status"))
    users = db.spark.createDataFrame([("u0", "Zero")], "user_id string, display_name string")
    return writes.inserted_audits(db.write_audit().where(F.col("created_at") != ts(EVENTS_NOW)), users, new, ts(EVENTS_NOW), validate=True)


@query("accounts_ensured", "SELECT account_name, min(user_id) AS user_id FROM (SELECT 'a' || s_suppkey AS account_name, 'old' AS user_id FROM supplier UNION ALL SELECT 'a' || (c_custkey % 500), 'u' || c_custkey FROM customer WHERE c_custkey % 500 NOT IN (SELECT s_suppkey FROM supplier)) GROUP BY 1")
def _accounts(db: Ledger):
    known = db.raw("supplier").select(F.lit("git").alias("account_type"), F.concat(F.lit("a"), "s_suppkey").alias("account_name"), F.lit("old").alias("user_id"))
    new = db.raw("customer").select(F.concat(F.lit("u"), "c_custkey").alias("user_id"), F.lit("git").alias("account_type"), F.concat(F.lit("a"), F.col("c_custkey") % 500).alias("account_name"))
    return state.accounts_ensured(db.spark.createDataFrame([("old",)], "user_id string"), known, new)[1].select("account_name", "user_id")


@query("source_ids_filled", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'kept' ELSE CASE event_id % 3 WHEN 0 THEN 'svn:' ELSE CASE event_id % 3 WHEN 1 THEN 'git:' ELSE 'mr:' END END || user_id || ':' || CASE event_id % 3 WHEN 2 THEN (event_id * 7)::varchar ELSE event_id::varchar END END AS source_id FROM events")
def _filled(db: Ledger):
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "svn").when(k % 3 == 1, "git").otherwise("mr")
    number = F.when(k % 3 != 2, k.cast("string")).when(k % 2 == 0, F.concat(F.lit("g/p!"), k * 7)).otherwise(F.concat(F.lit("https://h/g/p/merge_requests/"), k * 7))
    rows = db.raw("events").select("event_id", kind.alias("kind"), F.col("user_id").alias("repo_id"), number.alias("number"), F.when(k % 4 == 0, "kept").when(k % 4 == 1, "").alias("source_id"))
    return writes.filled_source_ids(rows).select("event_id", "source_id")


@query("jobs_reset", "SELECT job_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts, CASE WHEN status = 'failed' THEN NULL ELSE last_error END AS last_error FROM sync_jobs")
def _reset(db: Ledger):
    """Failed jobs taken as dead, and set free."""
    jobs = db.sync_jobs().withColumn("status", F.when(F.col("status") == "failed", "dead").otherwise(F.col("status")))
    return queues.reset_dead(jobs).select("job_id", "status", "attempts", "last_error")


@query("locks_released", "SELECT lock_id, CASE WHEN lock_id % 2 = 0 AND locked_by = 'w3' THEN NULL ELSE locked_by END AS locked_by, CASE WHEN lock_id % 2 = 0 THEN NULL ELSE locked_by END AS forced FROM sync_locks")
def _released(db: Ledger):
    locks = db.sync_locks()
    commands = locks.where("lock_id % 2 = 0").select("lock_id", F.lit("w3").alias("worker"))
    forced = queues.release_locks(locks, commands, force=True).select("lock_id", F.col("locked_by").alias("forced"))
    return queues.release_locks(locks, commands).select("lock_id", "locked_by").join(forced, "lock_id")


# ---- functions


@query("artifact_keys", "SELECT blob_id, form, CASE form WHEN 0 THEN 'scm/' || blob_id || '/git/a.diff' WHEN 1 THEN 'x/' || blob_id WHEN 2 THEN 'b/' || blob_id ELSE NULL END AS key, CASE WHEN form = 0 THEN blob_id END AS repo_id FROM patch_blobs, range(4) t(form)")
def _keys(db: Ledger):
    k = F.col("blob_id")
    forms = F.array(F.concat(F.lit("artifact://scm//"), k, F.lit("/./git/a.diff")), F.concat(F.lit("y/../x/"), k), F.concat(F.lit("s3://root/a/b/"), k), F.concat(F.lit("memory://patch_blobs/"), k))
    rows = db.patch_blobs().select("blob_id", F.posexplode(forms).alias("form", "uri"))
    key = uris.artifact_key(F.col("uri"), "s3://root/a")
    return rows.select("blob_id", F.col("form").cast("long").alias("form"), key.alias("key"), uris.scm_path(key)["repo_id"].alias("repo_id"))


@query("references_checked", "SELECT blob_id, CASE blob_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 1 END AS faults FROM patch_blobs")
def _references(db: Ledger):
    k, sha = F.col("blob_id") % 4, F.col("sha256")
    one = F.struct(F.when(k == 2, "s3://x").when(k == 1, "").otherwise("memory://x").alias("artifact_uri"), F.when(k == 1, None).when(k == 2, "zz").otherwise(sha).alias("sha256"), F.when(k == 1, "").when(k.isin(2, 3), "none").otherwise("1:a").alias("source_id"))
    return db.patch_blobs().select("blob_id", F.size(uris.reference_errors(F.array(one))).alias("faults"))


@query("evidence_normalized", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS n, CASE WHEN event_id % 3 = 0 THEN 'patch' WHEN event_id % 3 = 1 THEN 'external' END AS kind, event_id % 3 = 0 AS strong FROM events")
def _normalized(db: Ledger):
    k = F.col("event_id")
    shape = "array<struct<uri:string,sha256:string,kind:string>>"
    new = F.when(k % 3 == 0, F.array(F.struct(F.lit("memory://x").alias("uri"), F.lit("a" * 64).alias("sha256"), F.lit("patch").alias("kind")))).otherwise(F.array().cast(shape))
    old = F.when(k % 3 != 2, F.array(F.lit("u1"), F.lit("u2")))
    rows = db.raw("events").select("event_id", payloads.normalized_evidence(old, new).alias("e"))
    return rows.select("event_id", aggregates.evidence_summary(F.col("e"))["count"].alias("n"), F.get("e", F.lit(0))["kind"].alias("kind"), aggregates.evidence_summary(F.col("e"))["has_strong"].alias("strong"))


@query("cursors_upgraded", "SELECT event_id, 2 AS version, CASE WHEN event_id % 2 = 0 THEN event_id::varchar END AS last_rev, CASE WHEN event_id % 2 = 1 THEN 's' || event_id END AS last_sha, (event_id % 9)::varchar AS last_sync_count FROM events")
def _upgraded(db: Ledger):
    """Cursors of the first version, flat, and of the second."""
    k = F.col("event_id")
    flat = F.to_json(F.struct(k.alias("last_rev"), (k % 9).alias("last_sync_count")))
    nested = F.to_json(F.struct(F.lit(2).alias("version"), F.struct(F.concat(F.lit("s"), k).alias("last_commit_sha")).alias("watermark"), F.struct((k % 9).alias("last_sync_count")).alias("stats")))
    out = db.raw("events").select("event_id", payloads.upgraded_cursor(F.when(k % 2 == 0, flat).otherwise(nested)).alias("j"))
    said = lambda p: F.get_json_object("j", p)
    return out.select("event_id", said("$.version").cast("int").alias("version"), said("$.watermark.last_rev").alias("last_rev"), said("$.watermark.last_commit_sha").alias("last_sha"), said("$.stats.last_sync_count").alias("last_sync_count"))


@query("breaker_keys", "SELECT repo_id, scope, CASE WHEN scope = 'global' THEN 'proj:global' ELSE 'proj:' || scope || ':n' || repo_id || ':1' END AS key, CASE WHEN scope = 'global' THEN 'global|proj:global' ELSE scope || ':n' || repo_id || ':1|n' || repo_id || ':1|proj:' || scope || ':n' || repo_id || ':1' END AS legacy, CASE WHEN scope <> 'global' THEN 'n' || repo_id || ':1' END AS id FROM repos, (SELECT unnest(['global', 'pool', 'instance', 'tenant']) AS scope)")
def _breaker_keys(db: Ledger):
    rows = db.repos().select("repo_id", F.explode(F.array(*[F.lit(x) for x in ("global", "pool", "instance", "tenant")])).alias("scope"))
    key = identifiers.breaker_key(F.lit("proj"), F.col("scope"), F.when(F.col("scope") != "global", F.concat(F.lit("n"), "repo_id", F.lit(":1"))))
    return rows.select("repo_id", "scope", key.alias("key"), F.array_join(identifiers.legacy_breaker_keys(key), "|").alias("legacy"), identifiers.parse_breaker_key(key)["id"].alias("id"))


@query("cursors_move", "SELECT repo_id, form, form IN (0, 2, 3, 5, 7) AS moves FROM repos, range(8) t(form)")
def _moves(db: Ledger):
    """First, earlier, later, the same time in another form with a later key, and with an earlier one; then texts that are no times."""
    pairs = [(None, None, "2024-01-01T00:00:00Z", "a"), ("2024-01-02T00:00:00Z", "a", "2024-01-01T00:00:00Z", "z"), ("2024-01-01T00:00:00Z", "z", "2024-01-01T01:00:00+00:00", "a"), ("2024-01-01T00:00:00Z", "a", "2024-01-01T00:00:00+00:00", "b"), ("2024-01-01T00:00:00Z", "b", "2024-01-01T00:00:00Z", "a"), ("rev 1", "b", "rev 2", "a"), ("rev 2", "b", "rev 1", "c"), ("rev 2", None, "rev 2", "a")]
    forms = db.spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "form long, old_at string, old_key string, new_at string, new_key string")
    rows = db.repos().select("repo_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("form")).join(F.broadcast(forms), "form")
    return rows.select("repo_id", "form", cursors.should_advance(F.col("new_at"), F.col("new_key"), F.col("old_at"), F.col("old_key")).alias("moves"))


@query("windows_adapted", "SELECT user_id AS repo_id, list_reduce(list_prepend(3600::bigint, list((event_type = 'error')::bigint ORDER BY ts, event_id)), lambda a, x: CASE WHEN x = 1 THEN greatest(300, floor(a * 0.5))::bigint ELSE least(86400, floor(a * 1.5))::bigint END) AS width FROM events GROUP BY 1")
def _adapted(db: Ledger):
    rounds = db._events().select(F.col("user_id").alias("repo_id"), "ts", "event_id", (F.col("event_type") == "error").alias("limited"))
    return cursors.adapted_windows(rounds, "repo_id", ["ts", "event_id"], "limited")


@query("backfills_wanted", f"SELECT repo_id, state, state <> 'closed' OR epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(max(started_at)) > 86400000000 AS wanted FROM sync_runs, (SELECT unnest(['open', 'half_open', 'closed']) AS state) GROUP BY 1, 2")
def _wanted(db: Ledger):
    last = db.sync_runs().groupBy("repo_id").agg(F.max("started_at").alias("m")).withColumn("state", F.explode(F.array(F.lit("open"), F.lit("half_open"), F.lit("closed"))))
    return last.select("repo_id", "state", policy.wants_backfill(F.col("state"), timing.cursor_age(ts(EVENTS_NOW), F.col("m")), 86400).alias("wanted"))


@query("json_redacted", """SELECT event_id, '{"user":"u' || user_id || '","auth":{"Token":"[REDACTED]","list":[{"password":"[REDACTED]"}]},"note":"password=[REDACTED]"}' AS redacted FROM events""")
def _redacted(db: Ledger):
    raw = F.concat(F.lit('{"user":"u'), "user_id", F.lit('","auth":{"Token":"t'), "event_id", F.lit('","list":[{"password":"a\\"b"}]},"note":"password=x"}'))
    return db.raw("events").select("event_id", redact_json(raw).alias("redacted"))


@query("outcomes_ignored", "SELECT job_id, job_id::bigint % 3 = 0 AS ignored FROM sync_jobs")
def _ignored(db: Ledger):
    return db.sync_jobs().select("job_id", is_ignored(F.when(F.col("job_id").cast("long") % 3 == 0, "LOCK_HELD").otherwise(F.col("last_error"))).alias("ignored"))


@query("evidence_ways", "SELECT blob_id, form, CASE form WHEN 0 THEN 'sha256' WHEN 1 THEN 'blob_id' WHEN 2 THEN 'legacy' WHEN 3 THEN 'blob_id' ELSE NULL END AS kind, CASE WHEN form < 3 THEN 'ok' WHEN form = 3 THEN 'not_found' ELSE 'invalid' END AS resolution, CASE form WHEN 0 THEN min(blob_id) OVER (PARTITION BY sha256, form) WHEN 1 THEN blob_id WHEN 2 THEN min(blob_id) OVER (PARTITION BY source_id, form) END AS found_blob_id FROM patch_blobs, range(5) t(form)")
def _ways(db: Ledger):
    """Every blob by its hash, its id, its source alone, an id that is not there, and a text that leads nowhere."""
    base, k = F.lit("memory://patch_blobs/"), F.col("blob_id")
    forms = F.array(F.concat(base, F.lit("sha256/"), "sha256"), F.concat(base, F.lit("blob_id/"), k), F.concat(base, F.lit("git/"), "source_id"), F.concat(base, F.lit("blob_id/"), -k - 1 + 2 * k + 10**12), F.concat(base, k))
    blobs = db.patch_blobs()
    rows = blobs.select("blob_id", F.posexplode(forms).alias("form", "evidence_uri"))
    out = joins.resolve_evidence(rows, blobs, db.attachments().select("attachment_id", "sha256"))
    return out.select("blob_id", F.col("form").cast("long").alias("form"), "kind", "resolution", "found_blob_id")


@query("budget_with_payload", "SELECT tenant_id, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS pending, count(*) AS active FROM (SELECT status, coalesce(tenant_id, CASE WHEN job_id::bigint % 2 = 0 THEN 'from-payload' END) AS tenant_id FROM sync_jobs WHERE status IN ('pending', 'running')) WHERE tenant_id IS NOT NULL GROUP BY 1")
def _budget(db: Ledger):
    jobs = db.sync_jobs().withColumn("payload_json", F.to_json(F.struct(F.when(F.col("job_id").cast("long") % 2 == 0, "from-payload").alias("tenant_id"))))
    return aggregates.budget(jobs, "tenant_id", payload_key="tenant_id")
