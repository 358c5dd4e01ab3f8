"""Queries that show the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import errors, identifiers, payloads, text, timing, uris
from ledgerline.registry import query
from ledgerline.sources.ledger import EVENTS_NOW, Ledger, ts


@query("source_ids_parsed", "SELECT blob_id, split_part(source_id, ':', 1) AS kind, split_part(source_id, ':', 2)::bigint AS repo_id, split_part(source_id, ':', 3) AS number, true AS valid FROM patch_blobs")
def _source(db: Ledger):
    return db.patch_blobs().select("blob_id", identifiers.parse_source_id(F.col("source_id")).alias("p")).select("blob_id", "p.*")


@query("repo_keys", "SELECT repo_id, rtrim(url, '/') AS url, 'gl' || (repo_id % 4) || '.example.com' AS instance, split_part(project_key, '/', 1) AS tenant FROM repos")
def _keys(db: Ledger):
    return db.repos().select("repo_id", identifiers.normalize_url(F.col("url")).alias("url"), identifiers.instance_key(F.col("url")).alias("instance"), identifiers.tenant_id(F.lit("{}"), F.col("project_key")).alias("tenant"))


@query("job_types_mapped", "SELECT repo_id, l AS logical, CASE WHEN repo_type = 'git' THEN CASE l WHEN 'commits' THEN 'gitlab_commits' WHEN 'mrs' THEN 'gitlab_mrs' WHEN 'reviews' THEN 'gitlab_reviews' END WHEN l = 'commits' THEN 'svn' END AS job_type, CASE WHEN l = 'x' THEN 'unknown_job_type' WHEN repo_type = 'svn' AND l <> 'commits' THEN 'unsupported_for_repo_type' END AS reason FROM repos, (SELECT unnest(['commits', 'mrs', 'reviews', 'x']) AS l)")
def _types(db: Ledger):
    rows = db.repos().select("repo_id", "repo_type", F.explode(F.array(*[F.lit(x) for x in ("commits", "mrs", "reviews", "x")])).alias("logical"))
    return rows.select("repo_id", "logical", identifiers.physical_job_type(F.col("repo_type"), F.col("logical")).alias("p")).select("repo_id", "logical", "p.*")


@query("uris_classified", "SELECT blob_id, CASE WHEN coalesce(evidence_uri, '') = '' THEN NULL WHEN evidence_uri LIKE 'memory://%' THEN 'evidence_uri' WHEN evidence_uri LIKE 's3://%' THEN 'physical_uri' ELSE 'artifact_key' END AS uri_class, CASE WHEN contains(evidence_uri, '://') THEN split_part(evidence_uri, '://', 1) WHEN evidence_uri IS NOT NULL THEN '' END AS scheme FROM patch_blobs")
def _uris(db: Ledger):
    return db.patch_blobs().select("blob_id", uris.uri_class(F.col("evidence_uri")).alias("uri_class"), uris.scheme_of(F.col("evidence_uri")).alias("scheme"))


@query("evidence_parsed", "SELECT blob_id, CASE WHEN blob_id % 5 = 0 THEN source_id END AS id, CASE WHEN blob_id % 5 = 0 THEN sha256 END AS sha256, coalesce(blob_id % 5 = 0, false) AS valid FROM patch_blobs")
def _evidence(db: Ledger):
    return db.patch_blobs().select("blob_id", uris.parse_evidence(F.col("evidence_uri")).alias("p")).select("blob_id", "p.id", "p.sha256", "p.valid")


def _redacted(column: str) -> str:
    """The same list of patterns as SQL: $1 becomes \\1, and a leading (?i) the option i."""
    out = column
    for pattern, new in text.REDACTIONS:
        bare, by = pattern.removeprefix("(?i)"), new.replace("$", "\\")
        out = f"regexp_replace({out}, '{bare}', '{by}', '{'gi' if bare != pattern else 'g'}')"
    return out


@query("texts_redacted", f"SELECT doc_id, {_redacted('text')} AS redacted FROM documents")
def _redact(db: Ledger):
    return db.raw("documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query("cards_trimmed", "SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 180) || '... [内容已截断]' ELSE text END AS content, length(text) > 200 AS was_trimmed, length(text)::int AS original_length FROM conversations")
def _trim(db: Ledger):
    return db.cards().select("conv_id", "turn", text.trim(F.col("text"), 200).alias("t")).select("conv_id", "turn", "t.*")


_POINTER = "[%s 内容已移除，仅保留指针]' || chr(10) || '- uri: memory://local/content' || chr(10) || '- sha256: "
_SHORT = "CASE WHEN length(d) > 500 THEN substr(d, 1, 480) || '... [内容已截断]' ELSE d END"
_LOG = r"^\[\d{4}-\d{2}-\d{2}|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}|^[A-Z]+:\s|^\[INFO\]|^\[DEBUG\]|^\[ERROR\]|^\[WARN\]"


@query("cards_rendered", rf"""SELECT conv_id, turn, sha256(CASE WHEN length(md) > 4000 THEN substr(md, 1, 3950) || chr(10) || chr(10) || '[... 内容已截断 ...]' ELSE md END) AS payload_sha, length(md) > 4000 AS cut FROM (SELECT conv_id, turn,
  array_to_string(['[Kind] FACT', '[Owner] ' || role, '[Module] m' || conv_id, '[Visibility] team', '[TTL] long', '[Confidence] high', '', '[Summary]', CASE WHEN length(text) > 200 THEN substr(text, 1, 180) || '... [内容已截断]' ELSE text END, '', '[Details]'], chr(10)) || chr(10)
  || array_to_string(list_transform(range(1, 11), lambda i: i || ') ' || CASE (i - 1) % 4
      WHEN 0 THEN list_transform([CASE WHEN regexp_matches(text, '(?m)^[-+]{{3}}\s|^@@\s|^diff\s--git|^Index:\s') THEN '{_POINTER % "diff"}' || sha256(text) WHEN regexp_matches(text, '(?m){_LOG}') THEN '{_POINTER % "log"}' || sha256(text) ELSE text END], lambda d: {_SHORT})[1]
      WHEN 1 THEN '{_POINTER % "diff"}' || sha256('+++ b/' || role || chr(10) || '+x') WHEN 2 THEN '{_POINTER % "log"}' || sha256('at' || chr(10) || 'ERROR: ' || role) ELSE role END), chr(10)) || chr(10) || chr(10) || '[Evidence]' || chr(10)
  || '- uri=memory://patch_blobs/git/1:a/' || repeat('a', 64) || chr(10) || '  sha256=' || repeat('a', 64) || chr(10) || '  git_commit=' || conv_id AS md FROM conversations WHERE text <> '' AND role <> '')""")
def _cards(db: Ledger):
    rows = db.cards().where("text != '' and role != ''")
    kinds = F.array(F.col("text"), F.concat(F.lit("+++ b/"), "role", F.lit("\n+x")), F.concat(F.lit("at\nERROR: "), "role"), F.col("role"))
    details = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.get(kinds, i % 4))
    sha, none = F.lit("a" * 64), F.lit(None).cast("string")
    evidence = F.array(F.struct(F.concat(F.lit("memory://patch_blobs/git/1:a/"), sha).alias("uri"), sha.alias("sha256"), none.alias("event_id"), none.alias("svn_rev"), F.col("conv_id").cast("string").alias("git_commit"), none.alias("mr")))
    card = text.card_markdown(F.lit("fact"), F.col("role"), F.concat(F.lit("m"), "conv_id"), F.col("text"), details, evidence, F.lit("high"), F.lit("team"), F.lit("long"))
    return rows.select("conv_id", "turn", text.card_payload_sha(card).alias("payload_sha"), F.endswith(card, F.lit(text.CARD_MARK)).alias("cut"))


@query("texts_detected", rf"""SELECT doc_id, form, regexp_matches(t, '(?m)^[-+]{{3}}\s|^@@\s|^diff\s--git|^Index:\s') AS diff, regexp_matches(t, '(?m){_LOG}') AS log FROM (SELECT doc_id, form, text || chr(10) || CASE form WHEN 0 THEN '+++ b.txt' WHEN 1 THEN '@@ x' WHEN 2 THEN 'Index: a' WHEN 3 THEN 'ERROR: x' WHEN 4 THEN '[2024-01-01] x' WHEN 5 THEN '2024-01-01T10:00' WHEN 6 THEN '[INFO] x' WHEN 7 THEN 'diff --git a b' WHEN 8 THEN '++ no' ELSE 'error: no' END AS t FROM documents, range(10) f(form))""")
def _detected(db: Ledger):
    forms = F.array(*[F.lit(x) for x in ("+++ b.txt", "@@ x", "Index: a", "ERROR: x", "[2024-01-01] x", "2024-01-01T10:00", "[INFO] x", "diff --git a b", "++ no", "error: no")])
    rows = db.raw("documents").select("doc_id", F.col("text").alias("head"), F.posexplode(forms).alias("form", "line"))
    t = F.concat("head", F.lit("\n"), "line")
    return rows.select("doc_id", F.col("form").cast("long").alias("form"), text.is_diff(t).alias("diff"), text.is_log(t).alias("log"))


@query("diffs_summarized", """SELECT doc_id, source || ' | 1 insertion(s)(+), 2 deletion(s)(-)' || chr(10) || 'x.txt | ' || (2 + n) || ' insertion(s)(+), 0 deletion(s)(-)' || chr(10) || '2 file(s) changed, ' || (3 + n) || ' insertion(s)(+), 2 deletion(s)(-)' AS by_index,
  '2 file(s) changed, ' || (3 + n) || ' insertion(s)(+), 2 deletion(s)(-)' AS by_patch,
  CASE WHEN n = 0 THEN '' ELSE array_to_string(list_transform(range(n), lambda i: CASE WHEN i % 2 = 0 THEN 'f' || (i // 2) ELSE 'f' || (i // 2) || ' (new)' END), chr(10)) || chr(10) || ((n + 1) // 2) || ' file(s) changed' END AS by_api,
  'ministat [' || substr(sha256(source), 1, 8) || '] degraded: ' || n || ' file(s) changed, 7 insertion(s)(+), 0 deletion(s)(-)' AS by_counts, 'ministat [' || substr('abc:' || source, 1, 7) || '] degraded: ' || n || ' file(s) changed, 7 insertion(s)(+), 0 deletion(s)(-)' AS by_source,
  CASE WHEN n = 0 THEN '' ELSE 'ministat for r' || doc_id || ' (degraded)' || chr(10) || n || ' path(s) changed, ' || (n // 2) || ' modified, ' || ((n + 1) // 2) || ' added, 0 deleted, 0 replaced' || chr(10) || array_to_string(list_transform(range(least(n, 5)), lambda i: CASE WHEN i % 2 = 0 THEN '- ' || repeat('p', 40) || '...' || repeat('p', 20) ELSE '- q (dir)' END), chr(10)) END AS by_paths
  FROM (SELECT doc_id, coalesce(source, 'none') AS source, doc_id % 7 AS n FROM documents)""")
def _diffs(db: Ledger):
    n = (F.col("doc_id") % 7).cast("int")
    rows = db.raw("documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), n.alias("n"))
    diff = F.concat(F.lit("Index: "), "source", F.lit("\n=====\n--- a\n+++ b\n@@ -1 +1 @@\n+one\n-two\n-three\nIndex: x.txt \n--- a\n+++ b\n"), F.repeat(F.lit("+more\n"), F.col("n") + 2))
    upto = lambda f: F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), f))
    api = upto(lambda i: F.struct(F.concat(F.lit("f"), F.floor(i / 2)).alias("new_path"), F.lit("old").alias("old_path"), (i % 2 == 1).alias("new_file")))
    paths = upto(lambda i: F.struct(F.when(i % 2 == 0, "A").otherwise("M").alias("action"), F.when(i % 2 == 0, F.repeat(F.lit("p"), F.lit(90))).otherwise("q").alias("path"), F.when(i % 2 == 1, "dir").otherwise("file").alias("kind")))
    stats = F.create_map(F.lit("total"), F.col("n"), F.lit("additions"), F.lit(7))
    return rows.select(
        "doc_id", text.diffstat_of_index(diff).alias("by_index"), text.diffstat_of_patch(diff).alias("by_patch"), text.diffstat_of_api(api).alias("by_api"), text.ministat_of_counts(stats, F.sha2("source", 256)).alias("by_counts"),
        text.ministat_of_source(stats, F.concat(F.lit("9:abc:"), "source")).alias("by_source"), text.ministat_of_paths(paths, F.col("doc_id")).alias("by_paths"),
    )


@query("errors_classified", "SELECT job_id, CASE last_error WHEN 'HTTP 429 Too Many Requests' THEN 'rate_limit' WHEN 'read timed out' THEN 'timeout' WHEN '502 Bad Gateway' THEN 'server_error' WHEN 'connection reset by peer' THEN 'network' WHEN '401 Unauthorized' THEN 'auth_error' WHEN '403 Forbidden' THEN 'permission_denied' WHEN '404 project not found' THEN 'repo_not_found' WHEN 'repo_not_found' THEN 'repo_not_found' ELSE '' END AS category, last_error IN ('401 Unauthorized', '403 Forbidden', '404 project not found', 'repo_not_found') AS permanent, last_error IN ('HTTP 429 Too Many Requests', 'read timed out', '502 Bad Gateway', 'connection reset by peer') AS transient FROM sync_jobs")
def _errors(db: Ledger):
    return db.sync_jobs().select("job_id", errors.classify_last_error(F.col("last_error")).alias("e")).select("job_id", "e.category", "e.permanent", "e.transient")


@query("backoffs", "SELECT job_id, least(3600, CASE job_type WHEN 'svn' THEN 120 WHEN 'gitlab_mrs' THEN 45 ELSE 60 END * power(2, greatest(attempts + 3, 0)))::bigint AS seconds FROM sync_jobs")
def _backoffs(db: Ledger):
    kind = F.when(F.col("job_type") == "svn", "rate_limit").when(F.col("job_type") == "gitlab_mrs", "connection").otherwise("other")
    return db.sync_jobs().select("job_id", errors.backoff_seconds(kind, F.col("attempts") + 4).alias("seconds"))


@query("cursor_ages", f"SELECT repo_id, greatest(0.0::double, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(max(started_at))) / 1000000.0::double) AS age, strftime(max(started_at), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM sync_runs GROUP BY 1")
def _ages(db: Ledger):
    last = db.sync_runs().groupBy("repo_id").agg(F.max("started_at").alias("at"))
    return last.select("repo_id", timing.cursor_age(ts(EVENTS_NOW), F.col("at")).alias("age"), timing.to_iso(F.col("at")).alias("iso"))


@query("run_counts", "SELECT run_id, hits_429::bigint AS total_429_hits, timeouts::bigint AS timeout_count, requests::bigint AS total_requests, 0::bigint AS synced_count FROM sync_runs")
def _counts(db: Ledger):
    return db.sync_runs().select("run_id", payloads.counts(F.col("counts")).alias("c")).select("run_id", "c.total_429_hits", "c.timeout_count", "c.total_requests", "c.synced_count")


@query("run_statuses", "SELECT run_id, CASE status WHEN 'running' THEN 'failed' ELSE status END AS explicit, CASE WHEN synced_count % 4 = 0 THEN 'failed' WHEN synced_count % 3 = 0 THEN 'no_data' ELSE 'completed' END AS derived FROM sync_runs")
def _statuses(db: Ledger):
    none, k = F.lit(None).cast("string"), F.col("synced_count")
    return db.sync_runs().select("run_id", payloads.run_status(F.col("status"), none, k, F.lit(True)).alias("explicit"), payloads.run_status(none, F.when(k % 4 == 0, "boom"), k % 3, F.lit(True)).alias("derived"))


@query("audit_events_built", "SELECT audit_id, sha256(reason) AS payload_sha, length(reason)::int AS payload_len, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS event_ts FROM write_audit")
def _built(db: Ledger):
    event = payloads.audit_event(F.lit("api"), F.lit("store"), F.col("actor_user_id"), F.col("target_space"), F.col("action"), F.col("reason"), F.col("reason"), F.array(F.col("correlation_id")), F.col("created_at"))
    out = db.write_audit().select("audit_id", event.alias("j"))
    return out.select("audit_id", F.get_json_object("j", "$.payload_sha").alias("payload_sha"), F.get_json_object("j", "$.payload_len").cast("int").alias("payload_len"), F.get_json_object("j", "$.event_ts").alias("event_ts"))


_EVIDENCE = """, ev AS (SELECT doc_id, doc_id % 3 AS n, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN coalesce(source, '') ELSE 'memory://' || doc_id END AS uri, CASE doc_id % 4 WHEN 0 THEN sha256(coalesce(text, '')) WHEN 1 THEN substr(sha256(coalesce(text, '')), 1, 63) WHEN 2 THEN '' END AS sha, coalesce(source, '') AS src, lang FROM documents),
li AS (SELECT doc_id, CASE n WHEN 0 THEN [{'uri': uri, 'sha': sha, 'old': false}, {'uri': src, 'sha': sha, 'old': false}] WHEN 1 THEN list_filter([{'uri': uri, 'sha': '', 'old': true}, {'uri': lang, 'sha': '', 'old': true}], lambda x: x.uri <> '') ELSE [] END AS l FROM ev),
it AS (SELECT doc_id, i, l[i + 1].uri AS uri, l[i + 1].sha AS sha, l[i + 1].old AS old FROM (SELECT *, unnest(range(len(l))) AS i FROM li)),
fa AS (SELECT *, CASE WHEN coalesce(uri, '') = '' THEN 'EVIDENCE_MISSING_URI' WHEN coalesce(sha, '') = '' AND old THEN 'EVIDENCE_LEGACY_NO_SHA256' WHEN coalesce(sha, '') = '' THEN 'EVIDENCE_MISSING_SHA256' WHEN length(sha) <> 64 THEN 'EVIDENCE_INVALID_SHA256' END AS code FROM it)
"""


def _evidence_items(db: Ledger):
    """Documents with evidence of version 2, as old texts, and without any: uris and hashes of every right and wrong form."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    uri = F.when(k % 5 == 0, "").when(k % 5 == 2, F.coalesce("source", F.lit(""))).when(k % 5 != 1, F.concat(F.lit("memory://"), k.cast("string")))
    sha = F.when(k % 4 == 0, F.sha2(text, 256)).when(k % 4 == 1, F.substring(F.sha2(text, 256), 1, 63)).when(k % 4 == 2, "")
    item = lambda u: F.struct(u.alias("uri"), sha.alias("sha256"), F.lit(None).cast("string").alias("origin"))
    new = F.when(k % 3 == 0, F.array(item(uri), item(F.coalesce("source", F.lit("")))))
    return db.raw("documents").select("doc_id", F.when(k % 8 < 4, "strict").when(k % 8 < 6, "compat").alias("mode"), payloads.items_of(F.when(k % 3 == 1, F.array(uri, F.col("lang"))), new).alias("e"))


@query("evidence_faults", _EVIDENCE + "SELECT doc_id, i::int AS place, code, code <> 'EVIDENCE_LEGACY_NO_SHA256' AS error, code || ':evidence[' || i || ']' || CASE code WHEN 'EVIDENCE_MISSING_URI' THEN '' WHEN 'EVIDENCE_INVALID_SHA256' THEN ':' || substr(sha, 1, 16) || '...' ELSE ':' || uri END AS said FROM fa WHERE code IS NOT NULL")
def _evidence_faults(db: Ledger):
    return _evidence_items(db).select("doc_id", F.explode(payloads.evidence_faults(F.col("e.items"))).alias("f")).select("doc_id", "f.*")


@query("evidence_gate", _EVIDENCE + """SELECT doc_id, CASE n WHEN 0 THEN 'v2' WHEN 1 THEN 'v1_mapped' ELSE 'none' END AS source, bad IS NULL AS is_valid, CASE WHEN doc_id % 8 < 4 AND bad IS NOT NULL THEN 'reject' ELSE 'allow' END AS action, CASE WHEN doc_id % 8 < 4 AND bad IS NOT NULL THEN 'evidence_validation:' || lower(bad) ELSE 'evidence_accepted' END AS reason
FROM ev LEFT JOIN (SELECT doc_id, arg_min(code, i) AS bad FROM fa WHERE code <> 'EVIDENCE_LEGACY_NO_SHA256' GROUP BY 1) USING (doc_id)""")
def _evidence_gate(db: Ledger):
    gate = payloads.evidence_gate(F.col("mode"), F.col("e.items"))
    return _evidence_items(db).select("doc_id", F.col("e.source").alias("source"), payloads.validated_evidence(F.col("e.items"))["is_valid"].alias("is_valid"), gate["action"].alias("action"), gate["reason"].alias("reason"))


@query("audit_events_by_source", r"""SELECT outbox_id, s AS source, CASE WHEN outbox_id % 3 = 0 THEN 'corr-' || substr(md5(outbox_id::varchar), 1, 16) ELSE 'corr-' || substr(sha256(CASE WHEN outbox_id % 3 = 1 THEN 'odd' ELSE '' END || '|' || outbox_id), 1, 16) END AS correlation_id, CASE s WHEN 'gateway' THEN CASE WHEN outbox_id % 2 = 0 THEN 'private:w' END ELSE target_space END AS final_space,
  CASE WHEN s <> 'gateway' THEN retry_count END AS retry_count, CASE WHEN s = 'gateway' AND outbox_id % 2 = 0 THEN target_space || '>private:w' END AS pointer, CASE WHEN s = 'gateway' AND outbox_id % 5 > 0 THEN 'm' || outbox_id % 5 END AS mode, CASE s WHEN 'gateway' THEN CASE WHEN outbox_id % 2 = 0 THEN 'deferred' END WHEN 'outbox_worker' THEN locked_by ELSE coalesce(locked_by, '-') || ' ' || coalesce(strftime(locked_at, '%Y-%m-%dT%H:%M:%SZ'), '-') END AS told,
  CASE WHEN s = 'gateway' AND outbox_id % 4 > 0 THEN 1 ELSE 0 END AS n_refs, true AS has_null_actor FROM outbox, (SELECT unnest(['gateway', 'outbox_worker', 'reconcile_outbox']) AS s)""")
def _by_source(db: Ledger):
    """Each outbox row as an event of each source: sections that say nothing are absent, core fields are there and null."""
    k, at = F.col("outbox_id"), F.col("created_at")
    corr = payloads.correlation(F.when(k % 3 == 0, F.concat(F.lit("corr-"), F.substring(F.md5(k.cast("string")), 1, 16))).when(k % 3 == 1, "odd"), k)
    shared = {"target_space": F.col("target_space"), "outbox_id": k, "retry_count": F.col("retry_count"), "payload_sha": F.col("payload_sha")}
    even = k % 2 == 0
    own = {"requested_space": F.col("target_space"), "final_space": F.when(even, "private:w"), "is_pointerized": even, "pointer_space": F.when(even, "private:w"), "policy_mode": F.when(k % 5 > 0, F.concat(F.lit("m"), (k % 5).cast("string")))}
    items = F.when(k % 4 > 0, F.array(F.struct(F.lit("u").alias("uri"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("origin"))))
    events = {
        "gateway": payloads.gateway_event(F.lit("store"), at, corr, items, own, F.when(even, "deferred")),
        "outbox_worker": payloads.worker_event(F.lit("flush"), at, corr, shared, F.col("locked_by"), F.lit(None).cast("string")),
        "reconcile_outbox": payloads.reconcile_event(F.lit("fix"), at, corr, shared, F.col("locked_by"), F.col("locked_at")),
    }
    rows = db.outbox().select("outbox_id", F.explode(F.array(*events.values())).alias("j"))
    said = lambda path: F.get_json_object("j", f"$.{path}")
    pointer = F.when(said("pointer.from_space").isNotNull(), F.concat(said("pointer.from_space"), F.lit(">"), said("pointer.to_space")))
    lock = F.concat(F.coalesce(said("extra.original_locked_by"), F.lit("-")), F.lit(" "), F.coalesce(said("extra.original_locked_at"), F.lit("-")))
    told = F.when(said("source") == "gateway", said("extra.intended_action")).when(said("source") == "outbox_worker", said("extra.worker_id")).otherwise(lock)
    return rows.select("outbox_id", said("source").alias("source"), said("correlation_id").alias("correlation_id"), said("final_space").alias("final_space"), said("retry_count").cast("int").alias("retry_count"), pointer.alias("pointer"), said("policy.mode").alias("mode"), told.alias("told"), said("evidence_summary.count").cast("int").alias("n_refs"), F.col("j").contains('"actor_user_id":null').alias("has_null_actor"))
