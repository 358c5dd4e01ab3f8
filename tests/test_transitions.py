"""Queues, leases, writes and their invariants on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import integrity, joins, lookups, policy, queues, windows, writes
from ledgerline.schemas import conform, duplicates, schema_drift, violations
from ledgerline.sources.ledger import ts

NOW = dt.datetime(2024, 1, 1, 12)
OUTBOX = "outbox_id long, target_space string, payload_sha string, status string, retry_count int, next_attempt_at timestamp, locked_at timestamp, locked_by string, created_at timestamp"
JOBS = "job_id string, repo_id long, job_type string, mode string, priority int, status string, attempts int, max_attempts int, not_before timestamp, locked_at timestamp, locked_by string, lease_seconds int, tenant_id string, instance string, last_error string, created_at timestamp"


def at(seconds):
    return NOW + dt.timedelta(seconds=seconds)


def box(spark, rows):
    return spark.createDataFrame([(i, "team:p", sha, status, n, due, locked, by, at(-1000)) for i, sha, status, n, due, locked, by in rows], OUTBOX)


def job(i, status, attempts=0, locked=None, by=None, priority=1, tenant="t", repo=1, due=-10, error="", mode="incremental"):
    return (str(i), repo, "svn", mode, priority, status, attempts, 3, at(due), locked, by, 60, tenant, "gl", error, at(i))


def test_outbox_lease_limits(spark):
    rows = [(1, "a", "pending", 0, at(0), None, None), (2, "a", "pending", 0, at(1), None, None), (3, "a", "pending", 0, at(-5), at(-120), "w"), (4, "a", "pending", 0, at(-5), at(-121), "w"), (5, "a", "sent", 0, at(-5), None, None)]
    got = queues.claim_outbox(box(spark, rows), "me", ts(str(NOW)), 10)
    assert {r["outbox_id"] for r in got.where("claimed").collect()} == {1, 4}  # a lease that is exactly at its limit holds
    again = queues.claim_outbox(got.drop("claimed"), "other", ts(str(NOW)), 10)
    assert again.where("claimed").count() == 0
    assert got.count() == len(rows)


def test_outbox_settle(spark):
    rows = [(1, "a", "pending", 0, at(0), at(0), "me"), (2, "a", "pending", 4, at(0), at(0), "me"), (3, "a", "pending", 0, at(0), at(0), "you"), (4, "a", "sent", 0, at(0), at(0), "me"), (5, "a", "pending", 0, at(0), at(0), "me")]
    commands = spark.createDataFrame([(1, "me", "retry", 30, "e"), (2, "me", "retry", 30, "e"), (3, "me", "sent", 0, None), (4, "me", "sent", 0, None)], "outbox_id long, worker string, result string, backoff int, error string")
    got = {r["outbox_id"]: r for r in queues.settle_outbox(box(spark, rows), commands, ts(str(NOW))).collect()}
    assert (got[1]["status"], got[1]["retry_count"], got[1]["locked_by"], got[1]["next_attempt_at"]) == ("pending", 1, None, at(30))
    assert (got[2]["status"], got[2]["retry_count"]) == ("dead", 5)
    assert got[3]["conflict"] and got[3]["status"] == "pending" and got[3]["locked_by"] == "you"
    assert got[4]["conflict"] and not got[5]["conflict"] and got[5]["locked_by"] == "me"


def test_job_claim(spark):
    rows = [job(1, "pending", due=1), job(2, "failed", 3), job(3, "failed", 2, priority=5), job(4, "running", 1, at(-60), "w"), job(5, "running", 1, at(-61), "w"), job(6, "pending", tenant="u", priority=9), job(7, "pending", tenant=None, priority=9)]
    jobs = spark.createDataFrame(rows, JOBS)
    got = {r["job_id"]: r for r in queues.claim_jobs(jobs, "me", ts(str(NOW)), 10).where("claimed").collect()}
    assert set(got) == {"3", "5", "6", "7"} and got["3"]["attempts"] == 3 and all(r["status"] == "running" for r in got.values())
    fair = {r["job_id"] for r in queues.claim_jobs(jobs, "me", ts(str(NOW)), 10, fair=True).where("claimed").collect()}
    assert fair == {"5", "6", "7"}
    only = {r["job_id"] for r in queues.claim_jobs(jobs, "me", ts(str(NOW)), 10, tenants=["u"]).where("claimed").collect()}
    assert only == {"6", "7"}  # a null tenant passes


def test_job_settle_and_reset(spark):
    jobs = spark.createDataFrame([job(1, "running", 1, at(-1), "me"), job(2, "running", 3, at(-1), "me"), job(3, "running", 0, at(-1), "me"), job(4, "running", 1, at(-1), "you")], JOBS)
    commands = spark.createDataFrame([("1", "me", "fail", 10, "e"), ("2", "me", "fail", 10, "e"), ("3", "me", "requeue", 5, "e"), ("4", "me", "ack", 0, None)], "job_id string, worker string, result string, backoff int, error string")
    done = queues.settle_jobs(jobs, commands, ts(str(NOW)))
    got = {r["job_id"]: r for r in done.collect()}
    assert [got[i]["status"] for i in "1234"] == ["failed", "dead", "pending", "running"]
    assert got["1"]["not_before"] == at(10) and got["3"]["attempts"] == 0 and got["4"]["conflict"]
    fresh = {r["job_id"]: r for r in queues.reset_dead(done.drop("conflict")).collect()}
    assert (fresh["2"]["status"], fresh["2"]["attempts"], fresh["2"]["last_error"]) == ("pending", 0, None) and fresh["1"]["status"] == "failed"


def test_enqueue_keeps_one_active(spark):
    jobs = spark.createDataFrame([job(1, "pending", repo=1), job(2, "failed", repo=2)], JOBS)
    new = spark.createDataFrame([job(3, "pending", repo=1), job(4, "pending", repo=2), job(5, "pending", repo=2), job(6, "pending", repo=2, mode="backfill")], JOBS)
    assert {r["job_id"] for r in queues.enqueue(jobs, new).collect()} == {"4", "6"}


def test_reaper(spark):
    rows = [job(1, "running", 1, at(-500), "w", error="404"), job(2, "running", 1, at(-500), "w", error="timeout"), job(3, "running", 3, at(-500), "w", error="timeout"), job(4, "running", 1, at(-500), "w", error="odd"), job(5, "running", 1, at(-100), "w")]
    got = {r["job_id"]: (r["new_status"], r["retry_in"]) for r in queues.reap(spark.createDataFrame(rows, JOBS), ts(str(NOW))).collect()}
    assert got == {"1": ("dead", 0), "2": ("failed", 60), "3": ("failed", 240), "4": ("failed", 60)}


def test_locks(spark):
    locks = spark.createDataFrame([(1, 1, "svn", "w", at(-10), 60), (2, 2, "svn", "w", at(-61), 60), (3, 3, "svn", None, None, 60)], "lock_id long, repo_id long, job_type string, locked_by string, locked_at timestamp, lease_seconds int")
    asked = spark.createDataFrame([(1, "svn", "a", at(0)), (2, "svn", "a", at(0)), (2, "svn", "b", at(0)), (3, "svn", "a", at(0)), (4, "svn", "a", at(0))], "repo_id long, job_type string, worker string, requested_at timestamp")
    got = {(r["repo_id"], r["worker"]): r["granted"] for r in queues.claim_locks(locks, asked, ts(str(NOW))).collect()}
    assert got == {(1, "a"): False, (2, "a"): True, (2, "b"): False, (3, "a"): True, (4, "a"): True}
    free = queues.release_locks(locks, spark.createDataFrame([(1, "x"), (2, "w")], "lock_id long, worker string"))
    assert {r["lock_id"]: r["locked_by"] for r in free.collect()} == {1: "w", 2: None, 3: None}
    assert {r["lock_id"] for r in lookups.expired_locks(locks, ts(str(NOW))).collect()} == {2}


def test_upsert(spark):
    state = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "id long, url string, project string")
    changes = spark.createDataFrame([(2, "c", None), (2, "d", None), (3, "e", "r")], "id long, url string, project string")
    got = sorted(tuple(r) for r in writes.upsert(state, changes, ["id"], keep=["project"], order=F.col("url")).collect())
    assert got == [(1, "a", "p"), (2, "d", "q"), (3, "e", "r")]
    twice = writes.upsert(writes.upsert(state, changes, ["id"], keep=["project"], order=F.col("url")), changes, ["id"], keep=["project"], order=F.col("url"))
    assert sorted(tuple(r) for r in twice.collect()) == got
    assert writes.insert_new(state, changes, ["id"], "url").count() == 1


def test_merged_json(spark):
    df = spark.createDataFrame([('{"b": "1", "a": "x"}', '{"b": "2"}'), (None, '{"z": "1"}'), ('{"a": "1"}', None)], "o string, n string")
    assert [r[0] for r in df.select(writes.merged_json(F.col("o"), F.col("n"))).collect()] == ['{"a":"x","b":"2"}', '{"z":"1"}', '{"a":"1"}']


def test_merged_json_keeps_what_is_nested(spark):
    df = spark.createDataFrame([('{"b": {"x": [1, 2]}, "n": 5, "d": "t"}', '{"a": null, "c": {"k": true}}'), ("no object", '{"q": 1.5}'), ("[1]", None)], "o string, n string")
    assert [r[0] for r in df.select(writes.merged_json(F.col("o"), F.col("n"))).collect()] == ['{"a":null,"b":{"x":[1,2]},"c":{"k":true},"d":"t","n":5}', '{"q":1.5}', "{}"]


def test_numbering(spark):
    state = spark.createDataFrame([(7,)], "id long")
    got = writes.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), state, "id", "v").orderBy("v").collect()
    assert [r["id"] for r in got] == list(range(8, 1008))
    assert writes.numbered(spark.createDataFrame([], "v long"), state, "id", "v").count() == 0


def test_source_ids(spark):
    rows = [("mr", 1, "group/p!42", None), ("mr", 1, "https://h/x/7", ""), ("svn", 2, "9", None), ("git", 3, "abc", "kept")]
    got = [r["source_id"] for r in writes.filled_source_ids(spark.createDataFrame(rows, "kind string, repo_id long, number string, source_id string")).collect()]
    assert got == ["mr:1:42", "mr:1:7", "svn:2:9", "kept"]


def test_dedupe_keeps_null_and_batch_repeats(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "request_id string, n int")
    known = spark.createDataFrame([("a",), (None,)], "request_id string")
    assert sorted(r["n"] for r in joins.new_requests(batch, known).collect()) == [2, 3, 4]


def test_evidence_resolution(spark):
    sha, other = "a" * 64, "b" * 64
    blobs = spark.createDataFrame([("git", "git:1:x/y", sha)], "source_type string, source_id string, sha256 string")
    attachments = spark.createDataFrame([(5, sha)], "attachment_id long, sha256 string")
    uris = [f"memory://patch_blobs/git/git:1:x/y/{sha}", f"memory://patch_blobs/git/git:1:x/y/{other}", f"memory://patch_blobs/git/none/{sha}", f"memory://attachments/5/{sha}", f"memory://attachments/5/{other}", f"memory://attachments/6/{sha}", "x", None]
    got = {r["evidence_uri"]: r["resolution"] for r in joins.resolve_evidence(spark.createDataFrame([(u,) for u in uris], "evidence_uri string"), blobs, attachments).collect()}
    assert [got[u] for u in uris] == ["ok", "hash_mismatch", "not_found", "ok", "hash_mismatch", "not_found", "invalid", "invalid"]


def test_garbage(spark):
    files = spark.createDataFrame([("a//b.diff", 1, at(-10**6)), ("a/c.diff", 2, at(-10**6)), ("a/d.diff", 3, at(-5)), ("z/e.diff", 4, at(-10**6)), ("a/f.tmp", 5, at(-10**6))], "path string, size long, modified_at timestamp")
    refs = spark.createDataFrame([("artifact://a/b.diff",), ("memory://a/c.diff",), ("",), (None,), ("a/f.tmp",)], "uri string")
    got = {r["size"]: r["state"] for r in integrity.collect_garbage(files, refs, ts(str(NOW)), prefix="a/").collect()}
    assert got == {1: "referenced", 2: "candidate", 3: "too_young", 4: "outside", 5: "candidate"}


def test_policy_order(spark):
    rows = [("private:x", "u", "x" * 5000, None, False, False), ("team:p", "u", "", "FACT", False, False), ("team:p", "u", "x" * 1200, "FACT", True, False), ("team:p", "u", "x" * 1201, "FACT", True, False), ("team:p", "u", "x" * 201, "FACT", True, True), ("bad", "u", "", None, True, False), ("team:p", None, "", "OTHER", True, False)]
    df = spark.createDataFrame(rows, "target_space string, actor_user_id string, payload_md string, kind string, has_evidence boolean, is_bulk boolean")
    got = [(r["action"], r["reason"], r["final_space"]) for r in policy.decide_writes(df, policy.WritePolicy(allowed_kinds=("FACT",))).collect()]
    assert got == [
        ("allow", "private_space", "private:x"), ("redirect", "missing_evidence", "private:u"), ("allow", "policy_passed", "team:p"), ("redirect", "exceeds_max_chars:1201>1200", "private:u"),
        ("redirect", "bulk_too_long", "private:u"), ("reject", "unknown_space_type", "bad"), ("redirect", "kind_not_allowed:OTHER", "private:unknown"),
    ]


def test_health_order(spark):
    rows = [(1, at(-10), 10, 3, 0, 0), (2, None, 10, 2, 0, 0), (3, at(-7200), 0, 0, 0, 0), (4, at(-3599), 10, 0, 1, 10), (5, at(-3599), 10, 0, 0, 10), (6, at(-3600), 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "repo_id long, cursor_updated_at timestamp, recent_run_count int, recent_failed_count int, recent_429_hits int, recent_total_requests int")
    got = [(r["should_schedule"], r["reason"], r["adjustment"]) for r in policy.repo_health(df, ts(str(NOW))).orderBy("repo_id").collect()]
    assert got == [(False, "error_budget_exceeded:30.00%", 0), (True, "never_synced", -100), (True, "cursor_age=7200s", -2), (True, "rate_limited:10.00%", 50), (False, "within_threshold", 0), (True, "cursor_age=3600s", -1)]


def test_smoothing_and_turns(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 1.0)], "k string, i int, v double")
    assert [round(r["ema"], 4) for r in windows.smoothed(df, "k", ["i"], "v", 0.5).orderBy("i").collect()] == [1.0, 0.5, 0.75]


def test_schema_rules(spark):
    runs = spark.createDataFrame([("1", "odd"), ("2", "failed"), ("2", None)], "run_id string, status string")
    assert sorted(r["run_id"] for r in violations(conform(runs, "sync_runs"), "sync_runs").collect()) == ["1", "2"]
    assert duplicates(runs, ["run_id"]).count() == 1
    assert schema_drift(conform(runs, "sync_runs"), "sync_runs") == [] and ("status", "string", "string") not in schema_drift(runs, "sync_runs")


def test_each_kind_of_reference_meets_its_own_table(spark):
    """Rows that reach each exchange are those of one kind; none of them has a null key, and a source that most name is no list."""
    sha = lambda i: f"{i:064x}"
    blobs = spark.createDataFrame([(i, "git", f"git:1:{i % 3}", sha(i)) for i in range(30)], "blob_id long, source_type string, source_id string, sha256 string")
    attachments = spark.createDataFrame([(i, sha(100 + i)) for i in range(5)], "attachment_id long, sha256 string")
    uris = [f"memory://patch_blobs/git/git:1:0/{sha(0)}"] * 40 + [f"memory://patch_blobs/git/git:1:0/{sha(1)}"] * 3 + ["memory://patch_blobs/git/git:1:1"] * 5 + [f"memory://patch_blobs/sha256/{sha(7)}"] * 2 + ["memory://patch_blobs/blob_id/9"] * 4 + [f"memory://attachments/2/{sha(102)}"] * 6 + ["s3://x/y", None, "memory://attachments/77/" + sha(1)]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(uris)], "n long, evidence_uri string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = joins.resolve_evidence(rows, blobs, attachments)
        got = sorted((r["kind"] or "", r["resolution"], r["found_blob_id"]) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(uris)
    counts = {k: got.count(k) for k in set(got)}
    assert counts == {("patch_blobs", "ok", None): 40, ("patch_blobs", "hash_mismatch", None): 3, ("legacy", "ok", 1): 5, ("sha256", "ok", 7): 2, ("blob_id", "ok", 9): 4, ("attachments", "ok", None): 6, ("attachments", "not_found", None): 1, ("", "invalid", None): 2}
    plan = df._jdf.queryExecution().executedPlan()

    def exchanges(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from exchanges(node.executedPlan())
        elif "QueryStage" in name:
            yield from exchanges(node.plan())
        else:
            if name == "Exchange":
                yield int(node.metrics().apply("shuffleRecordsWritten").value()), node.output().mkString(",")
            for i in range(node.children().size()):
                yield from exchanges(node.children().apply(i))

    sizes = sorted({n for n, columns in exchanges(plan) if "evidence_uri" in columns})
    assert sizes and set(sizes) <= {43, 40, 3, 5, 2, 4, 7}


def test_audit_answers_each_row(spark):
    rows = spark.createDataFrame([(1, "a/b", "aa"), (2, None, "aa"), (3, "", "aa"), (4, "a/c", "aa"), (5, "none", "aa")], "blob_id long, uri string, sha256 string")
    files = spark.createDataFrame([("a/b", "aa"), ("a/c", "bb"), (".", "aa")], "path string, sha256 string")
    got = {r["blob_id"]: r["audit"] for r in integrity.audit_artifacts(rows, files).collect()}
    assert got == {1: "ok", 2: "missing", 3: "missing", 4: "mismatch", 5: "missing"}
