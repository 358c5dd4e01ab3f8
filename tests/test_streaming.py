"""Cursors, chunks, state machines, streams, connectors and sinks."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from ledgerline.operators.policy import SchedulerConfig
from ledgerline.plans import reports, scheduler
from ledgerline.sources import connectors, sinks
from ledgerline.sources.ledger import ts
from ledgerline.streaming import controllers as c
from ledgerline.streaming import cursors

T = dt.datetime(2024, 1, 1)


def test_after_cursor(spark):
    rows = [(T, "b", T, "a", True), (T, "a", T, "a", False), (T, "b", None, None, True), (T, "b", None, "b", False), (T, "b", None, "a", True), (None, "b", T, "a", False)]
    df = spark.createDataFrame(rows, "w timestamp, k string, cw timestamp, ck string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", cursors.after_cursor(*map(F.col, ("w", "k", "cw", "ck")))).collect())


def test_chunks(spark):
    w = spark.createDataFrame([(T, T + dt.timedelta(hours=5)), (T, T)], "since timestamp, until timestamp")
    got = cursors.time_chunks(w, 2).orderBy("index").collect()
    assert [(r["chunk_end"] - r["chunk_start"]).seconds // 3600 for r in got] == [2, 2, 1] and got[0]["total"] == 3
    r = spark.createDataFrame([(1, 25), (5, 4)], "start_rev long, end_rev long")
    assert [(x["chunk_start"], x["chunk_end"]) for x in cursors.revision_chunks(r, 10).orderBy("index").collect()] == [(1, 10), (11, 20), (21, 25)]


def test_revision_chunks_of_many_cells(spark, tmp_path):
    """Every chunk of ranges that fill none, one or many cells, of negative starts, and of equal ranges, once; and chunks are a few bytes each on the disk."""
    ends = [(1, 1), (5, 4), (1, 30), (-90, 4000), (None, 3), (3, None)] + [(k, 10 * cursors.CELL * 3 + k * 7) for k in range(1, 40)] + [(11, 10 * cursors.CELL + 10), (1, 10 * cursors.CELL), (1, 10 * cursors.CELL), (0, 20 * cursors.CELL - 1)]
    rows = [(i, a, z) for i, (a, z) in enumerate(ends)]
    got = sorted(tuple(r) for r in cursors.revision_chunks(spark.createDataFrame(rows, "id long, start_rev long, end_rev long"), 10).select("id", "index", "total", "chunk_start", "chunk_end").collect())
    want = [(i, k, -(-(z - a + 1) // 10), s, min(s + 9, z)) for i, a, z in rows if a is not None and z is not None for k, s in enumerate(range(a, z + 1, 10))]
    assert got == sorted(want)
    many = spark.range(600).selectExpr("id", "id % 20 + 100 * (id * 7919 % 150) + 1 as start_rev", "150000 - id * 104729 % 15000 as end_rev")
    cursors.revision_chunks(many, 100).select("id", "index", "chunk_start", "chunk_end").coalesce(1).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows > 780_000 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 5 * rows



def test_regression_is_marked(spark):
    shape = "k string, cursor_at timestamp, cursor_key string"
    old = spark.createDataFrame([("a", T, "5"), ("b", T, "5")], shape)
    new = spark.createDataFrame([("a", T, "4"), ("b", T, "6"), ("c", T, "1")], shape)
    got = {r["k"]: (r["cursor_key"], r["regressed"]) for r in cursors.advanced(old, new, "k").collect()}
    assert got == {"a": ("5", True), "b": ("6", False), "c": ("1", False)}


def test_token_bucket():
    b, ok, wait = c.take_token(c.Bucket(tokens=1.0, at=0.0), 0.0)
    assert ok
    b, ok, wait = c.take_token(b, 0.0)
    assert not ok and abs(wait - 0.1) < 1e-9
    assert c.take_token(b, 0.1)[1] and not c.take_token(c.Bucket(paused_until=5.0), 1.0)[1]


def test_breaker_walk():
    b, d = c.breaker_check(c.Breaker(), 0, 1.0, 0, 0, 4)
    assert b == c.Breaker() and d == c.Decision()  # too few samples: nothing is smoothed
    b, d = c.breaker_check(b, 1, 1.0, 0, 0, 5)
    assert (b.state, b.reason, d.allow_sync, d.backfill_only, d.batch, d.window, d.diff_mode, d.wait_seconds) == ("open", "failure_rate", True, True, 10, 300, "none", 600.0)
    b, d = c.breaker_check(b, 300, 0, 0, 0, 5)
    assert b.state == "open" and d.wait_seconds == 1.0 and b.failed == 1.0  # the mean rests while open
    half, d = c.breaker_check(b, 301, 0, 0, 0, 5)
    assert half.state == "half_open" and d.probe and d.probe_budget == 2 and d.probe_types == ("commits",) and d.batch == 10
    once = c.breaker_result(half, 301, True)
    assert once.state == "half_open" and c.breaker_result(once, 302, True).state == "closed"
    assert (c.breaker_check(once, 302, 0, 0, 0, 5)[1].diff_mode, c.breaker_check(once, 302, 0, 0, 0, 5)[1].backfill_only) == ("best_effort", False)
    assert c.breaker_result(half, 302, False).opened_at == 302
    spent = c.Breaker(state="half_open", probes=3, successes=1)
    assert c.breaker_check(spent, 9, 0, 0, 0, 5)[0].state == "open" and c.breaker_check(spent, 9, 0, 0, 0, 5)[1].wait_seconds == 300.0
    assert [c.recovery_batch(n) for n in (0, 1, 2)] == [55, 100, 100]


def test_breaker_smooths_all_rates():
    b = c.breaker_check(c.Breaker(), 0, 0.0, 0.0, 0.0, 5)[0]
    b = c.breaker_check(b, 1, 0.2, 0.38, 0.1, 5)[0]
    assert (b.state, b.failed, b.limited, b.timed_out) == ("closed", 0.1, 0.19, 0.05)
    assert c.breaker_check(b, 2, 0.0, 0.3, 0.0, 5)[0].reason == "rate_limit_rate"


def test_patch_limits_apart():
    p = c.Patches()
    for category in ["timeout", "timeout", "content_too_large", "timeout", "timeout", "other"]:
        p = c.patch_step(p, category)
    assert not p.skip and p.timeouts == 2
    p = c.patch_step(p, "timeout")
    assert p.skip and p.reason == "consecutive_timeout=3>=threshold=3" and c.patch_step(p, "other").skip and not c.patch_step(p, None).skip
    for _ in range(5):
        p = c.patch_step(p, "content_too_large")
    assert p.reason == "consecutive_content_too_large=5>=threshold=5"


def test_degradation_walk():
    d = c.Degradation()
    for _ in range(3):
        d = c.degradation_step(d, 1, 0, 0, 0, False)
    assert (d.diff_mode, d.batch, d.window, d.sleep) == ("none", 12, 450, 4.0)
    for _ in range(5):
        d = c.degradation_step(d, 0, 0, 0, 0, True)
    assert (d.diff_mode, d.batch, d.sleep) == ("best_effort", 14, 0.0)
    for _ in range(3):
        d = c.degradation_step(d, 0, 1, 0, 0, False)
    assert d.paused and d.sleep == 8.0  # the pause's own length
    d = c.Degradation(diff_mode="always")
    for _ in range(6):
        d = c.degradation_step(d, 0, 0, 0, 0, True)
    assert d.diff_mode == "always" and d.streak == 6 and d.batch == 100
    assert c.degradation_step(d, 0, 0, 0, 0, True, unknown=1).streak == 0


def test_folds_by_key(spark):
    rows = [(i, str(i % 3), float(i), "timeout" if i % 4 == 0 or i > 50 else None) for i in range(90)]
    got = {r["id"]: r["skip"] for r in c.patch_skips(spark.createDataFrame(rows, "id long, key string, at double, category string")).collect()}
    run: dict = {}
    for i, key, _, failed in rows:
        run[key] = run.get(key, 0) + 1 if failed else 0
        assert got[i] == (run[key] >= 3)


def test_caps_are_asymmetric():
    config = SchedulerConfig(per_instance=2, per_tenant=1, max_queue_depth=100, max_running=100)
    rows = [{"n": n, "instance": i, "tenant_id": t} for n, i, t in [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y"), (5, None, "z")]]
    assert [r["n"] for r in scheduler.admit(rows, {}, {}, config)] == [1, 4, 5]  # 2 used a place of a, so 3 found none and y stayed free


def test_rounds_equal_the_rows_one_after_the_other(spark):
    """Random candidates and queues: what the ranks let in is what the fold lets in, with and without turns of tenants."""
    shape = "repo_id long, job_type string, priority int, instance string, tenant_id string, reason string"
    for seed in range(6):
        r = random.Random(seed)
        rows = [(i, k, r.randrange(4), r.choice(("a", "b", "c", None)), r.choice(("x", "y", "z", None)), "due") for i in range(25) for k in ("commits", "mrs", "reviews")]
        jobs = [(r.choice(("pending", "running", "failed")), r.choice(("a", "b", None)), r.choice(("x", None))) for _ in range(5)]
        config = SchedulerConfig(per_instance=r.choice((0, 2, 9)), per_tenant=r.choice((1, 3, 9)), max_queue_depth=r.choice((4, 12, 60)), max_running=r.choice((2, 9)), max_enqueue_per_scan=r.choice((5, 100)), tenant_fairness=seed % 2 == 1, max_per_tenant_per_round=1 + seed % 3)
        df = spark.createDataFrame(rows, shape)
        got = [tuple(x) for x in scheduler.select_jobs(df, spark.createDataFrame(jobs, "status string, instance string, tenant_id string"), config).collect()]
        live = [j for j in jobs if j[0] != "failed"]
        count = lambda k: {v: sum(j[k] == v for j in live) for v in {j[k] for j in live} if v is not None}
        turns = [x.asDict() for x in scheduler.ranked(df, config).orderBy("turn").collect()]
        want = scheduler.admit(turns, count(1), count(2), config, sum(j[0] == "running" for j in live), sum(j[0] == "pending" for j in live))
        assert sorted(got, key=str) == sorted((tuple(w[c] for c in df.columns) for w in want), key=str)


def test_turns_of_tenants(spark):
    """One of each tenant in a round, tenants by their best job; none is a tenant too."""
    rows = [(1, "commits", 5, "x"), (2, "commits", 1, "y"), (2, "mrs", 2, "y"), (3, "commits", 3, None), (1, "mrs", 6, "x"), (4, "reviews", 1, "y")]
    df = spark.createDataFrame(rows, "repo_id long, job_type string, priority int, tenant_id string")
    order = lambda **k: [(r["repo_id"], r["job_type"]) for r in scheduler.ranked(df, SchedulerConfig(**k)).orderBy("turn").collect()]
    assert order() == [(2, "commits"), (4, "reviews"), (2, "mrs"), (3, "commits"), (1, "commits"), (1, "mrs")]
    assert order(tenant_fairness=True) == [(2, "commits"), (3, "commits"), (1, "commits"), (4, "reviews"), (1, "mrs"), (2, "mrs")]
    assert order(tenant_fairness=True, max_per_tenant_per_round=2) == [(2, "commits"), (4, "reviews"), (3, "commits"), (1, "commits"), (1, "mrs"), (2, "mrs")]


def test_candidates_are_logical(spark):
    """Reviews are scheduled, physical names in the queue count, and with a list of its own a scheduler keeps to it."""
    state = spark.createDataFrame([(1, "git", "https://a/x.git", "t/x", None, 0, 0, 0, 0)], "repo_id long, repo_type string, url string, project_key string, cursor_updated_at timestamp, recent_run_count long, recent_failed_count long, recent_429_hits long, recent_total_requests long")
    pair = lambda *names: spark.createDataFrame([(1, n) for n in names], "repo_id long, job_type string")
    types = lambda active, paused, **k: sorted((r["job_type"], r["priority"]) for r in scheduler.candidates(state, active, paused, ts("2024-01-01"), SchedulerConfig(**k)).collect())
    assert types(pair(), pair()) == [("commits", 0), ("mrs", 100), ("reviews", 200)]
    assert types(pair("gitlab_commits"), pair("mrs")) == [("reviews", 200)]
    assert types(pair(), pair(), mvp_job_types=("commits",)) == [("commits", 0)] and types(pair(), pair(), mvp_job_types=()) == []


def test_new_jobs_respect_breakers(spark):
    chosen = spark.createDataFrame([(1, "svn", 1, "i", "t", "r"), (2, "svn", 1, "i", "u", "r"), (3, "svn", 1, "j", None, "r")], "repo_id long, job_type string, priority int, instance string, tenant_id string, reason string")
    breakers = spark.createDataFrame([("tenant", "t", "open"), ("instance", "j", "open"), ("instance", "i", "closed")], "scope string, id string, state string")
    assert [r["repo_id"] for r in scheduler.new_jobs(chosen, breakers, ts("2024-01-01")).collect()] == [2]


def test_streams(spark, tmp_path):
    shape = "run_id string, status string, started_at timestamp"
    rows = [("1", "failed", T), ("1", "failed", T), ("2", "completed", T + dt.timedelta(minutes=5)), ("3", "failed", T + dt.timedelta(hours=3))]
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    q = cursors.deduplicated_stream(stream(), "started_at", "run_id").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 3
    q = cursors.windowed_health(stream()).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["status"], r["n"]) for r in spark.table("windows").collect()) == [("completed", 1), ("failed", 1), ("failed", 2)]
    q = cursors.upsert_stream(stream(), str(tmp_path / "state"), ["run_id"], "started_at", str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "state" / "v=0")).count() == 3


def test_state_stream(spark, tmp_path):
    spark.createDataFrame([(i, "k", "timeout") for i in range(4)], "id long, key string, category string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, key string, category string").parquet(str(tmp_path / "in"))
    q = c.patch_skip_stream(stream).writeStream.format("memory").queryName("skips").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r["skip"] for r in spark.table("skips").collect()) == 2


def test_breaker_stream_keeps_state_between_batches(spark, tmp_path):
    shape = "id long, key string, at double, failed_rate double, limited_rate double, timeout_rate double, n int, ok boolean"
    rows = [(i, "k", float(i * 100), 1.0 if i < 3 else 0.0, 0.0, 0.0, 10, i >= 3) for i in range(9)]
    for i in range(0, 9, 3):
        spark.createDataFrame(rows[i : i + 3], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = c.breaker_stream(stream).writeStream.format("memory").queryName("breakers").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r["id"]: r["state"] for r in c.breaker_states(spark.createDataFrame(rows, shape)).collect()}
    assert {r["id"]: r["state"] for r in spark.table("breakers").collect()} == want
    assert [want[i] for i in range(9)] == ["open", "open", "open", "half_open", "closed", "open", "open", "open", "half_open"]


def test_refresh(spark, tmp_path):
    path = str(tmp_path / "facts")
    assert reports.refresh(spark, spark.range(3), path, 1) == (0, 3)
    assert reports.refresh(spark, spark.range(5), path, 2) == (3, 5)


def test_connectors(spark, tmp_path):
    (tmp_path / "commits.json").write_text(json.dumps([{"id": "abc", "author_name": "A", "author_email": "a@x", "committed_date": "2024-01-01T10:00:00Z", "message": "m", "parent_ids": ["1", "2"], "stats": {"additions": 1, "deletions": 2, "total": 3}}]))
    got = connectors.saved_commits(spark, str(tmp_path / "commits.json"), 7).first()
    assert (got["source_id"], got["is_merge"], got["ts"]) == ("git:7:abc", True, dt.datetime(2024, 1, 1, 10))
    (tmp_path / "log.xml").write_text('<log><logentry revision="5"><author>a</author><date>2024-01-01T00:00:00.5Z</date><msg>hi</msg><paths><path action="M" kind="file">/x</path><path action="A" kind="file">/y</path></paths></logentry></log>')
    got = connectors.svn_log(spark, str(tmp_path / "log.xml"), 1).first()
    assert (got["rev_num"], got["source_id"], got["changed_paths"], got["message"]) == (5, "svn:1:5", 2, "hi")
    folder = tmp_path / "store" / "a"
    folder.mkdir(parents=True)
    for name in ("x.diff", ".hidden", "y.tmp"):
        (folder / name).write_text("abc")
    assert [r["size"] for r in connectors.files_below(spark, str(tmp_path / "store")).collect()] == [3]
    assert connectors.file_hashes(spark, str(folder / "x.diff")).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    (tmp_path / "user.md").write_text('---\nname: "Ann"\naliases: [a, b]\nroles:\n  - dev\n  - ops\n---\n# other: no\n')
    got = {r["key"]: r["values"] for r in connectors.identity_files(spark, str(tmp_path / "user.md")).collect()}
    assert got == {"name": ["Ann"], "aliases": ["a", "b"], "roles": ["dev", "ops"]}
    event = {"time": "2024-01-01T00:00:00Z", "api": {"name": "PutObject", "bucket": "b", "object": "k", "statusCode": 200}, "requestID": "r", "remotehost": "1.2.3.4:99"}
    rows = connectors.object_store_events(spark.createDataFrame([(json.dumps(event),), ("broken",)], "value string")).collect()
    assert (rows[0]["operation"], rows[0]["remote_ip"], rows[0]["success"]) == ("PutObject", "1.2.3.4", True) and rows[1]["operation"] is None


def test_identity_overlay(spark):
    shape = "user_id string, name string, aliases array<string>, roles array<string>"
    base = spark.createDataFrame([("a", "A", ["x", "y"], None), ("b", "B", [], [])], shape)
    over = spark.createDataFrame([("a", None, ["y", "z"], ["dev"])], shape)
    got = {r["user_id"]: (r["name"], r["aliases"], r["roles"]) for r in connectors.merged_users(base, over).collect()}
    assert got == {"a": ("A", ["x", "y", "z"], ["dev"]), "b": ("B", [], [])}


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([(1, "t", 'a "q", b', "open"), (2, "t", "x|y", None)], "item_id long, item_type string, title string, status string")
    items = items.withColumn("active_at", F.lit("2024-01-01"))
    sinks.render_views(spark, items.orderBy("item_id"), str(tmp_path), "2024-01-01", 1)
    lines = (tmp_path / "manifest.csv").read_text().split("\n")
    assert lines[3].startswith("item_id,") and lines[4].startswith('1,t,"a ""q"", b"') and len(lines) == 7
    assert sinks.index_lines(items.orderBy("item_id"), 2)[-1] == "| 2 | t | x\\|y | - | 2024-01-01 |"
    metrics = spark.createDataFrame([("jobs", "dead", 1), ("jobs", 'q"', 2)], "metric string, label string, n long")
    got = [r["line"] for r in sinks.prometheus_lines(metrics).collect()]
    assert got[0].startswith("# HELP ledger_jobs") and got[1:] == ['ledger_jobs{label="dead"} 1', 'ledger_jobs{label="q\\""} 2']
    assert json.loads(sinks.envelope(items.select("item_id")).first()["json"])["ok"]
    sinks.append_by_day(spark.createDataFrame([(1, T)], "id int, at timestamp"), "at", str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1
