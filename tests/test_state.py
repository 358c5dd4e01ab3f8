"""Artifact store, reconciliation, and the smaller rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import aggregates, lookups, policy, queues, state, writes
from ledgerline.sources.artifacts import ArtifactStore
from ledgerline.sources.ledger import ts
from ledgerline.streaming.controllers import next_window

T = dt.datetime(2024, 1, 1, 12)


def test_store(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path), prefixes=("scm/",))
    info = store.put("artifact://scm//1/../2/x.diff", b"abc")
    assert (info.key, info.size) == ("scm/2/x.diff", 3) and store.exists("scm/2/x.diff") and store.get("scm/2/x.diff") == b"abc"
    assert store.put("scm/2/x.diff", b"abc") == info and store.info("scm/2/x.diff") == info
    for key, content, sha, error in (("scm/2/x.diff", b"other", None, FileExistsError), ("scm/../../x", b"", None, ValueError), ("y/x", b"", None, ValueError), ("scm/z", b"", "0" * 64, ValueError)):
        with pytest.raises(error):
            store.put(key, content, sha)
    assert ArtifactStore(spark, str(tmp_path), "always").put("scm/2/x.diff", b"other").size == 5
    with pytest.raises(FileExistsError):
        ArtifactStore(spark, str(tmp_path), "never").put("scm/2/x.diff", b"other")
    assert [(r["key"], r["size"]) for r in store.listing().collect()] == [("scm/2/x.diff", 5)]
    (tmp_path / "outside.bin").write_bytes(b"other")
    store.put_file("scm/2/x.diff", str(tmp_path / "outside.bin"))
    (tmp_path / "outside.bin").write_bytes(b"another one")
    with pytest.raises(FileExistsError):
        store.put_file("scm/2/x.diff", str(tmp_path / "outside.bin"))
    store.put_file("scm/3/y.diff", str(tmp_path / "outside.bin"))
    assert store.get("scm/3/y.diff") == b"another one" and store.get("scm/2/x.diff") == b"other" and not list(tmp_path.glob("scm/*/*.tmp"))


def test_reconcile(spark):
    box = spark.createDataFrame(
        [(1, "team:p", "sent", None, None, T), (2, "team:p", "dead", None, None, T), (3, "team:p", "pending", T - dt.timedelta(seconds=601), "w", T), (4, "team:p", "pending", T - dt.timedelta(seconds=600), "w", T), (5, "team:p", "sent", None, None, T)],
        "outbox_id long, target_space string, status string, locked_at timestamp, locked_by string, next_attempt_at timestamp",
    )
    audit = spark.createDataFrame([("outbox_flush_success", '{"outbox_id": 5}'), ("outbox_flush_success", '{"outbox_id": "x"}'), ("other", '{"outbox_id": 1}')], "reason string, evidence_refs_json string")
    rows, after = queues.reconcile(box, audit, ts(str(T)), reschedule=True)
    assert sorted((r["reason"], r["action"]) for r in rows.collect()) == [("outbox_flush_dead", "reject"), ("outbox_flush_success", "allow"), ("outbox_stale", "redirect")]
    assert {r["outbox_id"]: r["locked_by"] for r in after.collect()} == {1: None, 2: None, 3: None, 4: "w", 5: None}
    again, _ = queues.reconcile(box, audit.unionByName(rows.select("reason", "evidence_refs_json")), ts(str(T)))
    assert again.count() == 0


def test_small_rules(spark):
    df = spark.createDataFrame([(True, 20.0), (False, 3.9), (False, 4.0)], "paused boolean, tokens double")
    assert [tuple(r[0]) for r in df.select(policy.bucket_penalty(F.col("paused"), F.col("tokens"), F.lit(20.0))).collect()] == [(1000, "bucket_paused"), (200, "bucket_low_tokens"), (0, None)]
    df = spark.createDataFrame([("open", 0), ("closed", 11), ("closed", 10)], "s string, lag int")
    assert [r[0] for r in df.select(policy.wants_backfill(F.col("s"), F.col("lag"), 10)).collect()] == [True, True, False]
    assert (next_window(600, True), next_window(600, False), next_window(400, True)) == (300, 900, 300)
    refs = spark.createDataFrame([([("a", None), ("b", "x")] + [(str(i), "") for i in range(5)],)], "r array<struct<uri:string,sha256:string>>")
    assert tuple(refs.select(aggregates.evidence_summary(F.col("r")).alias("s")).first()["s"]) == (7, True, ["a", "b", "0", "1", "2"])
    uris = spark.range(1000).select(F.concat(F.lit("p/"), F.col("id")).alias("uri"))
    one = {r[0] for r in lookups.sampled(uris, "uri", "p/", 10).collect()}
    assert 60 < len(one) < 140 and one == {r[0] for r in lookups.sampled(uris.repartition(7), "uri", "p/", 10).collect()}


def test_actors_and_accounts(spark):
    requests = spark.createDataFrame([("u1", "team:p"), ("x", "team:p"), (None, "team:p")], "actor_user_id string, target_space string")
    users = spark.createDataFrame([("u1",)], "user_id string")
    got = {r["actor_user_id"]: (r["actor_state"], r["target_space"]) for r in policy.validate_actors(requests, users, "degrade").collect()}
    assert got == {"u1": ("ok", "team:p"), "x": ("actor_unknown:degrade", "private:unknown"), None: ("ok", "team:p")}
    accounts = spark.createDataFrame([("git", "a", "u1")], "account_type string, account_name string, user_id string")
    new = spark.createDataFrame([("u2", "git", "a"), ("u3", "git", "b"), ("u2", "git", "b")], "user_id string, account_type string, account_name string")
    u, a = state.accounts_ensured(users, accounts, new)
    assert sorted(r["user_id"] for r in u.collect()) == ["u1", "u2", "u3"]
    assert {r["account_name"]: r["user_id"] for r in a.collect()} == {"a": "u1", "b": "u2"}


def test_old_rows_go(spark):
    jobs = spark.createDataFrame([("completed", T - dt.timedelta(days=31)), ("completed", T), ("failed", T - dt.timedelta(days=99)), (None, None)], "status string, at timestamp")
    assert writes.without_old(jobs, "completed", "at", ts(str(T)), 30).count() == 3


def test_late_changes_stay_behind(spark):
    """A change that is older than the row in state changes nothing; of several the last counts; without an order in state all do."""
    old = spark.createDataFrame([("a", 10, "x"), ("b", 1, "x")], "k string, o int, v string")
    new = spark.createDataFrame([("a", 3, "late"), ("b", 5, "early"), ("b", 7, "new"), ("c", 2, "first")], "k string, o int, v string")
    got = {r["k"]: (r["o"], r["v"]) for r in writes.upsert(old, new, ["k"], order=F.col("o")).collect()}
    assert got == {"a": (10, "x"), "b": (7, "new"), "c": (2, "first")}
    got = {r["k"]: r["v"] for r in writes.upsert(old.drop("o"), new, ["k"], order=F.col("o")).collect()}
    assert got == {"a": "late", "b": "new", "c": "first"}


def test_numbers_are_gapless(spark):
    """In order, from behind the largest id, whatever the values are: equal, null, negative; and for nothing."""
    values = [5.0, None, -3.0, 5.0, 5.0, 1e12, -1e12, 0.0]
    state_ = spark.createDataFrame([(41,)], "id long")
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int")
    got = sorted((r["id"], r["v"], r["i"]) for r in writes.numbered(rows, state_, "id", "v", "i", ranges=4).collect())
    want = sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [g[0] for g in got] == list(range(42, 50)) and [g[1:] for g in got] == want
    assert writes.numbered(rows.where("false"), state_.where("false"), "id", "v", "i").count() == 0
    assert sorted(r["id"] for r in writes.hashed(rows.select("i"), state_.where("false"), "id", "i").collect()) == list(range(1, 9))


def test_items_without_events_stay(spark):
    items = spark.createDataFrame([(1, "open", T, T + dt.timedelta(days=9)), (2, "open", T, T)], "item_id long, status string, created_at timestamp, updated_at timestamp")
    events = spark.createDataFrame([(7, 2, "done", T + dt.timedelta(days=1)), (8, 2, None, T + dt.timedelta(days=2))], "event_id long, item_id long, status_to string, created_at timestamp")
    got = {r["item_id"]: (r["status"], r["updated_at"]) for r in writes.add_events(items, events).collect()}
    assert got == {1: ("open", T + dt.timedelta(days=9)), 2: ("done", T + dt.timedelta(days=1))}


def test_only_allowed_roots(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x")
    from ledgerline.sources import connectors

    assert connectors.allowed_files(spark, f"file://{tmp_path}/a", [str(tmp_path)]).count() == 1
    for path in (f"{tmp_path}/a/../..", "/etc", f"{tmp_path}-other"):
        with pytest.raises(ValueError, match="allowed"):
            connectors.allowed_files(spark, path, [str(tmp_path)])
