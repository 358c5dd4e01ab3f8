"""Objects copied by a job: every state, retries, sources that go, and stores of one object at a time."""

import hashlib

import pytest
from oracle import assert_same, connect

from ledgerline import registry
from ledgerline.sources import objects
from ledgerline.sources.artifacts import ArtifactStore

PLAN = "key string, source string, target string, sha256 string"


def sha(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


@pytest.fixture
def place(tmp_path):
    for folder in ("source", "target"):
        (tmp_path / folder).mkdir()
    return tmp_path


def plan_of(spark, place, rows):
    return spark.createDataFrame([(k, str(place / "source" / k), str(place / "target" / k), h) for k, h in rows], PLAN)


def told(df):
    return {r["key"]: (r["state"], r["size"], r["sha256"]) for r in df.collect()}


def test_every_state(spark, place, monkeypatch):
    big = b"0123456789" * 2_000_000  # several parts
    for k, c in {"a": b"one", "b": b"two", "c": b"", "d": b"right", "e": big, "deep": b"x"}.items():
        (place / "source" / k).write_bytes(c)
    (place / "target" / "b").write_bytes(b"two")
    (place / "target" / "d").write_bytes(b"wrong")
    (place / "blocked").write_bytes(b"a file, no folder")
    rows = plan_of(spark, place, [("a", sha(b"one").upper()), ("b", None), ("c", sha(b"")), ("d", None), ("e", sha(big)), ("gone", None), ("deep", sha(b"y"))])
    bad = spark.createDataFrame([("f", str(place / "source" / "a"), str(place / "blocked" / "f"), None), (None, None, None, None)], PLAN)
    dry = told(objects.copied(rows, str(place / "dry"), dry_run=True))
    assert {k: v[0] for k, v in dry.items()} == {"a": "pending", "b": "pending", "c": "pending", "d": "pending", "e": "pending", "gone": "missing", "deep": "mismatch"} and not (place / "target" / "a").exists()
    got = told(objects.copied(rows.unionByName(bad), str(place / "log")))
    assert {k: v[0] for k, v in got.items()} == {"a": "verified", "b": "skipped", "c": "verified", "d": "conflict", "e": "verified", "gone": "missing", "deep": "mismatch", "f": "failed", None: "failed"}
    assert got["e"][1:] == (len(big), sha(big)) and (place / "target" / "e").read_bytes() == big and (place / "target" / "d").read_bytes() == b"wrong"
    assert not [p for p in (place / "target").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    assert told(objects.copied(plan_of(spark, place, [("d", None)]), str(place / "log2"), replace=True))["d"][0] == "verified" and (place / "target" / "d").read_bytes() == b"right"
    assert {r["state"]: (r["n"], r["bytes"]) for r in objects.summary(spark.read.parquet(str(place / "log" / "result"))).collect()}["skipped"] == (1, 3)


def test_a_task_that_runs_again_says_the_same(place):
    (place / "source" / "a").write_bytes(b"one")
    args = ("a", str(place / "source" / "a"), str(place / "target" / "a"), sha(b"one"), False, False)
    first = objects._copy(*args, "delete", None, False)
    assert first == objects._copy(*args, "delete", None, False) == (3, sha(b"one"), "verified", None)
    assert not (place / "source" / "a").exists()


def test_sources_go_only_when_safe(spark, place):
    for k in "ab":
        (place / "source" / k).write_bytes(k.encode())
    (place / "target" / "b").write_bytes(b"other")
    objects.copied(plan_of(spark, place, [("a", None), ("b", None)]), str(place / "log"), sources="trash", trash=str(place / "trash"))
    assert not (place / "source" / "a").exists() and (place / "trash" / "a").read_bytes() == b"a" and (place / "source" / "b").exists()
    with pytest.raises(ValueError):
        objects.copied(plan_of(spark, place, []), str(place / "log"), sources="trash")
    assert objects.copied(plan_of(spark, place, []), str(place / "none")).collect() == []


def test_uris_follow_what_is_safe(spark, place):
    results = spark.createDataFrame([("a", "s/a", "t/a", 1, "x", "verified", None), ("b", "s/b", "t/b", 1, "x", "conflict", None), ("c", "s/c", "t/c", 1, "x", "skipped", None)], objects.RESULT)
    rows = spark.createDataFrame([(1, "s/a"), (2, "s/a"), (3, "s/b"), (4, None), (5, "s/c")], "id long, uri string")
    assert {r["id"]: r["uri"] for r in objects.with_new_uris(rows, results).collect()} == {1: "t/a", 2: "t/a", 3: "s/b", 4: None, 5: "t/c"}


def test_parts_of_one_object(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "store"))
    info = store.put_parts("k/one", (bytes([i]) * 1000 for i in range(5)))
    assert (info.size, info.sha256) == (5000, sha(b"".join(store.parts("k/one", 999)))) and [len(p) for p in store.parts("k/one", 2000)] == [2000, 2000, 1000]
    assert store.put_parts("k/one", store.parts("k/one", 7)) == info
    with pytest.raises(FileExistsError):
        store.put_parts("k/one", [b"other"])
    with pytest.raises(ValueError):
        store.put_parts("k/two", [b"other"], sha256=info.sha256)
    assert not store.exists("k/two") and b"".join(store.parts("k/one")) == b"".join(bytes([i]) * 1000 for i in range(5))


ODD = [(i, f"text {i}") for i in range(120)] + [(i, f"other {i}") for i in range(60)] + [(i, f"text {i}") for i in range(20)]
ODD += [(-i, f"below {i}") for i in range(1, 60)] + [(None, "no id"), (None, "no id either"), (None, None), (8, None), (15, "another"), (29, "another")]
EMPTY = [(i, ("", None, f"text {i}")[i % 3]) for i in range(100)]


@pytest.mark.parametrize("rows", [ODD, EMPTY], ids=["ids", "texts"])
@pytest.mark.parametrize("name", ["objects_after_copy", "objects_copied"])
def test_odd_documents_equal_sql(spark, tmp_path, name, rows):
    """Documents of one id and other texts, or the same again, of an id below 0, and without one; and empty texts: each row is what the SQL says."""
    con = connect()
    con.execute("create temp table given (doc_id bigint, text varchar)")
    con.executemany("insert into given values (?, ?)", rows)
    con.execute(f"copy given to '{tmp_path}/documents.parquet' (format parquet)")
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet'")
    assert_same(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], con)


def test_the_driver_lists_no_objects(spark, tmp_path):
    """The files that the driver knows of are those of tables, so many as tasks wrote, however many objects there are."""
    spark.range(400).selectExpr("id as doc_id", "concat('text ', id) as text").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.queries()["objects_after_copy"](spark, str(tmp_path))
    files = out.inputFiles()
    assert all(f.endswith(".parquet") for f in files) and len(files) < 40
    assert out.where("safe").count() > 100
