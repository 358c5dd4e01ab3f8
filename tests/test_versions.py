"""Tables of versions: what a change touches, retries, lost jobs, and appends that count once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import writes
from ledgerline.sources.versions import BucketedTable, OnceLog, bucket_of
from ledgerline.streaming import cursors

SHAPE = "k string, o int, v string"


def step(state, new):
    return writes.upsert(state, new, ["k"], order=F.col("o"))


def files_of(path):
    return {str(p.relative_to(path)): (p.stat().st_mtime_ns, p.stat().st_size) for p in path.rglob("*.parquet") if "/_" not in str(p.relative_to(path)) and not str(p.relative_to(path)).startswith("_")}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 16)
    table.apply(spark.createDataFrame([(f"k{i}", i, "old") for i in range(200)], SHAPE), step)
    before = files_of(tmp_path / "t")
    changes = spark.createDataFrame([("k3", 900, "new"), ("k3", 800, "older"), ("k7", 1, "late"), ("fresh", 1, "first")], SHAPE)
    assert table.apply(changes, step) == 1
    touched = {r[0] for r in changes.select(bucket_of(["k"], 16)).distinct().collect()}
    after = files_of(tmp_path / "t")
    assert {k: v for k, v in after.items() if k in before} == before
    assert {int(k.split("b=")[1].split("/")[0]) for k in after if k.startswith("v=1/")} == touched
    assert {r["bucket"]: r["v"] for r in table.manifest().collect()} == {b: int(b in touched) for b in range(16)}
    want = sorted([(f"k{i}", i, "old") for i in range(200) if i != 3] + [("k3", 900, "new"), ("fresh", 1, "first")])
    assert rows_of(table.read()) == want and table.read(0).count() == 200
    assert rows_of(BucketedTable(spark, str(tmp_path / "t"), ["k"], 99).read()) == want  # a table keeps its own buckets


def test_any_order_of_batches_gives_the_whole_upsert(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"k{r.randrange(60)}", o, f"v{o}") for o in range(300)]
    r.shuffle(rows)
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 8)
    for i in range(0, 300, 100):
        table.apply(spark.createDataFrame(rows[i : i + 100], SHAPE), step)
    best = {}
    for k, o, v in sorted(rows, key=lambda x: x[1]):
        best[k] = (k, o, v)
    assert rows_of(table.read()) == sorted(best.values())


def test_a_batch_that_comes_again_and_one_that_was_lost(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    one, two = (spark.createDataFrame([(f"k{i}", o, f"v{o}") for i in range(9)], SHAPE) for o in (1, 2))
    table.apply(one, step, 5)
    table.apply(two, step, 6)
    before = files_of(tmp_path / "t")
    table.apply(one, step, 6)  # the number is there: nothing is read or written
    assert files_of(tmp_path / "t") == before and table.versions() == [5, 6]

    def fails(state, new):
        return writes.upsert(state, new, ["k"], order=F.col("o")).withColumn("v", F.when(F.col("k") == "k8", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))

    three = spark.createDataFrame([(f"k{i}", 3, "v3") for i in range(9)], SHAPE)
    with pytest.raises(Exception, match="lost"):
        table.apply(three, fails)
    assert table.versions() == [5, 6] and {r[2] for r in rows_of(table.read())} == {"v2"}
    assert table.apply(three, step) == 7 and {r[2] for r in rows_of(table.read())} == {"v3"}


def test_of_two_writers_the_second_is_told(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.apply(spark.createDataFrame([("a", 1, "x")], SHAPE), step)

    def slow(state, new):  # another writes version 1 meanwhile
        assert table.folder.commit(spark.createDataFrame([(-1, 1, 0, table._manifest(0)[1])], "bucket int, v long, n long, shape string"), "_manifest/1")
        return step(state, new)

    with pytest.raises(FileExistsError):
        table.apply(spark.createDataFrame([("a", 3, "second")], SHAPE), slow)
    assert table.versions() == [0, 1] and table.read().count() == 0


def test_empty_null_and_many_keys(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k", "o"], 4)
    keep = lambda state, new: writes.upsert(state, new, ["k", "o"])
    table.apply(spark.createDataFrame([], SHAPE), keep)
    assert table.read().count() == 0
    table.apply(spark.createDataFrame([("a", 1, None), ("a", 2, "é")], SHAPE), keep)
    table.apply(spark.createDataFrame([], SHAPE), keep)
    assert sorted(map(tuple, table.read().collect())) == [("a", 1, None), ("a", 2, "é")] and table.versions() == [0, 1, 2]


def test_vacuum(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    for o in range(4):
        table.apply(spark.createDataFrame([(f"k{i}", o, f"v{o}") for i in range(20 if o == 0 else 1)], SHAPE), step)
    want = rows_of(table.read())
    gone = table.vacuum(keep=1)
    assert gone and table.versions() == [3] and rows_of(table.read()) == want


def test_upsert_stream_touches_few_buckets(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    shape = "run_id string, status string, started_at timestamp"
    spark.createDataFrame([(str(i), "failed", at) for i in range(50)], shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: cursors.upsert_stream(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "state"), ["run_id"], "started_at", str(tmp_path / "check")).awaitTermination(60)
    run()
    before = files_of(tmp_path / "state")
    spark.createDataFrame([("7", "completed", at + dt.timedelta(hours=1)), ("8", "late", at - dt.timedelta(hours=1))], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    table = BucketedTable(spark, str(tmp_path / "state"), ["run_id"])
    assert {r["run_id"]: r["status"] for r in table.read().collect()} == {str(i): "completed" if i == 7 else "failed" for i in range(50)}
    after = files_of(tmp_path / "state")
    assert all(after[k] == v for k, v in before.items()) and len({k.split("/")[1] for k in after if k.startswith("v=1/")}) <= 2


def test_appends_count_once(spark, tmp_path):
    log = OnceLog(spark, str(tmp_path / "log"))
    at = dt.datetime(2024, 1, 1, 12)
    batch = lambda n, text: spark.createDataFrame([(i, text, at + dt.timedelta(days=i)) for i in range(n)], "id long, said string, at timestamp")
    assert log.append(batch(3, "one"), 0, "at") and not log.append(batch(3, "again"), 0, "at")
    bad = batch(2, "cut off").withColumn("said", F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("said")))
    with pytest.raises(Exception, match="lost"):
        log.append(bad, 1, "at")
    batch(1, "left behind").withColumn("day", F.to_date("at")).write.mode("overwrite").partitionBy("day").parquet(str(tmp_path / "log" / "batch=1"))
    assert sorted((r["id"], r["said"], str(r["day"])) for r in log.read().collect()) == [(i, "one", f"2024-01-0{i + 1}") for i in range(3)]
    assert log.append(batch(2, "two"), 1, "at") and log.done() == ["0", "1"]
    assert sorted((r["batch"], r["id"], r["said"]) for r in log.read().collect()) == [("0", i, "one") for i in range(3)] + [("1", i, "two") for i in range(2)]


def test_a_stream_that_repeats_a_batch(spark, tmp_path):
    """The stream's own record of a batch is lost after its rows are written, so it sends it again."""
    spark.createDataFrame([(i, "x") for i in range(5)], "id long, said string").coalesce(1).write.parquet(str(tmp_path / "in"))
    log = OnceLog(spark, str(tmp_path / "log"))
    for check in ("a", "b"):
        stream = spark.readStream.schema("id long, said string").parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(log.sink()).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
    assert sorted(r["id"] for r in log.read().collect()) == list(range(5))


def test_a_cursor_that_goes_back(spark):
    old, new = (spark.createDataFrame(rows, "repo long, cursor_at int, cursor_key string") for rows in ([(1, 5, "a"), (2, 5, "a")], [(1, 6, "a"), (2, 5, "b"), (3, 1, "x")]))
    assert [r["regressed"] for r in cursors.advanced(old, new, "repo", strict=True).collect()] == [False] * 3
    with pytest.raises(Exception, match="cursor_regression:1"):
        cursors.advanced(new, old, "repo", strict=True).collect()
    assert {r["repo"]: r["regressed"] for r in cursors.advanced(new, old, "repo").collect()} == {1: True, 2: True, 3: False}
