import zlib

from pyspark.sql import functions as F

from ledgerline.llm import sharding as s


def test_laws(docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(4000)])
    rows = s.assign_shards(docs).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert moved and all(r["grown_shard"] == 8 for r in moved) and len(moved) < 4000 / 9 * 1.3
    sizes = [sum(r["shard"] == k for r in rows) for k in range(8)]
    assert max(sizes) < 4000 / 8 * 1.25 and min(sizes) > 4000 / 8 * 0.75
    assert all(r["text_crc32"] == zlib.crc32(r["text"].encode()) for r in rows)


def test_weights(docs_of):
    rows = s.assign_shards(docs_of([(i, "") for i in range(4000)]), weights=[3.0, 1.0]).collect()
    assert 0.7 < sum(r["shard"] == 0 for r in rows) / 4000 < 0.8


def test_slots_with_repeats(docs_of):
    docs = docs_of([(1, "a")] * 500 + [(i, None) for i in range(50)] + [(None, "x")] * 3 + [(7, "b"), (7, "c")])
    got = s.number_slots(s.assign_shards(docs)).collect()
    assert len(got) == 555
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1


def test_native_and_clashing_names(docs_of):
    docs = docs_of([(1, "a")]).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(5))
    df = s.number_slots(s.assign_shards(docs))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.first()["slot"] == 0
