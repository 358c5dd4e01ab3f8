import random
from collections import Counter

from ledgerline.llm import exact_dedup as e


def brute(rows):
    import hashlib

    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups: dict = {}
    for k, t in rows:
        groups.setdefault(low(t), []).append(k)
    out = []
    for t, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        done = False
        for k in keys:
            kept = k == best and not done
            done |= kept
            out.append((k, best, len(keys), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_heavy_and_light(docs_of):
    r = random.Random(2)
    rows = [(i, "Hot Text") for i in range(700)] + [(1000 + i, r.choice(["x", "X", "é", "É", "", None, f"u{i}"])) for i in range(600)] + [(1, "Hot Text"), (None, "hot text"), (None, "nulls"), (None, "nulls")]
    got = sorted((tuple(x) for x in e.exact_groups(docs_of(rows), counters=8).collect()), key=str)
    assert got == brute(rows)


def test_misra_gries_finds_what_is_frequent(spark):
    r = random.Random(3)
    values = ["a"] * 900 + ["b"] * 500 + [f"u{r.randrange(5000)}" for _ in range(3000)]
    r.shuffle(values)
    got = e.misra_gries(spark.createDataFrame([(v, 1) for v in values], "digest string, _copies long").repartition(7), 16).collect()
    counts = Counter(values)
    assert {"a", "b"} <= {x["digest"] for x in got} and len(got) <= 16
    assert all(x["low"] <= counts[x["digest"]] for x in got)


def test_heavy_rows_are_not_shuffled(spark, docs_of):
    """What the shuffle writes are the rows that are in no frequent group, once."""
    rows = [(i, "hot") for i in range(3000)] + [(5000 + i, f"text {i // 2}") for i in range(400)]
    df = e.exact_groups(docs_of(rows).repartition(6), counters=8)
    assert len(df.collect()) == 3400
    plan = df._jdf.queryExecution().executedPlan()

    def exchanges(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from exchanges(node.executedPlan())
        elif "QueryStage" in name:
            yield from exchanges(node.plan())
        else:
            if name == "Exchange":
                yield int(node.metrics().apply("shuffleRecordsWritten").value())
            for i in range(node.children().size()):
                yield from exchanges(node.children().apply(i))

    assert list(exchanges(plan)) == [400]


def test_heavy_and_rest_are_apart(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "b")], "_key long, _id long, digest string")
    winners = spark.createDataFrame([("a", 2)], "digest string, group_size long")
    heavy, rest = e.split_heavy(rows, winners)
    assert sorted(r["_key"] for r in heavy.collect()) == [1, 2] and [r["_key"] for r in rest.collect()] == [3]
    for part in (heavy, rest):
        assert "Exchange hash" not in part._jdf.queryExecution().executedPlan().toString()


def test_other_keys(spark):
    rows = spark.createDataFrame([("b", "T", 1), ("a", "t", 2), (None, "t", 3), ("b", "t", 4)], "name string, text string, digest int")
    got = sorted(((r["name"], r["keep_id"], r["group_size"], r["kept"]) for r in e.exact_groups(rows, "name").collect()), key=str)
    assert [r[:3] for r in got] == [("a", "b", 4), ("b", "b", 4), ("b", "b", 4), (None, "b", 4)] and sum(r[3] for r in got) == 1
