import random

import pytest

from ledgerline.llm import mixing as m


def fill(sizes, weights=(5, 2, 1)):
    """Targets by pouring again and again what caps leave over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left, free = total - sum(capped.values()), [s for s in names if s not in capped]
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return capped | target
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 5, 1000, 10**6]) * r.randint(1, 9) for s in [None, "", "a", "b", "Z", "é", "zz"]}
    got = {x["source"]: x["target"] for x in m.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = fill(sizes)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(docs_of):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(0, 40), None, r.choice(["hot"] * 6 + ["b", "c", None, "tiny"])) for i in range(1500)] + [(None, "x y"), (3, "a b c", None, "b"), (3, "a b c", None, "b"), (9000, None, None, "c")]
    docs = docs_of(rows)
    got = m.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, m.mix(docs.repartition(5)).collect()))
    longest = max(x["size"] for x in got)
    for s in {x["source"] for x in got}:
        own = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 3 * longest
        assert all(x["taken"] <= 3 * x["size"] for x in own)
    total = sum(x["size"] for x in got)
    assert total - longest <= sum(x["taken"] for x in got) <= total
    taken = m.mixed(docs)
    assert taken.columns == docs.columns and sum(len(x["text"].split()) for x in taken.collect()) == sum(x["taken"] for x in got)


def test_words_are_those_of_ascii_blanks(docs_of):
    got = {x["doc_id"]: x["size"] for x in m.mix(docs_of([(1, "a\x0bb\tc\nd"), (2, "a\xa0b"), (3, "\x1c"), (4, None)])).collect()}
    assert got == {1: 4, 2: 1, 3: 1, 4: 0}


def test_late_finish_times(docs_of):
    """One document is far larger than its source's target, and what is left over comes to it last."""
    rows = [(1, "w " * 4000, None, "z"), *((i, "w " * 3, None, "a") for i in range(2, 40)), (99, "w", None, "b")]
    got = {x["doc_id"]: x for x in m.mix(docs_of(rows), weights=(1000, 1000, 1)).collect()}
    total = sum(x["size"] for x in got.values())
    assert sum(x["taken"] for x in got.values()) <= total and all(got[i]["taken"] == 9 for i in range(2, 40)) and got[99]["taken"] == 3


def test_keys_of_text_and_repeated_rows(spark, docs_of, monkeypatch):
    """Keys are of any type; a row that makes up a third of all, with one key and text, counts as often as it stands there."""
    monkeypatch.setattr(m, "FEW", 3)
    r = random.Random(8)
    rows = [(f"k{i}", "w " * r.randint(0, 9), r.choice(["a", "b", None])) for i in range(300)] + [("hot", "x y z", "a")] * 150 + [(None, "n n", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = m.mix(docs).collect()
    assert len(got) == len(rows)
    total, longest = sum(x["size"] for x in got), max(x["size"] for x in got)
    assert total - longest <= sum(x["taken"] for x in got) <= total
    with monkeypatch.context() as few:
        few.setattr(m, "RANGES", 8)
        few.setattr(m, "ROWS", 40)
        assert sorted(map(str, m.mix(docs).collect())) == sorted(map(str, got))
    taken = m.mixed(docs)
    assert taken.columns == docs.columns and {x["doc_id"] for x in taken.collect()} == {x["doc_id"] for x in got if x["taken"]}


def test_scratch_tables_go(spark, docs_of):
    """Of all tables on the way, those stay that the result reads."""
    import os

    from ledgerline.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    taken = m.mixed(docs_of([(i, "w " * (i % 5), None, "ab"[i % 2]) for i in range(50)]))
    assert len(taken.collect()) > 0
    assert [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["ends"]
