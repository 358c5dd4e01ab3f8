import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerline.llm import conversation_trie as t

NONE = hashlib.sha256(b"").hexdigest()


def brute(rows, rebuild):
    convs = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            convs[c].append(((n is not None, n or 0), role or "", text or ""))
    plain = {c: [(r, x) for _, r, x in sorted(own)] for c, own in convs.items()}
    full = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        full[c] = plain.get(c - rest, [])[:h] + own[h:] if rebuild else own
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, own in members.items():
        ends = sorted(c for c in own if len(full[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def table_of(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string").repartition(5)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), *range(-7, 0), 10**12 + 3, 10**12 + 4]:
        if r.random() < 0.15:
            continue
        for i in range(r.choice((1, 2, 3, 8, 9, 14))):
            rows.append((c, i, r.choice(("user", "assistant", None, "")), r.choice(("a", "é", "", None, "long text"))))
    for c in range(2000, 2040):  # one conversation, often
        rows += [(c, i, "user", f"turn {i}") for i in range(12)]
    rows += [(3, 0, "user", "again"), (3, 0, "user", "again"), (3, None, "user", "b"), (3, None, "user", "a"), (3, None, "tool", "z"), (None, 1, "user", "no key"), (4, 2, "user", "ties"), (4, 2, "user", "tie")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_against_brute_force(table_of, rebuild):
    rows = corpus(150, 1)
    assert told(t.prefix_trie(table_of(rows), of=t.rebuilt if rebuild else t.whole)) == brute(rows, rebuild)


def test_turnless_and_alone(table_of):
    """Id 7 is built of nothing where 5 is absent and it has no turns of its own beyond its first h."""
    c = next(k for k in range(1, 99) if k % 5 and zlib.crc32(str(k).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]
    assert told(t.prefix_trie(table_of(rows), of=t.rebuilt)) == brute(rows, True) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert told(t.prefix_trie(table_of([(None, 1, "a", "b")]))) == []


def test_long_chains_take_few_rounds(table_of, monkeypatch):
    """One conversation of 600 turns from which others part at every turn, and logs that grow turn by turn: rounds are the logarithm of the conversations."""
    rows = [(1000, i, "user", f"t{i}") for i in range(600)]
    for c in range(0, 600, 4):
        rows += [(2000 + c, i, "user", f"t{i}") for i in range(c)] + [(2000 + c, c, "user", f"own {c}")]
    rows += [(5000 + k, i, "bot", f"g{i}") for k in range(40) for i in range(k + 1)]
    rounds = []
    real = t.materialize
    monkeypatch.setattr(t, "materialize", lambda df, name: (rounds.append(name), real(df, name))[1])
    assert told(t.prefix_trie(table_of(rows))) == brute(rows, False)
    assert rounds.count("peeled") <= 9


def test_a_group_reaches_over_ranges(spark):
    """Sums of a group that lies in many ranges, beside small ones and nulls."""
    from pyspark.sql import functions as F

    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 50}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(3)
    got = t.scanned(df, ["g"], [F.col("i")], {"n": ("sum", F.lit(1)), "top": ("max", F.when(F.col("i") % 7 == 0, F.col("i"))), "x": ("xor", F.col("i"))}).collect()
    seen: dict = {}
    for r in sorted(got, key=lambda r: r["i"]):
        n, top, x = seen.get(r["g"], (None, None, None))
        assert (r["n"], r["top"], r["x"]) == (n, top, x)
        seen[r["g"]] = ((n or 0) + 1, r["i"] if r["i"] % 7 == 0 else top, r["i"] ^ (x or 0))
    assert len(got) == 3400


def test_ends_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK", 50)
    df = spark.createDataFrame([(1, 2, c) for c in range(1000)] + [(1, 3, 7), (-4, 2, -9)], "owner long, depth long, conv long").repartition(7)
    got = {(r["owner"], r["depth"]): r["ends_sha256"] for r in t.ends_of(df).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 2): sha(range(1000)), (1, 3): sha([7]), (-4, 2): sha([-9])}


def test_very_long_text(table_of):
    rows = [(1, 0, "user", "é" * 1_000_000), (2, 0, "user", "é" * 1_000_000)]
    assert [r["saved_tokens"] for r in t.prefix_trie(table_of(rows)).orderBy("depth").collect()] == [2_000_000, 2_000_000]
