import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from oracle import assert_same

from ledgerline.llm import filter_audit as f


def brute(rows, labels):
    """(part, order, step) -> counts, from (doc_id, text, lang) and (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = defaultdict(list)
    for i, t, lang in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        seen[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, own in seen.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [r for r in left if r[0][c]]
                left = [r for r in left if not r[0][c]]
                failing = sum(r[0][c] for r in own)
                total[c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[0][c] and sum(r[0].values()) == 1 for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words[: r.choice((40, 300))], k=r.choice((20, 99, 100, 160)))) for _ in range(n // 3)]
    texts += [t.upper() for t in texts[:9]] + [t + " #" for t in texts[:9]] + ["", None, " \t\x0b", "A" * 11 + "é" * 89, "A" * 10 + "é" * 90, "x y " * 120]
    rows = [(i, r.choice(texts), r.choice(("en", "de", None, ""))) for i in range(n)] + [(None, texts[0], "en"), (None, texts[0], "en"), (3, texts[1], "en"), (3, texts[1], "en")]
    labels = [(r.randrange(n), r.choice((0, 1, None)), r.choice((0, 1, None))) for _ in range(n)] + [(None, 1, 1)]
    return rows, labels


@pytest.fixture
def tables(spark):
    def make(rows, labels):
        docs = spark.createDataFrame([(i, t, x, "a", "b") for i, t, x in rows], "doc_id long, text string, lang string, mask string, good string").repartition(5)
        return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    return make


def test_against_brute_force(tables):
    rows, labels = corpus(300, 1)
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in f.audit(*tables(rows, labels)).collect()}
    assert got == brute(rows, labels) and len(got) == 3 * 600


def test_equals_sql_on_odd_rows(tables):
    import duckdb

    rows, labels = corpus(200, 2)
    rows = [r for r in rows if r[0] is not None]
    docs, said = tables(rows, labels)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", said.toPandas().astype("Int64"))
    assert_same(f.audit(docs, said), f.SQL, con)


def test_hot_text_and_long_text(tables):
    """A text of a third of all rows is settled without a shuffle of them; a text of a million words is one row."""
    long = " ".join(f"word{i}" for i in range(1_000_000))
    rows = [(i, "hot # text", "en") for i in range(900)] + [(1000 + i, f"t{i}", "en") for i in range(50)] + [(5000, long, "fr"), (5001, long, "fr")]
    got = {(r["part"], r["filter_order"], r["step"]): r for r in f.audit(*tables(rows, [])).collect()}
    assert got["en", "EABCD", 1]["removed"] == 899 and got["en", "EABCD", 2]["removed"] == 51
    assert [got["fr", "EABCD", s]["removed"] for s in range(1, 6)] == [1, 0, 0, 0, 0]


def test_more_parts_than_a_task_holds(tables, monkeypatch):
    monkeypatch.setattr(f, "PARTS", 3)
    rows = [(i, f"text {i % 4}", f"lang{i % 20}") for i in range(200)]
    assert {k: v for k, v in brute(rows, []).items()} == {(r[0], r[1], r[2]): list(r[3:]) for r in f.audit(*tables(rows, [])).collect()}


def test_first_failures():
    for mask in range(f.MASKS):
        for o, order in enumerate(f.ORDERS):
            want = next((s for s, c in enumerate(order) if mask >> f.FILTERS.index(c) & 1), f.STEPS)
            assert f.FIRST[mask, o] == want
    assert f.FIRST.shape == (32, 120)
