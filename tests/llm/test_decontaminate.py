import random
import re

from ledgerline.llm import decontaminate as d


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    out = []
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, question in items:
            q = words(question)
            for i in range(max(1, len(q) - n + 1)) if q else ():
                window = q[i : i + n]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        ids.add(str(item))
        out.append((key, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def test_against_brute_force(spark, docs_of):
    r = random.Random(4)
    pick = lambda n: [r.choice(["Aa", "b", "É", "d9", "e"]) for _ in range(n)]
    items = [(i, " ".join(pick(r.choice([0, 3, 7, 12, 15])))) for i in range(12)] + [(99, None), (98, "...")]
    docs = [(None, "x")]
    for i in range(80):
        w = pick(r.randint(0, 40))
        if r.random() < 0.5:
            w[5:5] = r.choice(items[:12])[1].split()
        docs.append((i, r.choice([" ", " - ", "\n"]).join(w) if i % 9 else None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10, 1 << 20):
        got = d.find_contamination(docs_of(docs), bench, block_bytes=block).collect()
        assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], x["items"]) for x in got), key=str) == brute(docs, items)


def test_spans_are_those_of_the_original(spark, docs_of):
    text = "Vorher «Ä»! ONE, two;\nthree - four... danach é"
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = d.find_contamination(docs_of([(1, text)]), bench).first()
    assert [text[s["start"] : s["end"]] for s in got["spans"]] == ["ONE, two;\nthree - four"]
    kept = d.keep_uncontaminated(docs_of([(1, text), (2, "one two three"), (3, None)]).withColumnRenamed("lang", "n_hit"), bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == [2, 3] and "n_hit" in kept.columns


def test_a_large_benchmark_is_held_by_blocks(spark, docs_of):
    """20 MB of items: what one automaton of a block takes, and that a planted passage is found in several passes."""
    r = random.Random(6)
    names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(40_000)]
    items, held = [], 0
    while held < 20 << 20:
        items.append((len(items), " ".join(r.choices(names, k=600))))
        held += len(items[-1][1])
    own, held = {}, 0
    for item, t in items:
        if held < d.BLOCK_BYTES:
            own |= {w: {str(item)} for w in d.item_windows(t)}
            held += len(t)
    assert len(own) > 140_000
    before = _resident()
    machine = d.Automaton(own)
    assert _resident() - before < 400
    assert machine.machine.get_stats()["total_size"] < 300 << 20
    bench = spark.createDataFrame(items[:40], "item_id long, text string")
    docs = [(1, "x " + " ".join(items[3][1].split()[100:130]) + " y"), (2, " ".join(items[39][1].split()[:9])), (3, " ".join(items[39][1].split()[5:15]) + " " + " ".join(items[7][1].split()[:10])), (3, None)]
    got = d.find_contamination(docs_of(docs), bench, block_bytes=40_000).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], x["items"]) for x in got), key=str) == sorted([(1, 32, 30, ["3"]), (2, 9, 0, []), (3, 20, 20, ["39", "7"]), (3, 0, 0, [])], key=str)


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / (1 << 20)


def test_many_words(spark, docs_of):
    """More than 256 and 65,536 different words, each alone an item of one word."""
    machine = d.Automaton({b"w%d" % i: {str(i)} for i in range(70_000)})
    assert machine.hits([b"w0", b"no", b"w255", b"w256", b"w65535", b"w65536", b"w69999", b"w70000"]) == [(0, 1, ["0"]), (2, 1, ["255"]), (3, 1, ["256"]), (4, 1, ["65535"]), (5, 1, ["65536"]), (6, 1, ["69999"])]
