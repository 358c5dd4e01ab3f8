import hashlib
import random
import re
from collections import defaultdict

import pytest
from oracle import assert_same

from ledgerline.llm import secret_scan as s

KIND = ["assign", "access", "hex", "bare"]
HEX = "0123456789abcdef"


def spans_of(text):
    """All base spans and all bare runs, one sign at a time."""
    base = []
    for m in re.finditer("""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, m.end(), m[2]))
    base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    bare = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 8]
    return sorted(base), [b for b in bare if not any(a[0] < b[2] and a[2] > b[0] for a in base)]


def brute(rows):
    """(doc_id, base, spans, verdicts) of (doc_id, text, source)."""
    found = [(i, src, *spans_of(t or "")) for i, t, src in rows]
    owners = defaultdict(set)
    for _, src, base, bare in found:
        for *_, v in base + bare:
            owners[v].add(src)
    out = []
    for i, _, base, bare in found:
        says = lambda v: "example" if len(owners[v]) > 1 else "live" if len(set(v)) >= 8 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) else "weak"
        every = sorted(base + [b for b in bare if says(b[3]) == "live"])
        name = lambda x: ",".join(f"{KIND[k]}:{a}:{z}" for a, k, z, _ in x)
        verdicts = [says(v) for *_, v in every]
        out.append((i, *[sum(b[1] == k for b in base) for k in range(3)], hashlib.sha256(name(base).encode()).hexdigest(), verdicts.count("live"), verdicts.count("example"), name(every)))
    return sorted(out, key=str)


def corpus(n, seed):
    r = random.Random(seed)
    pool = ["".join(r.choices(HEX, k=40)) for _ in range(9)] + ["".join(r.choices("ABCDEFGHJKLM0123456789xyz+/", k=r.choice((19, 20, 33)))) for _ in range(12)]
    odd = ["token=a:secret=longvalue1", "paſword = abcdefgh", "toKen: abcdefgh", "API_KEY='k.e-y/v+a_l=1'", "apikey:short", "PassWd\": \"abc123", "token:\n=abcdefg", "secret==abcdef", "AKIA" + "Q" * 15, "AKIA" + "Q7" * 8, "AKIAAKIA" + "Z" * 12,
        "f" * 23, "f" * 24, "é" + "0a" * 12 + "g", "a" * 30, "AbC-" * 8, "password:   ''", "x" * 25 + "1", "token = changeme", "𝄞 token = \"" + pool[0], pool[3], pool[9] + ".", "deadbeef" * 5 + "XYZ123456789"]
    rows = [(i, " ".join(r.choice([*odd, *pool, f"token = \"{r.choice(pool)}\"", "wörter", "Wort.", "\x0b"]) for _ in range(r.randrange(0, 9))), f"src{r.randrange(4)}") for i in range(n)]
    return [*rows, (n, None, "src0"), (n + 1, "", None), (n + 2, f"secret: {pool[1]}", None), (n + 2, f"secret: {pool[1]}", None), (None, f"it is {pool[10]}x1 only here", "src1"), (n + 3, "token = exampleexample1", "src1"), (n + 4, "token = exampleexample1", "src2")]


@pytest.fixture
def docs_with(spark):
    return lambda rows: spark.createDataFrame([(i, t, x, "r", "d") for i, t, x in rows], "doc_id long, text string, source string, digest string, n string").repartition(4)


def told(df):
    return sorted((tuple(r) for r in df.withColumn("spans", s.spelled()).collect()), key=str)


def test_against_brute_force(docs_with):
    rows = corpus(400, 5)
    got = told(s.find_secrets(docs_with(rows)))
    assert got == brute(rows)
    assert any("bare" in r[-1] for r in got) and any(r[-2] for r in got)


def test_equals_sql_on_odd_rows(docs_with):
    import duckdb

    docs = docs_with([r for r in corpus(200, 6) if r[0] is not None])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert_same(s.find_secrets(docs).withColumn("spans", s.spelled()), s.SQL, con)


def test_hot_example_and_long_text(docs_with):
    """A value in most texts is an example of all its owners; one in a very long text is found where it stands."""
    hot, own = "token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"", "zq81mvLx02PfAt64bnWs"
    rows = [(i, hot, f"src{i % 7}") for i in range(2000)] + [(3000, "wort " * 400_000 + own, "src1"), (3001, own + "!", "src1")]
    got = {r["doc_id"]: r for r in s.find_secrets(docs_with(rows)).collect()}
    assert all(got[i]["n_example"] == 1 and got[i]["n_live"] == 0 for i in range(2000))
    span = got[3000]["spans"][0]
    assert (span["start"], span["end"], span["verdict"], span["n"], span["owners"], span["repositories"]) == (2_000_000, 2_000_020, "live", 2, 1, 2)
    assert got[0]["spans"][0]["owners"] == 7 and got[0]["spans"][0]["repositories"] == 2000


def test_owners_are_a_parameter(docs_with):
    rows = [(1, "token = abcdef123456", "a"), (2, "token = abcdef123456", "b")]
    verdicts = lambda k: {v["verdict"] for r in s.find_secrets(docs_with(rows), most_owners=k).collect() for v in r["spans"]}
    assert verdicts(1) == {"example"} and verdicts(2) == {"live"}
