import pytest
from pyspark.sql import functions as F

from ledgerline.llm import url_filter as u

PAGES = "page_id long, url string, html string"


def judged(spark, rows, **more):
    return {r["page_id"]: r for r in u.judge_urls(spark.createDataFrame(rows, PAGES), **more).collect()}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/"), ("http://net/", "net", "/", "net/"), ("http://net", "net", "", None), ("http://xnet/", "xnet", "/", None), ("https://a.com/de/", "a.com", "/de/", None),
        ("x://example.com/de/1#f", "example.com", "/de/1", "example.com/de/"), ("http://h.org/fr/?a", "h.org", "/fr/", "org/fr/"), ("no scheme", "", "", None), (None, "", "", None), ("http://u.net?x=/", "u.net", "", None), ("a://b.net/://c.org/fr/", "b.net", "/://c.org/fr/", "net/"),
    ],
)
def test_rules(spark, url, host, path, rule):
    got = judged(spark, [(1, url, None)])[1]
    assert (got["host"], got["path"], got["rule"]) == (host, path, rule)
    assert got["verdict"] == ("block" if rule in ("net/", "example.com/de/") else "allow")


def test_aliases(spark):
    canonical = lambda t: f'<html><LINK href="{t}" rel=canonical></html>'
    rows = [
        (1, "http://a.com/1", canonical("http://bad.net/x")),  # a blocked target without a page of its own
        (2, "http://a.com/2", canonical("/1")), (3, "http://a.com/3", "<meta http-equiv='refresh' content=\"0; url=2\">"), (4, "http://a.com/4", canonical("http://a.com/5")),
        (6, "http://h.org/fr/6", canonical("http://bad.net/x2")), (7, "http://a.com/7", canonical("//bad.net/x2")),  # an allowed alias outweighs the blocked one
        (8, "http://h.org/fr/8", canonical("http://bad.net/x")),  # its own rule allows, and with it all of the group
        (9, None, canonical("http://bad.net/x")), (10, "http://a.com/1#part", None), (11, "http://a.com/1", None),
    ]
    first = judged(spark, [r for r in rows if r[0] != 8])
    assert {k: r["verdict"] for k, r in first.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 6: "allow", 7: "allow", 9: "allow", 10: "block", 11: "block"}
    assert {judged(spark, rows)[k]["verdict"] for k in (1, 2, 3, 8, 10)} == {"allow"}


def test_hub(spark):
    rows = [(i, f"http://a.com/{i}", '<link rel="canonical" href="http://a.com/hub">') for i in range(300)] + [(999, "http://a.com/hub", '<link rel="canonical" href="http://x.net/">')]
    assert {r["verdict"] for r in judged(spark, rows).values()} == {"block"}
    extra = spark.createDataFrame(rows[:2], PAGES).withColumn("component", F.lit(1)).withColumn("verdict", F.lit("mine"))
    assert u.judge_urls(extra).count() == 2


def test_links_against_sql(spark, tmp_path):
    """The query and its SQL over pages that name canonical forms and redirects: chains, stars, rings, hubs, targets without a page, odd urls, and no url."""
    import random

    from oracle import assert_same, connect

    r = random.Random(7)
    hosts = ["a.example.net", "example.net", "example.com", "b.org", "c.org", "x.test", "y.test", "EXAMPLE.net"]
    paths = ["/en/a", "/de/a", "/fr/a", "/", "", "/q?x=1", "/#f"]
    url = lambda i: f"{r.choice(['http', 'https'])}://{hosts[i % len(hosts)]}{r.choice(paths)}{'/' + str(i) if i % 3 else ''}"
    urls = [url(i) for i in range(160)]
    rows = []
    for i, address in enumerate(urls):
        to = r.choice(urls) if i % 4 else f"//z{i}.net/x"
        html = {0: f'<link rel="canonical" href="{to}">', 1: f"<LINK href='{to}' rel=canonical>", 2: f'<meta http-equiv="refresh" content="0; url={to}">', 3: "<p>plain</p>", 4: f'<link rel="alternate" href="{to}"><a href="{to}">canonical</a>', 5: None}[r.randrange(6)]
        rows.append((i, address, html))
    rows += [(500 + i, f"http://x.test/copy{i}", '<link rel="canonical" href="http://example.com/de/hub">') for i in range(40)]
    rows += [(600, None, "<link rel=canonical href=http://b.net/>"), (601, "no scheme", "<link rel=canonical href=/x>"), (602, "http://x.test", None), (603, urls[0], None), (603, urls[0], None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1).write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    got = u.op7(spark, str(tmp_path))
    assert_same(got, u.SQL, connect(str(tmp_path)))
    verdicts = [x["verdict"] for x in got.where("rule is null").collect()]
    assert verdicts.count("block") > 20 and verdicts.count("allow") > 20
