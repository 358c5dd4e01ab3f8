"""URL filters that follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, keep, materialize, scratch, table
from ledgerline.llm.graph import components

#: (verdict, rule): a host, a slash and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is the url's or above it and whose path the url's path starts with; null if none."""

    def fits(rule: str) -> Column:
        own, _, rest = rule.partition("/")
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")

    longest = sorted({r for _, r in rules}, key=lambda r: (-len(r), r))
    return reduce(lambda out, r: out.when(fits(r), F.lit(r)), longest[1:], F.when(fits(longest[0]), F.lit(longest[0]))) if longest else F.lit(None).cast("string")


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """What a rule says; where one text is both, allow. Null for no rule."""
    allow, block = ([r for v, r in rules if v == x] for x in ("allow", "block"))
    return F.when(rule.isin(allow), "allow").when(rule.isin(block), "block")


def name_of(url: Column) -> Column:
    """The form under which a url is known as a node: no fragment, scheme and host in small letters, a path of at least /."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(bare, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)", 1)
    full = F.concat(scheme, F.lit("://"), host_of(bare), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.when(bare.contains("://"), full)


def links_of(html: Column, url: Column) -> Column:
    """The targets that a page names as its canonical form or redirects to, as an array of absolute urls.

    <link rel=canonical href=...> and <meta http-equiv=refresh content="n; url=...">, in either order of attributes,
    with or without quotes; //host, /path and relative targets are read against the page's url.
    """

    def attribute(tag: Column, name: str) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{p}", 1), F.lit("")) for p in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")])

    canonical = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: t.rlike(r"(?is)\srel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")),
        lambda t: attribute(t, "href"),
    )
    refresh = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: t.rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?refresh\b")),
        lambda t: F.regexp_extract(attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1),
    )
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)

    def absolute(target: Column) -> Column:
        t = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
        plain = F.when(folder.endswith("/"), F.concat(folder, t)).otherwise(F.concat(folder, F.lit("/"), t))
        return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.startswith("/"), F.concat(root, t)).otherwise(plain)

    found = F.transform(F.filter(F.concat(canonical, refresh), lambda t: F.length(t) > 0), absolute)
    return F.when(html.rlike(r"(?i)canonical|refresh") & url.contains("://"), found)


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """For each row of pages: key, url, host, path, rule, verdict.

    A url's own rule decides. Without one, its aliases do: all urls that redirects and canonical links join with it, either way
    and over any number of steps, link targets without a page of their own included. An alias with an allow rule makes it allow;
    else one with a block rule makes it block; else it is allow. So a block reaches all aliases, but a rule that allows is
    never overruled. Urls that are null or have no :// have no aliases and are allow. Repeated rows each get the verdict;
    an empty input gives no rows. Rules are part of the plan: a list, not a table.

    Edges are drawn from the pages that name a target only; components are found by Spark rounds; the components' verdicts
    come back by a join on the url, which Spark can split where one url is very frequent.
    """
    address = F.col(url)
    known = pages.select(F.col(key), address.alias("url"), F.col(html).alias("_html"))
    with scratch() as tables:
        said = _verdicts(known, rules)
        keep(tables, said)
    rows = known.select(key, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), name_of(F.col("url")).alias("_name"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = verdict_of(F.col("rule"), rules)
    asks = own.isNull() & F.col("_name").isNotNull()  # only these need their aliases: no others go through the join, so null urls meet nowhere
    told = rows.where(asks).join(said, "_name", "left").select(key, "url", "host", "path", "rule", F.coalesce("_alias", F.lit("allow")).alias("verdict"))
    return told.unionByName(rows.where(~asks).select(key, "url", "host", "path", "rule", F.coalesce(own, F.lit("allow")).alias("verdict")))


def _verdicts(known: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(_name, _alias): what the aliases of each url that has some say; null for nothing. known: (url, _html)."""
    edges = known.select(name_of(F.col("url")).alias("a"), F.explode(links_of(F.col("_html"), F.col("url"))).alias("t")).select("a", name_of(F.col("t")).alias("b"))
    edges = materialize(edges.where("a is not null and b is not null and a != b").distinct(), "edges")
    rule = lambda x: rule_of(host_of(x), path_of(x), rules)
    comp = materialize(components(edges).withColumn("_says", verdict_of(rule(F.col("node")), rules)), "aliases")
    said = comp.groupBy("component").agg(F.bool_or(F.col("_says") == "allow").alias("_allow"), F.bool_or(F.col("_says") == "block").alias("_block"))
    return materialize(comp.join(materialize(said, "said"), "component").select(F.col("node").alias("_name"), F.when(F.coalesce("_allow", F.lit(False)), "allow").when(F.col("_block"), "block").alias("_alias")), "verdicts")


def op7(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages")).drop("url")


def _attribute(tag: str, name: str) -> str:
    parts = [f"nullif(regexp_extract({tag}, '(?is)\\s{name}\\s*=\\s*{p}', 1), '')" for p in ('"([^"]*)"', "''([^'']*)''", "([^\\s\"''>]+)")]
    return f"coalesce({', '.join(parts)})"


def _known(column: str) -> str:
    """name_of() in SQL."""
    rest = f"regexp_extract(regexp_extract({column}, '(?s)^([^#]*)', 1), '(?s)^.*?://[^/?#]*(.*)', 1)"
    return f"""CASE WHEN contains(regexp_extract({column}, '(?s)^([^#]*)', 1), '://') THEN lower(regexp_extract(regexp_extract({column}, '(?s)^([^#]*)', 1), '(?s)^(.*?)://', 1)) || '://' || {_host(f"regexp_extract({column}, '(?s)^([^#]*)', 1)")} || CASE WHEN {rest} LIKE '/%' THEN {rest} ELSE '/' || {rest} END END"""


def _host(column: str) -> str:
    return f"translate(coalesce(regexp_extract({column}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule(host: str, path: str) -> str:
    cases = " ".join(f"WHEN ({host} = '{r.partition('/')[0]}' OR {host} LIKE '%.{r.partition('/')[0]}') AND starts_with({path}, '/{r.partition('/')[2]}') THEN '{r}'" for r in sorted({r for _, r in RULES}, key=lambda r: (-len(r), r)))
    return f"CASE {cases} END"


_SAYS = "CASE {0} " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES) + " END"
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {_host('url')} AS host, {_PATH.format('url')} AS path, {_known('url')} AS name FROM pages),
tags AS (SELECT name, url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\srel\s*=\s*["'']?[^"''>]*\bcanonical\b')), lambda t: {_attribute('t', 'href')}),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\shttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract({_attribute('t', 'content')}, '(?is)url\s*=\s*[''"]?([^''"]+)', 1)))) AS raw FROM p WHERE name IS NOT NULL),
found AS (SELECT name, url, trim(replace(raw, '&amp;', '&'), ' ') AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder FROM tags WHERE length(raw) > 0),
aimed AS (SELECT name AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN t LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t WHEN t LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t WHEN folder LIKE '%/' THEN folder || t ELSE folder || '/' || t END AS target FROM found),
edges AS (SELECT a, {_known('target')} AS b FROM aimed), ways AS (SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT b, a FROM edges WHERE b IS NOT NULL),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
said AS (SELECT a, bool_or(says = 'allow') AS ok, bool_or(says = 'block') AS no FROM (SELECT a, {_SAYS.format('(' + _rule(_host('b'), _PATH.format('b')) + ')')} AS says FROM reach) GROUP BY 1),
r AS (SELECT *, {_rule('host', 'path')} AS rule FROM p)
SELECT page_id, host, path, rule, coalesce({_SAYS.format('rule')}, CASE WHEN ok THEN 'allow' WHEN no THEN 'block' END, 'allow') AS verdict FROM r LEFT JOIN said ON r.name = said.a
"""
