"""Secrets in texts, and how widely each is owned in the whole corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import keep, materialize, scratch, table
from ledgerline.llm.exact_dedup import split_heavy

#: The base patterns. ASCII only, so that no other letter counts as one in either case. A run of capitals or of hexadecimal digits is one
#: match or none, so its least length stands in the pattern.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST = 6
KINDS = ("assign", "access", "hex", "bare")
#: A run of these signs that may be a credential without any name before it: so long, with a letter and a digit, and so many different signs.
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIFFERENT = 8
#: A value with more owners than this is an example that was copied; with fewer, it is its owner's.
OWNERS = 1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind as its place in KINDS, end, value) of the base spans, in order."""
    found = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def looks_live(value: str) -> bool:
    """Whether a value has a letter, a digit and many different signs: words, placeholders and rows of one sign have not."""
    return len(set(value)) >= DIFFERENT and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def bare_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs that look like credentials and touch no base span."""
    out, i, reach = [], 0, 0
    for m in BARE.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach, i = max(reach, base[i][2]), i + 1
        if reach <= m.start() and looks_live(m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key, owner, repository, text) to the base of each text and its candidates (kind, start, end, digest of the value, live)."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary()), ("live", pa.bool_())]))
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            counts, sha, spans = ([], [], []), [], []
            for value in batch.column(4):
                text = value.as_py() or ""
                base = base_spans(text)
                for k, n in enumerate(counts):
                    n.append(sum(1 for s in base if s[1] == k))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append([{"kind": k, "start": a, "end": z, "digest": hashlib.sha256(v.encode()).digest(), "live": looks_live(v)} for a, k, z, v in (*base, *bare_spans(text, base))])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], *[pa.array(n, pa.int64()) for n in counts], pa.array(sha), pa.array(spans, span)], names=["_row", "_key", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


FOUND = "array<struct<kind: int, start: long, end: long, digest: binary, live: boolean>>"
#: Digests of so large a part of all spans are told apart where they are read; there are no more of them than this.
HEAVY = 1024


def ownership(spans: DataFrame) -> DataFrame:
    """(digest, n, owners, repositories) of spans (digest, owner, repository): how often, and with how many different owners and repositories.

    A repository belongs to an owner, so equal names below two owners are two. Spans are summed for each digest and repository first, then for each owner,
    so a digest in a third of all texts is many rows of many tasks until the last sum, to which each task adds one row.
    """
    one = spans.groupBy("digest", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    two = one.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return two.groupBy("digest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", most_owners: int = OWNERS) -> DataFrame:
    """For each row of df: key, n_assign, n_access, n_hex, base_sha256, n_live, n_example, spans.

    Base spans are what ASSIGN, ACCESS and HEX match, whatever becomes of their values. All their values, and bare runs that look like a credential,
    are counted over the whole corpus as digests. A value of more than most_owners owners is an example, which people copy; one of fewer that looks live
    is live, any other weak. A bare run becomes a span of its own if it is live. spans holds (start, kind, end, digest, n, owners, repositories, verdict)
    in order of start, then kind, with code points, end exclusive; n_live and n_example count spans by verdict.

    Null and empty texts have no spans; a null owner or repository counts as one more of them; repeated rows are rows of their own, and count as one
    repository; a null key is as any other. Texts of any length are searched whole. An empty input gives no rows.

    Texts are read once, in one pass of Arrow batches; their candidates are a table, and only rows that have some are shuffled. Digests of many spans
    are at most HEAVY, and meet their spans by a broadcast; all others by a shuffle in which none is large.
    """
    with scratch() as tables:
        source = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.col(text).alias("text"))
        kind = dict(source.dtypes)["_key"]
        rows = materialize(source.mapInArrow(_scan, f"_row long, _key {kind}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}"), "secrets")
        each = materialize(rows.where(F.size("found") > 0).select("_row", "owner", "repository", F.explode("found").alias("s")).select("_row", "owner", "repository", "s.*"), "spans")
        known = materialize(ownership(each), "ownership")
        every = known.agg(F.sum("n")).first()[0] or 0
        heavy = known.where(F.col("n") * HEAVY >= max(every, HEAVY * 2)).withColumn("group_size", F.col("n"))
        keep(tables, rows, each, known)
    often, rest = split_heavy(each, heavy)
    names = ("_row", "start", "kind", "end", "digest", "n", "owners", "repositories", "live")
    met = often.select(*names).unionByName(rest.join(known, "digest").select(*names))
    verdict = F.when(F.col("owners") > most_owners, "example").when(F.col("live"), "live").otherwise("weak")
    met = met.withColumn("verdict", verdict).where((F.col("kind") < KINDS.index("bare")) | (F.col("verdict") == "live"))
    met = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "digest", "n", "owners", "repositories", "verdict"))).alias("spans"))
    with_spans = rows.where(F.size("found") > 0).join(met, "_row", "left")
    without = rows.where(F.size("found") == 0).withColumn("spans", F.lit(None).cast(met.schema["spans"].dataType))
    of = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long").alias(f"n_{v}")
    out = with_spans.unionByName(without).withColumn("spans", F.coalesce("spans", F.array().cast(met.schema["spans"].dataType)))
    return out.select(F.col("_key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256", of("live"), of("example"), "spans")


def spelled(spans: str = "spans"):
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12(spark, sf_dir):
    """A document is a repository, and its source the owner."""
    return find_secrets(table(spark, sf_dir, "documents")).withColumn("spans", spelled())


_PATTERNS = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "bare": "[A-Za-z0-9+/_=-]+",
}


def _matches(i: int, kind: str, value: str, ok: str) -> str:
    """SQL of all matches of a kind with their places, by the pieces between them."""
    p = _PATTERNS[kind]
    return f"""
{kind}_m AS (SELECT r, unnest(range(1, len(m) + 1)) AS i, m, regexp_split_to_array(t, '{p}') AS g FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS m FROM d) WHERE len(m) > 0),
{kind} AS (SELECT r, {i} AS kind, s, s + length(x) AS e, {value} AS v FROM (SELECT r, m[i] AS x, (list_sum(list_transform(g[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[:i - 1], lambda y: length(y))), 0))::bigint AS s FROM {kind}_m) WHERE {ok})"""


SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS owner, coalesce(text, '') AS t FROM documents),"
    + ",".join(
        (
            _matches(0, "assign", r"""regexp_extract(x, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)""", r"""length(regexp_extract(x, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 6"""),
            _matches(1, "access", "x", "length(x) >= 20"),
            _matches(2, "hex", "x", "length(x) >= 24"),
            _matches(3, "bare", "x", "length(x) >= 20"),
        )
    )
    + r""",
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
live AS (SELECT v, regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8 AS ok FROM (SELECT DISTINCT v FROM base UNION SELECT v FROM bare)),
every AS (SELECT * FROM base UNION ALL SELECT b.* FROM bare b JOIN live USING (v) WHERE ok AND NOT EXISTS (SELECT 1 FROM base a WHERE a.r = b.r AND a.s < b.e AND a.e > b.s)),
owned AS (SELECT v, count(DISTINCT owner) AS owners FROM every JOIN d USING (r) GROUP BY 1),
judged AS (SELECT r, kind, s, e, CASE WHEN owners > 1 THEN 'example' WHEN ok THEN 'live' ELSE 'weak' END AS verdict FROM every JOIN owned USING (v) JOIN live USING (v)),
named AS (SELECT *, ['assign', 'access', 'hex', 'bare'][kind + 1] || ':' || s || ':' || e AS name FROM judged WHERE kind < 3 OR verdict = 'live'),
k AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example,
  string_agg(name, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY s, kind) AS spans FROM named GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(n_live, 0)::bigint AS n_live, coalesce(n_example, 0)::bigint AS n_example, coalesce(spans, '') AS spans FROM d LEFT JOIN k USING (r)
"""
)
