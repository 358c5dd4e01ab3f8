"""Redaction, trimming and detection in texts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ledger's contract: patterns in their order with what replaces them, and keys whose values are secret.
REDACTIONS = (
    (r"\b(glp[a-z]{1,2}-[A-Za-z0-9_-]{10,})\b", "[GITLAB_TOKEN]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9_.\-=]+", "[REDACTED]"),
    (r"(?i)postgres(ql)?://[^\s)]+", "[REDACTED]"),
    (r"(?i)(Authorization[:\s]+)(\S+\s+)?(\S+)", "$1[REDACTED]"),
    (r"(?i)(PRIVATE-TOKEN[:\s]+)[^\s,;]+", "$1[REDACTED]"),
    (r"(?i)(password[=:\s]+)[^\s&;,]+", "$1[REDACTED]"),
    (r"(?i)(token[=:\s]+)[^\s&;,]+", "$1[REDACTED]"),
    (r"(://[^:]+:)[^@]+(@)", "$1[REDACTED]$2"),
)
SECRET_KEYS = ("authorization", "proxy-authorization", "private-token", "x-private-token", "x-gitlab-token", "cookie", "set-cookie", "token", "access_token", "refresh_token", "password", "api_key", "apikey", "client_secret", "secret")
TRIM_MARK, TRIM_ROOM = "... [内容已截断]", 20
POINTER = "[{kind} 内容已移除，仅保留指针]\n- uri: {uri}\n- sha256: {sha256}"
LOCAL_URI = "memory://local/content"
DIFF_PATTERN = r"^[-+]{3}\s|^@@\s|^diff\s--git|^Index:\s"
LOG_PATTERN = r"^\[\d{4}-\d{2}-\d{2}|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}|^[A-Z]+:\s|^\[INFO\]|^\[DEBUG\]|^\[ERROR\]|^\[WARN\]"
CARD_HEADER = ("Kind", "Owner", "Module", "Visibility", "TTL", "Confidence")
CARD_SUMMARY, CARD_DETAIL, CARD_DETAILS, CARD_EVIDENCE, CARD_TOTAL, CARD_ROOM = 200, 500, 10, 10, 4000, 50
CARD_MARK = "\n\n[... 内容已截断 ...]"
CARD_REFS = ("event_id", "svn_rev", "git_commit", "mr")
#: Lines end at \n alone, and blanks and digits are those of Unicode.
_LINES = "(?dmU)"


def redact(text: Column) -> Column:
    """text without what looks like a secret; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def redact_map(values: Column) -> Column:
    """A map of strings with the values of secret keys hidden, and the others redacted."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), F.lit("[REDACTED]")).when(v.isNotNull(), redact(v)))


def redact_json(raw: Column) -> Column:
    """A JSON text of any depth with the texts under secret keys hidden, and each other text redacted by itself."""
    keys = "|".join(SECRET_KEYS)
    hidden = F.regexp_replace(raw, rf'(?i)("(?:{keys})"\s*:\s*)"(?:[^"\\]|\\.)*+"', '$1"[REDACTED]"')
    parts = F.regexp_extract_all(hidden, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]+'), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), F.concat(F.lit('"'), redact(F.substr(p, F.lit(2), F.length(p) - 2)), F.lit('"'))).otherwise(p)), "")


def trim(text: Column, longest: int) -> Column:
    """(content, was_trimmed, original_length): texts over `longest` end 20 characters before it, with a mark."""
    n = F.length(text)
    return F.struct(F.when(n > longest, F.concat(F.substring(text, 1, longest - TRIM_ROOM), F.lit(TRIM_MARK))).otherwise(text).alias("content"), (n > longest).alias("was_trimmed"), n.alias("original_length"))


def is_diff(text: Column) -> Column:
    return text.rlike(_LINES + DIFF_PATTERN)


def is_log(text: Column) -> Column:
    return text.rlike(_LINES + LOG_PATTERN)


def pointerized(text: Column, uri: Column | None = None, sha256: Column | None = None) -> Column:
    """A diff or log as a pointer to its content; other texts stay."""
    kind = F.when(is_diff(text), "diff").when(is_log(text), "log")
    where = F.coalesce(F.nullif(uri, F.lit("")), F.lit(LOCAL_URI)) if uri is not None else F.lit(LOCAL_URI)
    digest = F.coalesce(sha256, F.sha2(text, 256)) if sha256 is not None else F.sha2(text, 256)
    return bound(kind, lambda k: F.when(k.isNotNull(), filled(POINTER, kind=k, uri=where, sha256=digest)).otherwise(text))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used: inside a lambda Spark shares nothing."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by the column of that name."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def card_markdown(kind: Column, owner: Column, module: Column, summary: Column, details: Column, evidence: Column, confidence: Column, visibility: Column, ttl: Column) -> Column:
    """A memory card as Markdown: the header, a trimmed summary, numbered details and the evidence; at most ten of each, 4,000 characters in all.

    details is an array of texts, of which diffs and logs become pointers; evidence an array of structs with uri, sha256 and any of
    event_id, svn_rev, git_commit, mr as text, of which empty ones are left out.
    """
    header = [F.concat(F.lit(f"[{name}] "), c) for name, c in zip(CARD_HEADER, (F.upper(kind), owner, module, F.lower(visibility), F.lower(ttl), F.lower(confidence)), strict=True)]
    shown = F.transform(F.slice(details, 1, CARD_DETAILS), lambda t: pointerized(t))
    numbered = F.transform(shown, lambda t, i: F.concat((i + 1).cast("string"), F.lit(") "), trim(t, CARD_DETAIL)["content"]))

    def lines(e: Column) -> Column:
        refs = [F.when(F.coalesce(e[r], F.lit("")) != "", F.concat(F.lit(f"  {r}="), e[r])) for r in CARD_REFS]
        return F.concat_ws("\n", F.concat(F.lit("- uri="), e["uri"]), F.concat(F.lit("  sha256="), e["sha256"]), *refs)

    empty = F.lit("")
    out = F.concat_ws("\n", *header, empty, F.lit("[Summary]"), trim(summary, CARD_SUMMARY)["content"], empty, F.lit("[Details]"), numbered, empty, F.lit("[Evidence]"), F.transform(F.slice(evidence, 1, CARD_EVIDENCE), lines))
    return bound(out, lambda text: F.when(F.length(text) > CARD_TOTAL, F.concat(F.substring(text, 1, CARD_TOTAL - CARD_ROOM), F.lit(CARD_MARK))).otherwise(text))


def card_faults(owner: Column, module: Column, summary: Column, details: Column, evidence: Column) -> Column:
    """What a card lacks, as an array: names of empty fields, and evidence that is no memory, svn, git or https uri with a SHA-256."""
    blank = lambda name, c: F.when(F.coalesce(c, F.lit("")) == "", name)
    none = lambda name, c: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, name)
    wrong = lambda e: ~F.coalesce(e["uri"].rlike("^(memory|svn|git|https)://") & e["sha256"].rlike("^[a-fA-F0-9]{64}$"), F.lit(False))
    return F.array_compact(F.array(blank("owner", owner), blank("module", module), blank("summary", summary), none("details", details), none("evidence", evidence), F.when(F.exists(evidence, wrong), "evidence_form")))


def card_payload_sha(markdown: Column) -> Column:
    return F.sha2(markdown, 256)


def _count(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


#: Fixed values of the ledger's contract: the short texts that stand for a diff.
CHANGES = "{ins} insertion(s)(+), {dels} deletion(s)(-)"
FILES_CHANGED = "{files} file(s) changed"


def diffstat_of_api(diffs: Column) -> Column:
    """The files of an API's diffs (array of structs old_path, new_path, new_file), a line each, and how many different ones; empty for none."""
    path = lambda d: F.coalesce(F.nullif(d["new_path"], F.lit("")), F.nullif(d["old_path"], F.lit("")), F.lit("unknown"))
    lines = F.transform(diffs, lambda d: F.concat(path(d), F.when(F.coalesce(d["new_file"], F.lit(False)), " (new)").otherwise("")))
    total = filled(FILES_CHANGED, files=F.size(F.array_distinct(F.transform(diffs, path))))
    return F.when(F.coalesce(F.size(diffs), F.lit(0)) > 0, F.concat_ws("\n", lines, total)).otherwise("")


def diffstat_of_index(diff: Column) -> Column:
    """The files of a diff with Index: lines, in order, with their added and removed lines, and the sums; empty without such a line."""
    one = lambda lines: F.struct(F.trim(F.element_at(lines, 1)).alias("name"), F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~x.rlike(r"^(\+\+\+ |--- |@@|===)")).alias("lines"))
    parts = F.split(F.concat(F.lit("\n"), diff), r"(?:\r\n|\n|\r)Index: ")
    files = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda t: one(_lines(t)))
    counted = F.transform(files, lambda f: F.struct(f["name"].alias("name"), _count(f["lines"], lambda x: x.startswith("+")).alias("ins"), _count(f["lines"], lambda x: x.startswith("-")).alias("dels")))
    add = lambda xs, c: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x[c])

    def told(xs: Column) -> Column:
        names = F.array_distinct(F.transform(xs, lambda x: x["name"]))
        own = lambda n: F.filter(xs, lambda x: x["name"] == n)
        lines = F.transform(names, lambda n: filled("{name} | " + CHANGES, name=n, ins=add(own(n), "ins"), dels=add(own(n), "dels")))
        return F.concat_ws("\n", lines, filled(FILES_CHANGED + ", " + CHANGES, files=F.size(names), ins=add(xs, "ins"), dels=add(xs, "dels")))

    return F.coalesce(F.get(F.transform(F.filter(F.array(counted), lambda xs: F.size(xs) > 0), told), F.lit(0)), F.lit(""))


def diffstat_of_patch(diff: Column) -> Column:
    """The files that a patch's +++ and --- lines name (one at least), and its added and removed lines."""
    lines = _lines(F.coalesce(diff, F.lit("")))
    named = F.transform(F.filter(lines, lambda x: x.startswith("+++ ") | x.startswith("--- ")), lambda x: F.regexp_extract(x, r"^\S+\s+(\S+)", 1))
    files = F.greatest(F.size(F.array_distinct(F.filter(named, lambda x: x != ""))), F.lit(1))
    return filled(FILES_CHANGED + ", " + CHANGES, files=files, ins=_count(lines, lambda x: x.startswith("+") & ~x.startswith("+++")), dels=_count(lines, lambda x: x.startswith("-") & ~x.startswith("---")))


def ministat_of_counts(stats: Column, name: Column, width: int = 8) -> Column:
    """A line for a commit that is known by its counts (map total, additions, deletions); width is 8 for a commit, 7 for what follows the first colon of a source id."""
    get = lambda k: F.coalesce(F.try_element_at(stats, F.lit(k)), F.lit(0))
    short = F.substring(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")), 1, width)
    return filled("ministat [{short}] degraded: " + FILES_CHANGED + ", " + CHANGES, short=short, files=get("total"), ins=get("additions"), dels=get("deletions"))


def ministat_of_source(stats: Column, source_id: Column) -> Column:
    return ministat_of_counts(stats, F.regexp_replace(source_id, "^[^:]*:", ""), 7)


def ministat_of_paths(paths: Column, revision: Column | None = None, listed: bool = True) -> Column:
    """A revision by its changed paths (array of structs action, path, kind): counts and, if listed, replaced ones and the first five paths; empty for none."""
    n = lambda a: _count(paths, lambda p: p["action"] == a)
    known = revision.isNotNull() & (revision.cast("string") != "") if revision is not None else F.lit(False)
    number = revision.cast("string") if revision is not None else F.lit("")
    head = F.concat(F.lit("ministat"), F.when(known, F.concat(F.lit(" for r"), number)).otherwise(""), F.lit(" (degraded)")) if listed else F.concat(F.lit("ministat (degraded)"), F.when(known, F.concat(F.lit(" r"), number)).otherwise(""))
    counts = filled("{n} path(s) changed, {m} modified, {a} added, {d} deleted" + (", {r} replaced" if listed else ""), n=F.size(paths), m=n("M"), a=n("A"), d=n("D"), r=n("R"))
    short = lambda t: F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 40), F.lit("..."), F.right(t, F.lit(20)))).otherwise(t)
    lines = F.transform(F.slice(paths, 1, 5), lambda p: F.concat(F.lit("- "), short(F.coalesce(p["path"], F.lit(""))), F.when(p["kind"] == "dir", " (dir)").otherwise(""))) if listed else F.array().cast("array<string>")
    return F.when(F.coalesce(F.size(paths), F.lit(0)) > 0, F.concat_ws("\n", head, counts, lines)).otherwise("")
