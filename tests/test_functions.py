"""Scalar functions: boundary values, nulls and ties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import errors, identifiers, payloads, text, timing, uris
from ledgerline.operators.joins import normalized_key


def value(spark, *args, f, schema=None):
    names = [f"c{i}" for i in range(len(args))]
    kinds = schema or ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([args], kinds).select(f(*map(F.col, names)).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("https://GitLab.example.com:443/group/x", "gitlab.example.com"), ("http://h:80", "h"), ("http://h:8080/p", "h:8080"), ("user:pw@h.example/p", "h.example"), ("  ", None), (None, None)],
)
def test_instance_key(spark, raw, want):
    assert value(spark, raw, f=identifiers.instance_key) == want


@pytest.mark.parametrize(
    ("raw", "valid", "number"),
    [("git:7:0123abc", True, "0123abc"), ("git:7:xyz", False, "xyz"), ("svn:1:42", True, "42"), ("mr:1:!42", False, "!42"), ("svn:x:1", False, "1"), (None, False, None)],
)
def test_source_id(spark, raw, valid, number):
    got = value(spark, raw, f=identifiers.parse_source_id)
    assert (got["valid"], got["number"]) == (valid, number)


@pytest.mark.parametrize(
    ("payload", "project", "want"),
    [('{"tenant_id": "t"}', "g/p", "t"), ('{"tenant_id": " "}', "g/p", "g"), ("{}", "single", None), (None, "a/b/c", "a"), ("{}", None, None)],
)
def test_tenant(spark, payload, project, want):
    assert value(spark, payload, project, f=identifiers.tenant_id) == want


def test_job_types(spark):
    assert tuple(value(spark, "git", "mrs", f=identifiers.physical_job_type)) == ("gitlab_mrs", None)
    assert tuple(value(spark, "svn", "mrs", f=identifiers.physical_job_type)) == (None, "unsupported_for_repo_type")
    assert tuple(value(spark, "hg", "mrs", f=identifiers.physical_job_type)) == (None, "unknown_repo_type")
    assert tuple(value(spark, "git", "x", f=identifiers.physical_job_type)) == (None, "unknown_job_type")
    assert value(spark, "gitlab_mrs", f=identifiers.logical_job_type) == "mrs"


def test_breaker_keys(spark):
    assert tuple(value(spark, "p:tenant:a:b", f=identifiers.parse_breaker_key)) == ("p", "tenant", "a:b")
    assert tuple(value(spark, "p", f=identifiers.parse_breaker_key)) == ("p", "global", None)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a//b/./c", "a/b/c"), ("a/b/../c", "a/c"), ("../a", "../a"), ("a/../../b", "../b"), (r"a\b", "a/b"), (".", ""), ("artifact://x/y/", "x/y"), ("", "")],
)
def test_normalized_key(spark, raw, want):
    assert value(spark, raw, f=normalized_key) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("memory://x", "evidence_uri"), ("s3://b/k", "physical_uri"), ("artifact://k", "artifact_key"), ("a/b", "artifact_key"), ("", None), (None, None)],
)
def test_uri_class(spark, raw, want):
    assert value(spark, raw, f=uris.uri_class) == want


def test_evidence(spark):
    sha = "a" * 64
    got = value(spark, f"memory://patch_blobs/git/git:1:x/y/{sha}", f=uris.parse_evidence)
    assert (got["kind"], got["id"], got["sha256"], got["valid"]) == ("patch_blobs", "git:1:x/y", sha, True)
    assert value(spark, f"memory://attachments/5/{sha}", f=uris.parse_evidence)["kind"] == "attachments"
    assert not value(spark, "memory://attachments/x/1", f=uris.parse_evidence)["valid"]
    assert value(spark, "scm/3/svn/r17.diff", f=uris.scm_path)["number"] == "17"


def test_reference_errors(spark):
    df = spark.createDataFrame([([("memory://x", "a" * 64, "git:1:a"), (None, "zz", "nocolon"), ("http://x", "", "")],)], "r array<struct<artifact_uri:string,sha256:string,source_id:string>>")
    got = df.select(uris.reference_errors(F.col("r")).alias("e")).first()["e"]
    assert got == ["[1] artifact_uri missing", "[1] sha256 malformed", "[1] source_id malformed", "[2] artifact_uri is not memory://", "[2] sha256 missing", "[2] source_id missing"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("x glpat-abcdefghij1 y", "x [GITLAB_TOKEN] y"),
        ("postgresql://u:p@h/db ok", "[REDACTED] ok"),
        ("Authorization: Basic abc", "Authorization: [REDACTED]"),
        ("password=abc&x", "password=[REDACTED]&x"),
        ("https://u:pw@h/x", "https://u:[REDACTED]@h/x"),
        ("nothing", "nothing"),
        (None, ""),
    ],
)
def test_redaction(spark, raw, want):
    assert value(spark, raw, f=text.redact) == want


def test_redacted_map(spark):
    got = spark.createDataFrame([({"Token": "x", "note": "password=1", "n": None},)], "m map<string,string>").select(text.redact_map(F.col("m")).alias("m")).first()["m"]
    assert got == {"Token": "[REDACTED]", "note": "password=[REDACTED]", "n": None}


@pytest.mark.parametrize("n", [99, 100, 101])
def test_trim(spark, n):
    got = value(spark, "x" * n, f=lambda c: text.trim(c, 100))
    assert got["was_trimmed"] == (n > 100) and got["original_length"] == n
    assert got["content"] == ("x" * n if n <= 100 else "x" * 80 + text.TRIM_MARK)


def test_diff_and_log(spark):
    diff = "intro\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n+c"
    log = "2024-01-01T10:00:00 something ERROR bad"
    assert value(spark, diff, f=text.is_diff) and not value(spark, diff, f=text.is_log)
    assert value(spark, log, f=text.is_log) and value(spark, log, f=text.pointerized).startswith("[log ")
    assert value(spark, "plain", f=text.pointerized) == "plain"
    assert value(spark, diff, f=text.diffstat_of_patch) == "2 file(s) changed, 2 insertion(s)(+), 1 deletion(s)(-)" and value(spark, diff, f=text.diffstat_of_index) == ""


@pytest.mark.parametrize(("line", "diff", "log"), [("+++ b.txt", True, False), ("@@ x", True, False), ("Index: a", True, False), ("ERROR: x", False, True), ("[2024-01-01] x", False, True), ("2024-01-01T10:00", False, True), ("+++b", False, False), ("at [INFO] x", False, False)])
def test_what_is_a_diff_or_log(spark, line, diff, log):
    assert (value(spark, f"first\n{line}", f=text.is_diff), value(spark, f"first\n{line}", f=text.is_log)) == (diff, log)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP 429", (False, True, "rate_limit")), ("auth_invalid: x", (True, False, "auth_invalid")), ("token expired", (True, False, "auth_error")), ("forbidden", (True, False, "permission_denied")),
        ("it does not exist", (True, False, "repo_not_found")), ("please retry", (False, True, "default")), ("503", (False, True, "server_error")), ("odd", (False, False, "")), ("", (False, False, "")), (None, (False, False, "")),
    ],
)
def test_last_error(spark, raw, want):
    assert tuple(value(spark, raw, f=errors.classify_last_error)) == want


def test_exceptions_and_backoff(spark):
    assert value(spark, "ReadTimeout", "401", f=errors.classify_exception) == "timeout"
    assert value(spark, "ValueError", "not found", f=errors.classify_exception) == "repo_not_found"
    assert value(spark, "ValueError", None, f=errors.classify_exception) == "exception"
    assert [value(spark, "rate_limit", f=lambda c, n=n: errors.backoff_seconds(c, F.lit(n))) for n in (1, 2, 5, 6)] == [120, 240, 1920, 3600]
    assert tuple(value(spark, 7, "timeout", "", f=errors.resolved_backoff, schema="c0 int, c1 string, c2 string")) == (7, "retry_after")
    assert tuple(value(spark, None, "timeout", "", f=errors.resolved_backoff, schema="c0 int, c1 string, c2 string")) == (30, "error_category")
    assert tuple(value(spark, 0, None, "odd", f=errors.resolved_backoff, schema="c0 int, c1 string, c2 string")) == (60, "default")


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2024-01-01T10:00:00Z", "2024-01-01T10:00:00Z"), ("2024-01-01T10:00:00+02:00", "2024-01-01T08:00:00Z"), ("2024-01-01T10:00:00.5Z", "2024-01-01T10:00:00Z"), ("nope", None), (None, None)],
)
def test_iso(spark, raw, want):
    assert value(spark, raw, f=lambda c: timing.to_iso(timing.parse_iso(c))) == want


def test_cursor_age(spark):
    now = dt.datetime(2024, 1, 1, 0, 1)
    f = lambda a, b: timing.cursor_age(a, b)
    assert value(spark, now, dt.datetime(2024, 1, 1), f=f, schema="c0 timestamp, c1 timestamp") == 60.0
    assert value(spark, now, None, f=f, schema="c0 timestamp, c1 timestamp") == float("inf")
    assert value(spark, now, dt.datetime(2025, 1, 1), f=f, schema="c0 timestamp, c1 timestamp") == 0.0


def test_payloads(spark):
    assert value(spark, '{"last_rev": 5}', f=payloads.upgraded_cursor) == '{"version":2,"watermark":{"last_rev":"5"},"stats":{}}'
    assert value(spark, '{"synced_count": "3", "diff_count": -1, "bulk_count": "x"}', f=payloads.count_errors) == ["diff_count", "bulk_count"]
    assert value(spark, '{"mode": "backfill", "window_type": "rev", "start_rev": 9, "end_rev": 2, "batch_size": 0}', f=payloads.payload_errors) == ["batch_size below 1", "rev window reversed"]
    assert value(spark, '{"mode": "x"}', f=payloads.payload_errors) == ["mode unknown"]
    run = lambda *a: value(spark, *a, f=payloads.run_status, schema="c0 string, c1 string, c2 int, c3 boolean")
    assert [run("running", None, 1, True), run(None, "boom", 1, True), run(None, None, 0, True), run(None, None, 3, True)] == ["failed", "failed", "no_data", "completed"]
