"""Artifact, evidence and physical URIs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.operators.joins import normalized_key

# Fixed values of the ledger's contract: kinds of schemes.
REMOTE = ("http", "https", "s3", "gs", "ftp")
LOCAL = ("file", "memory", "artifact")
PHYSICAL = ("file", "s3", "gs", "http", "https", "ftp")


def scheme_of(uri: Column) -> Column:
    """The scheme in small letters, '' for none."""
    return F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def path_of(uri: Column) -> Column:
    """What stands behind the scheme; the uri itself without one."""
    return F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")


def uri_class(uri: Column) -> Column:
    """evidence_uri, physical_uri or artifact_key; null for nothing."""
    s = scheme_of(uri)
    return F.when(F.coalesce(uri, F.lit("")) == "", None).when(s == "memory", "evidence_uri").when(s.isin(*PHYSICAL), "physical_uri").otherwise("artifact_key")


def parse_uri(uri: Column) -> Column:
    s = scheme_of(uri)
    return F.struct(s.alias("scheme"), path_of(uri).alias("path"), s.isin(*REMOTE).alias("is_remote"), (s.isin(*LOCAL) | (s == "")).alias("is_local"), uri_class(uri).alias("uri_class"))


def artifact_key(uri: Column, root: str | None = None) -> Column:
    """The key of an artifact: normalised; of a file:// or s3:// uri below `root` the rest; null where it is no key."""
    kind = uri_class(uri)
    below = F.when(uri.startswith(root.rstrip("/") + "/"), F.substr(uri, F.lit(len(root.rstrip("/")) + 2))) if root else F.lit(None).cast("string")
    return F.nullif(F.when(kind == "artifact_key", normalized_key(uri)).when(kind == "physical_uri", normalized_key(below)), F.lit(""))


def scm_path(uri: Column) -> Column:
    """(repo_id, kind, number, extension, valid) of scm/<repo>/<svn or git>/<number>.<extension>."""
    pattern = r"^scm/([0-9]+)/(svn|git)/(?:r?)([0-9A-Za-z]+)\.([a-z0-9]+)$"
    part = lambda i: F.nullif(F.regexp_extract(normalized_key(uri), pattern, i), F.lit(""))
    return F.struct(part(1).try_cast("long").alias("repo_id"), part(2).alias("kind"), part(3).alias("number"), part(4).alias("extension"), part(1).isNotNull().alias("valid"))


def attachment_evidence(attachment_id: Column, sha256: Column) -> Column:
    return F.concat_ws("/", F.lit("memory://attachments"), attachment_id.cast("string"), sha256)


def parse_evidence(uri: Column) -> Column:
    """(kind, source_type, id, sha256, valid); a source id is all between the type and the last part."""
    patch = r"^memory://patch_blobs/([^/]+)/(.+)/([0-9a-f]{64})$"
    attach = r"^memory://attachments/([0-9]+)/([0-9a-f]{64})$"
    p, a = (lambda i: F.nullif(F.regexp_extract(uri, patch, i), F.lit(""))), (lambda i: F.nullif(F.regexp_extract(uri, attach, i), F.lit("")))
    return F.struct(F.when(p(1).isNotNull(), "patch_blobs").when(a(1).isNotNull(), "attachments").alias("kind"), p(1).alias("source_type"), F.coalesce(p(2), a(1)).alias("id"), F.coalesce(p(3), a(2)).alias("sha256"), (p(1).isNotNull() | a(1).isNotNull()).alias("valid"))


def reference_errors(refs: Column) -> Column:
    """What is wrong with an array of structs (artifact_uri, sha256, source_id), one text a fault, with the place."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""

    def faults(r: Column, i: Column) -> Column:
        say = lambda cond, text: F.when(cond, F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.lit(text)))
        return F.array_compact(
            F.array(
                say(blank(r["artifact_uri"]), "artifact_uri missing"), say(~blank(r["artifact_uri"]) & ~F.coalesce(r["artifact_uri"].startswith("memory://"), F.lit(False)), "artifact_uri is not memory://"),
                say(blank(r["sha256"]), "sha256 missing"), say(~blank(r["sha256"]) & ~F.coalesce(r["sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "sha256 malformed"),
                say(blank(r["source_id"]), "source_id missing"), say(~blank(r["source_id"]) & ~F.coalesce(r["source_id"].contains(":"), F.lit(False)), "source_id malformed"),
            )
        )

    return F.flatten(F.transform(refs, faults))
