"""Sources beyond tables: saved API answers, revision logs, identity files, artifact folders, audit webhooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.functions.timing import parse_iso


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; the columns that are asked for reach the scan."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database, read in `parts` ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and parts > 1:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


#: What saved API answers hold; each is an array of these.
COMMITS = "id string, author_name string, author_email string, committed_date string, message string, parent_ids array<string>, web_url string, stats struct<additions: long, deletions: long, total: long>"
DIFFS = "old_path string, new_path string, new_file boolean, deleted_file boolean, renamed_file boolean, diff string"
MERGE_REQUESTS = "iid long, title string, state string, updated_at string, web_url string, author struct<username: string>"
NOTES = "id string, body string, created_at string, author struct<username: string>, state string, resolvable boolean, resolved boolean"
DISCUSSIONS = "id string, notes array<struct<id: string, body: string, created_at: string, author: struct<username: string>, state: string, resolvable: boolean, resolved: boolean>>"
LOG = "logentry array<struct<_revision: long, author: string, date: string, msg: string, paths: struct<path: array<struct<_VALUE: string, _action: string, _kind: string>>>>>"


def answers(raw: DataFrame, column: str, shape: str) -> DataFrame:
    """A row for each object of the JSON arrays in a column, its fields under _a, beside raw's other columns."""
    array = f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in StructType.fromDDL(shape))}>>"
    return raw.select(*[c for c in raw.columns if c != column], F.explode(F.from_json(column, array)).alias("_a"))


def commits_of(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw (repo_id, an API's answer) as commits."""
    a = lambda c: F.col(f"_a.{c}")
    return answers(raw, column, COMMITS).select("repo_id", a("id").alias("commit_sha"), F.concat_ws(":", F.lit("git"), F.col("repo_id").cast("string"), a("id")).alias("source_id"), F.format_string("%s <%s>", a("author_name"), a("author_email")).alias("author_raw"), parse_iso(a("committed_date")).alias("ts"), a("message").alias("message"), (F.size(a("parent_ids")) > 1).alias("is_merge"), a("stats").alias("stats"), a("web_url").alias("web_url"))


def diffs_of(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw (repo_id, commit_sha, an API's answer) as one row a changed file, and what happened to it."""
    a = lambda c: F.col(f"_a.{c}")
    change = F.when(a("new_file"), "added").when(a("deleted_file"), "deleted").when(a("renamed_file"), "renamed").otherwise("modified")
    return answers(raw, column, DIFFS).select("repo_id", "commit_sha", F.coalesce(F.nullif(a("new_path"), F.lit("")), a("old_path")).alias("path"), change.alias("change"), a("diff").alias("diff"))


def merge_requests_of(raw: DataFrame, column: str = "value") -> DataFrame:
    a = lambda c: F.col(f"_a.{c}")
    return answers(raw, column, MERGE_REQUESTS).select("repo_id", F.concat_ws(":", F.lit("mr"), F.col("repo_id").cast("string"), a("iid").cast("string")).alias("source_id"), a("iid").alias("iid"), a("title").alias("title"), a("state").alias("status"), a("author.username").alias("author"), parse_iso(a("updated_at")).alias("updated_at"), a("web_url").alias("url"))


def _review_row(kind, note) -> list[Column]:
    return [F.concat_ws(":", kind, note["id"]).alias("source_event_id"), kind.alias("event_type"), F.to_json(F.struct(note["body"].alias("body"), note["state"].alias("state"), note["author"]["username"].alias("author"))).alias("payload_json"), parse_iso(note["created_at"]).alias("ts")]


def review_events_of(raw: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """raw (mr_id, an API's answer) as notes, approvals or state events."""
    return answers(raw, column, NOTES).select("mr_id", *_review_row(F.lit(kind), F.col("_a")))


def discussions_of(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw (mr_id, an API's answer) as one row a note of each discussion, with the discussion and whether it is resolved."""
    rows = answers(raw, column, DISCUSSIONS).select("mr_id", F.col("_a.id").alias("discussion_id"), F.explode("_a.notes").alias("_n"))
    return rows.select("mr_id", "discussion_id", *_review_row(F.lit("note"), F.col("_n")), F.coalesce(F.col("_n.resolved"), F.lit(False)).alias("resolved"))


def saved_commits(spark: SparkSession, path: str, repo_id: int) -> DataFrame:
    """Commits of saved API answers (JSON, one array a file)."""
    return commits_of(_texts(spark, path).withColumn("repo_id", F.lit(repo_id).cast("long")))


def saved_merge_requests(spark: SparkSession, path: str, repo_id: int) -> DataFrame:
    return merge_requests_of(_texts(spark, path).withColumn("repo_id", F.lit(repo_id).cast("long")))


def saved_review_events(spark: SparkSession, path: str, mr_id: str, kind: str) -> DataFrame:
    """Notes, approvals or state events of a merge request, of saved answers."""
    return review_events_of(_texts(spark, path).withColumn("mr_id", F.lit(mr_id)), kind)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(value) of whole files; one object that is no array counts as an array of it."""
    t = F.trim("value")
    return spark.read.text(path, wholetext=True).select(F.when(t.startswith("{"), F.concat(F.lit("["), F.regexp_replace(t, r"\}\s*\n\s*\{", "},{"), F.lit("]"))).otherwise(t).alias("value"))


def revisions_of(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw (repo_id, a log in XML) as revisions."""
    rows = raw.select("repo_id", F.explode(F.from_xml(column, LOG, {"rowTag": "log"})["logentry"]).alias("_a"))
    return rows.select("repo_id", F.col("_a._revision").alias("rev_num"), F.concat_ws(":", F.lit("svn"), F.col("repo_id").cast("string"), F.col("_a._revision").cast("string")).alias("source_id"), F.col("_a.author").alias("author_raw"), parse_iso(F.col("_a.date")).alias("ts"), F.col("_a.msg").alias("message"), F.greatest(F.coalesce(F.size("_a.paths.path"), F.lit(0)), F.lit(0)).alias("changed_paths"))


def svn_log(spark: SparkSession, path: str, repo_id: int) -> DataFrame:
    """Revisions of a log file in XML, with Spark's own reader of XML, which cuts a large file between its entries."""
    shape = "_revision long, author string, date string, msg string, paths struct<path: array<struct<_VALUE: string, _action: string, _kind: string>>>"
    raw = spark.read.format("xml").option("rowTag", "logentry").schema(shape).load(path)
    return raw.select(F.lit(repo_id).cast("long").alias("repo_id"), F.col("_revision").alias("rev_num"), F.concat(F.lit(f"svn:{repo_id}:"), F.col("_revision").cast("string")).alias("source_id"), F.col("author").alias("author_raw"), parse_iso(F.col("date")).alias("ts"), F.col("msg").alias("message"), F.greatest(F.coalesce(F.size("paths.path"), F.lit(0)), F.lit(0)).alias("changed_paths"))


def allowed_files(spark: SparkSession, path: str, roots: list[str]) -> DataFrame:
    """files_below() for a file:// folder, which must be one of the allowed roots or below one."""
    plain = path.removeprefix("file://").rstrip("/")
    if ".." in plain.split("/") or not any(plain == r.removeprefix("file://").rstrip("/") or plain.startswith(r.removeprefix("file://").rstrip("/") + "/") for r in roots):
        raise ValueError(f"{path} is below none of the allowed roots")
    return files_below(spark, path)


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified_at) of all files below a folder, without their content; hidden and temporary ones are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    name = F.element_at(F.split("path", "/"), -1)
    return raw.where(~name.startswith(".") & ~name.endswith(".tmp"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def identity_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, values): the flat `key: value` and `key: [a, b]` lines, and `- item` lists, of YAML files or the front matter of Markdown files."""
    return identities_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def identities_of(raw: DataFrame) -> DataFrame:
    """identity_files() of (path, text)."""
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    body = F.when(F.col("path").endswith(".md"), front).otherwise(F.col("text"))
    blocks = F.regexp_extract_all(body, F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_]*:[^\n]*(?:\n[ \t]*-[^\n]*)*)"), 1)
    rows = raw.select("path", F.explode(blocks).alias("b"))
    key, rest = F.regexp_extract("b", r"^([A-Za-z0-9_]+):", 1), F.regexp_replace("b", r"^[A-Za-z0-9_]+:[ \t]*", "")
    items = F.when(rest.startswith("["), F.split(F.regexp_replace(rest, r"[\[\]]", ""), r"\s*,\s*")).when(rest.rlike(r"^\s*-"), F.transform(F.filter(F.split(rest, "\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, r"^\s*-\s*", ""))).otherwise(F.array(rest))
    clean = F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", ""))
    return rows.select("path", key.alias("key"), F.filter(clean, lambda x: x != "").alias("values"))


def merged_users(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """User settings (user_id, name, aliases, roles) with an overlay: its values win, lists are joined in order without repeats."""
    o = overlay.select("user_id", *[F.col(c).alias(f"_{c}") for c in ("name", "aliases", "roles")])
    both = lambda c: F.array_distinct(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(f"_{c}", F.array().cast("array<string>"))))
    return base.join(o, "user_id", "full").select("user_id", F.coalesce("_name", "name").alias("name"), both("aliases").alias("aliases"), both("roles").alias("roles"))


WEBHOOK = "version string, time string, trigger string, api struct<name: string, bucket: string, object: string, statusCode: int, rx: long, tx: long, timeToResponse: string>, requestID string, remotehost string, userAgent string, accessKey string"


def object_store_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Audit webhook texts as rows, in batch or as a stream; what is no event has a null operation and keeps its text."""
    e = F.from_json(column, WEBHOOK)
    s = raw.select(F.col(column).alias("raw"), e.alias("e"))
    return s.select(
        F.lit("minio").alias("provider"), parse_iso(F.col("e.time")).alias("event_ts"), F.col("e.api.bucket").alias("bucket"), F.col("e.api.object").alias("object_key"), F.col("e.api.name").alias("operation"), F.col("e.api.statusCode").alias("status_code"),
        F.col("e.requestID").alias("request_id"), F.col("e.accessKey").alias("principal"), F.regexp_replace("e.remotehost", r":[0-9]+$", "").alias("remote_ip"), (F.col("e.api.statusCode") < 400).alias("success"), "raw",
    )


def vector_search(query: Column, vectors: DataFrame, column: str = "embedding", k: int = 10) -> DataFrame:
    """The k rows with the greatest dot product with a query vector: a stand-in for an external semantic store."""
    score = F.aggregate(F.zip_with(column, query, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return vectors.withColumn("score", score).orderBy(F.desc("score"), vectors.columns[0]).limit(k)
