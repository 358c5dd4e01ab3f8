"""Writes as new versions of a table: state and change rows in, the next state out. Callers write the result to a new place."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.lookups import latest_per
from ledgerline.registry import query
from ledgerline.schemas import KEYS
from ledgerline.sources.ledger import Ledger, seconds, ts
from ledgerline.sources.versions import BucketedTable, shared_folder


def numbered(new: DataFrame, state: DataFrame, key: str, *order: str, ranges: int = 256) -> DataFrame:
    """new with ids that go on from the largest of state, in the order of the given columns; the first is a number or a time.

    Its span is cut into ranges, which are numbered inside; a small table of their counts gives where each starts. Where any order will do,
    a hash comes first: see hashed().
    """
    first = F.col(order[0]).cast("double")
    span = new.agg(F.min(first).alias("_low"), F.max(first).alias("_high")).join(state.agg(F.coalesce(F.max(key).cast("long"), F.lit(0).cast("long")).alias("_top")))
    inner = F.least(F.floor((first - F.col("_low")) / (F.col("_high") - F.col("_low")) * (ranges - 1)), F.lit(ranges - 2)) + 1
    rows = new.join(F.broadcast(span)).withColumn("_part", F.when(first.isNull() | (F.col("_low") == F.col("_high")), 0).otherwise(inner))  # one row: no cross product
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_i", inside).join(F.broadcast(start), "_part").withColumn(key, F.col("_top") + F.col("_start") + F.col("_i")).drop("_part", "_i", "_start", "_low", "_high", "_top")


def hashed(new: DataFrame, state: DataFrame, key: str, *columns: str) -> DataFrame:
    """numbered() in an order by hash, which spreads over all ranges whatever the columns hold."""
    return numbered(new.withColumn("_hash", F.xxhash64(*columns)), state, key, "_hash", *columns).drop("_hash")


def upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), order: Column | None = None) -> DataFrame:
    """state with the changes: of several to one key the last by `order`, by an aggregate of one row a key.

    Where state has the columns of `order` too, a change that stands before the row in state is late and changes nothing. Columns in
    `keep` keep the old value where the new is null; others are replaced. The two meet in one join.
    """
    columns = [c for c in state.columns if c not in keys]
    taken = F.col("_changed")
    if order is not None:
        rest = [c for c in changes.columns if c not in keys]
        known = set(names_in(changes, order)) <= set(state.columns)
        changes = changes.withColumn("_o", order).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_o").alias("_last"), F.max("_o").alias("_o")).select(*keys, "_last.*", "_o")
        if known:
            state = state.withColumn("_stands", order)
            taken = taken & (F.col("_stands").isNull() | F.coalesce(F.col("_o") >= F.col("_stands"), F.lit(False)))
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], *(["_o"] if order is not None else []), F.lit(True).alias("_changed"))
    joined = state.join(new, list(keys), "full").withColumn("_taken", F.coalesce(taken, F.lit(False)))
    pick = lambda c: F.when(~F.col("_taken"), F.col(c)).otherwise(F.coalesce(f"_new_{c}", c) if c in keep else F.col(f"_new_{c}")).alias(c)
    return joined.select(*[F.col(k) if k in keys else pick(k) for k in state.columns if k != "_stands"])


def names_in(df: DataFrame, column: Column) -> list[str]:
    """The columns of df that an expression reads."""
    found = df.select(column.alias("_"))._jdf.queryExecution().analyzed().references().toSeq()
    return [found.apply(i).name() for i in range(found.size())]


def insert_new(state: DataFrame, rows: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """Rows whose key state does not have, the first of each key: what an insert that does nothing on conflict adds."""
    fresh = rows.join(state.select(*keys).distinct(), list(keys), "left_anti")
    first = fresh.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))).where("_rn = 1").drop("_rn")
    return first.select(*rows.columns)


def add_events(items: DataFrame, events: DataFrame) -> DataFrame:
    """items after their events: the state of the newest event that names one, and its time; items without one stay as they are."""
    last = latest_per(events.where("status_to is not null").select("item_id", "status_to", "created_at", "event_id"), ["item_id"], "created_at", "event_id")
    return items.join(last.select("item_id", F.col("status_to").alias("_to"), F.col("created_at").alias("_at")), "item_id", "left").withColumns({"status": F.coalesce("_to", "status"), "updated_at": F.coalesce("_at", "updated_at")}).drop("_to", "_at")


def create_items(items: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """items with new ones (item_type, title and what else is known): ids go on from the largest, in an order by hash; open unless said otherwise."""
    known = lambda c, value: F.coalesce(F.col(c), value) if c in new.columns else value
    rows = new.withColumns({"status": known("status", F.lit("open")), "scope_json": known("scope_json", F.lit("{}")), "created_at": now, "updated_at": now})
    return items.unionByName(hashed(rows, items, "item_id", "item_type", "title").select(*[c for c in items.columns if c in (*rows.columns, "item_id")]), allowMissingColumns=True)


def attached(attachments: DataFrame, new: DataFrame, items: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """attachments with new ones (item_id, kind, uri, sha256, size_bytes) of items that are there, and the rows whose item is not."""
    there = items.select("item_id").distinct()
    rows = hashed(new.join(there, "item_id", "left_semi").withColumn("created_at", now), attachments, "attachment_id", "item_id", "uri", "sha256")
    return attachments.unionByName(rows.select(*attachments.columns), allowMissingColumns=True), new.join(there, "item_id", "left_anti")


#: Fixed values of the ledger's contract: states of an audit row.
AUDIT_STATES = ("success", "failed", "redirected", "pending")
SHA256 = "^[0-9a-fA-F]{64}$"


def audit_fault(evidence: Column) -> Column:
    """Why an audit row's evidence JSON may not be stored; null if it may. An empty or null one may.

    patches and attachments are lists of objects with artifact_uri and sha256; a patch also names its source, and the uri's hash is the object's.
    """
    refs = lambda name: F.from_json(F.get_json_object(evidence, f"$.{name}"), "array<struct<artifact_uri:string,sha256:string,source_id:string,source_type:string,kind:string>>")
    held = lambda name: F.get_json_object(evidence, f"$.{name}")
    empty = lambda c: c.isNull() | (c == "")
    said = lambda r: F.lower(F.regexp_extract(r["artifact_uri"], "/([0-9a-fA-F]{64})$", 1))
    wrong = lambda r, pattern: empty(r["artifact_uri"]) | empty(r["sha256"]) | ~r["artifact_uri"].rlike(pattern) | (said(r) != F.lower(r["sha256"]))
    patch = lambda r: F.coalesce(wrong(r, "^memory://patch_blobs/[^/]+/.+/[0-9a-fA-F]{64}$") | ~r["sha256"].rlike(SHA256) | empty(r["source_id"]) | empty(r["source_type"]), F.lit(True))
    attachment = lambda r: F.coalesce(wrong(r, "^memory://attachments/[0-9]+/[0-9a-fA-F]{64}$"), F.lit(True))
    return (
        F.when(empty(evidence), F.lit(None).cast("string"))
        .when(~F.coalesce(evidence.rlike(r"^\s*\{") & F.try_parse_json(evidence).isNotNull(), F.lit(False)), "not_an_object")
        .when(held("patches").isNotNull() & ~held("patches").startswith("["), "patches_not_a_list")
        .when(F.exists(F.coalesce(refs("patches"), F.array()), patch), "invalid_patch")
        .when(held("attachments").isNotNull() & ~held("attachments").startswith("["), "attachments_not_a_list")
        .when(F.exists(F.coalesce(refs("attachments"), F.array()), attachment), "invalid_attachment")
    )


def inserted_audits(audit: DataFrame, users: DataFrame, new: DataFrame, now: Column, validate: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(audit, users, refused) after new rows (actor_user_id, target_space, action, reason, evidence_refs_json, correlation_id, status).

    Ids go on from the largest. Unknown actors become users; an empty correlation id is none, an absent state success. Refused, with a `fault`, are
    states that are not known and, with `validate`, evidence of a wrong form.
    """
    rows = new.withColumns({"status": F.coalesce("status", F.lit("success")), "correlation_id": F.nullif("correlation_id", F.lit("")), "evidence_refs_json": F.coalesce("evidence_refs_json", F.lit("{}")), "created_at": now})
    fault = F.when(~F.col("status").isin(*AUDIT_STATES), "invalid_status")
    rows = rows.withColumn("fault", F.coalesce(fault, audit_fault(F.col("evidence_refs_json"))) if validate else fault)
    good = rows.where("fault is null")
    there = audit.unionByName(hashed(good, audit, "audit_id", "target_space", "action", "reason", "actor_user_id", "correlation_id", "evidence_refs_json").select(*audit.columns), allowMissingColumns=True)
    fresh = good.where("actor_user_id != ''").select(F.col("actor_user_id").alias("user_id")).distinct().join(users.select("user_id"), "user_id", "left_anti")
    return there, users.unionByName(fresh.withColumn("display_name", F.col("user_id")).select(*[c for c in users.columns if c in ("user_id", "display_name")]), allowMissingColumns=True), rows.where("fault is not null")


def merged_json(old: Column, new: Column) -> Column:
    """A shallow merge of two JSON objects as text, keys in order, the new value winning; nested values and numbers stay what they are, and what is no object counts as an empty one."""
    kind = "map<string,variant>"
    as_map = lambda j: F.coalesce(F.from_json(j, kind), F.from_json(F.lit("{}"), kind))
    a, b = as_map(old), as_map(new)
    both = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    bound = F.transform(F.array(both), lambda m: F.map_from_arrays(F.array_sort(F.map_keys(m)), F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k))))
    return F.to_json(F.get(bound, F.lit(0)))


def materialized(blobs: DataFrame, results: DataFrame) -> DataFrame:
    """blobs after attempts (blob_id, new_uri, error): done with a uri, or failed with one attempt more."""
    tries = F.coalesce(F.get_json_object("meta_json", "$.attempts").try_cast("int"), F.lit(0))
    done = F.col("error").isNull()
    patch = F.when(done, F.to_json(F.struct(F.lit("done").alias("materialize_status")))).otherwise(F.to_json(F.struct(F.lit("failed").alias("materialize_status"), (tries + 1).cast("string").alias("attempts"), F.col("error").alias("last_error"))))
    out = blobs.join(results.withColumn("_hit", F.lit(True)), "blob_id", "left")
    return out.withColumns({"uri": F.when(F.col("_hit") & done, F.col("new_uri")).otherwise(F.col("uri")), "meta_json": F.when(F.col("_hit"), merged_json(F.col("meta_json"), patch)).otherwise(F.col("meta_json"))}).select(*blobs.columns)


def finished_runs(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """runs after ends (run_id, status, finished_at) of those that are still running."""
    e = ends.select("run_id", F.col("status").alias("_s"), F.col("finished_at").alias("_f"))
    hit = F.col("_s").isNotNull() & (F.col("status") == "running")
    return runs.join(e, "run_id", "left").withColumns({"finished_at": F.when(hit, F.col("_f")).otherwise(F.col("finished_at")), "status": F.when(hit, F.col("_s")).otherwise(F.col("status"))}).select(*runs.columns)


def updated_audits(audit: DataFrame, updates: DataFrame) -> DataFrame:
    """audit after updates (audit_id, new_status, suffix, patch): only pending rows change; the suffix goes behind the reason, the patch into the JSON."""
    hit = F.col("new_status").isNotNull() & (F.col("status") == "pending")
    out = audit.join(updates, "audit_id", "left")
    return out.withColumns(
        {
            "reason": F.when(hit & F.col("suffix").isNotNull(), F.concat(F.coalesce("reason", F.lit("")), "suffix")).otherwise(F.col("reason")),
            "evidence_refs_json": F.when(hit & F.col("patch").isNotNull(), merged_json(F.col("evidence_refs_json"), F.col("patch"))).otherwise(F.col("evidence_refs_json")),
            "status": F.when(hit, F.col("new_status")).otherwise(F.col("status")),
        }
    ).select(*audit.columns)


def evidence_uri(source_type: Column, source_id: Column, sha256: Column) -> Column:
    return F.concat_ws("/", F.lit("memory://patch_blobs"), source_type, source_id, sha256)


def filled_evidence(blobs: DataFrame) -> DataFrame:
    """blobs with an evidence uri where it is missing: the one in their meta, else the canonical one; and with it in their meta, where that has none."""
    empty = F.col("evidence_uri").isNull() | (F.col("evidence_uri") == "")
    meta = F.nullif(F.get_json_object("meta_json", "$.evidence_uri"), F.lit(""))
    uri = F.when(empty, F.coalesce(meta, evidence_uri(F.col("source_type"), F.col("source_id"), F.col("sha256")))).otherwise(F.col("evidence_uri"))
    out = blobs.withColumn("evidence_uri", uri)
    said = F.to_json(F.struct(F.col("evidence_uri").alias("evidence_uri")))
    return out.withColumn("meta_json", F.when(meta.isNull() & F.col("evidence_uri").isNotNull(), merged_json(F.col("meta_json"), said)).otherwise(F.col("meta_json")))


def filled_source_ids(facts: DataFrame) -> DataFrame:
    """facts (kind, repo_id, number, source_id) with svn:<repo>:<n>, git:<repo>:<sha> or mr:<repo>:<iid> where there is none; an iid stands behind ! or the last slash."""
    iid = F.coalesce(F.nullif(F.regexp_extract("number", "!([0-9]+)$", 1), F.lit("")), F.element_at(F.split("number", "/"), -1))
    number = F.when(F.col("kind") == "mr", iid).otherwise(F.col("number"))
    return facts.withColumn("source_id", F.coalesce(F.nullif("source_id", F.lit("")), F.concat_ws(":", "kind", F.col("repo_id").cast("string"), number)))


def without_old(df: DataFrame, status: str, when: str, now: Column, days: int) -> DataFrame:
    """df without rows of a status that are older than `days`."""
    return df.where(~F.coalesce((F.col("status") == status) & (F.col(when) < seconds(now, F.lit(-86400 * days))), F.lit(False)))


def merged_identities(known: DataFrame, found: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The next identities, and one row of counts: inserted, updated (a column differs) and unchanged."""
    columns = [c for c in known.columns if c not in keys]
    old = known.select(*keys, F.struct(*columns).alias("_old"))
    new = found.select(*keys, F.struct(*columns).alias("_new"))
    both = old.join(new, list(keys), "full")
    state = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull() | F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    counts = both.agg(*[F.count_if(state == s).alias(s) for s in ("inserted", "updated", "unchanged")])
    return both.select(*keys, F.coalesce("_new", "_old").alias("_c")).select(*keys, "_c.*"), counts


def facts(svn: DataFrame, git: DataFrame, mrs: DataFrame) -> DataFrame:
    """The timeline of all sources that have a source id."""
    return svn.unionByName(git).unionByName(mrs).where("source_id is not null")


def ledger_facts(db: Ledger) -> DataFrame:
    orders, lines, events = db._orders(), db.raw("lineitem"), db._events()
    row = lambda kind, repo, number, at: [F.lit(kind).alias("source_type"), F.concat_ws(":", F.lit(kind), repo.cast("string"), number).alias("source_id"), at.cast("timestamp").alias("ts")]
    return facts(
        orders.select(*row("svn", F.col("o_custkey"), F.col("o_orderkey").cast("string"), F.col("o_orderdate"))),
        lines.select(*row("git", F.col("l_suppkey"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.col("l_shipdate"))),
        events.select(*row("mr", F.col("user_id"), F.when(F.col("event_type") != "error", F.col("event_id").cast("string")), F.col("ts"))),
    )


@query("facts_by_source", "SELECT source_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT source_id) AS ids FROM (SELECT 'svn' AS source_type, 'svn:' || o_custkey || ':' || o_orderkey AS source_id, o_orderdate AS ts FROM orders UNION ALL SELECT 'git', 'git:' || l_suppkey || ':' || l_orderkey || '-' || l_linenumber, l_shipdate FROM lineitem UNION ALL SELECT 'mr', 'mr:' || user_id || CASE WHEN event_type <> 'error' THEN ':' || event_id ELSE '' END, ts FROM events) GROUP BY 1")
def _facts(db: Ledger):
    return ledger_facts(db).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("source_id").alias("ids"))


@query("facts_of_a_month", "SELECT source_type, source_id, ts FROM (SELECT 'svn' AS source_type, 'svn:' || o_custkey || ':' || o_orderkey AS source_id, o_orderdate AS ts FROM orders UNION ALL SELECT 'git', 'git:' || l_suppkey || ':' || l_orderkey || '-' || l_linenumber, l_shipdate FROM lineitem) WHERE ts >= TIMESTAMP '1998-03-01' AND ts < TIMESTAMP '1998-04-01'")
def _month(db: Ledger):
    return ledger_facts(db).where((F.col("ts") >= ts("1998-03-01")) & (F.col("ts") < ts("1998-04-01")))


@query("items_after_events", "SELECT item_id, coalesce(s, status) AS status, coalesce(c, updated_at) AS updated_at FROM items LEFT JOIN (SELECT item_id, status_to AS s, created_at AS c FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, event_id DESC) AS rn FROM item_events WHERE status_to IS NOT NULL) WHERE rn = 1) USING (item_id)")
def _items(db: Ledger):
    return add_events(db.items(), db.item_events()).select("item_id", "status", "updated_at")


@query("repos_upserted", "SELECT coalesce(r.repo_id, c.repo_id) AS repo_id, coalesce(c.url, r.url) AS url, coalesce(c.project_key, r.project_key) AS project_key FROM repos r FULL JOIN (SELECT DISTINCT c_nationkey + 90 AS repo_id, 'u' || (c_nationkey + 90) AS url, CASE WHEN c_nationkey % 2 = 0 THEN 'k' || c_nationkey END AS project_key FROM customer) c USING (repo_id)")
def _repos(db: Ledger):
    n = F.col("c_nationkey")
    changes = db.raw("customer").select((n + 90).cast("long").alias("repo_id"), F.concat(F.lit("u"), n + 90).alias("url"), F.when(n % 2 == 0, F.concat(F.lit("k"), n)).alias("project_key"))
    return upsert(db.repos().drop("repo_type"), changes, ["repo_id"], keep=["project_key"], order=F.col("url"))


@query("kv_upserted", "SELECT namespace, key, value_json FROM (SELECT *, row_number() OVER (PARTITION BY namespace, key ORDER BY updated_at DESC, event_id DESC) AS rn FROM kv_changes) WHERE rn = 1")
def _kv(db: Ledger):
    changes = db.kv_changes()
    cut = ts("2024-01-15")
    old = latest_per(changes.where(F.col("updated_at") < cut), KEYS["kv"], "updated_at", "event_id").drop("event_id")
    return upsert(old, changes.where(F.col("updated_at") >= cut), KEYS["kv"], order=F.struct("updated_at", "event_id")).select("namespace", "key", "value_json")


#: When the changes below begin: the last hours of the log, which few keys change in.
_LATE = "2024-01-30 22:00:00"
_BUCKET = "('0x' || substr(md5(namespace || '|' || key), 1, 8))::bigint % 32"


def kv_table(db: Ledger) -> BucketedTable:
    """The key-value state before the last hours as a table of 32 buckets, then what came in the last hours, with changes that are late again among it, as its next version."""
    changes, cut = db.kv_changes(), ts(_LATE)
    old = latest_per(changes.where(F.col("updated_at") < cut), KEYS["kv"], "updated_at", "event_id")
    table = BucketedTable(db.spark, f"{shared_folder(db.spark)}/kv-{uuid.uuid4().hex}", KEYS["kv"], 32)
    step = lambda state, new: upsert(state, new, KEYS["kv"], order=F.struct("updated_at", "event_id"))
    table.apply(old, step)
    fresh = changes.where(F.col("updated_at") >= cut)
    late = changes.where(F.col("updated_at") < cut).join(fresh.select(*KEYS["kv"]).distinct(), KEYS["kv"], "left_semi")
    table.apply(fresh.unionByName(late), step)
    return table


@query("kv_incremental", f"""SELECT namespace, key, value_json, b AS bucket, max((last >= TIMESTAMP '{_LATE}')::int) OVER (PARTITION BY b) AS version FROM (SELECT *, {_BUCKET} AS b, updated_at AS last, row_number() OVER (PARTITION BY namespace, key ORDER BY updated_at DESC, event_id DESC) AS rn FROM kv_changes) WHERE rn = 1""")
def _kv_incremental(db: Ledger):
    """The whole state after an incremental change: a bucket is of the first version unless one of its keys changed."""
    table = kv_table(db)
    rows = table.read().withColumn("bucket", table.bucket()).join(F.broadcast(table.manifest()), "bucket")  # a row a bucket
    return rows.select("namespace", "key", "value_json", F.col("bucket").cast("long").alias("bucket"), F.col("v").cast("int").alias("version"))


@query("kv_buckets", f"""SELECT b AS bucket, count(*) AS n, max(rewritten) AS rewritten FROM (SELECT {_BUCKET} AS b, namespace, key, max((updated_at >= TIMESTAMP '{_LATE}')::int) AS rewritten FROM kv_changes GROUP BY ALL) GROUP BY 1""")
def _kv_buckets(db: Ledger):
    """Rows of each bucket, and whether the change rewrote it: the files of the older manifest, and of the newer one, are not the same."""
    table = kv_table(db)
    files = lambda v: table.read(v).select(table.bucket().alias("b"), F.input_file_name().alias("file")).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("file")).alias("files"))
    old, new = files(0).select("b", F.col("files").alias("before")), files(1)
    return new.join(old, "b", "left").select(F.col("b").cast("long").alias("bucket"), "n", F.coalesce((F.col("files") != F.col("before")).cast("int"), F.lit(1)).alias("rewritten"))


@query("blobs_inserted", "SELECT min(attachment_id) AS attachment_id, sha256 FROM attachments WHERE sha256 NOT IN (SELECT sha256 FROM patch_blobs) GROUP BY sha256")
def _insert(db: Ledger):
    rows = db.attachments().select("attachment_id", "sha256")
    return insert_new(db.patch_blobs().select("sha256"), rows, ["sha256"], "attachment_id")


@query("blobs_evidence_filled", "SELECT blob_id, CASE WHEN coalesce(evidence_uri, '') = '' THEN 'memory://patch_blobs/git/' || source_id || '/' || sha256 ELSE evidence_uri END AS evidence_uri FROM patch_blobs")
def _evidence(db: Ledger):
    return filled_evidence(db.patch_blobs()).select("blob_id", "evidence_uri")


@query("blobs_meta_filled", """SELECT blob_id, uri AS evidence_uri, CASE WHEN blob_id % 3 = 0 AND blob_id % 2 = 0 THEN 'old://' || blob_id ELSE uri END AS in_meta, CASE WHEN blob_id % 3 = 0 THEN blob_id % 7 END AS depth FROM (SELECT blob_id, CASE WHEN coalesce(evidence_uri, '') <> '' THEN evidence_uri WHEN blob_id % 3 = 0 AND blob_id % 2 = 0 THEN 'old://' || blob_id ELSE 'memory://patch_blobs/git/' || source_id || '/' || sha256 END AS uri FROM patch_blobs)""")
def _meta(db: Ledger):
    """Meta with a uri and without, nested and absent: the uri is written back where there was none, and what is nested stays so."""
    k = F.col("blob_id")
    nested = F.struct((k % 7).alias("depth"))
    meta = F.when(k % 3 == 0, F.to_json(F.struct(F.when(k % 2 == 0, F.concat(F.lit("old://"), k.cast("string"))).alias("evidence_uri"), nested.alias("more")))).when(k % 3 == 1, "{}")
    out = filled_evidence(db.patch_blobs().withColumn("meta_json", meta))
    said = lambda path: F.get_json_object("meta_json", path)
    return out.select("blob_id", "evidence_uri", said("$.evidence_uri").alias("in_meta"), said("$.more.depth").cast("long").alias("depth"))


@query("audit_updated", "SELECT audit_id, CASE WHEN status = 'pending' AND audit_id % 3 = 0 THEN reason || ':outbox:' || audit_id ELSE reason END AS reason, CASE WHEN status = 'pending' AND audit_id % 3 = 0 THEN 'redirected' ELSE status END AS status FROM write_audit")
def _update(db: Ledger):
    audit = db.write_audit()
    updates = audit.where("audit_id % 3 = 0").select("audit_id", F.lit("redirected").alias("new_status"), F.concat(F.lit(":outbox:"), "audit_id").alias("suffix"), F.lit('{"done": "1"}').alias("patch"))
    return updated_audits(audit, updates).select("audit_id", "reason", "status")


@query("ids_assigned", "SELECT c_custkey, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_acctbal, c_custkey) AS repo_id FROM customer")
def _ids(db: Ledger):
    return numbered(db.raw("customer").select("c_custkey", "c_acctbal"), db.repos(), "repo_id", "c_acctbal", "c_custkey").select("c_custkey", "repo_id")


@query("jobs_without_old", "SELECT job_id, status, created_at FROM sync_jobs WHERE NOT (status = 'failed' AND created_at < TIMESTAMP '2001-08-02' - INTERVAL 900 DAY)")
def _cleanup(db: Ledger):
    return without_old(db.sync_jobs(), "failed", "created_at", ts("2001-08-02"), 900).select("job_id", "status", "created_at")


@query("identities_merged", "SELECT count(*) FILTER (k IS NULL) AS inserted, count(*) FILTER (k IS NOT NULL AND f IS NOT NULL AND a <> b) AS updated, count(*) FILTER (k IS NOT NULL AND (f IS NULL OR a = b)) AS unchanged FROM (SELECT s_suppkey AS k, s_name AS a FROM supplier) s FULL JOIN (SELECT c_custkey AS f, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Supplier#' || c_custkey END AS b FROM customer WHERE c_custkey > 50) c ON k = f")
def _identities(db: Ledger):
    known = db.raw("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))
    n = F.col("c_custkey")
    found = db.raw("customer").where(n > 50).select(n.alias("user_id"), F.when(n % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Supplier#"), n)).alias("name"))
    return merged_identities(known, found, ["user_id"])[1]
