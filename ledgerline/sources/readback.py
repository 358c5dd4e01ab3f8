"""Queries that read back what sinks, listings and refreshes have written, from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators.writes import ledger_facts
from ledgerline.plans.reports import refresh
from ledgerline.registry import query
from ledgerline.sources import connectors, sinks
from ledgerline.sources.ledger import Ledger
from ledgerline.sources.versions import OnceLog, shared_folder


def _place(db: Ledger, name: str) -> str:
    return f"{shared_folder(db.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("audits_appended_once", "SELECT audit_id, reason, CASE WHEN audit_id % 2 = 0 THEN '0' ELSE '1' END AS batch, created_at::date::varchar AS day FROM write_audit")
def _once(db: Ledger):
    """Two batches of audits, each of which comes twice."""
    log, audit = OnceLog(db.spark, _place(db, "audits")), db.write_audit().select("audit_id", "reason", "created_at")
    for batch in (0, 1, 0, 1):
        log.append(audit.where(F.col("audit_id") % 2 == batch), batch, "created_at")
    return log.read().select("audit_id", "reason", "batch", F.col("day").cast("string").alias("day"))


@query("facts_refreshed", """SELECT version, lag(n, 1, 0) OVER (ORDER BY version) AS before, n AS after FROM (SELECT 1::bigint AS version, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem) UNION ALL SELECT 2, (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events))""")
def _refreshed(db: Ledger):
    """The facts of source control as the first version of a table, and all facts as the second."""
    path, facts = _place(db, "facts"), ledger_facts(db)
    rows = [(v, *refresh(db.spark, df, path, v)) for v, df in ((1, facts.where("source_type != 'mr'")), (2, facts))]
    return db.spark.createDataFrame(rows, "version long, before long, after long")


@query("files_listed", "SELECT part, count(*) AS n, sum(octet_length(encode(coalesce(html, ''))) + 1)::bigint AS bytes FROM (SELECT page_id % 5 AS part, html FROM pages) GROUP BY 1")
def _listed(db: Ledger):
    """Pages as text files in folders, listed below the one root that is allowed; a text file ends each row with a line feed."""
    root = _place(db, "pages")
    pages = db.raw("pages").select(F.coalesce("html", F.lit("")).alias("value"), (F.col("page_id") % 5).alias("part"))
    pages.repartition("part").write.partitionBy("part").text(root)
    sizes = connectors.allowed_files(db.spark, root, [root.rpartition("/")[0]]).where(F.col("path").contains("/part=")).withColumn("part", F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long"))
    rows = pages.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("part").agg(F.sum("size").alias("bytes")).join(rows, "part").select("part", "n", "bytes")


@query("views_rendered", """SELECT 'manifest.csv' AS file, n + 4 AS lines, n AS rows FROM (SELECT least(40, count(*)) AS n FROM customer) UNION ALL SELECT 'index.md', n + 4, n FROM (SELECT least(20, count(*)) AS n FROM customer)""")
def _rendered(db: Ledger):
    """The two files of a rendering of 20 items, and of twice as many in the manifest, read as text: their lines, and the rows of items among them."""
    root = _place(db, "views")
    items = db.items().withColumns({"event_id": F.lit(None).cast("long"), "event_type": F.lit(None).cast("string"), "active_at": F.col("updated_at")}).orderBy("item_id")
    sinks.render_views(db.spark, items, root, "2024-01-30T00:00:00Z", 20)
    lines = db.spark.read.text(f"{root}/*").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").rlike(r"^(\| )?[0-9]+[ ,]")).alias("rows"))


@query("schema_drifts", "SELECT * FROM (VALUES ('items', 'scope_json', 'string', ''), ('kv', 'event_id', '', 'bigint'), ('patch_blobs', 'updated_at', 'timestamp', ''), ('repos', 'created_at', 'timestamp', ''), ('repos', 'default_branch', 'string', ''), ('sync_locks', 'created_at', 'timestamp', ''), ('sync_locks', 'updated_at', 'timestamp', '')) t(tab, col, want, have) WHERE (SELECT count(*) FROM customer) >= 0")
def _drifts(db: Ledger):
    """Where the views over the given tables differ from the ledger's schemas."""
    views = {"items": db.items(), "kv": db.kv_changes(), "patch_blobs": db.patch_blobs(), "repos": db.repos(), "sync_locks": db.sync_locks()}
    found = [(t, *d) for t, df in views.items() for d in schemas.schema_drift(df, t)]
    return db.spark.createDataFrame(found, "tab string, col string, want string, have string")
