"""Reports that put several statistics together, and the refresh of the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.aggregates import audit_stats, evidence_coverage, evidence_modes, intercept_stats, outbox_stats
from ledgerline.registry import query
from ledgerline.sources.ledger import EVENTS_NOW, ORDERS_NOW, Ledger, ts
from ledgerline.sources.versions import Folder


def reliability_report(outbox: DataFrame, audit: DataFrame, blobs: DataFrame, attachments: DataFrame, outbox_now: Column, audit_now: Column) -> DataFrame:
    """(section, metric, value) of the outbox, audits, evidence and intercepts: one pass over each table."""
    parts = {"outbox": outbox_stats(outbox, outbox_now), "audit": audit_stats(audit, audit_now), "intercepts": intercept_stats(audit, audit_now), "evidence": evidence_coverage(blobs, attachments), "modes": evidence_modes(audit, audit_now)}
    out = None
    for section, df in parts.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        long = df.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.*")
        out = long if out is None else out.unionByName(long)
    return out


def refresh(spark: SparkSession, df: DataFrame, path: str, version: int) -> tuple[int, int]:
    """Write df as the next version of a table (path/v=<version>); the rows before and after."""
    count = lambda v: spark.read.parquet(f"{path}/v={v}").count() if f"v={v}" in Folder(spark, path).names("") else 0
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    return count(version - 1), count(version)


@query("reliability_report", f"""SELECT section, metric, value FROM (SELECT 'outbox' AS section, count(*)::double AS total, count(*) FILTER (status = 'pending')::double AS pending, count(*) FILTER (status = 'sent')::double AS sent, count(*) FILTER (status = 'dead')::double AS dead, avg(retry_count)::double AS avg_retry_count, (epoch_us(TIMESTAMP '{ORDERS_NOW}') - epoch_us(min(created_at) FILTER (status = 'pending'))) / 1000000.0::double AS oldest_pending_age_seconds FROM outbox) UNPIVOT (value FOR metric IN (total, pending, sent, dead, avg_retry_count, oldest_pending_age_seconds))
UNION ALL SELECT section, metric, value FROM (SELECT 'audit' AS section, count(*)::double AS total, count(*) FILTER (action = 'allow')::double AS allow, count(*) FILTER (action = 'redirect')::double AS redirect, count(*) FILTER (action = 'reject')::double AS reject, count(*) FILTER (created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR)::double AS recent_24h FROM write_audit) UNPIVOT (value FOR metric IN (total, allow, redirect, reject, recent_24h))
UNION ALL SELECT section, metric, value FROM (SELECT 'intercepts' AS section, count(*) FILTER (reason LIKE '%diff%' AND reason NOT LIKE '%log%')::double AS diff_reject, count(*) FILTER (reason LIKE '%log%' AND reason NOT LIKE '%diff%')::double AS log_reject, count(*) FILTER (reason LIKE '%diff%' AND reason LIKE '%log%')::double AS diff_log_reject, count(*) FILTER (reason LIKE '%diff%' OR reason LIKE '%log%')::double AS total_intercept, count(*) FILTER ((reason LIKE '%diff%' OR reason LIKE '%log%') AND created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR)::double AS recent_24h FROM write_audit WHERE action = 'reject') UNPIVOT (value FOR metric IN (diff_reject, log_reject, diff_log_reject, total_intercept, recent_24h))
UNION ALL SELECT section, metric, value FROM (SELECT *, round(blobs_with_uri * 100.0::double / blobs_total, 2) AS blobs_pct, round(blobs_with_uri * 100.0::double / (blobs_total + attachments_total), 2) AS coverage_pct FROM (SELECT 'evidence' AS section, count(*)::double AS blobs_total, count(*) FILTER (evidence_uri <> '')::double AS blobs_with_uri, (SELECT count(*) FROM attachments)::double AS attachments_total, 0::double AS attachments_with_uri, count(*) FILTER (evidence_uri LIKE 'memory://%' OR evidence_uri = 'notes/readme')::double AS invalid_count, count(*) FILTER (evidence_uri = 'notes/readme')::double AS invalid_corrected_count FROM patch_blobs)) UNPIVOT (value FOR metric IN (blobs_total, blobs_with_uri, attachments_total, attachments_with_uri, invalid_count, invalid_corrected_count, blobs_pct, coverage_pct))
UNION ALL SELECT section, metric, value FROM (SELECT 'modes' AS section, count(*)::double AS total, count(*) FILTER (ref_mode = 'strict')::double AS strict_mode_count, count(*) FILTER (ref_mode = 'compat' OR ref_mode IS NULL)::double AS compat_mode_count, count(*) FILTER (ref_patches > 0)::double AS with_v2_evidence FROM write_audit WHERE created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY) UNPIVOT (value FOR metric IN (total, strict_mode_count, compat_mode_count, with_v2_evidence))""")
def _report(db: Ledger):
    return reliability_report(db.outbox(), db.write_audit(), db.patch_blobs(), db.attachments(), ts(ORDERS_NOW), ts(EVENTS_NOW))
