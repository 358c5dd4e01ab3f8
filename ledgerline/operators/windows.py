"""What needs an order inside groups: newest of each, last N, fair turns, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.aggregates import rate, with_counts
from ledgerline.registry import query
from ledgerline.sources.ledger import Ledger


def first_per(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group: Spark keeps one row a group before the shuffle for rank limits of this form."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_runs(runs: DataFrame, n: int) -> DataFrame:
    """The last n runs of each repository."""
    w = Window.partitionBy("repo_id").orderBy(F.col("started_at").desc_nulls_last(), F.col("run_id").cast("long").desc())
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def repo_stats(runs: DataFrame, n: int = 20) -> DataFrame:
    """Of each repository's last n runs: counts, rates, and the state of the newest. All repositories at once."""
    status = F.col("status")
    out = with_counts(last_runs(runs, n)).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("recent_runs"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "completed").alias("completed"),
        F.max(F.when(F.col("_rn") == 1, status)).alias("last_status"), F.sum("hits_429").alias("hits_429"), F.sum("requests").alias("requests"), F.max("started_at").alias("last_run_at"),
    )
    return out.withColumns({"failure_rate": F.round(rate(F.col("failed"), F.col("recent_runs")), 6), "rate_limit_rate": F.round(rate(F.col("hits_429"), F.col("requests")), 6)})


def fair_candidates(jobs: DataFrame) -> DataFrame:
    """The best job of each tenant, none counting as one tenant: the least priority, then the oldest."""
    return first_per(jobs.withColumn("_tenant", F.coalesce("tenant_id", F.lit(""))), ["_tenant"], "priority", "created_at", F.col("job_id").cast("long")).drop("_tenant")


def round_robin(jobs: DataFrame, per_round: int = 1) -> DataFrame:
    """jobs with turn, the order in which tenants take turns: per_round jobs of each tenant a round, tenants by their best job."""
    tenant = F.coalesce("tenant_id", F.lit(""))
    order = ["priority", "created_at", F.col("job_id").cast("long")]
    out = jobs.withColumn("_tenant", tenant)
    out = out.withColumn("_rn", F.row_number().over(Window.partitionBy("_tenant").orderBy(*order)))
    best = F.min(F.struct("priority", "created_at", F.col("job_id").cast("long"))).over(Window.partitionBy("_tenant"))
    return out.withColumns({"round": F.floor((F.col("_rn") - 1) / per_round), "_best": best}).withColumnRenamed("_rn", "place").drop("_tenant")


def smoothed(df: DataFrame, by: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """df with ema, the exponential mean alpha * x + (1 - alpha) * previous, alpha kept to [0.01, 1]; it starts at the first value.

    Values so far back that they weigh less than a double can tell are left out, so each row folds a bounded number of values, however long a group is.
    """
    a = min(1.0, max(0.01, alpha))
    reach = 1 if a == 1.0 else math.ceil(60 * math.log(2) / -math.log(1 - a))
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-reach, 0)
    seen = F.collect_list(F.col(value).cast("double")).over(w)
    fold = F.aggregate(F.slice(seen, 2, reach + 1), F.get(seen, F.lit(0)), lambda acc, x: F.lit(a) * x + F.lit(1 - a) * acc)
    return df.withColumn("ema", fold)


@query("repo_stats", "SELECT *, round(failed / recent_runs, 6) AS failure_rate, round(coalesce(least(1.0::double, hits_429 / nullif(requests, 0)), 0), 6) AS rate_limit_rate FROM (SELECT repo_id, count(*) AS recent_runs, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed') AS completed, max(status) FILTER (rn = 1) AS last_status, sum(hits_429)::bigint AS hits_429, sum(requests)::bigint AS requests, max(started_at) AS last_run_at FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, run_id::bigint DESC) AS rn FROM sync_runs) WHERE rn <= 20 GROUP BY 1)")
def _repo_stats(db: Ledger):
    return repo_stats(db.sync_runs())


@query("jobs_fair_candidates", "SELECT job_id, tenant_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(tenant_id, '') ORDER BY priority, created_at, job_id::bigint) AS rn FROM sync_jobs WHERE status = 'pending') WHERE rn = 1")
def _fair(db: Ledger):
    return fair_candidates(db.sync_jobs().where("status = 'pending'")).select("job_id", "tenant_id", "priority")


@query("jobs_round_robin", "SELECT job_id, (rn - 1) // 2 AS round, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(tenant_id, '') ORDER BY priority, created_at, job_id::bigint) AS rn FROM sync_jobs WHERE status = 'pending')")
def _turns(db: Ledger):
    return round_robin(db.sync_jobs().where("status = 'pending'"), 2).select("job_id", F.col("round").cast("long").alias("round"), F.col("place").cast("long").alias("place"))


@query("failure_ema", "SELECT run_id, round(list_reduce(xs, lambda a, x: 0.3::double * x + 0.7::double * a), 6) AS ema FROM (SELECT run_id, rn, list(f) OVER (PARTITION BY repo_id ORDER BY started_at, run_id::bigint ROWS UNBOUNDED PRECEDING) AS xs FROM (SELECT *, (status = 'failed')::int::double AS f, row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, run_id::bigint DESC) AS rn FROM sync_runs) WHERE rn <= 10)")
def _ema(db: Ledger):
    runs = last_runs(db.sync_runs(), 10).withColumns({"f": (F.col("status") == "failed").cast("int"), "n": F.col("run_id").cast("long")})
    return smoothed(runs, "repo_id", ["started_at", "n"], "f", 0.3).select("run_id", F.round("ema", 6).alias("ema"))
