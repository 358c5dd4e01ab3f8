"""Sinks: a manifest, an index page, metrics, JSON envelopes and appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = ("item_id", "item_type", "title", "project_key", "status", "owner_user_id", "event_id", "event_type", "created_at", "active_at")


def manifest_rows(items: DataFrame) -> DataFrame:
    """(item_id, line): the row of each item in manifest.csv, cells quoted where they need it."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit("")) if c in items.columns else F.lit("")
        return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return items.select("item_id", F.concat_ws(",", *[cell(c) for c in MANIFEST]).alias("line"))


def index_rows(items: DataFrame) -> DataFrame:
    """(item_id, line): the row of each item in index.md, bars escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return items.select("item_id", F.concat(F.lit("| "), F.concat_ws(" | ", cell("item_id"), cell("item_type"), cell("title"), cell("status"), cell("active_at")), F.lit(" |")).alias("line"))


def manifest_lines(items: DataFrame, generated_at: str, limit: int = 1000) -> list[str]:
    """The lines of manifest.csv for the first `limit` items: three of comment, the header, and a row an item."""
    rows = [r["line"] for r in manifest_rows(items.limit(limit)).collect()]
    return ["# manifest of items", f"# generated_at: {generated_at}", f"# rows: {len(rows)}", ",".join(MANIFEST), *rows]


def index_lines(items: DataFrame, limit: int = 50) -> list[str]:
    """The lines of index.md: a table of the first `limit` items."""
    return ["# Items", "", "| id | type | title | status | active |", "| --- | --- | --- | --- | --- |", *(r["line"] for r in index_rows(items.limit(limit)).collect())]


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A small text file at a path of any file system that Spark reaches, put in place by a rename."""
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(part, True)
    out.write(bytearray(("\n".join(lines) + "\n").encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def render_views(spark: SparkSession, items: DataFrame, folder: str, generated_at: str, limit: int = 50) -> None:
    """manifest.csv of twice the limit, and index.md of the limit."""
    rows = items.limit(limit * 2)
    write_lines(spark, manifest_lines(rows, generated_at), f"{folder}/manifest.csv")
    write_lines(spark, index_lines(rows, limit), f"{folder}/index.md")


def prometheus_lines(metrics: DataFrame, prefix: str = "ledger") -> DataFrame:
    """(line) of metrics (metric, label, n): one sample each, with its HELP and TYPE before the first of a metric."""
    safe = F.regexp_replace("label", r'(["\\])', r"\\$1")
    name = F.concat(F.lit(f"{prefix}_"), F.regexp_replace("metric", "[^a-zA-Z0-9_]", "_"))
    sample = F.concat(name, F.lit('{label="'), safe, F.lit('"} '), F.col("n").cast("string"))
    head = metrics.select("metric", name.alias("name")).distinct().select("metric", F.lit("").alias("label"), F.lit(0).alias("o"), F.concat(F.lit("# HELP "), "name", F.lit(" "), "metric", F.lit("\n# TYPE "), "name", F.lit(" gauge")).alias("line"))
    rows = metrics.select("metric", "label", F.lit(1).alias("o"), sample.alias("line"))
    return head.unionByName(rows).orderBy("metric", "o", "label").select("line")


def envelope(df: DataFrame, code: str = "OK", limit: int = 1000) -> DataFrame:
    """One row of JSON: {ok, code, rows} with at most `limit` rows, which are one answer to one caller; where there are more, truncated says so."""
    first = df.limit(limit + 1).agg(F.collect_list(F.struct(*df.columns)).alias("_all"))
    more = F.when(F.size("_all") > limit, F.lit(True)).alias("truncated")
    return first.select(F.to_json(F.struct(F.lit(code == "OK").alias("ok"), F.lit(code).alias("code"), F.slice("_all", 1, limit).alias("rows"), more)).alias("json"))


def append_by_day(df: DataFrame, when: str, path: str) -> None:
    """Append audit rows to a table that is partitioned by day."""
    df.withColumn("day", F.to_date(when)).repartition("day").write.mode("append").partitionBy("day").parquet(path)
