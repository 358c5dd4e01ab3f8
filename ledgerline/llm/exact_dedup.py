"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, keep, materialize, scratch, table

#: Counters of a Misra-Gries summary; a digest of more than one row in COUNTERS / 2 is always found.
COUNTERS = 1024


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, low): digests that may be frequent, with a lower bound of their rows; at most `counters` of them.

    Each task keeps at most `counters` counters and, when it has more, takes the first value that goes from all of them
    (the mergeable form of the summary). A digest with f of n rows keeps at least f - n / counters over all tasks, and
    all bounds together are n at most, so those of n / counters or more are `counters` digests at most.
    """

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, rows = pd.Series(dtype="int64"), 0
        for batch in batches:
            rows += int(batch["_copies"].sum())
            kept = kept.add(batch.groupby("digest")["_copies"].sum(), fill_value=0).astype("int64")
            if len(kept) > counters:
                kept = kept - kept.nlargest(counters + 1).iloc[-1]
                kept = kept[kept > 0]
        if rows:
            yield pd.DataFrame({"digest": [*kept.index, None], "low": [*kept, rows]})

    kind = dict(digests.dtypes)["digest"]
    parts = materialize(digests.select("digest", "_copies").mapInPandas(summary, f"digest {kind}, low long"), "misra-gries")
    n = parts.where("digest is null").agg(F.sum("low")).first()[0] or 0
    return parts.where("digest is not null").groupBy("digest").agg(F.sum("low").alias("low")).where(F.col("low") >= max(2.0, n / counters))


def split_heavy(rows: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a winner's digest, with its columns, and all others: both where they are read, without a shuffle."""
    split = rows.join(F.broadcast(winners), "digest", "left")
    return split.where("group_size is not null"), split.where("group_size is null").select(*rows.columns)


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """For each row of df: key, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and all empty texts are one
    group. The row with the largest key stays; a null key is below all others. Of repeated rows (equal key and text)
    exactly one is kept. An empty input gives no rows.

    The scan writes (key, number of the row, digest) to the shared folder, and Misra-Gries reads that where it lies. The
    digests that it finds are counted exactly, row by row into one row a task, before they are trusted; these few winners, `counters` at most, are
    broadcast, so that rows of large groups are settled where they are read and never shuffled. All others are shuffled
    once by their digest, for the aggregate and for its way back, in groups of less than 1 / `counters` of the rows each.
    """
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256))
    with scratch() as tables:
        rows = materialize(df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_id"), digest.alias("digest")), "digests")
        total = [F.max(F.struct("_key", "_id")).alias("_best"), F.count(F.lit(1)).alias("group_size")]
        often = misra_gries(rows.withColumn("_copies", F.lit(1).cast("long")), counters).select("digest")
        winners = materialize(rows.join(F.broadcast(often), "digest", "left_semi").groupBy("digest").agg(*total), "winners")
        keep(tables, rows, winners)
    heavy, rest = split_heavy(rows, winners)
    rest = rest.repartition("digest")
    rest = rest.join(rest.groupBy("digest").agg(*total), "digest")
    one = heavy.select("_key", "_id", "digest", "_best", "group_size").unionByName(rest.select("_key", "_id", "digest", "_best", "group_size"))
    return one.select(F.col("_key").alias(key), F.col("_best._key").alias("keep_id"), "group_size", (F.col("_id") == F.col("_best._id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND row_number() OVER (PARTITION BY text_sha256, doc_id ORDER BY 1) = 1 AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
