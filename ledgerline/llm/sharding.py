"""Sharding by rendezvous hashing over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import hash52

#: Slots are numbered in so many ranges a shard, which bounds what one task sorts.
RANGES = 256


def rendezvous_shard(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard of a key: shard s has the score -ln(u) / weight with u the key's hash for s, and the least score wins.

    A shard more changes no other shard's score, so rows move into the new shard only.
    A tie goes to the lower shard. Null keys hash as empty text.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")

    def score(s: int) -> Column:
        u = (hash52(*keys, F.lit(s)) + F.lit(1)).cast("double") / F.lit(float(2**52 + 1))
        return F.struct((-F.ln(u) / F.lit(float(weights[s]))).alias("score"), F.lit(s).alias("shard"))

    scores = [score(s) for s in range(len(weights))]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 8, grown_weights: Sequence[float] | None = None) -> DataFrame:
    """df with size (UTF-8 bytes of the text plus 1), text_crc32, law, shard and grown_shard; no shuffle.

    A null text has 0 bytes and the CRC of no bytes, 0. A null key is a key as any other. Columns of df that have the
    name of an added one are replaced. grown_weights: the shards after a change, one more of weight 1 unless given.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.withColumns(
        {
            "size": F.octet_length(raw).cast("long") + F.lit(1).cast("long"),
            "text_crc32": F.crc32(raw),
            "law": F.lit("key"),
            "shard": rendezvous_shard([F.col(key)], weights),
            "grown_shard": rendezvous_shard([F.col(key)], grown_weights or [*weights, 1.0]),
        }
    )


def number_slots(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of assign_shards() with slot: in each shard gapless from 0, in the order of the key's hash.

    Only the small columns move. Equal rows meet before the shuffle as one row with a count, so no key makes a large
    group; each shard is cut into RANGES ranges of the hash, and a table of their counts (RANGES rows a shard) gives
    the first slot of each range. An empty input gives no rows.
    """
    named = [key, "size", "text_crc32", "law", "shard", "grown_shard"]
    order = hash52(F.col(key), F.col("text_crc32"))
    alike = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", order).withColumn("_range", F.shiftright("_h", 52 - 8))
    counts = alike.groupBy("shard", "_range").agg(F.sum("_n").alias("_sum"))
    first = counts.select("shard", "_range", (F.sum("_sum").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_sum")).alias("_first"))
    inside = Window.partitionBy("shard", "_range").orderBy("_h", F.col(key).asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = alike.withColumn("_end", F.sum("_n").over(inside)).join(first, ["shard", "_range"])
    start = F.col("_first") + F.col("_end") - F.col("_n")
    return placed.select(*named, F.explode(F.sequence(start, start + F.col("_n") - 1)).alias("slot"))


def op3(spark, sf_dir):
    from ledgerline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return number_slots(assign_shards(docs)).select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))


def _score(s: int) -> str:
    return f"(-ln(((('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, ''), '{s}')), 1, 13))::bigint + 1)::double) / {float(2**52 + 1)}) / 1.0)"


def _least(n: int) -> str:
    return f"list_position([{', '.join(f's{s}' for s in range(n))}], least({', '.join(f's{s}' for s in range(n))})) - 1"


#: CRC-32 as the bytewise division by the polynomial 0xEDB88320.
SQL = f"""
WITH bits AS (SELECT b, list_reduce(list_prepend(b::ubigint, [k::ubigint for k in range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::ubigint) ELSE c >> 1 END) AS v FROM range(256) t(b)),
tab AS (SELECT list(v ORDER BY b) AS t FROM bits),
raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
crc AS (SELECT doc_id, octet_length(encode(text))::bigint + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::ubigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255::ubigint)::bigint + 1])), 4294967295::ubigint)::bigint AS text_crc32
  FROM raw, tab),
s AS (SELECT *, {', '.join(f'{_score(s)} AS s{s}' for s in range(9))} FROM crc),
p AS (SELECT doc_id, size, text_crc32, 'key' AS law, ({_least(8)})::int AS shard, ({_least(9)})::int AS grown_shard,
  ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, ''), text_crc32::varchar)), 1, 13))::bigint AS h FROM s)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM p
"""
