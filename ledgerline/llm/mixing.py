"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, hash52, keep, materialize, scratch, table

#: Documents of a source are shuffled into so many ranges of their hash, or more, of about ROWS documents; the queue is cut in steps of so
#: many ranges, until one has FEW entries at most.
RANGES, ROWS, FEW = 1024, 200_000, 4096
#: No source, and no document, is taken more often than this.
MOST = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row a source.

    Sources in code point order, null last, have the weights in turn and share the sum of all sizes; a target stops at
    `most` times its source's size, and what is over goes to the others by weight until none is above. This is filling
    to a level: in order of cap / weight, the first k are capped, for the least k at which the level fits the next.
    The sums are exact integers, so each target is one division and one product. One row a source: a small table.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = (F.row_number().over(by_name) - 1) % n
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (rank + 1).cast("int"))
    full = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before, whole = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    rows = rows.withColumns({"_all": F.sum("source_size").over(whole), "_allw": F.sum("_w").over(whole), "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_wcapped": F.coalesce(F.sum("_w").over(before), F.lit(0)), "_at": F.row_number().over(full)})
    level = (F.col("_all") - F.col("_capped")) / (F.col("_allw") - F.col("_wcapped"))
    rows = rows.withColumn("_level", level).withColumn("_fits", F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_at")))
    rows = rows.withColumn("_first", F.min("_fits").over(whole)).withColumn("_fill", F.max(F.when(F.col("_at") == F.col("_first"), F.col("_level"))).over(whole))
    target = F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first")), F.col("_cap").cast("double")).otherwise(F.least(F.col("_fill") * F.col("_w"), F.col("_cap").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def place_of(seed: str, key: Column, text: Column) -> Column:
    """A document's place in the shuffled order: 52 bits of the MD5 of seed, key and text."""
    return hash52(F.lit(seed), key, F.md5(F.coalesce(text, F.lit(""))))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = MOST, seed: str = "mix") -> DataFrame:
    """For each row of df: key, source, size, source_size, target, taken, place.

    size: words of the text, 0 for null. Each source's documents stand in a shuffled order that the MD5 of seed, key and
    text fixes, so reruns agree. In pass e (0, 1, ...) a document has the virtual finish time
    (e * source_size + cumulative size) / target; all are put in order of it and taken until the next would pass the sum of all
    sizes. taken is size times the passes that were taken, at most `most` of them. Ties go by source, hash and key; empty
    documents take 0 words; repeated rows are documents of their own. An empty input gives no rows.

    The cumulative sums run inside (source, range of the hash), with a table of range sums for what comes before, so a
    source of a third of all rows is many tasks, the more the larger the input; rows that repeat key and text go through that as one row with a
    count. The cut of the queue is found from sums of 1,024 ranges of the finish time, then 1,024 ranges inside the one that is cut, and
    so on, until the few entries of a range are put in order. Keys are of any type that has an order.
    """
    with scratch() as tables:
        h = place_of(seed, F.col(key), F.col(text))
        kind = dict(df.dtypes)[key]
        size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
        docs = df.select(F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_s"), F.col(source).isNull().alias("_null"), size.alias("size"), h.alias("_h"))
        docs = materialize(docs.groupBy("_key", "_s", "_null", "size", "_h").agg(F.count(F.lit(1)).alias("_n")), "sizes")
        step = 2**52 // max(RANGES, docs.count() // ROWS) + 1
        docs = docs.withColumn("_range", F.floor(F.col("_h") / step))
        ranges = docs.groupBy("_s", "_null", "_range").agg(F.sum(F.col("size") * F.col("_n")).alias("_sum"))
        named = F.when(~F.col("_null"), F.col("_s"))
        goals = source_targets(ranges.groupBy("_s", "_null").agg(F.sum("_sum").alias("source_size")).select(named.alias("source"), "source_size"), weights, most)
        goals = materialize(goals.withColumn("_s", F.coalesce(F.col("source"), F.lit(""))).withColumn("_null", F.col("source").isNull()).drop("source"), "goals")
        before = F.sum("_sum").over(Window.partitionBy("_s", "_null").orderBy("_range")) - F.col("_sum")
        start = materialize(ranges.select("_s", "_null", "_range", before.alias("_before")), "start")

        inside = Window.partitionBy("_s", "_null", "_range").orderBy("_h", F.col("_key").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
        rows = docs.withColumn("_end", F.sum(F.col("size") * F.col("_n")).over(inside)).join(start, ["_s", "_null", "_range"]).join(goals, ["_s", "_null"])
        rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        rows = queue = materialize(rows.withColumn("_cum", F.col("_before") + F.col("_end") - F.col("_i") * F.col("size")).drop("_before", "_end", "_range", "_n", "_i"), "queue")

        passes = F.when((F.col("target") > 0) & (F.col("size") > 0), F.least(F.lit(most), F.ceil(F.col("target") / F.col("source_size")))).otherwise(0)
        finish = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.when(e < passes, (e * F.col("source_size") + F.col("_cum")) / F.col("target")))
        entry = lambda f: F.struct(f.alias("f"), F.col("_null").alias("null"), F.col("_s").alias("s"), F.col("_h").alias("h"), F.col("_key").isNotNull().alias("keyed"), F.col("_key").alias("key"), F.col("size").alias("size"))
        rows = rows.withColumn("_entries", F.filter(F.transform(finish, entry), lambda e: e["f"].isNotNull()))
        last = _last_taken(rows.select(F.explode("_entries").alias("e")), goals, kind)
        taken = F.size(F.filter("_entries", lambda e: last(e))) * F.col("size")
        keep(tables, queue)
        return rows.select(F.col("_key").alias(key), named.alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("_h").alias("place"))


def _cell(f: Column, level: int) -> Column:
    """The range of a finish time inside its range of the level above: below RANGES however late it is, and in its order."""
    at = f / (1 + f) * RANGES
    for _ in range(level):
        at = (at - F.floor(at)) * RANGES
    return F.floor(at)


def _last_taken(entries: DataFrame, goals: DataFrame, kind: str):
    """A test of an entry: whether it stands before the cut. Sums come to the driver for 1,024 ranges a step, and one entry."""
    left = goals.agg(F.sum("source_size")).first()[0] or 0
    path, part = [], entries
    while True:
        cell = _cell(F.col("e.f"), len(path))
        sums = sorted((row["r"], row["n"], row["k"]) for row in part.groupBy(cell.alias("r")).agg(F.sum("e.size").alias("n"), F.count(F.lit(1)).alias("k")).collect())
        r, few = (sums[-1][0] + 1 if sums else 0), 0
        for at, n, k in sums:
            if n > left:
                r, few = at, k
                break
            left -= n
        path.append(r)
        part = part.where(cell == r)
        if few <= FEW or len(path) == 5:  # five steps are all bits of a finish time
            break
    found = part.select("e", F.sum("e.size").over(Window.orderBy("e").rowsBetween(Window.unboundedPreceding, 0)).alias("sum")).where(F.col("sum") <= left).agg(F.max("e").alias("e")).first()
    e = found and found["e"]

    def test(x: Column) -> Column:
        before, same = F.lit(False), F.lit(True)
        for level, r in enumerate(path):
            cell = _cell(x["f"], level)
            before, same = before | (same & (cell < r)), same & (cell == r)
        if e is None:
            return before
        kinds = {"f": "double", "null": "boolean", "s": "string", "h": "long", "keyed": "boolean", "key": kind, "size": "long"}
        return before | (same & (x <= F.struct(*[F.lit(e[c]).cast(k).alias(c) for c, k in kinds.items()])))

    return test


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns. Texts without words take no part.

    What a pass takes of a source is a start of its shuffled order, so the last document of each pass says it for all: a
    row a source, which Spark broadcasts or shuffles by its size, and no text moves when it is small. Rows that repeat the
    last document of a pass go with it.
    """
    place = lambda p, k: F.struct(p.alias("place"), k.isNotNull().alias("keyed"), k.alias("key"))
    with scratch() as tables:
        rows = mix(docs, key, text, source, weights, most, seed).where("size > 0")
        ends = [F.max(F.when(F.col("taken") >= F.col("size") * e, place(F.col("place"), F.col(key)))).alias(f"_end{e}") for e in range(1, most + 1)]
        ends = materialize(rows.groupBy(source).agg(*ends).select(F.coalesce(source, F.lit("")).alias("_s"), F.col(source).isNull().alias("_null"), *[f"_end{e}" for e in range(1, most + 1)]), "ends")
        keep(tables, ends)
    own = place(place_of(seed, F.col(key), F.col(text)), F.col(key))
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(source, F.lit("")).alias("_s"), F.col(source).isNull().alias("_null"), own.alias("_place")).where(F.col(f"_row.{text}").rlike(WORD))
    times = sum((F.when(F.col("_place") <= F.col(f"_end{e}"), 1).otherwise(0) for e in range(2, most + 1)), F.when(F.col("_place") <= F.col("_end1"), 1).otherwise(0))
    return held.join(ends, ["_s", "_null"]).withColumn("_times", times).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), "_times")).alias("_i")).select("_row.*")


def op5(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source", "place")


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint AS size,
  ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))), 1, 13))::bigint AS h FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::bigint AS w, source_size * 3 AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER ()::bigint AS t, sum(w) OVER ()::bigint AS ws,
  coalesce(sum(cap) OVER p, 0)::bigint AS capped, coalesce(sum(w) OVER p, 0)::bigint AS wcapped, row_number() OVER (ORDER BY cap / w, source IS NULL, encode(source)) AS pos
  FROM w WINDOW p AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (t - capped) / (ws - wcapped) AS level FROM o),
f AS (SELECT *, min(CASE WHEN level <= cap / w THEN pos END) OVER () AS first FROM l),
g AS (SELECT source, source_size, CASE WHEN first IS NULL OR pos < first THEN cap::double ELSE least(max(CASE WHEN pos = first THEN level END) OVER () * w, cap::double) END AS target FROM f),
c AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::bigint AS cum FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, (e * source_size + cum) / target AS fin FROM c, range(3) r(e) WHERE target > 0 AND e < ceil(target / source_size)),
q AS (SELECT *, sum(size) OVER (ORDER BY fin, source IS NULL, encode(source), h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS run FROM e),
k AS (SELECT doc_id, h, size, source, sum(size)::bigint AS taken FROM q WHERE run <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT c.doc_id, c.size, source_size, target, coalesce(taken, 0)::bigint AS taken FROM c LEFT JOIN k ON c.doc_id IS NOT DISTINCT FROM k.doc_id AND c.h = k.h AND c.size = k.size AND c.source IS NOT DISTINCT FROM k.source
"""
