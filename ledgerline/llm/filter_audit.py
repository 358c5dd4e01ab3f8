"""Audit of how filters interact: what each step of each order of the filters removes, by a lookup of the first failure."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import keep, materialize, scratch, table, UPPER
from ledgerline.llm.exact_dedup import misra_gries, split_heavy

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS, MASKS = len(FILTERS), 1 << len(FILTERS)
#: Words that a text has at least; of 100 words so many distinct ones at least; of 100 characters so many capitals at most; signs that no text holds.
WORDS, DISTINCT, CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"
#: Parts that a task counts at once; beyond, it hands on what it has.
PARTS = 512

#: Of each order, the filter of each step; for each mask of failed filters and each order, the first step whose filter fails, STEPS if none does.
FILTER_AT = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
_FAILS = (np.arange(MASKS)[:, None, None] >> FILTER_AT[None]) & 1
FIRST = np.where(_FAILS.any(axis=2), _FAILS.argmax(axis=2), STEPS)

COUNTS = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "rows")


def mask_of(raw: bytes, chars: int) -> int:
    """The filters A to D that a text fails, as bits: A is 1."""
    words = raw.split()  # of bytes: ASCII white space only
    without = lambda signs: len(raw) - len(raw.translate(None, signs))
    fails = (len(words) < WORDS, 100 * len(set(words)) < DISTINCT * len(words), 100 * without(UPPER.encode()) > CAPITALS * chars, without(SIGNS) > 0)
    return sum(1 << i for i, f in enumerate(fails) if f)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, text) to (_key, part, mask of A to D, digest of the text)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch, mask, digest = whole.slice(at, 1024), [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                raw = text.encode()
                mask.append(mask_of(raw, len(text)))
                digest.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())], names=["_key", "part", "mask", "digest"])


def removals(hist: np.ndarray) -> np.ndarray:
    """Counts of rows by (part, mask, good, toxic) to COUNTS by (part, order, step): each mask stands in FIRST at the step that removes it, in each order."""
    parts, orders = len(hist), len(ORDERS)
    every, good, toxic = hist.sum(axis=(2, 3)), hist[:, :, 1].sum(axis=2), hist[:, :, :, 1].sum(axis=2)
    place = ((np.arange(parts)[:, None, None] * orders + np.arange(orders)[None, None]) * (STEPS + 1) + FIRST[None]).ravel()
    summed = lambda w: np.rint(np.bincount(place, np.repeat(w.ravel(), orders), minlength=parts * orders * (STEPS + 1))).astype(np.int64).reshape(parts, orders, STEPS + 1)[:, :, :STEPS]
    fails = np.stack([every[:, (np.arange(MASKS) >> f) & 1 == 1].sum(axis=1) for f in range(STEPS)], axis=1)[:, FILTER_AT]
    alone = every[:, 1 << np.arange(STEPS)][:, FILTER_AT]
    removed = summed(every)
    rows = np.broadcast_to(every.sum(axis=1)[:, None, None], removed.shape)
    return np.stack((removed, fails - removed, alone, summed(good), summed(toxic), rows))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, mask, good, toxic) to partial sums (part, filter_order, step, COUNTS), for the parts of a task."""
    held: dict[str, np.ndarray] = {}

    def told() -> pa.RecordBatch:
        k = len(ORDERS) * STEPS
        out = removals(np.stack(list(held.values()))).reshape(len(COUNTS), -1)
        names = pa.array(list(held)).take(pa.array(np.repeat(np.arange(len(held)), k)))
        orders = pa.array(ORDERS).take(pa.array(np.tile(np.repeat(np.arange(len(ORDERS)), STEPS), len(held))))
        step = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(held) * len(ORDERS)))
        return pa.RecordBatch.from_arrays([names, orders, step, *map(pa.array, out)], names=["part", "filter_order", "step", *COUNTS])

    for batch in batches:
        part = batch.column(0).dictionary_encode()
        code, mask, good, toxic = (np.asarray(x) for x in (part.indices, batch.column(1), batch.column(2), batch.column(3)))
        cell = ((code.astype(np.int64) * MASKS + mask) * 2 + good) * 2 + toxic
        hist = np.bincount(cell, minlength=len(part.dictionary) * MASKS * 4).reshape(-1, MASKS, 2, 2)
        for name, own in zip(part.dictionary.to_pylist(), hist, strict=True):
            held[name] = held[name] + own if name in held else own
        if len(held) > PARTS:
            yield told()
            held = {}
    if held:
        yield told()


def flagged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """For each row of docs: part, mask (of the filters that it fails, A to E from the lowest bit), good and toxic (0 or 1).

    Texts are scanned once. Equal texts meet as digests: frequent ones, found by a Misra-Gries summary and verified, are settled where they are read;
    all others are shuffled once. A row without a key has no label, and is neither a smaller nor a larger one, so E passes it. Of several labels of
    one key each counts: a row is good, or toxic, if one says so.
    """
    with scratch() as tables:
        source = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
        kind = dict(source.dtypes)["_key"]
        rows = materialize(source.mapInArrow(_scan, f"_key {kind}, part string, mask int, digest binary"), "masks")
        total = [F.min("_key").alias("_first"), F.count(F.lit(1)).alias("group_size")]
        often = misra_gries(rows.withColumn("_copies", F.lit(1).cast("long"))).select("digest")
        winners = materialize(rows.join(F.broadcast(often), "digest", "left_semi").groupBy("digest").agg(*total), "winners")
        keep(tables, rows, winners)
    heavy, rest = split_heavy(rows, winners)
    rest = rest.repartition("digest")
    rest = rest.join(rest.groupBy("digest").agg(*total), "digest")
    names = ("_key", "part", "mask", "_first")
    every = heavy.select(*names).unionByName(rest.select(*names))
    last = F.when(F.col("_key") > F.col("_first"), F.lit(1 << 4)).otherwise(F.lit(0))
    every = every.select("_key", "part", F.col("mask").bitwiseOR(last).alias("mask"))
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
    known = every.where("_key is not null").join(said, "_key", "left")
    unknown = every.where("_key is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return known.unionByName(unknown).select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """For each part of docs, each order of the filters A to E and each step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A: under 100 words, which ASCII white space parts. B: under 80 distinct words in 100. C: over 10 capitals A-Z in 100 code points. D: one of #$%&*|.
    E: the text of a smaller key, anywhere in docs and whether that row was removed or not. Null and empty texts are one text, without words; a null
    part is the empty string; repeated rows are rows of their own, and neither is smaller. Without rows there is no part and so no result.

    Each task counts its rows by part, mask of failures and label, looks up the step that removes each mask in each of the 120 orders in FIRST, and sums
    that with bincount; Spark then adds up the tasks' sums, 600 rows a part. So a part of any size costs no shuffle of its rows.
    """
    shape = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    sums = flagged(docs, labels, key, text, part).mapInArrow(_count, shape).groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
    order = Window.partitionBy("part", "filter_order").orderBy("step")
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    out = sums.withColumns({"kept": F.col("rows") - F.sum("removed").over(order), "shapley": F.sum("removed").over(of_filter)})
    return out.select("part", "filter_order", "step", "kept", *COUNTS[:-1], "shapley")


def op13(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM w GROUP BY 1),
l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
  FROM w JOIN first USING (t) LEFT JOIN l USING (doc_id)),
h AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || p.x || q.x || r.x AS filter_order FROM c a, c b, c p, c q, c r WHERE len(list_distinct([a.x, b.x, p.x, q.x, r.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
x AS (SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS letter, f[ascii(substr(filter_order, step, 1)) - 64] AS fails,
  list_contains([f[ascii(substr(filter_order, i, 1)) - 64] FOR i IN range(1, step)], true) AS gone, len(list_filter(f, lambda y: y)) AS failed FROM h, s),
y AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::bigint AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::bigint AS removed,
  sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::bigint AS redundant, sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END)::bigint AS unique_fails,
  sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::bigint AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley FROM y
"""
