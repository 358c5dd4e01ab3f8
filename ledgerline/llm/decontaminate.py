"""Benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.llm.common import keep, keyed, LOWER, materialize, scratch, table, UPPER

#: Words of a window. A benchmark of more bytes of text than this is dealt to blocks of about so many, and each block is a pass of its own. A window
#: word takes two nodes of 50 bytes, so a block takes 200 MB, and 600 MB at most, where all words are single letters.
WINDOW = 10
BLOCK_BYTES = 1 << 20
#: Texts that a task holds as words at once.
ROWS = 256

#: ASCII other than 0-9, a-z becomes a blank and A-Z small letters; bytes of other characters stay, so words keep their bytes.
_FOLD = bytes(
    c + 32 if chr(c) in UPPER else c if chr(c) in LOWER + "0123456789" or c >= 0x80 else 0x20
    for c in range(256)
)


def item_windows(text: str | None, n: int = WINDOW) -> list[bytes]:
    """The windows of an item: n consecutive words each; all its words if they are fewer; none without words."""
    words = (text or "").encode().translate(_FOLD).split()
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


class Automaton:
    """Finds windows in a text. It runs over words: each word of a window has a number and stands as two characters, its digits to the base 256."""

    NONE = "\0\0"

    def __init__(self, windows: dict[bytes, set[str]]):
        self.code: dict[bytes, str] = {}
        self.found = [(w.count(b" ") + 1, sorted(items)) for w, items in windows.items()]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(windows):
            self.machine.add_word("".join(self._name(x) for x in w.split(b" ")), i)
        self.machine.make_automaton()

    def _name(self, word: bytes) -> str:
        if (name := self.code.get(word)) is None:
            high, low = divmod(len(self.code), 256)
            self.code[word] = name = chr(0x200 + high) + chr(0x100 + low)
        return name

    def hits(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(first word, words, items) of each occurrence."""
        if not self.found or not words:
            return []
        get, none = self.code.get, self.NONE
        line = "".join([get(w, none) for w in words])
        return [((end >> 1) - self.found[i][0] + 1, *self.found[i]) for end, i in self.machine.iter(line)]


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each word in the text as it was."""
    raw = text.encode()
    folded = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 0x20
    edges = np.diff(np.concatenate(([False], folded, [False])).astype(np.int8))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    return chars[np.flatnonzero(edges == 1)], chars[np.flatnonzero(edges == -1)]


def _windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(item, text) to rows (window, item)."""
    for batch in batches:
        rows = [(w, item or "") for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in item_windows(t, n)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.string())], names=["window", "item"])


def _grouped(windows: pa.Table) -> dict[bytes, set[str]]:
    out: dict[bytes, set[str]] = {}
    for w, item in zip(windows["window"].to_pylist(), windows["item"].to_pylist(), strict=True):
        out.setdefault(w, set()).add(item)
    return out


SPANS = "array<struct<start: long, end: long>>"
_HITS, _SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("items", pa.list_(pa.string()))])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))


def _report(keys: pa.Array, name: str, texts: list, found: list) -> pa.RecordBatch:
    """The rows of find_contamination() for texts and the hits (first word, words, items) in each."""
    out: dict[str, list] = {"n_words": [], "n_hit": [], "items": [], "spans": []}
    for t, own in zip(texts, found, strict=True):
        n = len(t.encode().translate(_FOLD).split()) if t else 0
        spans, hit = [], np.zeros(0, dtype=bool)
        if own:
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, [start for start, *_ in own], 1)
            np.add.at(cover, [start + count for start, count, _ in own], -1)
            hit = np.cumsum(cover)[:-1] > 0
            first, end = word_offsets(t)
            edges = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
            spans = [{"start": int(first[a]), "end": int(end[z - 1])} for a, z in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]
        for column, value in zip(out.values(), (n, int(hit.sum()), sorted({i for *_, ids in own for i in ids}), spans), strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS)
    return pa.RecordBatch.from_arrays([keys, *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], names=[name, *out])


def find_contamination(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs: key, n_words, n_hit, items (sorted strings), spans (characters [start, end) of the text).

    Both sides are lower-cased (A-Z) and cut into words of 0-9, letters and all beyond ASCII. A word inside any occurrence of a window is hit; spans join
    hit words that touch. Null and empty texts have no words; null items count as the id ''; repeated rows each get
    their result; an empty benchmark hits nothing.

    A benchmark of up to block_bytes of text is one automaton, and each text is scanned once, without a shuffle. A larger one is a table of windows, dealt to
    blocks by hash; block after block, its windows alone are broadcast and a job over all texts writes what it finds, and the finds come back to the rows by
    a hash of the text. So a larger benchmark takes more passes, and neither the driver nor a task holds more than a block.
    """
    shape = keyed(docs, key, f"n_words long, n_hit long, items array<string>, spans {SPANS}")
    items = bench.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    windows = items.mapInArrow(lambda batches: _windows(batches, n), "window binary, item string")
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held > block_bytes:
        return _by_blocks(docs, windows, key, text, -(-held // block_bytes), shape)
    known = docs.sparkSession.sparkContext.broadcast(_grouped(windows.toArrow()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(known.value)
        for batch in _slices(batches):
            texts = batch.column(1).to_pylist()
            yield _report(batch.column(0), key, texts, [machine.hits(t.encode().translate(_FOLD).split()) if t else [] for t in texts])

    return docs.select(key, text).mapInArrow(scan, shape)


def _by_blocks(docs: DataFrame, windows: DataFrame, key: str, text: str, blocks: int, shape: StructType) -> DataFrame:
    """find_contamination() in a pass over the texts for each block of windows. Finds are a table of the few texts that have some."""
    spark = docs.sparkSession
    sign = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("and"), F.col(text)).alias("b"))
    texts = docs.select(sign.alias("sign"), F.col(text).alias("text"))
    with scratch() as tables:
        dealt = materialize(windows.distinct().withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks))), "windows")
        found = []
        for b in range(blocks):
            known = spark.sparkContext.broadcast(_grouped(dealt.where(F.col("block") == b).toArrow()))

            def scan(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
                machine = Automaton(known.value)
                for batch in _slices(batches):
                    rows = [(i, own) for i, t in enumerate(batch.column(1).to_pylist()) if t and (own := machine.hits(t.encode().translate(_FOLD).split()))]
                    hits = [[{"start": s, "words": k, "items": ids} for s, k, ids in own] for _, own in rows]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array(hits, _HITS)], names=["sign", "hits"])

            part = texts.mapInArrow(scan, "sign struct<a: long, b: long>, hits array<struct<start: int, words: int, items: array<string>>>")
            found.append(materialize(part.groupBy("sign").agg(F.first("hits").alias("hits")), "hits"))
            known.destroy()
        every = materialize(reduce(DataFrame.unionByName, found).groupBy("sign").agg(F.flatten(F.collect_list("hits")).alias("hits")), "found")
        keep(tables, every)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield _report(batch.column(0), key, batch.column(1).to_pylist(), [[tuple(h.values()) for h in own or ()] for own in batch.column(2).to_pylist()])

    held = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), sign.alias("sign"))
    return held.join(every, "sign", "left").select("_key", "_text", "hits").mapInArrow(report, shape)


def keep_uncontaminated(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs of which no word is hit, with all their columns."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    return find_contamination(held, bench, "_row", "_text").where("n_hit = 0").select("_row.*")


def op6(spark, sf_dir):
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
hi AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::varchar AS s FROM h) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
