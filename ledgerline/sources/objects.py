"""Objects copied from one store to another by a Spark job: tasks stream them in parts, hash them on the way and read them back."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.registry import query
from ledgerline.sources.ledger import Ledger
from ledgerline.sources.versions import shared_folder

#: Bytes of an object that a task holds at once.
PART = 8 << 20
RESULT = "key string, source string, target string, size long, sha256 string, state string, error string"
#: What becomes of the source of an object that is safe at its target.
SOURCES = ("keep", "delete", "trash")


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type == fs.FileType.File


def _digest(store, path: str) -> tuple[str, int]:
    sha, size = hashlib.sha256(), 0
    with store.open_input_stream(path) as stream:
        while part := stream.read(PART):
            sha.update(part)
            size += len(part)
    return sha.hexdigest(), size


def _put(parts: Iterator[bytes], target: str) -> tuple[str, int]:
    """Write parts under a name of this attempt, then move them to the target: what is there is whole, whichever attempt put it there."""
    store, path = _at(target)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part, sha, size = f"{folder}/.{name}.{uuid.uuid4().hex}", hashlib.sha256(), 0
    try:
        with store.open_output_stream(part) as out:
            for piece in parts:
                out.write(piece)
                sha.update(piece)
                size += len(piece)
        store.move(part, path)
    except BaseException:
        if _there(store, part):
            store.delete_file(part)
        raise
    return sha.hexdigest(), size


def _pieces(store, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path) as stream:
        while part := stream.read(PART):
            yield part


def _copy(key: str, source: str, target: str, expected: str | None, had: bool, replace: bool, remove: str, trash: str | None, dry: bool) -> tuple:
    """One object: (size, sha256, state, error)."""
    try:
        (a, start), (b, end) = _at(source), _at(target)
        if not _there(a, start):
            if not had and remove != "keep" and expected and _there(b, end) and _digest(b, end)[0] == expected:
                return (*_digest(b, end)[::-1], "verified", None)  # an attempt before this one has moved it
            return None, None, "missing", None
        sha, size = _digest(a, start)
        if expected and sha != expected.lower():
            return size, sha, "mismatch", None
        if dry:
            return size, sha, "pending", None
        here = _there(b, end)
        if here and _digest(b, end)[0] == sha:
            state = "skipped" if had else "verified"
        elif had and not replace:
            return size, sha, "conflict", None
        else:
            _put(_pieces(a, start), target)
            state = "verified"
            if _digest(b, end) != (sha, size):
                return size, sha, "failed", "the target is not what was read"
        if remove == "trash":
            store, path = _at(f"{trash}/{key}")
            store.create_dir(path.rpartition("/")[0], recursive=True)
            _put(_pieces(a, start), f"{trash}/{key}")
        if remove != "keep" and state == "verified":
            a.delete_file(start)
        return size, sha, state, None
    except Exception as e:  # of any store: the row says what it was
        return None, None, "failed", f"{type(e).__name__}: {e}"[:300]


def copied(plan: DataFrame, path: str, replace: bool = False, sources: str = "keep", trash: str | None = None, dry_run: bool = False, tasks: int | None = None) -> DataFrame:
    """Copy the objects of plan (key, source, target, sha256) and return a row for each, which is also a table at path: key, source, target, size, sha256, state, error.

    source and target are uris of any store that Arrow reaches; sha256 is what the object should have, or null. States: verified (copied, and read
    back equal), skipped (the target was there with the same content), conflict (with another one, and replace is not set), missing, mismatch (the source
    is not what it should be), failed, with an error; with dry_run nothing is written, and pending is what would be copied. sources: keep, delete or
    trash, which puts them below trash; only verified objects go.

    Which targets are there before is written first. So a task that runs again, after its executor was lost, gives the row that it would have given: an
    object that this job has put there counts as verified. A task holds a part of one object. Objects are dealt by hash; a null or repeated key is a row of its own.
    """
    if sources not in SOURCES or (sources == "trash" and not trash):
        raise ValueError(f"unknown or incomplete way with sources: {sources}")
    spark = plan.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_there(*_at(t.as_py())) if t.is_valid else False for t in batch.column("target")])], names=[*batch.schema.names, "had"])

    rows = plan.select("key", "source", "target", F.lower("sha256").alias("sha256")).repartition(tasks, F.xxhash64("key", "source"))
    rows.mapInArrow(look, "key string, source string, target string, sha256 string, had boolean").write.mode("overwrite").parquet(f"{path}/before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [(k, s, t, *(_copy(k, s, t, sha, had, replace, sources, trash, dry_run) if s and t else (None, None, "failed", "no uri"))) for k, s, t, sha, had in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*said, strict=True) if said else [[]] * 7, (*[pa.string()] * 3, pa.int64(), *[pa.string()] * 3), strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    before = spark.read.parquet(f"{path}/before").repartition(tasks, F.xxhash64("key", "source"))
    before.mapInArrow(run, RESULT).write.mode("overwrite").parquet(f"{path}/result")
    return spark.read.schema(RESULT).parquet(f"{path}/result")


def stored(rows: DataFrame, root: str) -> DataFrame:
    """Write rows (key, content) as objects below root; (key, uri, size, sha256) of each, as they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, f"{root}/{k}", *_put(iter([c or b""]), f"{root}/{k}")[::-1]) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "uri", "size", "sha256"])

    return rows.select(F.col("key").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "key string, uri string, size long, sha256 string")


def read_back(uris: DataFrame, path: str, tasks: int | None = None) -> DataFrame:
    """(uri, size, sha256) of the objects of uris (uri) that are there, empty ones too, which is also a table at path. Each is hashed in parts by the task that its uri is dealt to, and no folder is listed."""
    spark = uris.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = [(u, *_digest(*at)[::-1]) for u in batch.column(0).to_pylist() if _there(*(at := _at(u)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*there, strict=True) if there else [[]] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["uri", "size", "sha256"])

    dealt = uris.select("uri").where("uri is not null").distinct().repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("uri"))
    dealt.mapInArrow(run, "uri string, size long, sha256 string").write.mode("overwrite").parquet(path)
    return spark.read.schema("uri string, size long, sha256 string").parquet(path)


def summary(results: DataFrame) -> DataFrame:
    """(state, n, bytes) of copied objects."""
    return results.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def with_new_uris(rows: DataFrame, results: DataFrame, column: str = "uri") -> DataFrame:
    """rows with the uri of the copy, where the object is safe there: what verified and skipped rows say. Several rows may name one object."""
    new = results.where(F.col("state").isin("verified", "skipped")).groupBy(F.col("source").alias(column)).agg(F.min("target").alias("_to"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("_to", column)).select(*rows.columns)


def _key():
    """The object of a document: its id and the hash of its text, as an id may be null or that of several texts."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("_"), F.sha2(F.coalesce("text", F.lit("")), 256))


def _plan(db: Ledger, root: str) -> DataFrame:
    """Texts as objects, of which some are not there, some are not what the ledger says, and some targets are there already, right or wrong."""
    docs = db.raw("documents").select(_key().alias("key"), F.coalesce("doc_id", F.lit(2)).alias("n"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    n = F.col("n")
    stored(docs.where(n % 11 != 0), f"{root}/source").write.format("noop").mode("overwrite").save()
    stored(docs.where(n % 7 == 0), f"{root}/target").write.format("noop").mode("overwrite").save()
    stored(docs.where(n % 7 == 1).withColumn("content", F.lit(b"another")), f"{root}/target").write.format("noop").mode("overwrite").save()
    sha = F.when(n % 5 == 0, F.sha2(F.concat(F.col("content"), F.lit(b"!")), 256)).when(n % 5 != 1, F.sha2("content", 256))
    uri = lambda place: F.concat(F.lit(f"{root}/{place}/"), "key")
    return docs.select("key", uri("source").alias("source"), uri("target").alias("target"), sha.alias("sha256"))


_STATES = """, ob AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'mismatch' WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 7 = 1 THEN CASE WHEN coalesce(text, '') = 'another' THEN 'skipped' ELSE 'conflict' END ELSE 'verified' END AS state FROM documents)
"""


def _copied(db: Ledger) -> tuple[str, DataFrame]:
    root = f"{shared_folder(db.spark).removeprefix('file://').rstrip('/')}/objects-{uuid.uuid4().hex}"
    return root, copied(_plan(db, root), f"{root}/log")


@query("objects_copied", _STATES + "SELECT doc_id AS blob_id, state, CASE WHEN state <> 'missing' THEN octet_length(encode(t))::bigint END AS size, CASE WHEN state <> 'missing' THEN sha256(t) END AS sha256 FROM ob")
def _objects(db: Ledger):
    """Every text of the documents as an object that is copied from one folder to another."""
    return _copied(db)[1].select(F.split_part("key", F.lit("_"), F.lit(1)).try_cast("long").alias("blob_id"), "state", "size", "sha256")


@query("objects_after_copy", _STATES + "SELECT doc_id AS blob_id, CASE WHEN state IN ('verified', 'skipped') THEN 'target' ELSE 'source' END AS place, state IN ('verified', 'skipped') AS safe FROM ob")
def _after(db: Ledger):
    """The uris after the copy, and whether what is read back at the target is the text's content."""
    root, results = _copied(db)
    files = read_back(results.select(F.col("target").alias("uri")), f"{root}/there").select("uri", F.col("sha256").alias("_sha"))
    docs = db.raw("documents").select(F.col("doc_id").alias("blob_id"), F.concat(F.lit(f"{root}/source/"), _key()).alias("uri"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    moved = with_new_uris(docs, results).withColumn("place", F.element_at(F.split("uri", "/"), -2))
    return moved.join(files, "uri", "left").select("blob_id", "place", F.coalesce((F.col("place") == "target") & (F.col("_sha") == F.col("sha256")), F.lit(False)).alias("safe"))
