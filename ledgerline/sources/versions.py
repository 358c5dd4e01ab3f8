"""Tables of versions under a folder: buckets of a key, of which a change rewrites those that it touches, and appends that happen once."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one that the session names, or a temporary one where all run in one process."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-ledgerline-")


class Folder:
    """A folder of any file system that Spark reaches, and how a piece of it becomes visible: by one rename, which never replaces anything."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.at("").getFileSystem(self._conf())

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        """What lies in a folder, if it is there, without what is being written."""
        found = self.at(name)
        return sorted(n for s in self.fs.listStatus(found) if not (n := s.getPath().getName()).startswith(".")) if self.fs.exists(found) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def commit(self, df: DataFrame, name: str) -> bool:
        """Write a small table and show it under a name at once; False, and nothing changes, if that is taken already."""
        parent, _, last = name.rpartition("/")
        part = f"{parent}/.{last}-{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(f"{self.path}/{part}")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), self._conf())
        try:
            if self.fs.exists(self.at(name)):
                return False
            context.rename(self.at(part), self.at(name), self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        finally:
            self.remove(part)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a key: 32 bits of its MD5, which any engine can recompute; nulls count as empty."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


class BucketedTable:
    """A keyed table whose rows lie in buckets by a hash of the key, under path/v=<version>/b=<bucket>.

    Each version has a manifest, path/_manifest/<version>, which says for each bucket the version that wrote it. A change reads and rewrites
    only the buckets of its keys, and its manifest points to the older files for all others. The manifest is put in place by one rename after the data, so
    readers see a version whole or not at all; a job that is lost leaves files that no manifest names, and its retry replaces them. One
    writer a table at a time; of two that write one version, the second is told so. Of the driver's, only the manifest, a row a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        """buckets: of a table that is new; a table that is there keeps its own."""
        self.spark, self.keys, self.folder = spark, list(keys), Folder(spark, path)
        self.path, self.buckets = self.folder.path, buckets
        if found := self.versions():
            self.buckets = json.loads(self._manifest(found[-1])[1])["buckets"]

    def versions(self) -> list[int]:
        return sorted(int(v) for v in self.folder.names("_manifest"))

    def _manifest(self, version: int) -> tuple[dict[int, tuple[int, int]], str]:
        """{bucket: (version, rows)} and the shape."""
        rows = self.spark.read.parquet(f"{self.path}/_manifest/{version}").collect()
        return {r["bucket"]: (r["v"], r["n"]) for r in rows if r["bucket"] >= 0}, next(r["shape"] for r in rows if r["bucket"] < 0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(bucket, v, n): the version that wrote each bucket, and its rows."""
        version = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(f"{self.path}/_manifest/{version}").where("bucket >= 0").select("bucket", "v", "n")

    def _read(self, places: dict[int, tuple[int, int]], shape: str) -> DataFrame:
        said = json.loads(shape)
        own = StructType.fromJson(said["schema"])
        if not places:
            return self.spark.createDataFrame([], own)
        return self.spark.read.schema(own).parquet(*[f"{self.path}/v={v}/{said['place']}={b}" for b, (v, _) in sorted(places.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        return self._read(*self._manifest(self.versions()[-1] if version is None else version))

    def bucket(self) -> Column:
        """The bucket of a row, which manifest() tells more of."""
        return bucket_of(self.keys, self.buckets)

    def apply(self, changes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None) -> int:
        """The next version: step(state, changes) of the buckets that changes touch, where it gives their next rows. Returns its number.

        A number that is there already is left as it is, so a batch that comes again changes nothing. The first version is made of changes alone.
        """
        have = self.versions()
        number = (have[-1] + 1 if have else 0) if number is None else number
        if number in have:
            return number
        before = [v for v in have if v < number]
        place = "b"
        while place in changes.columns:
            place += "_"
        places, shape = self._manifest(before[-1]) if before else ({}, json.dumps({"schema": changes.schema.jsonValue(), "buckets": self.buckets, "place": place}))
        place = json.loads(shape)["place"]
        name = f"_changes/{number}"
        changes.write.mode("overwrite").parquet(f"{self.path}/{name}")
        held = self.spark.read.schema(changes.schema).parquet(f"{self.path}/{name}")
        touched = {r["b"] for r in held.select(self.bucket().alias("b")).distinct().collect()}
        state = self._read({b: p for b, p in places.items() if b in touched}, shape)
        written = step(state, held).withColumn(place, self.bucket()).repartition(place)
        written.write.mode("overwrite").partitionBy(place).parquet(f"{self.path}/v={number}")
        at = {b: (number, 0) for b in touched if self.folder.names(f"v={number}/{place}={b}")}
        sizes = self._read(at, shape).groupBy(self.bucket().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {r["b"]: (number, r["n"]) for r in sizes}
        rows = [(b, v, n, None) for b, (v, n) in ({b: p for b, p in places.items() if b not in touched} | counts).items()]
        if not self.folder.commit(self.spark.createDataFrame([*rows, (-1, number, 0, shape)], "bucket int, v long, n long, shape string"), f"_manifest/{number}"):
            raise FileExistsError(f"{self.path}: version {number} was written by another")
        self.folder.remove(name)
        return number

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the newest manifests, and the buckets that none of these names."""
        have = self.versions()
        for v in have[:-keep]:
            self.folder.remove(f"_manifest/{v}")
        named = {(v, b) for m in have[-keep:] for b, (v, _) in self._manifest(m)[0].items()}
        gone = []
        for folder in self.folder.names(""):
            if folder.startswith("v=") and int(folder[2:]) <= max(have, default=-1):
                for b in self.folder.names(folder):
                    if b.startswith("b") and (int(folder[2:]), int(b.partition("=")[2])) not in named:
                        self.folder.remove(f"{folder}/{b}")
                        gone.append(f"{folder}/{b}")
        return gone


class OnceLog:
    """Appends of which each batch counts once: path/batch=<id> holds the rows, and path/_done/<id> says that they count.

    A batch whose mark is there is not written again. One that was cut off has no mark, so its rows are seen by nobody, and a retry replaces them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder, self.path = spark, Folder(spark, path), path.rstrip("/")

    def done(self) -> list[str]:
        return self.folder.names("_done")

    def append(self, df: DataFrame, batch: str | int, when: str | None = None) -> bool:
        """Write a batch, by days of `when` if that is named; False if it was written before."""
        if str(batch) in self.done():
            return False
        rows = df if when is None else df.withColumn("day", F.to_date(when)).repartition("day")
        writer = rows.write.mode("overwrite")
        (writer if when is None else writer.partitionBy("day")).parquet(f"{self.path}/batch={batch}")
        schema = rows.schema.json()
        return self.folder.commit(self.spark.createDataFrame([(str(batch), schema)], "batch string, shape string"), f"_done/{batch}")

    def read(self) -> DataFrame:
        """The rows of all batches that count, with batch."""
        if not (done := self.done()):
            raise FileNotFoundError(f"{self.path} has no batch")
        schema = StructType.fromJson(json.loads(self.spark.read.parquet(f"{self.path}/_done/{done[0]}").first()["shape"]))
        full = StructType([*[f for f in schema.fields if f.name != "batch"], *StructType.fromDDL("batch string").fields])
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*[f"{self.path}/batch={b}" for b in done])

    def sink(self, when: str | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that the stream repeats counts once."""
        return lambda df, number: self.append(df, number, when) and None
