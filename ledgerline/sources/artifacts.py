"""An artifact store on any file system that Spark reaches: single objects through the Hadoop API, many through DataFrames."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.joins import normalized_key


@dataclass(frozen=True)
class ArtifactInfo:
    key: str
    size: int
    sha256: str


class ArtifactStore:
    """Objects below a root. Writes go to a temporary name and are put in place by a rename; keys stay below the root."""

    def __init__(self, spark: SparkSession, root: str, overwrite: str = "same", prefixes: tuple[str, ...] = ()):
        """overwrite: never, same (only with the same content) or always; prefixes: where keys may be, everywhere if empty."""
        if overwrite not in ("never", "same", "always"):
            raise ValueError(f"unknown overwrite policy {overwrite}")
        self.spark, self.root, self.overwrite, self.prefixes = spark, root.rstrip("/"), overwrite, prefixes
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, key: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def _key(self, key: str) -> str:
        parts: list[str] = []
        for p in key.removeprefix("artifact://").replace("\\", "/").split("/"):
            if p == ".." and parts:
                parts.pop()
            elif p == "..":
                raise ValueError(f"{key} leaves the store")
            elif p not in ("", "."):
                parts.append(p)
        clean = "/".join(parts)
        if not clean or (self.prefixes and not clean.startswith(self.prefixes)):
            raise ValueError(f"{key} is not allowed")
        return clean

    def exists(self, key: str) -> bool:
        return self.fs.exists(self._path(self._key(key)))

    def get(self, key: str) -> bytes:
        stream = self.fs.open(self._path(self._key(key)))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def info(self, key: str) -> ArtifactInfo:
        """Size and hash, which a task reads: the content does not come to the driver."""
        clean = self._key(key)
        row = self.spark.read.format("binaryFile").load(f"{self.root}/{clean}").select("length", F.sha2("content", 256).alias("sha256")).first()
        return ArtifactInfo(clean, row["length"], row["sha256"])

    def put_file(self, key: str, source: str) -> None:
        """Store a file of any file system that Spark reaches: a stream from one to the other in bounded parts, put in place by a rename."""
        clean = self._key(key)
        target, part, origin = self._path(clean), self._path(f"{clean}.copy.tmp"), self.jvm.org.apache.hadoop.fs.Path(source)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        if self.fs.exists(target) and self.overwrite == "never":
            raise FileExistsError(clean)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(origin.getFileSystem(conf), origin, self.fs, part, False, True, conf)
        if self.fs.exists(target) and self.overwrite == "same" and self.info(f"{clean}.copy.tmp").sha256 != self.info(clean).sha256:
            self.fs.delete(part, False)
            raise FileExistsError(clean)
        self.fs.delete(target, False)
        self.fs.rename(part, target)

    def put(self, key: str, content: bytes, sha256: str | None = None) -> ArtifactInfo:
        """Store content; a given hash must be its own. What is there already stays or is replaced by the policy."""
        clean, digest = self._key(key), hashlib.sha256(content).hexdigest()
        if sha256 is not None and sha256.lower() != digest:
            raise ValueError(f"{key}: the content's hash is {digest}")
        target, part = self._path(clean), self._path(f"{clean}.{digest[:12]}.tmp")
        if self.fs.exists(target) and self.overwrite != "always":
            if self.overwrite == "never" or self.info(clean).sha256 != digest:
                raise FileExistsError(clean)
            return ArtifactInfo(clean, len(content), digest)
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        self.fs.delete(target, False)
        self.fs.rename(part, target)
        return ArtifactInfo(clean, len(content), digest)

    def parts(self, key: str, size: int = 8 << 20) -> Iterator[bytes]:
        """The content in parts of a bounded size."""
        stream = self.fs.open(self._path(self._key(key)))
        try:
            while part := bytes(stream.readNBytes(size)):
                yield part
        finally:
            stream.close()

    def put_parts(self, key: str, parts: Iterable[bytes], sha256: str | None = None) -> ArtifactInfo:
        """Store content that comes in parts, each written as it comes. The policy holds as for put(), once the hash of all is known."""
        clean, digest, size = self._key(key), hashlib.sha256(), 0
        target, part = self._path(clean), self._path(f"{clean}.{uuid.uuid4().hex[:12]}.tmp")
        out = self.fs.create(part, True)
        try:
            for piece in parts:
                out.write(bytearray(piece))
                digest.update(piece)
                size += len(piece)
        finally:
            out.close()
        done, there = ArtifactInfo(clean, size, digest.hexdigest()), self.fs.exists(target)
        wrong = sha256 is not None and sha256.lower() != done.sha256
        if wrong or (there and (self.overwrite == "never" or (self.overwrite == "same" and self.info(clean).sha256 != done.sha256))):
            self.fs.delete(part, False)
            if wrong:
                raise ValueError(f"{key}: the content's hash is {done.sha256}")
            raise FileExistsError(clean)
        self.fs.delete(target, False)
        self.fs.rename(part, target)
        return done

    def listing(self) -> DataFrame:
        """(key, path, size, modified_at) of all objects."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
        bare = self._path("").toUri().getPath()
        return raw.select(normalized_key(F.element_at(F.split("path", bare + "/", 2), -1)).alias("key"), "path", "size", "modified_at").where(~F.col("path").endswith(".tmp"))
