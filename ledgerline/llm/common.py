"""Small helpers that the operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a row group of a table: a task that writes large rows holds one group.
GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where all run in one process, one of our own if that is unset."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return found
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ledgerline-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and survives lost executors."""
    return gathered([df], name)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """materialize() of parts of one schema, each written as its turn comes: one table, so that later plans don't grow with the number of parts."""
    path = None
    for df in parts:
        path = path or f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.mode("append").option("parquet.block.size", GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    if (held := _scope.get()) is not None:
        held.append(out)
    return out


class Held(list):
    """Tables of a scope, and those that were taken from it."""

    def __init__(self) -> None:
        super().__init__()
        self.kept: list[DataFrame] = []


_scope: ContextVar[Held | None] = ContextVar("_scope", default=None)


@contextmanager
def scratch() -> Iterator[Held]:
    """Within, tables of materialize() are kept in a list; those that are still in it at the end are removed.

    Each thread has its own list. What a lazy result still reads is taken from it with keep(), and belongs to the scope around, if there is one.
    """
    outer = _scope.get()
    token = _scope.set(held := Held())
    try:
        yield held
    finally:
        _scope.reset(token)
        discard(*held)
        if outer is not None:
            outer.extend(held.kept)


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """Within, the shuffle files of a job go as it ends; else they stay until the driver happens to collect its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, rows: int):
    """Within, jobs hand their rows to Python so many at a time: of large rows, a batch lies in the executor and in its Python worker."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidied(spark: SparkSession) -> None:
    """Let the driver collect its garbage, which Spark's cleaner does each half hour: plans and broadcasts of jobs that have ended go, and its heap stays small."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep(held: Held, *tables: DataFrame) -> None:
    """Take tables from the list of a scope: something lazy reads them."""
    for df in tables:
        held[:] = [x for x in held if x is not df]
        held.kept.append(df)


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def consumed(df: DataFrame, parts: int) -> Iterator[DataFrame]:
    """A table of materialize() in up to so many parts, each of some of its files, which are removed as the next part is asked for: what is made of them takes their place."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    parts = min(parts, len(files))
    for i in range(parts if parts > 1 else 0):
        some = files[i::parts]
        yield spark.read.schema(df.schema).parquet(*some)
        for name in some:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, False)
    if parts <= 1:
        yield df
    discard(df)


def unused(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, key: str, rest: str) -> StructType:
    """The schema of df's key and of the columns in rest, which is DDL."""
    return StructType([df.schema[key], *StructType.fromDDL(rest).fields])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def hash52(*parts: Column) -> Column:
    """A number from 0 to 2**52 - 1 that any SQL engine with MD5 can recompute; nulls count as empty."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10).cast("long")


def _merged(kind: str, a: Column, b: Column) -> Column:
    both = {"sum": lambda: a + b, "max": lambda: F.greatest(a, b), "xor": lambda: a.bitwiseXOR(b)}[kind]()
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def scanned(df: DataFrame, group: Sequence[str], order: Sequence[Column], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with, for each name, the sum, max or xor of a column over the rows that come before a row in its group; null where there are none.

    Rows are sorted into ranges of (group, order), so one large group is spread over many tasks: each range is summed inside, and of the few groups
    that reach over several ranges, two a range at most, the sums of the ranges before are added.
    """
    agg = {"sum": F.sum, "max": F.max, "xor": F.bit_xor}
    held = materialize(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_p", F.spark_partition_id()), "ranges")
    ends = held.groupBy("_p").agg(F.min(F.struct(*group)).alias("a"), F.max(F.struct(*group)).alias("z"))
    wide = ends.select("_p", F.explode(F.array_distinct(F.array("a", "z"))).alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_g.*")
    total = held.join(F.broadcast(wide), [*group], "left_semi").groupBy(*group, "_p").agg(*[agg[k](c).alias(name) for name, (k, c) in values.items()])
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = materialize(total.select(*group, "_p", *[agg[k](name).over(earlier).alias(f"_of_{name}") for name, (k, _) in values.items()]), "offsets")
    before = Window.partitionBy(*group, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumns({name: agg[k](c).over(before) for name, (k, c) in values.items()})
    out = local.join(F.broadcast(offset), [*group, "_p"], "left")
    return out.select(*df.columns, *[_merged(k, F.col(name), F.col(f"_of_{name}")).alias(name) for name, (k, _) in values.items()])
