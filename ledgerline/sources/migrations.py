"""Schema migrations of a table under a folder: an ordered log of steps that can be resumed, with checks before and after each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.registry import query
from ledgerline.sources.ledger import Ledger
from ledgerline.sources.versions import Folder, shared_folder

KINDS = ("add", "rename", "backfill", "drop")


@dataclass(frozen=True)
class Step:
    """A change of a column. add: value is its type; rename: its new name; backfill: the expression of its new values; drop: nothing.

    before and after are conditions that all rows meet before, and after, the step; a null does not meet one.
    """

    name: str
    kind: str
    column: str
    value: str | None = None
    before: str | None = None
    after: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of step {self.kind}")


class MigrationFailed(ValueError):
    """A step that could not be done; those before it are, and the table is as they left it."""


def stepped(df: DataFrame, step: Step) -> DataFrame:
    """df after a step, by an expression alone."""
    has = step.column in df.columns
    if step.kind == "add":
        if has:
            raise MigrationFailed(f"{step.name}: {step.column} is there already")
        return df.withColumn(step.column, F.lit(None).cast(step.value))
    if not has:
        raise MigrationFailed(f"{step.name}: there is no {step.column}")
    if step.kind == "rename":
        if step.value in df.columns:
            raise MigrationFailed(f"{step.name}: {step.value} is there already")
        return df.withColumnRenamed(step.column, step.value)
    if step.kind == "drop":
        return df.drop(step.column)
    return df.withColumn(step.column, F.expr(step.value).cast(df.schema[step.column].dataType))


class MigratedTable:
    """Parquet versions under path/v=<n> and a log under path/_steps/<n>, whose entries appear by one rename.

    Adding, renaming and dropping columns writes no data: a reader applies them to the last version that was written as expressions, which Spark prunes and
    pushes down. Only a backfill writes a version. A step counts once its entry is there: one that failed, or was cut off, is done again by the next
    run(), which goes on behind the last entry. Steps that were done may not change.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder, self.path = spark, Folder(spark, path), path.rstrip("/")

    def create(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v=0")
        self._enter(0, None, 0, df.schema, self.spark.read.parquet(f"{self.path}/v=0").count())

    def _enter(self, n: int, step: Step | None, base: int, schema: StructType, rows: int) -> None:
        entry = (n, json.dumps(asdict(step)) if step else None, base, schema.json(), rows)
        if not self.folder.commit(self.spark.createDataFrame([entry], "n int, step string, base int, shape string, rows long"), f"_steps/{n:06d}"):
            raise MigrationFailed(f"step {n} was done by another")

    def _entries(self) -> list:
        """A row a step: a short list."""
        return self.spark.read.parquet(f"{self.path}/_steps/*").orderBy("n").collect() if self.folder.names("_steps") else []

    def read(self, n: int | None = None) -> DataFrame:
        """The table after step n, or after all."""
        entries = [e for e in self._entries() if n is None or e["n"] <= n]
        base = entries[-1]["base"]
        df = self.spark.read.schema(StructType.fromJson(json.loads(next(e["shape"] for e in entries if e["n"] == base)))).parquet(f"{self.path}/v={base}")
        for e in entries:
            if e["n"] > base:
                df = stepped(df, Step(**json.loads(e["step"])))
        return df

    def log(self) -> DataFrame:
        """(n, name, kind, column, base, rows) of the steps that are done; base is the version whose files the table then has."""
        said = F.from_json("step", "name string, kind string, column string")
        rows = self.spark.read.parquet(f"{self.path}/_steps/*")
        return rows.where("n > 0").select("n", said["name"].alias("name"), said["kind"].alias("kind"), said["column"].alias("column"), "base", "rows")

    def _check(self, df: DataFrame, step: Step, condition: str | None, when: str) -> None:
        if condition is not None and (bad := df.where(~F.coalesce(F.expr(condition), F.lit(False))).count()):
            raise MigrationFailed(f"{step.name}: {bad} rows do not meet {condition} {when}")

    def run(self, steps: Sequence[Step]) -> int:
        """Do the steps that are not done yet, in order; how many these were."""
        entries = self._entries()
        for e, step in zip(entries[1:], steps, strict=False):
            if json.loads(e["step"]) != asdict(step):
                raise MigrationFailed(f"{step.name}: step {e['n']} was done in another form")
        todo = list(steps)[len(entries) - 1 :]
        for n, step in enumerate(todo, len(entries)):
            df, base = self.read(), entries[-1]["base"]
            self._check(df, step, step.before, "before")
            new = stepped(df, step)
            if step.kind == "backfill":
                base = n
                new.write.mode("overwrite").parquet(f"{self.path}/v={n}")
                new = self.spark.read.schema(new.schema).parquet(f"{self.path}/v={n}")
            rows = new.count()
            if rows != entries[-1]["rows"]:
                raise MigrationFailed(f"{step.name}: {entries[-1]['rows']} rows have become {rows}")
            self._check(new, step, step.after, "after")
            self._enter(n, step, base, new.schema, rows)
            entries = self._entries()
        return len(todo)


def _migrated(db: Ledger) -> MigratedTable:
    """Orders through five steps, of which the third fails at first and is mended, so the run is resumed."""
    table = MigratedTable(db.spark, f"{shared_folder(db.spark)}/migrated-{uuid.uuid4().hex}")
    table.create(db.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    steps = [
        Step("urgency", "add", "urgency", "int"),
        Step("owner", "rename", "o_custkey", "owner_id", before="o_custkey >= 0"),
        Step("fill urgency", "backfill", "urgency", "CASE WHEN o_orderstatus <> 'F' THEN cast(substring(o_orderpriority, 1, 1) AS int) END", after="urgency BETWEEN 1 AND 5"),
        Step("no priority", "drop", "o_orderpriority"),
        Step("double", "backfill", "urgency", "urgency * 2", before="urgency < 6", after="urgency >= 2"),
    ]
    try:
        table.run(steps)
    except MigrationFailed:
        steps[2] = Step("fill urgency", "backfill", "urgency", "cast(substring(o_orderpriority, 1, 1) AS int)", after="urgency BETWEEN 1 AND 5")
        table.run(steps)
    return table


@query("orders_migrated", "SELECT o_orderkey, o_custkey AS owner_id, o_orderstatus, (substr(o_orderpriority, 1, 1)::int * 2)::int AS urgency FROM orders")
def _orders(db: Ledger):
    return _migrated(db).read()


@query("migration_log", "SELECT n::int AS n, name, kind, c AS column, base::int AS base, (SELECT count(*) FROM orders) AS rows FROM (VALUES (1, 'urgency', 'add', 'urgency', 0), (2, 'owner', 'rename', 'o_custkey', 0), (3, 'fill urgency', 'backfill', 'urgency', 3), (4, 'no priority', 'drop', 'o_orderpriority', 3), (5, 'double', 'backfill', 'urgency', 5)) t(n, name, kind, c, base)")
def _log(db: Ledger):
    """The log of the run above: the failed attempt left no entry, and only backfills wrote files."""
    return _migrated(db).log()
