"""Migrations: resumed after a failure, checked before and after, and without data written but by backfills."""

import pytest

from ledgerline.sources.migrations import MigratedTable, MigrationFailed, Step


@pytest.fixture
def table(spark, tmp_path):
    t = MigratedTable(spark, str(tmp_path / "t"))
    t.create(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string"))
    return t


STEPS = [
    Step("size", "add", "size", "int"),
    Step("title", "rename", "name", "title"),
    Step("fill", "backfill", "size", "length(title)", before="id > 0", after="size >= 1"),
    Step("no id", "drop", "id"),
]


def test_a_failed_step_is_resumed(table, tmp_path):
    with pytest.raises(MigrationFailed, match="fill: 1 rows do not meet size >= 1 after"):
        table.run(STEPS)
    assert table.read().columns == ["id", "title", "size"] and [r["size"] for r in table.read().collect()] == [None] * 3
    mended = [*STEPS[:2], Step("fill", "backfill", "size", "coalesce(length(title), 9)", after="size >= 1"), *STEPS[3:]]
    assert table.run(mended) == 2 and table.run(mended) == 0
    assert sorted(tuple(r) for r in table.read().collect() if r["title"]) == [("a", 1), ("b", 1)] and table.read(2).columns == ["id", "title", "size"]
    assert [(r["n"], r["kind"], r["base"], r["rows"]) for r in table.log().orderBy("n").collect()] == [(1, "add", 0, 3), (2, "rename", 0, 3), (3, "backfill", 3, 3), (4, "drop", 3, 3)]
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")) == ["v=0", "v=3"]


def test_a_step_that_was_cut_off(spark, table, tmp_path):
    """Files of a backfill without an entry are nobody's, and are replaced."""
    table.run(STEPS[:2])
    spark.createDataFrame([(7, "left", 7)], "id long, title string, size int").write.parquet(str(tmp_path / "t" / "v=3"))
    assert table.read().count() == 3
    table.run([*STEPS[:2], Step("fill", "backfill", "size", "1")])
    assert [r["size"] for r in table.read().collect()] == [1, 1, 1]


def test_what_may_not_be(table):
    table.run(STEPS[:1])
    for steps, said in (
        ([Step("size", "add", "size", "long")], "in another form"),
        ([STEPS[0], Step("again", "add", "SIZE".lower(), "int")], "there already"),
        ([STEPS[0], Step("x", "rename", "none", "y")], "there is no none"),
        ([STEPS[0], Step("x", "rename", "name", "size")], "there already"),
        ([STEPS[0], Step("x", "drop", "name", before="name is not null")], "1 rows do not meet"),
    ):
        with pytest.raises(MigrationFailed, match=said):
            table.run(steps)
    with pytest.raises(ValueError, match="unknown kind"):
        Step("x", "widen", "id")
    assert table.log().count() == 1


def test_reading_prunes_what_is_dropped(spark, table):
    table.run([Step("drop", "drop", "name"), Step("key", "rename", "id", "key")])
    plan = table.read().where("key = 2")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "EqualTo(id,2)" in plan
    assert [tuple(r) for r in table.read().where("key = 2").collect()] == [(2,)]
