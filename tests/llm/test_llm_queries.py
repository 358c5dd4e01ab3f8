"""Queries of the subpackage against SQL on the driver's tables, and what an empty table gives."""

import pytest
from oracle import DATA, assert_same, connect

from ledgerline.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    assert_same(llm.queries()[name](spark, DATA), llm.oracle_sql()[name], connect())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, empty, name):
    assert llm.queries()[name](spark, empty).collect() == []


def test_pipeline_of_nothing(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []
