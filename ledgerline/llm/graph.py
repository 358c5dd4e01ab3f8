"""Connected components as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, materialize


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition as stars: each node with the least node that it reaches inside the partition."""
    above: dict = {}

    def root(x):
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                above[max(ra, rb)] = min(ra, rb)
    if nodes := list(above):
        yield pd.DataFrame({"a": nodes, "b": [root(x) for x in nodes]})


#: Links that one task draws together.
LINKS_A_TASK = 200_000


def _star(links: DataFrame) -> bool:
    """Whether each node has one link upward or is the upper end of links, and not both."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    return ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("low")).where("n > 1 or (n = 1 and low = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the least node reachable, for each node of an edge to another node.

    Null ends, loops and repeated edges do no harm. Tasks of about LINKS_A_TASK links first draw these together into stars, so
    chains shorten at once; of more than one task, rounds of large-star and small-star steps follow until all is stars. The
    least neighbour of each node is a table of its own, so that the join with a hub's many links can be split by Spark.
    Every round is written to the shared folder, and nothing of it goes to the driver but counts.
    """
    kind = dict(edges.dtypes)["a"]
    shape = f"a {kind}, b {kind}"
    tidy = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")), "edges")
    tasks = 1 + tidy.count() // LINKS_A_TASK

    def gathered(links: DataFrame) -> DataFrame:
        return links.coalesce(tasks).mapInPandas(_forest, shape).where("a > b")

    links = materialize(gathered(tidy), "links")
    discard(tidy)
    while tasks > 1 and not _star(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), "large")
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        new = materialize(gathered(small), "links")
        discard(links, least, large, lower)
        links = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
