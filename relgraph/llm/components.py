"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from relgraph.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``); a component is named by its smallest node.

    Alternating large-star and small-star steps: each hangs the neighbours of a node
    on the smallest of them, until the edges are stars. A hub is only joined, never
    gathered; the minima are written apart, so that both sides of a join come from
    plain exchanges, which Spark can split where a hub makes one partition large.
    Null ends and self-links are ignored; an empty table gives no rows.
    """
    links, now = _counted(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    before = None
    while now != before:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
        # large star: larger neighbours of a node hang on its smallest neighbour
        large = both.join(lowest, "a").where("b > a and b <> low").select(F.col("low").alias("a"), "b").distinct()
        large = stored(large, "large")
        # small star: a node and its smaller neighbours hang on the smallest of these
        down = large.select(F.col("b").alias("node"), F.col("a").alias("other"))
        low = stored(down.groupBy("node").agg(F.min("other").alias("low")), "low")
        hung = down.join(low, "node")
        before = now
        links, now = _counted(
            hung.select(F.col("low").alias("a"), F.col("other").alias("b")).where("a <> b")
            .unionByName(low.select(F.col("low").alias("a"), F.col("node").alias("b"))).distinct()
        )
    ends = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return ends.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _counted(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as written, with their number and a sum of their hashes, taken while they are written."""
    seen = Observation()
    said = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")]
    kept = stored(links.observe(seen, *said), "links")
    return kept, (seen.get["n"], seen.get["hashes"])
