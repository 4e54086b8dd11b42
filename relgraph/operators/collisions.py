"""Paths that a case-folding or normalising file system cannot keep apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.functions.jsontext import nfd


def path_collisions(paths: DataFrame, scope: list[str]) -> DataFrame:
    """Groups of paths with one collision key: duplicate, case-only or normalization.

    Exact repetitions are combined before the paths leave the JVM, and groups are reduced
    to counts and extremes, so a crowded key stays one small row.
    """
    spelled = paths.groupBy(*scope, "path").agg(F.count(F.lit(1)).alias("rows"))
    keyed = spelled.withColumn("folded", F.lower("path")).withColumn("key", nfd(F.col("folded")))
    kind = (
        F.when(F.col("spellings") == 1, "duplicate")
        .when(F.col("low_folded") != F.col("high_folded"), "normalization")
        .otherwise("case-only")
    )
    return (
        keyed.groupBy(*scope, "key")
        .agg(
            F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("spellings"), F.min("folded").alias("low_folded"),
            F.max("folded").alias("high_folded"), F.min("path").alias("first"),
        )
        .where("rows > 1")
        .select(*scope, "key", "first", "rows", "spellings", kind.alias("kind"))
    )
