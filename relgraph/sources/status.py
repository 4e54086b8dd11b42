"""Captured version-control status output, decoded into change rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _records(outputs: DataFrame, keys: list[str], carries_origin) -> DataFrame:
    """Records of NUL-separated fields; a rename or copy takes the next field as its origin.

    In a run of fields that each look like a rename, every second one is the origin of the
    one before it.
    """
    fields = outputs.select(*keys, F.posexplode(F.filter(F.split("output", "\x00"), lambda f: f != "")).alias("at", "field"))
    w = W.partitionBy(*keys).orderBy("at")
    looks = fields.withColumn("looks", carries_origin(F.col("field"))).withColumn(
        "starts", F.col("looks") & ~F.coalesce(F.lag("looks").over(w), F.lit(False))
    )
    run = looks.withColumn("run", F.last(F.when(F.col("starts"), F.col("at")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    after_rename = F.coalesce(F.lag("looks").over(w), F.lit(False))
    marked = run.withColumn("is_origin", after_rename & ((F.col("at") - 1 - F.col("run")) % 2 == 0)).withColumn(
        "next_field", F.lead("field").over(w)
    )
    return marked.where(~F.col("is_origin")).select(
        *keys, "at", "field", F.when(F.col("looks"), F.col("next_field")).alias("origin"), "looks"
    )


def decode_status(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``status --porcelain -z`` output: one per bucket a path is in.

    A record that lacks its path or its origin comes back in the bucket ``malformed``.
    """
    records = _records(outputs, keys, lambda f: F.substring(f, 1, 2).rlike("[RC]"))
    index, worktree = F.substring("field", 1, 1), F.substring("field", 2, 1)
    path = F.regexp_replace(F.col("field").substr(F.lit(3), F.length("field")), "^ ", "")
    read = records.select(*keys, "at", index.alias("x"), worktree.alias("y"), path.alias("path"), "origin", "looks")
    broken = (F.col("path") == "") | (F.col("looks") & F.col("origin").isNull())
    untracked = (F.col("x") == "?") | (F.col("y") == "?")
    bucket = lambda name, status: F.struct(F.lit(name).alias("bucket"), status.alias("status"))
    rows = (
        F.when(broken, F.array(bucket("malformed", F.col("x"))))
        .when(untracked, F.array(bucket("untracked", F.lit("?"))))
        .otherwise(
            F.array_compact(
                F.array(
                    F.when(F.col("x") != " ", bucket("staged", F.col("x"))), F.when(F.col("y") != " ", bucket("unstaged", F.col("y")))
                )
            )
        )
    )
    origin = F.when(~untracked, F.col("origin")).alias("origin")
    return read.select(*keys, "at", "path", origin, F.explode(rows).alias("b")).select(*keys, "at", "b.bucket", "b.status", "path", "origin")


def decode_name_status(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``diff --name-status`` output with a tab between status and path."""
    records = _records(outputs, keys, lambda f: f.rlike("^[RC][^\t]*\t"))
    return records.select(
        *keys, "at", F.substring("field", 1, 1).alias("status"), F.substring_index("field", "\t", -1).alias("path"), "origin",
        (~F.contains("field", F.lit("\t")) | (F.col("looks") & F.col("origin").isNull())).alias("malformed"),
    )
