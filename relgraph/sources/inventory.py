"""Scan of a file tree into an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ENTRIES = 500_000


def scan_inventory(spark: SparkSession, root: str, project_id: str, max_entries: int = MAX_ENTRIES) -> dict[str, DataFrame]:
    """Files under ``root`` with size and content hash.

    ``unreadable`` lists files that exist but could not be read; ``truncated`` is one row
    that says whether the tree has more entries than the bound, which asks for a full scan.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.substring_index("path", base, -1), "^/+", "")
    # without the content column only the listing is read
    listing = reader.load(root).select(relative.alias("path"), F.col("length").alias("bytes"))
    read = reader.option("ignoreCorruptFiles", "true").load(root)
    hashed = read.select(
        F.lit(project_id).alias("project_id"), relative.alias("path"), F.lit("file").alias("kind"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash"),
    )
    return {
        "files": hashed,
        "unreadable": listing.join(hashed.select("path"), "path", "left_anti").select(F.lit(project_id).alias("project_id"), "path"),
        "truncated": listing.agg((F.count(F.lit(1)) > max_entries).alias("truncated")),
    }
