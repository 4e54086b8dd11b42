"""Change-hint documents: validation and unfolding, for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.functions.paths import strict_path_reason

# ---- fixed values -------------------------------------------------------------
MAX_DOCUMENT_BYTES = 1024 * 1024
MAX_PATHS = 4096
KNOWN_REASONS = ["manual", "git", "tool", "reconcile"]
PROJECT_ROOT = "."
DOCUMENT_SCHEMA = "solution_id string, project_id string, reason string, paths array<string>"
# -------------------------------------------------------------------------------


def _path_reason(path: Column, at: Column, paths: Column) -> Column:
    return (
        F.when(path == PROJECT_ROOT, "hint-targets-project-root")
        .when(strict_path_reason(path).isNotNull(), strict_path_reason(path))
        .when(F.array_position(paths, path) <= at, "duplicate-hint-path")
    )


def parse_hints(
    documents: DataFrame, solution_id: str, project_id: str | None = None, reason: str | None = None
) -> dict[str, DataFrame]:
    """Accepted paths as rows, refused documents with the first rule they break.

    ``documents`` has a ``document`` column of JSON text; its other columns are kept. A
    document is accepted or refused as a whole.
    """
    kept = [c for c in documents.columns if c != "document"]
    parsed = documents.withColumn("d", F.from_json("document", DOCUMENT_SCHEMA, {"mode": "PERMISSIVE"})).withColumn(
        "object", F.substring(F.ltrim("document"), 1, 1) == "{"
    )
    project = F.coalesce(F.col("d.project_id"), F.lit(project_id))
    given_reason = F.coalesce(F.col("d.reason"), F.lit(reason), F.lit("manual"))
    paths = F.col("d.paths")
    per_path = F.filter(F.transform(paths, lambda p, i: _path_reason(p, i, paths)), lambda r: r.isNotNull())
    refused = (
        F.when(F.octet_length("document") > MAX_DOCUMENT_BYTES, "hint-document-too-large")
        .when(~F.col("object") | F.col("d").isNull() | paths.isNull(), "hint-document-invalid")
        .when(F.col("d.solution_id") != solution_id, "solution-scope-mismatch")
        .when(F.lit(project_id).isNotNull() & (F.col("d.project_id") != F.lit(project_id)), "project-scope-mismatch")
        .when(project.isNull(), "hint-document-invalid")
        .when(F.lit(reason).isNotNull() & (F.col("d.reason") != F.lit(reason)), "reason-scope-mismatch")
        .when(~given_reason.isin(*KNOWN_REASONS), "unknown-hint-reason")
        .when(F.size(paths) == 0, "empty-hint-batch")
        .when(F.size(paths) > MAX_PATHS, "hint-batch-too-large")
        .when(F.size(per_path) > 0, F.get(per_path, F.lit(0)))
    )
    judged = parsed.select(*kept, "document", project.alias("project_id"), given_reason.alias("reason"), paths.alias("paths"), refused.alias("rule"))
    return {
        "hints": judged.where(F.col("rule").isNull()).select(
            *kept, F.lit(solution_id).alias("solution_id"), "project_id", "reason", F.explode("paths").alias("path")
        ),
        "rejects": judged.where(F.col("rule").isNotNull()).select(*kept, "document", "rule"),
    }


def read_hints(spark: SparkSession, folder: str, solution_id: str, max_files: int = 1000) -> dict[str, DataFrame]:
    """A stream over a folder in which producers drop one JSON document per file."""
    stream = (
        spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files).load(folder)
    ).select(F.col("value").alias("document"))
    return parse_hints(stream, solution_id)
