"""Inventories of files: reconciliation, dirty sets, digests and incremental replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relgraph.functions import identity
from relgraph.functions.paths import language
from relgraph.operators.graph import dependents


def known_inventory(files: DataFrame) -> DataFrame:
    """Files with an observed hash."""
    return files.where(F.col("observed_hash").isNotNull()).select("project_id", "path", "observed_hash")


def dirty_files(files: DataFrame) -> DataFrame:
    """Files whose desired generation is ahead of the indexed one."""
    return files.where(F.col("desired_generation") > F.col("indexed_generation")).select(
        "project_id", "path", "observed_hash", "desired_generation"
    )


def dirty_paths(files: DataFrame, dirty: DataFrame) -> DataFrame:
    return files.join(dirty.select("project_id", "path"), ["project_id", "path"], "left_semi").select(
        "project_id", "path"
    )


def publish_inputs(files: DataFrame) -> DataFrame:
    """Live files of a supported language that have been read."""
    return files.where(
        F.col("observed_hash").isNotNull() & ~F.col("deleted") & language(F.col("path")).isNotNull()
    )


def poll_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """created / modified / removed hints between two (size, mtime) snapshots."""
    stamp = F.struct("size_bytes", "modified_ns")
    old = before.select("project_id", "path", stamp.alias("old"))
    new = after.select("project_id", "path", stamp.alias("new"))
    kind = (
        F.when(F.col("old").isNull(), "created")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old") != F.col("new"), "modified")
    )
    return (
        old.join(new, ["project_id", "path"], "full_outer")
        .select("project_id", "path", kind.alias("kind"))
        .where(F.col("kind").isNotNull())
    )


def reconcile_inventory(files: DataFrame, observed: DataFrame, generation: int) -> dict[str, DataFrame]:
    """Full-outer reconciliation of stored files with one observation.

    ``files`` is the new state, ``dirty`` the queued work, ``changes`` one row per path
    with its verdict. A project whose observation repeats a path, or whose stored
    generation is not below ``generation``, is left as it was and reported in
    ``violations``.
    """
    repeated = (
        observed.groupBy("project_id", "path")
        .count()
        .where("count > 1")
        .select("project_id", F.lit("duplicate-inventory-path").alias("rule"))
        .distinct()
    )
    behind = (
        files.groupBy("project_id")
        .agg(F.max("desired_generation").alias("highest"))
        .where(F.col("highest") >= F.lit(generation))
        .select("project_id", F.lit("generation-not-advancing").alias("rule"))
    )
    violations = repeated.unionByName(behind)
    blocked = violations.select("project_id").distinct()
    seen = observed.join(blocked, "project_id", "left_anti").select(
        "project_id", "path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("seen")
    )
    open_files = files.join(blocked, "project_id", "left_anti")
    kept_files = files.join(blocked, "project_id", "left_semi")
    stored = open_files.select(
        "project_id", "path", "observed_hash", "indexed_hash", "desired_generation", "indexed_generation", "deleted",
        F.lit(True).alias("stored"),
    )
    both = stored.join(seen, ["project_id", "path"], "full_outer")
    is_seen, is_stored = F.col("seen").isNotNull(), F.col("stored").isNotNull()
    change = (
        F.when(is_seen & ~is_stored, "new-file")
        .when(is_seen & F.col("deleted"), "reappeared")
        .when(is_seen & ~F.col("observed_hash").eqNullSafe(F.col("new_hash")), "content-change")
        .when(is_seen, "unchanged")
        .when(~F.col("deleted"), "deleted")
        .otherwise("absent")
    )
    judged = both.withColumn("change", change)
    queued = F.col("change").isin("new-file", "reappeared", "content-change", "deleted")
    state = judged.select(
        "project_id",
        "path",
        F.when(is_seen, F.col("new_hash")).when(queued, F.lit(None)).otherwise(F.col("observed_hash")).alias("observed_hash"),
        "indexed_hash",
        F.when(queued, F.lit(generation).cast("long")).otherwise(F.col("desired_generation")).alias("desired_generation"),
        F.coalesce("indexed_generation", F.lit(0)).cast("long").alias("indexed_generation"),
        F.when(is_seen, F.lit(False)).otherwise(F.lit(True)).alias("deleted"),
    )
    return {
        "files": state.unionByName(kept_files.select(*state.columns)),
        "dirty": judged.where(queued).select(
            "project_id", "path", F.lit(generation).cast("long").alias("target_generation"), F.col("change").alias("reason")
        ),
        "changes": judged.select("project_id", "path", "change"),
        "violations": violations,
    }


def inventory_report(changes: DataFrame) -> DataFrame:
    """added / changed / unchanged / deleted / queued per project."""
    is_in = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return changes.groupBy("project_id").agg(
        is_in("new-file").alias("added"),
        is_in("content-change", "reappeared").alias("changed"),
        is_in("unchanged").alias("unchanged"),
        is_in("deleted").alias("deleted"),
        is_in("new-file", "content-change", "reappeared", "deleted").alias("queued"),
    )


def inventory_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """``modified:`` / ``removed:`` / ``added:`` labels between two (path, hash) inventories."""
    old = before.select("project_id", "path", F.col("content_hash").alias("old"))
    new = after.select("project_id", "path", F.col("content_hash").alias("new"))
    label = (
        F.when(F.col("old").isNull(), "added:")
        .when(F.col("new").isNull(), "removed:")
        .when(F.col("old") != F.col("new"), "modified:")
    )
    return (
        old.join(new, ["project_id", "path"], "full_outer")
        .select("project_id", F.concat(label, F.col("path")).alias("difference"))
        .where(F.col("difference").isNotNull())
    )


def digest_leaves(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """``group, at, rows, leaf``: the different rows of a group by the first six digits of their hashes.

    A row's hash is sha256 of its ``col US col LF`` line; a leaf is sha256 of its rows' hashes in
    order. Leaves can be stored: after a change, only those of changed rows differ.
    """
    unit, end = F.lit("\x1f"), F.lit("\n")
    parts = [p for i, c in enumerate(columns) for p in ([unit] if i else []) + [F.col(c).cast("string")]]
    hashes = df.select(*group, F.sha2(F.concat(*parts, end), 256).alias("h")).distinct()
    found = hashes.groupBy(*group, F.substring("h", 1, 6).alias("at"))
    return found.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("leaf"))


def digest_of(leaves: DataFrame, group: list[str]) -> DataFrame:
    """``group, rows, digest`` of stored leaves: a tree of fixed shape, whatever the size of a group.

    A node is sha256 over ``place:digest LF`` lines of at most 4,096 children, first of
    leaves that share three digits, then of these nodes.
    """
    def level(df: DataFrame, value: str, *by) -> DataFrame:
        said = F.array_join(F.array_sort(F.collect_list(F.concat("at", F.lit(":"), F.col(value), F.lit("\n")))), "")
        return df.groupBy(*group, *by).agg(F.sum("rows").alias("rows"), F.sha2(said, 256).alias("digest"))

    middle = level(leaves, "leaf", F.substring("at", 1, 3).alias("top")).withColumnRenamed("top", "at")
    return level(middle, "digest").select(*group, "rows", "digest")


def ordered_digest(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """``group, rows, digest`` over a group's different rows; equal row sets give equal digests (``digest_leaves``, ``digest_of``)."""
    return digest_of(digest_leaves(df, group, columns), group)


def export_signatures(exports: DataFrame) -> DataFrame:
    """Fingerprint of the sorted distinct exported names of each file."""
    return (
        exports.groupBy("file")
        .agg(F.array_sort(F.collect_set("name")).alias("exported"))
        .select("file", identity.tuple_digest(F.col("exported")).alias("fingerprint"))
    )


def replacement_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """removed / added / retained fact keys per replaced file; same digest means skipped.

    Both sides are ``(file, digest, key)``; a file only in ``old`` is untouched.
    """
    digests = (
        old.select("file", F.col("digest").alias("old_digest"))
        .distinct()
        .join(new.select("file", F.col("digest").alias("new_digest")).distinct(), "file", "right")
    )
    same = digests.where(F.col("old_digest") == F.col("new_digest")).select("file")
    touched = digests.select("file")
    before = old.join(touched, "file", "left_semi").select("file", "key", F.lit(1).alias("before")).distinct()
    after = new.select("file", "key", F.lit(1).alias("after")).distinct()
    moved = (
        before.join(after, ["file", "key"], "full_outer")
        .join(same, "file", "left_anti")
        .select(
            "file",
            "key",
            F.when(F.col("before").isNull(), "added")
            .when(F.col("after").isNull(), "removed")
            .otherwise("retained")
            .alias("status"),
        )
    )
    skipped = before.join(same, "file", "left_semi").select("file", "key", F.lit("skipped").alias("status"))
    return moved.unionByName(skipped)


def invalidation_plan(previous: DataFrame, current: DataFrame, deps: DataFrame) -> dict[str, DataFrame]:
    """Files whose signature changed, went or came, and everything that depends on the first two."""
    diff = previous.select("file", F.col("fingerprint").alias("old")).join(
        current.select("file", F.col("fingerprint").alias("new")), "file", "full_outer"
    )
    changed = diff.where(F.col("old") != F.col("new")).select("file")
    removed = diff.where(F.col("new").isNull()).select("file")
    added = diff.where(F.col("old").isNull()).select("file")
    roots = changed.unionByName(removed)
    stale = dependents(deps, roots.select(F.col("file").alias("id"))).select(F.col("id").alias("file"))
    direct = deps.join(removed.select(F.col("file").alias("target")), "target", "left_semi").distinct()
    return {
        "changed": changed,
        "removed": removed,
        "added": added,
        "stale": stale,
        "cleared": direct,
        "diagnostics": direct.join(current.select(F.col("file").alias("dependent")), "dependent", "left_semi"),
    }


def cleared_edges(removed: DataFrame, dependencies: DataFrame, current: DataFrame) -> DataFrame:
    """Resolved edges into removed targets; ``diagnosed`` when the dependent still exists."""
    hit = dependencies.join(removed.select("target"), "target", "left_semi").distinct()
    alive = current.select(F.col("file").alias("dependent"), F.lit(True).alias("alive")).distinct()
    return hit.join(alive, "dependent", "left").select(
        "dependent", "target", F.coalesce("alive", F.lit(False)).alias("diagnosed")
    )


def invalidate_incoming(edges: DataFrame, removed_nodes: DataFrame) -> DataFrame:
    """Edges of other files that point at removed nodes become unresolved, by the old qualified name.

    A file is a path of a project: ``edges(project_id, owner_file, target_project_id, target_id, ..)``
    and ``removed_nodes(project_id, id, owner_file, qualified_name)``.
    """
    gone = removed_nodes.select(
        F.col("project_id").alias("target_project_id"), F.col("id").alias("target_id"),
        F.col("qualified_name").alias("_name"), F.col("project_id").alias("_project"), F.col("owner_file").alias("_owner"),
    )
    same_file = F.col("project_id").eqNullSafe(F.col("_project")) & F.col("owner_file").eqNullSafe(F.col("_owner"))
    hit = F.col("_name").isNotNull() & ~same_file
    # edges without a target join nothing and would all meet in one partition
    unaimed = edges.where("target_id is null or target_project_id is null")
    return (
        edges.where("target_id is not null and target_project_id is not null").join(gone, ["target_project_id", "target_id"], "left")
        .withColumn("unresolved_target", F.when(hit, F.col("_name")).otherwise(F.col("unresolved_target")))
        .withColumn("resolution", F.when(hit, "unresolved").otherwise(F.col("resolution")))
        .withColumn("target_id", F.when(hit, F.lit(None)).otherwise(F.col("target_id")))
        .select(*edges.columns)
        .unionByName(unaimed)
    )


def replace_facts(
    nodes: DataFrame, edges: DataFrame, files: DataFrame, done: DataFrame, new_nodes: DataFrame, new_edges: DataFrame
) -> dict[str, DataFrame]:
    """Replace the facts of the analysed files and acknowledge their generation.

    ``done`` is ``(project_id, owner_file, generation, hash)``; nodes, edges and files carry
    their ``project_id`` too. All deletions of the batch happen
    before its insertions; an acknowledgement that is not for the desired generation
    leaves the file dirty.
    """
    file = ["project_id", "owner_file"]
    owners = done.select(*file).distinct()
    removed = nodes.join(owners, file, "left_semi")
    kept_nodes = nodes.join(owners, file, "left_anti")
    kept_edges = invalidate_incoming(edges.join(owners, file, "left_anti"), removed)
    ack = done.select("project_id", F.col("owner_file").alias("path"), F.col("generation").alias("_g"), F.col("hash").alias("_h"))
    hit = F.col("_g") == F.col("desired_generation")
    state = (
        files.join(ack, ["project_id", "path"], "left")
        .withColumn("indexed_generation", F.when(hit, F.col("_g")).otherwise(F.col("indexed_generation")))
        .withColumn("indexed_hash", F.when(hit, F.col("_h")).otherwise(F.col("indexed_hash")))
        .select(*files.columns)
    )
    return {
        "nodes": kept_nodes.unionByName(new_nodes.select(*nodes.columns)),
        "edges": kept_edges.unionByName(new_edges.select(*edges.columns)),
        "files": state,
    }


def audit_facts(nodes: DataFrame, edges: DataFrame, max_nodes: int = 20_000, max_edges: int = 100_000) -> DataFrame:
    """``(project_id, owner_file, rule, subject)`` rows for every rule a file's fact set breaks."""
    file = ["project_id", "owner_file"]

    def rows(df: DataFrame, rule: str, subject) -> DataFrame:
        return df.select(*file, F.lit(rule).alias("rule"), subject.alias("subject"))

    empty = lambda *cs: F.exists(F.array(*cs), lambda v: F.coalesce(v, F.lit("")) == "")
    repeated = lambda df: df.groupBy(*file, "id").count().where("count > 1")
    crowded = lambda df, cap: df.groupBy(*file).count().where(F.col("count") > cap)
    shape = F.col("unresolved_target").isNotNull() != (F.col("resolution") == "unresolved")
    owned = nodes.select(*file, F.col("id").alias("source_id")).distinct()
    found = [
        rows(crowded(nodes, max_nodes), "too-many-nodes", F.col("count").cast("string")),
        rows(crowded(edges, max_edges), "too-many-edges", F.col("count").cast("string")),
        rows(nodes.where(empty("id", "kind", "qualified_name")), "incomplete-node", F.col("id")),
        rows(repeated(nodes), "duplicate-node", F.col("id")),
        rows(edges.where(empty("id", "kind")), "incomplete-edge", F.col("id")),
        rows(repeated(edges), "duplicate-edge", F.col("id")),
        rows(edges.join(owned, [*file, "source_id"], "left_anti"), "orphan-edge-source", F.col("id")),
        rows(edges.where(shape), "resolution-target-mismatch", F.col("id")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_solution(tables: dict[str, DataFrame], solution: str) -> dict[str, DataFrame]:
    """Every given table without the rows of one solution.

    A row goes with its solution, with a project of it, or with a job or revision of it.
    Ids of nodes are ids inside a project, so an edge goes if the project of its owner
    file or that of its source goes (``owner_project``, ``source_project``, which is the
    owner's where there is no such column), never by a bare id.

    ``solutions(id)``, ``projects(id, solution_id)``, ``jobs(id, solution_id)``,
    ``graph_revisions(id, solution_id)`` and ``runtime_checkpoints(solution_id)``; ``files``,
    ``nodes``, ``dirty_files``, ``catalog_refs`` and ``published_generations`` by ``project_id``;
    ``job_attempts(job_id)``, ``job_files(job_id, project_id)``, ``publish_outbox(project_id, revision_id)``.
    Null keys belong to no solution and stay. Tables named otherwise are refused.
    """
    def ids(table: str, name: str) -> DataFrame:
        return tables[table].where(F.col("solution_id") == solution).select(F.col("id").alias(name)).distinct()

    def without(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
        return df.join(gone.toDF("_gone"), F.col(column) == F.col("_gone"), "left_anti")

    by_solution = lambda df: df.where(~F.col("solution_id").eqNullSafe(F.lit(solution)))
    by_project = lambda df: without(df, ids("projects", "project_id"), "project_id")
    by_job = lambda df: without(df, ids("jobs", "job_id"), "job_id")
    by_owner = lambda df: without(df, ids("projects", "project_id"), "owner_project")
    by_source = lambda df: without(df, ids("projects", "project_id"), "source_project") if "source_project" in df.columns else df
    by_revision = lambda df: without(df, ids("graph_revisions", "revision_id"), "revision_id")
    rules = {
        "edges": [by_owner, by_source], "job_files": [by_job, by_project], "job_attempts": [by_job], "publish_outbox": [by_project, by_revision],
        **dict.fromkeys(["nodes", "files", "dirty_files", "catalog_refs", "published_generations"], [by_project]),
        **dict.fromkeys(["jobs", "graph_revisions", "runtime_checkpoints", "projects"], [by_solution]),
        "solutions": [lambda df: df.where(~F.col("id").eqNullSafe(F.lit(solution)))],
    }
    left = {}
    for name, df in tables.items():
        if name not in rules:
            raise ValueError(f"no rule for table {name}")
        for rule in rules[name]:
            df = rule(df)
        left[name] = df
    return left


def occurrence_keys(decls: DataFrame) -> DataFrame:
    """Rewrite every key that repeats inside a file with its 0-based occurrence, in source order."""
    same = W.partitionBy("file", "base_key")
    at = F.row_number().over(same.orderBy("line")) - 1
    many = F.count(F.lit(1)).over(same) > 1
    return decls.withColumn("occurrence", F.when(many, at.cast("long"))).withColumn(
        "key",
        F.when(F.col("occurrence").isNotNull(), identity.repeated_key(F.col("base_key"), F.col("occurrence"))).otherwise(
            F.col("base_key")
        ),
    )


def anonymous_ordinals(decls: DataFrame) -> DataFrame:
    """One counter per file over its declarations without an explicit name."""
    rows = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    unnamed = F.col("quality") != "explicit"
    return decls.withColumn("ordinal", F.when(unnamed, F.sum(F.when(unnamed, 1).otherwise(0)).over(rows)).cast("long"))
