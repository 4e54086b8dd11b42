"""From stored facts to the published graph, and its completed diagram form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relgraph.functions import identity
from relgraph.functions.kinds import (EDGE_KINDS, NODE_KINDS, RESOLUTIONS, canonical_resolution, contract_edge_kind,
                                      contract_kind, vocabulary_kind, vocabulary_rank)
from relgraph.operators.ordered import rank_in_ranges

CONTAINS_RULE = "declaration-contains-v1"
PLACEHOLDER = "unresolved:"


def occurrence_suffix(nodes: DataFrame) -> DataFrame:
    """Published key of each node: the qualified name, ``#2``, ``#3``... for later occurrences.

    A qualified name may repeat in a large share of the files, or of the lines of one
    file, so its occurrences are ranked over ranges of file, line and id.
    """
    keys = ["project_id", "language", "contract_kind", "qualified_name"]
    mapped = nodes.withColumn("contract_kind", contract_kind(F.col("kind"))).where(F.col("contract_kind").isNotNull())
    ranked = rank_in_ranges(mapped, keys, ["owner_file", "start_line", "id"], "occurrence")
    return ranked.withColumn(
        "published_key",
        F.when(F.col("occurrence") == 1, F.col("qualified_name")).otherwise(
            F.concat("qualified_name", F.lit("#"), F.col("occurrence").cast("string"))
        ),
    )


def publish_graph(nodes: DataFrame, edges: DataFrame, wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """Published nodes and edges with content-derived ids.

    Stored ids are ids inside a project: an edge of ``project_id`` starts at that project's
    ``source_id`` and ends at ``target_id`` of ``target_project_id``. An edge whose source is
    not published is dropped. A target that is not published
    becomes unresolved, named by the stored name, else the target's qualified name, else
    the owner file. An edge without evidence gets the first line of its owner file. Of stored
    edges that publish the same id, the one with the smallest stored id stays. ``attributes``
    of nodes are passed on. Of edges, the ``wanted`` columns are returned; others that decide nothing do not move.

    Published ids are hashes, which nothing compresses: they move as bytes, and each node moves once, as the end it is of edges.
    """
    keyed = occurrence_suffix(nodes)
    published = keyed.select(
        identity.node_id(F.col("project_id"), F.col("language"), F.col("contract_kind"), F.col("published_key")).alias("pub_id"),
        "id", "project_id", F.col("contract_kind").alias("kind"), "name", F.col("published_key").alias("qualified_name"),
        "language", F.struct(F.col("owner_file").alias("file"), "start_line", "end_line").alias("source"),
        F.lit("semantic_key").alias("identity_quality"), *(["attributes"] if "attributes" in nodes.columns else []),
    )
    names = published.select("project_id", "id", "pub_id")
    kind = contract_edge_kind(F.col("kind"))
    typed = edges.withColumn("edge_kind", kind).where(F.col("edge_kind").isNotNull())
    # one relation for both ends: the published id where there is one, else the stored name
    is_id, is_name = F.lit(b"\x01"), F.lit(b"\x00")
    unpublished = nodes.where(contract_kind(F.col("kind")).isNull()).select("project_id", "id", F.concat(is_name, F.encode("qualified_name", "UTF-8")).alias("said"))
    said = names.select("project_id", "id", F.concat(is_id, F.unhex("pub_id")).alias("said")).unionByName(unpublished).where(
        "project_id is not null and id is not null")
    has_id = F.coalesce(F.col("said") >= is_id, F.lit(False))
    known = said.withColumn("published", F.max(has_id).over(W.partitionBy("project_id", "id"))).where(has_id | ~F.col("published")).drop("published")
    source, target = known.alias("s"), known.alias("t")
    joined = typed.alias("e").join(source, (F.col("e.project_id") == F.col("s.project_id")) & (F.col("e.source_id") == F.col("s.id"))).where(
        F.col("s.said") >= is_id).select("e.*", F.expr("substring(s.said, 2)").alias("pub_source"))
    # edges without a target are sought under salted names, as null keys would be one task; what they meet is no target of theirs
    sought = F.coalesce("e.target_id", F.concat(F.lit("-"), F.xxhash64("e.id", "e.source_id").cast("string")))
    joined = joined.alias("e").join(target, (F.col("e.target_project_id") == F.col("t.project_id")) & (sought == F.col("t.id")), "left").select(
        "e.*", F.when(F.col("e.target_id").isNotNull(), F.col("t.said")).alias("said"))
    joined = joined.withColumns({
        "pub_target": F.when(has_id, F.expr("substring(said, 2)")), "stored_name": F.when(~has_id, F.decode(F.expr("substring(said, 2)"), "UTF-8"))})
    resolved = F.col("pub_target").isNotNull()
    name = F.coalesce("unresolved_target", "stored_name", "owner_file")

    def at(line: Column) -> Column:
        place = F.struct(F.col("owner_file").alias("file"), line.alias("start_line"), line.alias("end_line"))
        return F.array(F.struct(place.alias("source"), F.lit(CONTAINS_RULE).alias("rule_id")))

    if "evidence" in edges.columns:
        given = F.size(F.coalesce("evidence", F.array())) > 0
        evidence = F.when(given, F.col("evidence")).otherwise(at(F.lit(1).cast("long")))
    else:
        evidence = at(F.col("line"))
    shaped = joined.select(
        F.col("id").alias("stored_id"),
        "project_id",
        F.col("pub_source").alias("source_id"),
        F.col("pub_target").alias("target_id"),
        F.when(~resolved, name).alias("unresolved_target"),
        "target_project_id",
        F.col("edge_kind").alias("kind"),
        F.when(~resolved, "unresolved")
        .when(F.col("resolution") == "unresolved", "exact_static")
        .otherwise(F.col("resolution"))
        .alias("resolution"),
        evidence.alias("evidence"),
        "analyzer_id",
    ).where(resolved_or_named())
    text = lambda c: F.lower(F.hex(c))
    made = identity.edge_id(text("source_id"), F.col("kind"), F.coalesce(text("target_id"), "unresolved_target"), identity.evidence_key(F.col("evidence")))
    with_id = shaped.withColumn("id", F.unhex(made))
    columns = [c for c in with_id.columns if c not in ("id", "stored_id")]
    wanted = [c for c in columns if wanted is None or c in wanted]
    # whole rows break ties, so that equal stored ids leave nothing to chance. Edges of one id have one source and kind, and
    # their targets differ by being there or not; nothing is decided behind the last wanted column.
    decides = [c for c in columns[:max((columns.index(c) + 1 for c in wanted), default=0)] if c in wanted or c not in ("source_id", "kind")]
    with_id = with_id if "target_id" in wanted else with_id.withColumn("target_id", F.col("target_id").isNotNull())
    first = with_id.groupBy("id").agg(F.min(F.struct("stored_id", *decides)).alias("e"))
    shown = lambda c: text(f"e.{c}").alias(c) if c in ("source_id", "target_id") else F.col(f"e.{c}")
    return {
        "nodes": published.drop("id").withColumnRenamed("pub_id", "id"),
        "edges": first.select(*map(shown, wanted), text("id").alias("id")),
        "keys": names,
    }


def resolved_or_named():
    return F.col("target_id").isNotNull() | (F.col("unresolved_target") != "")


def publication_coverage(edges: DataFrame, files: DataFrame) -> DataFrame:
    """What a publication of each project covers: its input files, those indexed as desired, and published edges without a target."""
    inputs = files.where("NOT deleted").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("input_files"), F.count_if(F.col("indexed_generation") >= F.col("desired_generation")).alias("processed_files"))
    open_ends = edges.where("unresolved_target is not null").groupBy("project_id").agg(F.count(F.lit(1)).alias("unresolved_references"))
    complete = F.when(F.col("processed_files") == F.col("input_files"), "complete_for_profile").otherwise("partial")
    return inputs.join(open_ends, "project_id", "left").select(
        "project_id", complete.alias("status"), "input_files", "processed_files",
        F.coalesce("unresolved_references", F.lit(0)).alias("unresolved_references"),
    )


def publish_order(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in id order across partitions, without one global sort task."""
    ranged = df.repartitionByRange(partitions, "id") if partitions else df.repartitionByRange("id")
    return ranged.sortWithinPartitions("id")


def dedup_edges(edges: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """One row for each id: the smallest of its rows, with the ``wanted`` columns.

    Rows are compared column by column, so what stands behind the last wanted column decides nothing and does not move.
    """
    wanted = wanted or edges.columns
    rest = [c for c in edges.columns if c != "id"]
    rest = rest[:max((rest.index(c) + 1 for c in wanted if c != "id"), default=0)]
    if not rest:
        return edges.select("id").distinct()
    first = edges.groupBy("id").agg(F.min(F.struct(*rest)).alias("e"))
    return first.select(*("id" if c == "id" else F.col(f"e.{c}").alias(c) for c in wanted))


def edge_locators(edges: DataFrame, shard_plan: DataFrame, complete: bool) -> dict[str, DataFrame]:
    """Where each edge record lives; ``missing`` must be empty for the answer to be usable.

    ``both`` has the rows of the two, told apart by ``found``, out of one join; edges move once for it.
    """
    planned = shard_plan.select("key", "bucket", "shard", F.lit(True).alias("found"))
    both = edges.select("key", "from_id", "to_id", "relation").join(planned, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return {
        "locators": both.where("found").drop("found").withColumn("complete", F.lit(complete)),
        "missing": both.where("NOT found").select("key"),
        "both": both.withColumn("complete", F.when(F.col("found"), F.lit(complete))),
    }


def complete_placeholders(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """A closed graph: every end of every edge is a node, real or placeholder.

    The first record of an id, by project, wins; ``node_projects`` lists all projects of a
    node as rows because a popular placeholder may belong to any number of them. ``edge_kinds``
    has ``kind, resolution, target_kind`` of each row of ``edges``, without looking up its source.
    """
    placeholder = lambda name: F.concat(F.lit(PLACEHOLDER), F.substring(F.sha2(name, 256), 1, 16))
    kind = vocabulary_kind(F.col("kind"), EDGE_KINDS)
    real = nodes.select("id").distinct()
    typed = edges.withColumn("resolution", canonical_resolution(F.col("resolution"))).withColumn("kind", kind)
    raw = typed.withColumn("wanted", F.when(F.col("resolution") != "unresolved", F.col("target_id"))).withColumn(
        "target_name", F.coalesce("wanted", "unresolved_target", F.lit(""))
    ).select("id", "project_id", "source_id", "wanted", "target_name", "target_project_id", "kind.kind", "kind.vocabulary", "resolution")
    sources = real.select(F.col("id").alias("source_id"), F.lit(True).alias("has_source"))
    targets = real.select(F.col("id").alias("wanted"), F.lit(True).alias("has_target"))
    lost_source = F.col("has_source").isNull() & (F.col("source_id") != "")
    lost_target = F.col("has_target").isNull()
    target_kind = F.when(lost_target, "placeholder").otherwise("resolved").alias("target_kind")
    # Equal edges have one source, so they are found where the look-up of sources puts them. What follows from other columns
    # does not move, and an edge without a target is sought under a name that no node has, as null keys would be one task.
    open_name = F.when(F.col("wanted").isNull(), F.col("target_name")).alias("open_name")
    once = raw.select("id", "project_id", "source_id", "wanted", open_name, "target_project_id", "kind", "resolution").repartition("source_id").distinct()
    sought = F.coalesce(F.concat(F.lit("="), "wanted"), F.concat(F.lit("-"), F.xxhash64("id", "source_id").cast("string")))
    aims = real.select(F.concat(F.lit("="), "id").alias("aim"), F.lit(True).alias("has_target"))
    done = once.join(sources, "source_id", "left").join(aims, sought == F.col("aim"), "left").select(
        "id", "project_id",
        F.when(lost_source, placeholder(F.col("source_id"))).otherwise(F.col("source_id")).alias("source_id"),
        F.when(lost_target, placeholder(F.coalesce("wanted", "open_name"))).otherwise(F.col("wanted")).alias("target"),
        target_kind, F.col("open_name").alias("unresolved_target"), "target_project_id",
        "kind", vocabulary_kind(F.col("kind"), EDGE_KINDS)["vocabulary"].alias("vocabulary"), "resolution",
    )
    kinds = aimed(distinct_rows(raw).select("wanted", "kind", "resolution"), targets).select("kind", "resolution", target_kind)
    # Different edges stay different but for an end that is spelled like a placeholder, in a graph completed before.
    spelled = lambda c: F.coalesce(F.col(c).startswith(PLACEHOLDER), F.lit(False))
    if not raw.where(spelled("source_id") | spelled("wanted")).isEmpty():
        done = done.distinct()
        kinds = done.select("kind", "resolution", "target_kind")

    # An end is reduced to a row for each name and project before it is looked up among the nodes.
    def ends(df: DataFrame, name: str, end: int) -> DataFrame:
        named = df.groupBy(F.col(name).alias("name"), "project_id").agg(F.min(F.struct("id")).alias("first"), F.count(F.lit(1)).alias("rows"))
        return named.withColumn("end", F.lit(end))

    absent = lambda df: df.join(real.select(F.col("id").alias("name")), "name", "left_anti")
    made = (
        absent(ends(raw.where("source_id <> ''"), "source_id", 0)).withColumn("reason", F.lit("source-node-absent"))
        .unionByName(absent(ends(raw.where("wanted is not null"), "wanted", 1)).withColumn("reason", F.lit("target-node-absent")))
        .unionByName(ends(raw.where("wanted is null"), "target_name", 1).withColumn("reason", F.lit("unresolved-target")))
    )
    node_kind = vocabulary_kind(F.col("kind"), NODE_KINDS)
    rows = nodes.select(
        F.col("id").alias("node"), "project_id",
        F.struct(F.col("project_id").alias("project"), node_kind["kind"].alias("kind"), node_kind["vocabulary"].alias("vocabulary"),
                 F.col("name").alias("name"), F.col("qualified_name").alias("qualified_name")).alias("stored"),
    ).unionByName(
        made.select(
            placeholder(F.col("name")).alias("node"), "project_id",
            F.struct(F.col("project_id").alias("project"), F.col("first"), F.col("end"), F.col("name"), F.col("reason")).alias("made"),
        ),
        allowMissingColumns=True,
    )
    first = rows.groupBy("node").agg(F.min("stored").alias("s"), F.min("made").alias("m"), F.count_distinct("project_id").alias("projects"))
    is_made = F.col("s").isNull()
    either = lambda stored, placed: F.when(is_made, placed).otherwise(F.col(stored))
    return {
        "nodes": first.select(
            F.col("node").alias("id"), either("s.kind", F.lit("UnresolvedTarget")).alias("kind"),
            either("s.vocabulary", F.lit("frozen")).alias("vocabulary"), either("s.name", F.col("m.name")).alias("name"),
            "s.qualified_name", is_made.alias("placeholder"), F.when(is_made, F.col("m.reason")).alias("placeholder_reason"), "projects",
        ),
        "node_projects": rows.select(F.col("node").alias("id"), "project_id").distinct(),
        "edges": done,
        "edge_kinds": kinds,
        "absent": made.where(F.col("reason") != "unresolved-target").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("absent_targets")),
    }


def aimed(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with their targets; those without a target meet nothing, and as null keys they would be one task."""
    found = edges.where("wanted is not null").join(targets, "wanted", "left")
    return found.unionByName(edges.where("wanted is null"), allowMissingColumns=True)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Different rows, told apart by two 64-bit hashes of all columns, so that columns nobody reads do not move."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    marked = df.withColumns({f"_h{i}": F.xxhash64(F.lit(i), nulls, *df.columns) for i in (0, 1)})
    return marked.groupBy("_h0", "_h1").agg(*[F.first(c).alias(c) for c in df.columns]).drop("_h0", "_h1")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Counts of a completed graph and its legends in vocabulary order, extensions after it; of ``edges`` only ``edge_kinds`` is read."""
    node_kinds = nodes.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("placeholder").alias("placeholders")
    )
    edge_kinds = edges.groupBy("kind", "resolution").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("target_kind") == "placeholder").alias("placeholders")
    )
    counts = (
        node_kinds.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("nodes"),
            F.coalesce(F.sum("placeholders"), F.lit(0)).alias("placeholders"),
            F.count(F.lit(1)).alias("node_kinds"), F.lit(1).alias("one"),
        )
        .join(
            edge_kinds.agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("edges"),
                F.coalesce(F.sum("placeholders"), F.lit(0)).alias("placeholder_edges"),
                F.count_distinct("kind").alias("edge_kinds"), F.count_distinct("resolution").alias("resolutions"),
                F.lit(1).alias("one"),
            ),
            "one",
        )
        .drop("one")
    )

    def legend(values: DataFrame, column: str, vocabulary: list[str], name: str) -> DataFrame:
        rank = vocabulary_rank(F.col(column), vocabulary)
        frozen = rank <= len(vocabulary)
        return values.groupBy(column).agg(F.sum("rows").alias("rows")).select(
            F.lit(name).alias("legend"), rank.cast("long").alias("rank"), F.col(column).alias("value"),
            F.when(frozen, "frozen").otherwise("extension").alias("vocabulary"), "rows",
        )

    legends = (
        legend(node_kinds, "kind", NODE_KINDS, "node")
        .unionByName(legend(edge_kinds, "kind", EDGE_KINDS, "edge"))
        .unionByName(legend(edge_kinds, "resolution", RESOLUTIONS, "resolution"))
    )
    return {"counts": counts, "legends": legends}
