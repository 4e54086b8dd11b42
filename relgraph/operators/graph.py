"""Bounded graph answers and reachability."""

from __future__ import annotations

import uuid
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relgraph.session import cut, scratch

ENVELOPE_RESERVE_BYTES = 1024


@dataclass(frozen=True)
class Limits:
    """Bounds of one answer; values outside of the accepted range are refused, not clamped."""

    max_bytes: int = 8192
    max_nodes: int = 64
    depth: int = 1

    def __post_init__(self):
        for name, low, high in (("max_bytes", 2048, 1_048_576), ("max_nodes", 1, 4096), ("depth", 1, 6)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"limit-unbounded: {name} must be in {low}..{high}")


class SymbolNotFound(LookupError):
    pass


def node_document(nodes: DataFrame) -> DataFrame:
    """Nodes as records; their JSON text is made by ``body``, of the rows an answer keeps."""
    fields = F.struct(
        "id", "kind", "language", "name", "project_id", "qualified_name",
        F.struct("end_line", "file", "start_line").alias("source"),
    )
    return nodes.select(
        F.lit(0).alias("role"), "id", F.coalesce("qualified_name", "name").alias("readable"),
        F.lit("node").alias("record_kind"), fields.alias("node"),
    )


def edge_document(edges: DataFrame) -> DataFrame:
    """Edges as records, with both ends beside the fields of their JSON text."""
    fields = F.struct(
        "analyzer_id",
        F.array(F.struct(F.lit("declaration-contains-v1").alias("rule_id"),
                         F.struct("end_line", "file", "start_line").alias("source"))).alias("evidence")
        if "evidence" not in edges.columns else F.col("evidence"),
        "id", "kind", "resolution", "source_id", "target_id", "target_project_id", "unresolved_target",
    )
    return edges.select(
        F.lit(1).alias("role"), "id", "source_id", F.coalesce("target_id", "unresolved_target").alias("to_id"),
        F.lit("edge").alias("record_kind"), fields.alias("edge"),
    )


def documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as records; the published order is (role, id)."""
    return node_document(nodes).unionByName(edge_document(edges), allowMissingColumns=True)


def body() -> Column:
    """The JSON text of a record of ``documents``."""
    return F.when(F.col("role") == 0, F.to_json("node")).otherwise(F.to_json("edge"))


def apply_budget(candidates: DataFrame, order: list[str], limits: Limits) -> dict[str, DataFrame]:
    """The leading records that fit, and an envelope that says what was left out.

    Only ``max_nodes + 1`` candidates, at most 4097, are ever sorted into one place
    and written as JSON; the rest is counted.
    """
    usable = candidates.where(F.col("id").isNotNull())
    text = F.to_json(F.struct(F.col("id").alias("key"), F.col("record_kind").alias("kind")))
    # {"key":..,"kind":..} plus ,"body": and the body, which is already JSON
    length = F.octet_length(text) + F.octet_length("body") + len(',"body":')
    first = usable.orderBy(*order).limit(limits.max_nodes + 1)
    head = cut(first.withColumn("body", body()).drop("node", "edge").withColumn("length", length.cast("long")))
    everything = W.partitionBy(F.lit(0)).orderBy(*order)
    sized = (
        head.withColumn("rn", F.row_number().over(everything))
        .withColumn("running", F.sum("length").over(everything.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("too_many", F.col("rn") > limits.max_nodes)
        .withColumn("too_long", F.col("running") + ENVELOPE_RESERVE_BYTES > limits.max_bytes)
    )
    fails = F.col("too_many") | F.col("too_long")
    stop = F.min(F.when(fails, F.col("rn"))).over(W.partitionBy(F.lit(0)))
    judged = sized.withColumn("stop", stop).withColumn("taken", F.col("stop").isNull() | (F.col("rn") < F.col("stop")))
    records = judged.where("taken").select("rn", "id", "record_kind", "body", "length")
    at_stop = F.col("rn") == F.col("stop")
    taken = judged.agg(
        F.count_if("taken").alias("records"),
        F.coalesce(F.sum(F.when(F.col("taken"), F.col("length"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.bool_or(at_stop & F.col("too_many")), F.lit(False)).alias("node_limit"),
        F.coalesce(F.bool_or(at_stop & ~F.col("too_many")), F.lit(False)).alias("byte_limit"),
        F.lit(1).alias("one"),
    )
    total = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.lit(1).alias("one"))
    stopped = F.col("node_limit") | F.col("byte_limit")
    envelope = taken.join(total, "one").select(
        "records",
        "bytes",
        F.when(stopped, F.col("candidates") - F.col("records")).otherwise(F.lit(0)).alias("omitted"),
        stopped.alias("truncated"),
        F.array_compact(
            F.array(F.when(F.col("byte_limit"), F.lit("byte-limit")), F.when(F.col("node_limit"), F.lit("node-limit")))
        ).alias("reasons"),
    )
    return {"head": head, "records": records, "envelope": envelope}


#: Ids that a symbol may name for its edges to be found where they lie; more are joined by a shuffle.
HELD_SEEDS = 200_000
#: Ids of a level of a walk that go to every task as hashes, to leave rows that touch none of them where they lie.
HELD_LEVEL = 2_000_000


def near(rows: DataFrame, column: str, ids: DataFrame, held: int = HELD_LEVEL) -> DataFrame:
    """``rows`` without most of those whose ``column`` is none of ``ids(id)``, found where they lie; a join by it decides.

    More than ``held`` ids leave the rows as they are.
    """
    if ids.limit(held + 1).count() > held:
        return rows
    marks = ids.select(F.xxhash64("id").alias("_mark")).distinct()
    return rows.join(F.broadcast(marks), F.xxhash64(column) == F.col("_mark"), "left_semi")


def context_candidates(nodes: DataFrame, edges: DataFrame, symbol: str, held_seeds: int = HELD_SEEDS) -> DataFrame:
    """Records the symbol names, then the edges that touch one of them; one hop, whatever the depth.

    Up to ``held_seeds`` ids go to every task, so that edges are read and move nowhere.
    """
    every = documents(nodes, edges)
    named = (F.col("id") == symbol) | (F.col("readable") == symbol) | F.array_contains(F.split("id", ":"), symbol)
    named = F.coalesce(named, F.lit(False))
    hits = cut(every.where(named).withColumn("phase", F.lit(0)))
    seeds = cut(hits.select(F.explode(F.array("id", "readable")).alias("end")).where(F.col("end").isNotNull()).distinct())
    others = edge_document(edges).where(~F.coalesce(F.array_contains(F.split("id", ":"), symbol) | (F.col("id") == symbol), F.lit(False)))
    if seeds.limit(held_seeds + 1).count() <= held_seeds:
        ends = lambda column, seen: F.broadcast(seeds.select(F.col("end").alias(column), F.lit(True).alias(seen)))
        touching = (
            others.join(ends("source_id", "_from"), "source_id", "left").join(ends("to_id", "_to"), "to_id", "left")
            .where(F.col("_from").isNotNull() | F.col("_to").isNotNull()).drop("_from", "_to")
        )
        return hits.unionByName(touching.withColumn("phase", F.lit(1)), allowMissingColumns=True)
    # one posting for each end of an edge, one semi-join; an edge with both ends among the seeds counts once
    postings = others.withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "end", F.explode(F.array_distinct(F.array("source_id", "to_id")))
    )
    touching = postings.join(seeds, "end", "left_semi").dropDuplicates(["_row"]).drop("_row", "end")
    return cut(hits.unionByName(touching.withColumn("phase", F.lit(1)), allowMissingColumns=True))


def context(nodes: DataFrame, edges: DataFrame, symbol: str, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """The records around a symbol under a budget; raises when the symbol is unknown."""
    answer = apply_budget(context_candidates(nodes, edges, symbol), ["phase", "role", "id"], limits)
    # hits come first in the order, so an answer without any means an unknown symbol
    if answer["head"].where(F.col("phase") == 0).isEmpty():
        raise SymbolNotFound(symbol)
    return answer


def _roots(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


#: Steps of one id that one task holds in ``adjacency``; an id with more is a hub and gets several slices.
HUB_STEPS = 100_000
#: Steps of one bucket of ``adjacency``, which one task reads.
BUCKET_STEPS = 2_000_000


@contextmanager
def adjacency(steps: DataFrame, hub_steps: int = HUB_STEPS):
    """Steps stored in buckets by ``from_id`` while the block runs, and the hubs among the ids.

    The steps are shuffled once, to be written. A join with the stored table moves the
    other side only. ``hubs(from_id, slices)`` has at most one row for each ``hub_steps``
    steps, and is None without any; with hubs the buckets are by ``(from_id, slice)``.
    """
    spark = steps.sparkSession
    stored = steps.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    degree = stored.groupBy("from_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_steps)
    hubs = cut(degree.select("from_id", F.ceil(F.col("n") / hub_steps).cast("int").alias("slices")))
    keys = ["from_id"]
    if hubs.isEmpty():
        hubs = None
    else:
        part = F.pmod(F.xxhash64("to_id"), F.coalesce("slices", F.lit(1))).cast("int")
        stored = stored.join(hubs, "from_id", "left").withColumn("slice", part).drop("slices")
        keys = ["from_id", "slice"]
    name = f"steps_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // BUCKET_STEPS))
    writer = stored.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
    with scratch(spark, name) as path:
        writer.option("path", path).saveAsTable(name)
        try:
            yield spark.table(name), hubs
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _hop(stored: DataFrame, hubs: DataFrame | None, level: DataFrame) -> DataFrame:
    """The steps out of a level."""
    frontier = level.withColumnRenamed("id", "from_id")
    if hubs is None:
        return stored.join(frontier, "from_id")
    parts = F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
    sliced = frontier.join(hubs, "from_id", "left").withColumn("slice", F.explode(parts))
    return stored.join(sliced, ["from_id", "slice"])


def reach(
    steps: DataFrame, roots: DataFrame, max_depth: int | None = None, with_path: bool = False, hub_steps: int = HUB_STEPS,
    held: int = HELD_LEVEL,
) -> DataFrame:
    """``(id, depth[, path])`` of everything reachable over ``steps(from_id, to_id[, edge])``, roots at 0.

    A level of at most ``held`` ids finds its steps where they lie (``near``), so only these move; steps are read once a
    level and should lie in a table. From the first larger level on they are stored in buckets (``adjacency``), and a join
    moves the frontier alone. Each level is written to the checkpoint folder, so a lost
    executor costs at most that level and the plan does not grow with the depth.
    With ``with_path`` the edge keys of the first-discovered path are kept, which
    orders nodes of one level as a queue would have found them. Steps with a null end
    lead nowhere.
    """
    start = roots.select("id").distinct().withColumn("depth", F.lit(0))
    if with_path:
        start = start.withColumn("path", F.array().cast("array<string>"))
    level = cut(start)
    seen = level
    depth = 0
    whole = steps.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    buckets = None
    with ExitStack() as stack:
        while max_depth is None or depth < max_depth:
            depth += 1
            if buckets is None and level.limit(held + 1).count() > held:
                buckets = stack.enter_context(adjacency(steps, hub_steps))
            out = _hop(*buckets, level) if buckets else _hop(near(whole, "from_id", level, held), None, level)
            fresh = out.groupBy(F.col("to_id").alias("id"))
            if with_path:
                found = fresh.agg(F.min(F.concat("path", F.array("edge"))).alias("path"))
            else:
                found = fresh.agg(F.lit(depth).alias("depth"))
            found = found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
            level = cut(found.select(*seen.columns))
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
    return seen


def dependents(deps: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything that depends on the roots, directly or not; the roots themselves are left out."""
    steps = deps.select(F.col("target").alias("from_id"), F.col("dependent").alias("to_id"))
    return reach(steps, roots).join(roots.select("id").distinct(), "id", "left_anti")


def closure(edges: DataFrame, symbol_files: DataFrame, symbol: str) -> dict[str, DataFrame]:
    """Forward closure of a symbol and the size of the files it touches.

    ``edges(source_id, target_id)``, ``symbol_files(id, file, bytes)``; an unknown symbol
    gives an empty closure.
    """
    spark = edges.sparkSession
    known = symbol_files.where(F.col("id") == symbol).select("id")
    steps = edges.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"))
    members = reach(steps, known)
    touched = near(symbol_files, "id", members).join(members, "id", "left_semi").select("file", "bytes").distinct()
    return {
        "members": members,
        "summary": members.agg(F.count(F.lit(1)).alias("nodes"), F.lit(1).alias("one"))
        .join(
            touched.agg(
                F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.lit(1).alias("one")
            ),
            "one",
        )
        .drop("one"),
    }


def impact_reach(edges: DataFrame, node_id: str, depth: int) -> DataFrame:
    """Nodes that reach ``node_id`` against the edge direction, with depth and discovery path."""
    steps = edges.select(
        F.coalesce("target_id", "unresolved_target").alias("from_id"), F.col("source_id").alias("to_id"),
        F.col("id").alias("edge"),
    )
    return reach(steps, _roots(edges.sparkSession, [node_id]), max_depth=depth, with_path=True)


def depth_limited(edges: DataFrame, reached: DataFrame, depth: int, strict_flag: bool = True) -> bool:
    """Whether the walk was cut by its depth.

    The strict flag is that of the node found last at the limit. Without it the flag
    is set when any node at the limit has further incoming edges.
    """
    edge_of = reached.where(F.col("depth") == depth)
    if strict_flag:
        edge_of = edge_of.orderBy(F.col("path").desc()).limit(1)
    incoming = edges.select(F.coalesce("target_id", "unresolved_target").alias("id"))
    return not edge_of.join(near(incoming, "id", edge_of), "id", "left_semi").limit(1).isEmpty()


def impact_candidates(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Out-edges of the reached nodes, then the nodes in the order they were found."""
    found = reached.where(F.col("depth") > 0)
    nothing = F.lit(None).cast("array<string>")
    out_edges = near(edge_document(edges), "source_id", found).join(
        found.select(F.col("id").alias("source_id")), "source_id", "left_semi"
    )
    records = node_document(nodes)
    at = found.select(F.col("id").alias("_id"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
    by_id = near(records, "id", found).join(at, F.col("id") == F.col("_id"))
    by_name = near(records, "readable", found).join(at, (F.col("readable") == F.col("_id")) & (F.col("id") != F.col("_id")))
    columns = records.columns
    nodes_in_order = (
        by_id.unionByName(by_name)
        .groupBy("id")
        .agg(F.min(F.struct("_d", "_p")).alias("_at"), *[F.first(c).alias(c) for c in columns if c != "id"])
    )
    return out_edges.select(
        F.lit(0).alias("phase"), F.lit(0).alias("level"), nothing.alias("found"), *out_edges.columns
    ).unionByName(
        nodes_in_order.select(
            F.lit(1).alias("phase"), F.col("_at._d").alias("level"), F.col("_at._p").alias("found"), *columns
        ),
        allowMissingColumns=True,
    )


def impact(
    nodes: DataFrame, edges: DataFrame, node_id: str, limits: Limits = Limits(), strict_flag: bool = True
) -> dict[str, DataFrame]:
    """Who is affected by a change of ``node_id``; raises when it is unknown."""
    known = nodes.where(
        (F.col("id") == node_id) | (F.coalesce("qualified_name", "name") == node_id)
    ).select("id").unionByName(edges.where(F.col("id") == node_id).select("id"))
    if known.limit(1).isEmpty():
        raise SymbolNotFound(node_id)
    reached = impact_reach(edges, node_id, limits.depth)
    cut_off = depth_limited(edges, reached, limits.depth, strict_flag)
    answer = apply_budget(impact_candidates(nodes, edges, reached), ["phase", "level", "found", "id"], limits)
    if cut_off:
        answer["envelope"] = answer["envelope"].select(
            "records", "bytes", "omitted", F.lit(True).alias("truncated"),
            F.array_sort(F.array_union("reasons", F.array(F.lit("depth-limit")))).alias("reasons"),
        )
    return answer


def project_graph(
    nodes: DataFrame, edges: DataFrame, node_ids: DataFrame | None, edge_ids: DataFrame | None = None, exact: bool = False
) -> dict[str, DataFrame]:
    """Nodes by id and the edges between them; ``exact`` keeps only listed edges, even none.

    ``missing`` lists requested ids that do not exist; callers treat any row as an error.
    """
    if node_ids is None and edge_ids is None:
        raise ValueError("an empty selection selects nothing")
    kept_nodes, kept_edges = nodes, edges
    missing = None
    if node_ids is not None:
        ids = node_ids.select("id").distinct()
        kept_nodes = nodes.join(ids, "id", "left_semi")
        kept_edges = (
            edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
            .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
            .select(*edges.columns)
        )
        missing = ids.join(nodes.select("id"), "id", "left_anti").select("id", F.lit("node").alias("kind"))
    if exact or edge_ids is not None:
        wanted = edge_ids.select("id").distinct() if edge_ids is not None else None
        if wanted is None:
            kept_edges = kept_edges.limit(0)
        else:
            absent = wanted.join(kept_edges.select("id"), "id", "left_anti").select("id", F.lit("edge").alias("kind"))
            kept_edges = kept_edges.join(wanted, "id", "left_semi")
            missing = absent if missing is None else missing.unionByName(absent)
    return {"nodes": kept_nodes, "edges": kept_edges, "missing": missing}


#: Slices of the edges that name one target, so that a popular name is more than one task.
NAME_SLICES = 16


def incoming_references(
    nodes: DataFrame, edges: DataFrame, coverage: DataFrame, targets: DataFrame, kind: str | None = None
) -> dict[str, DataFrame]:
    """References into the target nodes, by id or by qualified name, from any project.

    ``targets`` is ``(id)``. A target in a project that is not completely indexed gives no
    references and is listed in ``not_indexed``. ``coverage(project_id, total_files, pending_files)``.
    """
    wanted = nodes.join(targets.select("id").distinct(), "id", "left_semi").select(
        F.col("id").alias("node_id"), F.col("project_id").alias("target_project_id"), "qualified_name"
    )
    complete = coverage.where((F.col("total_files") > 0) & (F.col("pending_files") == 0)).select(
        F.col("project_id").alias("target_project_id")
    )
    ready = wanted.join(complete, "target_project_id", "left_semi").distinct()
    pool = edges if kind is None else edges.where(F.col("kind") == kind)
    columns = ["id", "source_id", "kind", "resolution", "target_id", "unresolved_target"]
    sources = nodes.select(F.col("id").alias("source_id"), F.col("project_id").alias("source_project_id"))
    by_id = ["target_project_id", "target_id"]
    by_name = ["target_project_id", "unresolved_target"]
    places = ready.groupBy("node_id").agg(F.count(F.lit(1)).alias("places"))
    placed = ready.join(places, "node_id")
    # A node of one place meets an edge at most once by id and once by name, so equal edges go before the names are
    # spelled out and their pairs, which may be far more than nodes and edges together, move nowhere.
    once, repeated = placed.where("places = 1").drop("places"), placed.where("places > 1").drop("places")
    direct = pool.select("target_project_id", *columns).join(once.select("node_id", "target_project_id", F.col("node_id").alias("target_id")), by_id)
    direct = direct.select("node_id", *columns).distinct().join(sources, "source_id")
    named = pool.where(F.col("unresolved_target").isNotNull()).select("target_project_id", *columns)
    named = named.join(once.select("target_project_id", F.col("qualified_name").alias("unresolved_target")).distinct(), by_name, "left_semi")
    named = named.distinct().join(sources, "source_id").withColumn("_slice", F.pmod(F.xxhash64("id", "source_id"), F.lit(NAME_SLICES)))
    holders = once.select("node_id", "target_project_id", F.col("qualified_name").alias("unresolved_target"))
    holders = holders.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NAME_SLICES - 1).cast("long"))))
    spelled = named.join(holders, [*by_name, "_slice"]).where(~F.col("target_id").eqNullSafe(F.col("node_id")))
    # ids of several places
    twice = pool.join(repeated.select("node_id", "target_project_id", F.col("node_id").alias("target_id")), by_id).select("node_id", *columns).unionByName(
        pool.join(repeated.select("node_id", "target_project_id", F.col("qualified_name").alias("unresolved_target")), by_name).select("node_id", *columns)
    ).distinct().join(sources, "source_id")
    out = ["source_id", "node_id", "id", "kind", "resolution", "target_id", "unresolved_target", "source_project_id"]
    references = direct.select(*out).unionByName(spelled.select(*out)).unionByName(twice.select(*out))
    return {
        "references": references.withColumnRenamed("id", "edge_id"),
        "not_indexed": wanted.join(complete, "target_project_id", "left_anti").select("node_id", "target_project_id"),
    }
