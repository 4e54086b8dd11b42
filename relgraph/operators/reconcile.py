"""From one flush of change hints to a decision: apply, rescan a little, or scan all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.functions.paths import ignore_reason, secret_match, within_root

MAX_FLUSH = 4096


def flush_sizes(hints: DataFrame) -> DataFrame:
    return hints.groupBy("project_id", "flush_id").agg(F.count(F.lit(1)).alias("hints"))


def _pair(case_insensitive: bool):
    """Fold of a flush's renamed-to paths, in order, over its unused origins."""

    def same(a: Column, b: Column) -> Column:
        return F.lower(a) == F.lower(b) if case_insensitive else a == b

    def step(state: Column, path: Column) -> Column:
        twin = F.get(F.filter(state["left"], lambda o: same(o, path)), F.lit(0))
        origin = F.coalesce(twin, F.get(state["left"], F.lit(0)))
        # using an origin up also uses up its repetitions
        left = F.filter(state["left"], lambda o: origin.isNull() | (o != origin))
        return F.struct(
            left.alias("left"),
            F.concat(
                state["pairs"],
                F.array(
                    F.struct(
                        path.alias("path"), origin.alias("origin"),
                        F.coalesce((origin != path) & same(origin, path), F.lit(False)).alias("case_only"),
                    )
                ),
            ).alias("pairs"),
        )

    return step


def bounded_flushes(hints: DataFrame) -> DataFrame:
    """The hints of flushes within the bound; an oversized flush asks for a full scan instead."""
    refused = flush_sizes(hints).where(F.col("hints") > MAX_FLUSH)
    return hints.join(refused.select("project_id", "flush_id"), ["project_id", "flush_id"], "left_anti")


def pair_renames(hints: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Pairs of each flush: a renamed-to path takes its twin or else the first unused origin.

    A flush has at most 4096 hints, larger ones have no pairs, so this is a bounded group.
    """
    return _pairs(bounded_flushes(hints), case_insensitive)


def _pairs(hints: DataFrame, case_insensitive: bool) -> DataFrame:
    is_from, is_to = F.col("kind") == "renamed_from", F.col("kind") == "renamed_to"
    in_order = lambda flag: F.transform(
        F.array_sort(F.collect_list(F.when(flag, F.struct("seq", "path")))), lambda r: r["path"]
    )
    grouped = hints.where(is_from | is_to).groupBy("project_id", "flush_id").agg(
        in_order(is_from).alias("origins"), in_order(is_to).alias("targets")
    )
    start = F.struct(
        F.col("origins").alias("left"),
        F.array().cast("array<struct<path:string,origin:string,case_only:boolean>>").alias("pairs"),
    )
    return grouped.select(
        "project_id", "flush_id", F.aggregate("targets", start, _pair(case_insensitive)).alias("s")
    ).select("project_id", "flush_id", F.col("s.pairs").alias("pairs"), F.col("s.left").alias("unmatched"))


def normalize_hints(hints: DataFrame, case_insensitive: bool = False) -> dict[str, DataFrame]:
    """Actions of each flush: removals, then upserts, then paired renames.

    A flush over the bound gives no actions and is listed in ``refused``.
    """
    sizes = flush_sizes(hints)
    refused = sizes.where(F.col("hints") > MAX_FLUSH)
    flush = ["project_id", "flush_id"]
    bounded = bounded_flushes(hints)
    none = F.lit(None).cast("string")
    direct = bounded.where(F.col("kind").isin("created", "modified", "removed", "renamed_from")).select(
        *flush,
        F.when(F.col("kind").isin("removed", "renamed_from"), 0).otherwise(1).alias("phase"),
        F.col("seq").alias("position"),
        F.when(F.col("kind").isin("removed", "renamed_from"), "remove").otherwise("upsert").alias("action"),
        "path", none.alias("origin"), F.lit(False).alias("case_only"),
    )
    pairs = _pairs(bounded, case_insensitive)
    renamed = pairs.select(*flush, F.posexplode("pairs").alias("position", "p")).select(
        *flush, F.lit(2).alias("phase"), F.col("position").cast("long").alias("position"), F.lit("upsert").alias("action"),
        "p.path", "p.origin", "p.case_only",
    )
    return {
        "actions": direct.unionByName(renamed),
        "unmatched": pairs.select(*flush, F.explode("unmatched").alias("path")),
        "dropped": bounded.where(F.col("kind") == "other").groupBy(*flush).agg(F.count(F.lit(1)).alias("dropped")),
        "refused": refused,
    }


def reconcile_decision(
    hints: DataFrame, known: DataFrame, flags: DataFrame, links: DataFrame | None = None, root: str = "/",
    case_insensitive: bool = False,
) -> dict[str, DataFrame]:
    """What each flush asks for.

    ``flags(project_id, flush_id, overflowed, sticky_reason)`` rows are optional per flush;
    ``links(project_id, path, target)`` are the symbolic links of the tree.
    """
    flush = ["project_id", "flush_id"]
    norm = normalize_hints(hints, case_insensitive)
    unmatched = norm["unmatched"].select(*flush).distinct().withColumn("unpaired", F.lit(True))
    ignored = ignore_reason(F.col("path"))["reason"].isNotNull()
    secret = secret_match(F.col("path")).isNotNull()
    acts = norm["actions"]
    if links is not None:
        link = links.select("project_id", "path", F.col("target").alias("_target"), F.lit(True).alias("_link"))
        acts = acts.join(link, ["project_id", "path"], "left")
        boundary = F.col("_link").isNotNull() & (F.col("_target").isNull() | ~within_root(root, F.col("_target")))
    else:
        boundary = F.lit(False)
    stored = known.select("project_id", "path", F.lit(True).alias("_known")).distinct()
    judged = acts.join(stored, ["project_id", "path"], "left").withColumn(
        "fate", F.when(ignored, "excluded").when(secret, "withheld").when(boundary, "boundary").otherwise("apply")
    )
    applied = F.col("fate") == "apply"
    untracked = applied & (F.col("action") == "upsert") & F.col("_known").isNull()
    counts = judged.groupBy(*flush).agg(
        F.count_if(F.col("fate") == "excluded").alias("excluded"),
        F.count_if(F.col("fate").isin("withheld", "boundary")).alias("withheld"),
        F.count_if(applied).alias("applied"),
        F.count_if(F.col("fate") == "boundary").alias("boundary"),
        F.count_if(applied & F.col("case_only")).alias("case_only"),
        F.count_if(untracked).alias("untracked"),
    )
    base = flush_sizes(hints).join(flags, flush, "left").join(unmatched, flush, "left").join(counts, flush, "left").na.fill(
        0, ["excluded", "withheld", "applied", "boundary", "case_only", "untracked"]
    )
    overflow = F.coalesce("overflowed", F.lit(False))
    too_many = F.col("hints") > MAX_FLUSH
    scan_trigger = (
        F.when(overflow, "backend_event")
        .when(too_many, "save_all_burst")
        .when(F.col("sticky_reason").isNotNull(), "backend_event")
        .when(F.col("unpaired"), "unpaired_rename")
    )
    scan_reason = (
        F.when(overflow, "backend_overflow")
        .when(too_many, "buffer_overflow")
        .when(F.col("sticky_reason").isNotNull(), F.col("sticky_reason"))
        .when(F.col("unpaired"), "backend_overflow")
    )
    bounded_trigger = (
        F.when(F.col("case_only") > 0, "case_only_rename")
        .when(F.col("boundary") > 0, "symlink_boundary")
        .when(F.col("untracked") > 0, "untracked_input")
    )
    outcome = (
        F.when(scan_trigger.isNotNull(), "full_scan")
        .when(F.col("applied") == 0, "apply")
        .when(bounded_trigger.isNotNull(), "bounded_rescan")
        .otherwise("apply")
    )
    decisions = base.select(
        *flush, "hints", outcome.alias("outcome"),
        F.when(outcome == "full_scan", scan_trigger).when(outcome == "bounded_rescan", bounded_trigger).alias("trigger"),
        F.when(outcome == "full_scan", scan_reason).alias("reason"),
        "excluded", "withheld", "applied",
    )
    rescans = (
        judged.where((applied & F.col("case_only")) | (F.col("fate") == "boundary") | untracked)
        .join(decisions.where("outcome = 'bounded_rescan'").select(*flush), flush, "left_semi")
        .select(*flush, "path")
        .distinct()
    )
    return {"decisions": decisions, "rescans": rescans, "actions": judged}
