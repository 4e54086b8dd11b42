"""Analytics over work intents, job events and pressure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relgraph.operators.ordered import lag_in_order, last_in_order, number_chunks, running_sum

# ---- fixed values -------------------------------------------------------------
BASE_PRIORITY = {
    "VERIFY_CHECKPOINT": 300, "CHECKPOINT_EXPORT": 300,
    "PARSE_BATCH": 200, "RESOLVE_AFFECTED": 200, "PUBLISH_PROJECT": 200,
    "INVENTORY_SCAN": 100, "REPAIR": 100, "PUBLISH_CATALOG": 100,
    "SNAPSHOT_GC": 0,
}
ALLOWED_TRANSITIONS = {
    "PENDING": ["LEASED", "CANCEL_REQUESTED", "SUPERSEDED"],
    "LEASED": ["RUNNING", "PENDING", "CANCEL_REQUESTED"],
    "RUNNING": ["SUCCEEDED", "FAILED", "RETRY_WAIT", "PENDING", "CANCEL_REQUESTED", "SUPERSEDED"],
    "RETRY_WAIT": ["PENDING", "CANCEL_REQUESTED", "SUPERSEDED"],
    "CANCEL_REQUESTED": ["CANCELLED"],
}
TERMINAL_STATES = ["SUCCEEDED", "FAILED", "CANCELLED", "SUPERSEDED"]
MAX_AGING_BONUS = 500
MAX_PAGE = 500
HIGH_WATER_PATHS = 10_000
# -------------------------------------------------------------------------------


def backlog_census(solutions: DataFrame, jobs: DataFrame, files: DataFrame, generations: DataFrame) -> DataFrame:
    """Counts by state, dirty files, generations per lane and the worst health, per solution."""
    state = lambda *names: F.count_if(F.col("state").isin(*names))
    by_state = jobs.groupBy("solution_id").agg(
        state("PENDING").alias("pending"), state("LEASED", "RUNNING").alias("leased"),
        state("RETRY_WAIT").alias("retry_wait"), state("FAILED").alias("failed"),
    )
    dirty = (
        files.where(F.col("desired_generation") > F.col("indexed_generation"))
        .groupBy("solution_id")
        .agg(F.count(F.lit(1)).alias("dirty_files"))
    )
    lanes = generations.groupBy("solution_id").agg(
        F.count_if(F.col("lane") == "live").alias("generations"),
        F.count_if(F.col("lane") == "checkpoint").alias("checkpoint_generations"),
    )
    joined = reduce(lambda a, b: a.join(b, "solution_id", "left"), [by_state, dirty, lanes], solutions)
    filled = joined.na.fill(0)
    queue = F.when((F.col("failed") > 0) | (F.col("retry_wait") > 0), 1).otherwise(0)
    catalog = F.when(F.col("generations") > 0, 0).otherwise(1)
    worst = F.greatest(queue, catalog)
    return filled.withColumn("health", F.when(worst == 0, "healthy").otherwise("degraded"))


def catalog_health(refs: DataFrame) -> DataFrame:
    """References and newest catalog id per solution."""
    return refs.groupBy("solution_id").agg(
        F.count(F.lit(1)).alias("refs"), F.max("catalog_generation_id").alias("generation_id")
    )


def effective_priority(kind: Column, created_at: Column, now: int) -> Column:
    base = F.try_element_at(F.create_map(*[F.lit(p) for kv in BASE_PRIORITY.items() for p in kv]), kind)
    waited = F.floor(F.greatest(F.lit(now) - created_at, F.lit(0)) / 1000)
    return (base + F.least(waited, F.lit(MAX_AGING_BONUS))).cast("long")


def aged_backlog(jobs: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """Ready jobs by aged priority, then ready, created and id."""
    ready = jobs.where(F.col("ready_at") <= now).withColumn(
        "effective", effective_priority(F.col("kind"), F.col("created_at"), now)
    )
    ordered = ready.orderBy(F.desc("effective"), "ready_at", "created_at", "id")
    return ordered if limit is None else ordered.limit(limit)


def backlog_page(jobs: DataFrame, solution: str, limit: int) -> dict[str, DataFrame]:
    """The first jobs of a solution and how many there are in all."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"the page limit must be in 1..{MAX_PAGE}")
    own = jobs.where(F.col("solution_id") == solution)
    return {
        "jobs": own.orderBy("created_at", "ready_at", "id").limit(limit),
        "total": own.agg(F.count(F.lit(1)).alias("total")),
    }


def audit_transitions(job_events: DataFrame, chunk_width: int = 65_536) -> DataFrame:
    """State changes that the life cycle does not allow.

    The previous state is looked up in chunks of the event sequence, so one busy job does
    not become one task.
    """
    with_previous = lag_in_order(
        job_events, ["job_id"], ["seq"], number_chunks("seq", chunk_width), ["state"], "previous"
    )
    pairs = [(a, b) for a, targets in ALLOWED_TRANSITIONS.items() for b in targets]
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in pairs])
    change = F.concat(F.col("previous.state"), F.lit(">"), F.col("state"))
    rule = F.when(F.col("previous.state").isin(*TERMINAL_STATES), "terminal-state").otherwise("transition-not-allowed")
    return (
        with_previous.where(F.col("previous").isNotNull() & ~F.array_contains(allowed, change))
        .select("job_id", "seq", F.col("previous.state").alias("from_state"), F.col("state").alias("to_state"), rule.alias("rule"))
    )


def latest_published(generations: DataFrame) -> DataFrame:
    """Newest generation per project and lane, by time and then id."""
    return (
        generations.groupBy("project_id", "lane")
        .agg(F.max(F.struct("published_at", "generation_id")).alias("newest"))
        .select("project_id", "lane", "newest.published_at", "newest.generation_id")
    )


def coalesce_intents(intents: DataFrame) -> DataFrame:
    """One pending row per scope: newest target, highest priority, earliest ready time, first id."""
    return intents.groupBy("solution_id", "kind", "scope_key").agg(
        F.min_by("id", "seq").alias("id"),
        F.max("target_event_seq").alias("target_event_seq"),
        F.max("priority").alias("priority"),
        F.min("ready_at").alias("ready_at"),
        F.count(F.lit(1)).alias("intents"),
    )


def high_water(hints: DataFrame, limit: int = HIGH_WATER_PATHS, salts: int = 64) -> DataFrame:
    """Whether a scope reached ``limit`` distinct paths, and at which hint.

    Only a path's first hint counts. Each scope keeps the first ``limit`` of those per
    salt and then overall, so at most ``salts * limit`` rows of a scope meet in one task.
    """
    limit = max(1, limit)
    firsts = hints.groupBy("project_id", "path").agg(F.min("seq").alias("seq"))
    salted = firsts.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)))
    local = W.partitionBy("project_id", "salt").orderBy("seq")
    early = salted.withColumn("n", F.row_number().over(local)).where(F.col("n") <= limit)
    overall = W.partitionBy("project_id").orderBy("seq")
    marks = (
        early.withColumn("n", F.row_number().over(overall)).where(F.col("n") == limit).select("project_id", F.col("seq").alias("crossed_at"))
    )
    totals = hints.groupBy("project_id").agg(F.count(F.lit(1)).alias("observed_hints"))
    distinct = firsts.groupBy("project_id").agg(F.count(F.lit(1)).alias("distinct_paths"))
    full = F.col("crossed_at").isNotNull()
    return (
        totals.join(distinct, "project_id")
        .join(marks, "project_id", "left")
        .select(
            "project_id", "observed_hints", full.alias("full_scan_required"), "crossed_at",
            F.when(full, F.lit(0)).otherwise(F.col("distinct_paths")).alias("kept_paths"),
            F.when(full, F.lit(1)).otherwise(F.lit(0)).alias("overflow_events"),
        )
    )


def dirty_generations(marks: DataFrame, acks: DataFrame, chunk_width: int = 65_536) -> dict[str, DataFrame]:
    """Desired and indexed generation per project, and the verdict on each acknowledgement.

    ``marks(project_id, seq)`` raise the desired generation by one each. ``acks(project_id,
    seq, generation)`` are judged against the generation desired at their place; a mark
    with the same ``seq`` comes before.
    """
    desired = marks.groupBy("project_id").agg(F.count(F.lit(1)).alias("desired"))
    events = marks.select("project_id", "seq", F.lit(1).alias("mark"), F.lit(None).cast("long").alias("generation")).unionByName(
        acks.select("project_id", "seq", F.lit(0).alias("mark"), F.col("generation").cast("long").alias("generation"))
    ).withColumn("turn", 1 - F.col("mark"))
    counted = running_sum(events, ["project_id"], ["seq", "turn"], number_chunks("seq", chunk_width), "mark", "desired")
    verdict = (
        F.when((F.col("generation") == 0) | (F.col("generation") > F.col("desired")), "invalid")
        .when(F.col("generation") == F.col("desired"), "applied")
        .otherwise("superseded")
    )
    judged = counted.where("mark = 0").withColumn("verdict", verdict)
    indexed = judged.where("verdict = 'applied'").groupBy("project_id").agg(F.max("generation").alias("indexed"))
    state = desired.join(indexed, "project_id", "left").select(
        "project_id", "desired", F.coalesce("indexed", F.lit(0)).alias("indexed"),
        (F.col("desired") > F.coalesce("indexed", F.lit(0))).alias("dirty"),
    )
    return {"state": state, "acks": judged.select("project_id", "seq", "generation", "desired", "verdict")}


FULL_SCAN_REASONS = {"overflow": "backend_overflow", "disconnected": "backend_reconnect",
                     "reconnected": "backend_reconnect", "backend_switch": "backend_switch",
                     "branch_change": "branch_change", "buffer_overflow": "buffer_overflow"}


def sticky_full_scan(events: DataFrame) -> DataFrame:
    """The full-scan flag of each project after all of its events.

    The flag keeps the first reason after the last acknowledgement.
    ``events(project_id, seq, event)`` with event ``ack`` or a key of ``FULL_SCAN_REASONS``.
    """
    last_ack = events.where("event = 'ack'").groupBy("project_id").agg(F.max("seq").alias("acked"))
    reason = F.try_element_at(
        F.create_map(*[F.lit(p) for kv in FULL_SCAN_REASONS.items() for p in kv]), F.col("event")
    )
    after = events.join(last_ack, "project_id", "left").withColumn(
        "reason", F.when(F.col("acked").isNull() | (F.col("seq") > F.col("acked")), reason)
    )
    held = F.when(F.col("reason").isNotNull(), F.col("seq"))
    return after.groupBy("project_id").agg(F.min_by("reason", held).alias("reason"), F.min(held).alias("since")).withColumn(
        "full_scan_required", F.col("reason").isNotNull()
    )


def epoch_changes(observations: DataFrame, chunk_width: int = 65_536) -> DataFrame:
    """Head and branch moves between consecutive observations of a repository."""
    seen = lag_in_order(
        observations, ["repo"], ["seq"], number_chunks("seq", chunk_width), ["head", "branch"], "previous"
    )
    head = ~F.col("head").eqNullSafe(F.col("previous.head"))
    branch = ~F.col("branch").eqNullSafe(F.col("previous.branch"))
    kind = F.when(head & branch, "head_and_branch_changed").when(head, "head_moved").when(branch, "branch_changed")
    return (
        seen.where(F.col("previous").isNotNull())
        .withColumn("change", kind)
        .where(F.col("change").isNotNull())
        .select(
            "repo", "seq", "change", F.col("previous.head").alias("from_head"), F.col("head").alias("to_head"),
            F.col("previous.branch").alias("from_branch"), F.col("branch").alias("to_branch"),
            F.lit(True).alias("full_scan_required"),
        )
    )


def late_results(results: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict on analysis results by generation: older ones are superseded and leave the file dirty."""
    joined = results.join(files.select("project_id", "path", "desired_generation"), ["project_id", "path"], "left")
    verdict = (
        F.when(F.col("desired_generation").isNull(), "unknown_file")
        .when(F.col("generation") == F.col("desired_generation"), "applied")
        .otherwise("superseded")
    )
    return joined.select("project_id", "path", "generation", "desired_generation", verdict.alias("verdict"))


def freshness_barrier(requests: DataFrame, required: DataFrame, progress: DataFrame, publication: DataFrame) -> DataFrame:
    """Whether every required scope has reached the target, or the first reason why not.

    ``requests(request_id, target_seq, require_publication)``, ``required(request_id, scope)``,
    ``progress(scope, indexed_seq)``, ``publication(request_id, available, catalog_verified,
    fingerprint_before, fingerprint_after)``.
    """
    reached = progress.groupBy("scope").agg(F.max("indexed_seq").alias("indexed_seq"))
    covered = (
        required.join(reached, "scope", "left")
        .join(requests, "request_id")
        .groupBy("request_id")
        .agg(F.bool_and(F.coalesce(F.col("indexed_seq") >= F.col("target_seq"), F.lit(False))).alias("covered"))
    )
    stable = F.col("fingerprint_before") == F.col("fingerprint_after")
    unavailable = F.col("require_publication") & ~F.col("available")
    reason = (
        F.when(~stable, "fingerprint_changed")
        .when(unavailable, "publication_unavailable")
        .when(~F.col("catalog_verified"), "catalog_not_verified")
        .when(~F.col("covered"), "WORKTREE_BUSY")
    )
    return (
        requests.join(covered, "request_id")
        .join(publication, "request_id")
        .select("request_id", reason.isNull().alias("verified"), reason.alias("reason"))
    )
