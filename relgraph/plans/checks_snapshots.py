"""Registered queries: backlog, generations, manifests, flush decisions, shard packing."""

from pyspark.sql import functions as F

from relgraph.operators import backlog, graph, inventory, packing, reconcile, snapshots
from relgraph.plans.registry import query, relation

NOW = 946_684_800_000

relation("solutions", "SELECT DISTINCT 'sol' || cast(k AS string) AS solution_id FROM (SELECT c_nationkey % 7 AS k FROM $customer) s")


@query("a6_backlog_census", """
WITH j AS (SELECT solution_id, count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state IN ('LEASED', 'RUNNING')) AS leased, count(*) FILTER (state = 'RETRY_WAIT') AS retry_wait, count(*) FILTER (state = 'FAILED') AS failed FROM @jobs GROUP BY 1),
f AS (SELECT solution_id, count(*) AS dirty_files FROM @files WHERE desired_generation > indexed_generation GROUP BY 1),
g AS (SELECT solution_id, count(*) FILTER (lane = 'live') AS generations, count(*) FILTER (lane = 'checkpoint') AS checkpoint_generations FROM @generations GROUP BY 1)
SELECT s.solution_id, coalesce(pending, 0) AS pending, coalesce(leased, 0) AS leased, coalesce(retry_wait, 0) AS retry_wait, coalesce(failed, 0) AS failed, coalesce(dirty_files, 0) AS dirty_files, coalesce(generations, 0) AS generations,
  coalesce(checkpoint_generations, 0) AS checkpoint_generations, CASE WHEN coalesce(failed, 0) > 0 OR coalesce(retry_wait, 0) > 0 OR coalesce(generations, 0) = 0 THEN 'degraded' ELSE 'healthy' END AS health
FROM @solutions s LEFT JOIN j USING (solution_id) LEFT JOIN f USING (solution_id) LEFT JOIN g USING (solution_id)""")
def _(read):
    return backlog.backlog_census(read("solutions"), read("jobs"), read("files"), read("generations"))


@query("a7_catalog_health", "SELECT solution_id, count(*) AS refs, max(generation_id) AS generation_id FROM @generations GROUP BY solution_id")
def _(read):
    return backlog.catalog_health(read("generations").withColumnRenamed("generation_id", "catalog_generation_id"))


PRIORITY = f"""SELECT id, CASE WHEN kind IN ('VERIFY_CHECKPOINT', 'CHECKPOINT_EXPORT') THEN 300 WHEN kind IN ('PARSE_BATCH', 'RESOLVE_AFFECTED', 'PUBLISH_PROJECT') THEN 200 WHEN kind = 'SNAPSHOT_GC' THEN 0 ELSE 100 END
  + least(greatest({NOW} - created_at, 0) // 1000, 500) AS effective, ready_at, created_at FROM @jobs WHERE ready_at <= {NOW}"""


@query("t1_aged_priority", f"SELECT id, cast(effective AS bigint) AS effective FROM ({PRIORITY}) p")
def _(read):
    return backlog.aged_backlog(read("jobs"), NOW).select("id", "effective")


@query("t1_next_jobs", f"SELECT id, cast(effective AS bigint) AS effective FROM ({PRIORITY}) p ORDER BY p.effective DESC, ready_at, created_at, id LIMIT 50")
def _(read):
    return backlog.aged_backlog(read("jobs"), NOW, 50).select("id", "effective")


@query("t2_backlog_page", """
SELECT id, (SELECT count(*) FROM @jobs WHERE solution_id = 'sol2') AS total FROM @jobs WHERE solution_id = 'sol2' ORDER BY created_at, ready_at, id LIMIT 100""")
def _(read):
    page = backlog.backlog_page(read("jobs"), "sol2", 100)
    return page["jobs"].select("id", F.lit(1).alias("one")).join(page["total"].withColumn("one", F.lit(1)), "one").select("id", "total")


@query("w10_transition_audit", """
WITH e AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS p FROM @job_events)
SELECT job_id, seq, p AS from_state, state AS to_state, CASE WHEN p IN ('SUCCEEDED', 'FAILED', 'CANCELLED', 'SUPERSEDED') THEN 'terminal-state' ELSE 'transition-not-allowed' END AS rule FROM e
WHERE p IS NOT NULL AND (p || '>' || state) NOT IN ('PENDING>LEASED', 'PENDING>CANCEL_REQUESTED', 'PENDING>SUPERSEDED', 'LEASED>RUNNING', 'LEASED>PENDING', 'LEASED>CANCEL_REQUESTED', 'RUNNING>SUCCEEDED', 'RUNNING>FAILED', 'RUNNING>RETRY_WAIT',
 'RUNNING>PENDING', 'RUNNING>CANCEL_REQUESTED', 'RUNNING>SUPERSEDED', 'RETRY_WAIT>PENDING', 'RETRY_WAIT>CANCEL_REQUESTED', 'RETRY_WAIT>SUPERSEDED', 'CANCEL_REQUESTED>CANCELLED')""")
def _(read):
    return backlog.audit_transitions(read("job_events"), chunk_width=500)


@query("w11_latest_published", """
SELECT project_id, lane, published_at, generation_id FROM @generations QUALIFY row_number() OVER (PARTITION BY project_id, lane ORDER BY published_at DESC, generation_id DESC) = 1""")
def _(read):
    return backlog.latest_published(read("generations"))


@query("a15_m7_intent_coalescing", """
SELECT solution_id, kind, scope_key, min_by(id, target_event_seq) AS id, max(target_event_seq) AS target_event_seq, max(priority) AS priority, min(ready_at) AS ready_at, count(*) AS intents FROM @jobs GROUP BY ALL""")
def _(read):
    return backlog.coalesce_intents(read("jobs").withColumn("seq", F.col("target_event_seq")))


@query("a14_high_water", """
WITH f AS (SELECT project_id, path, min(seq) AS seq FROM @hints GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS n FROM f),
x AS (SELECT project_id, max(CASE WHEN n = 100 THEN seq END) AS crossed_at, count(*) AS paths FROM n GROUP BY 1), h AS (SELECT project_id, count(*) AS observed_hints FROM @hints GROUP BY 1)
SELECT project_id, observed_hints, crossed_at IS NOT NULL AS full_scan_required, crossed_at, CASE WHEN crossed_at IS NULL THEN paths ELSE 0 END AS kept_paths, CASE WHEN crossed_at IS NULL THEN 0 ELSE 1 END AS overflow_events FROM h JOIN x USING (project_id)""")
def _(read):
    return backlog.high_water(read("hints"), 100)


# one acknowledgement per event, one of the right generation half-way, and one at the end
relation("acks", """SELECT 'p' || cast(user_id % 8 AS string) AS project_id, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 3 = 0 THEN event_id ELSE event_id % 2000 END AS generation FROM $events
UNION ALL SELECT h.project_id, m.seq, count(*) FROM @hints h JOIN (SELECT project_id, cast(floor(avg(seq)) AS bigint) AS seq FROM @hints GROUP BY 1) m ON h.project_id = m.project_id WHERE h.seq <= m.seq GROUP BY h.project_id, m.seq
UNION ALL SELECT project_id, max(seq) + 1, count(*) FROM @hints WHERE project_id <> 'p6' GROUP BY project_id""")

IN_ORDER = """WITH m AS (SELECT project_id, seq, 0 AS turn, cast(NULL AS bigint) AS generation FROM @hints UNION ALL SELECT project_id, seq, 1, generation FROM @acks),
c AS (SELECT *, count(*) FILTER (turn = 0) OVER (PARTITION BY project_id ORDER BY seq, turn RANGE UNBOUNDED PRECEDING) AS desired FROM m),
v AS (SELECT project_id, seq, generation, desired, CASE WHEN generation = 0 OR generation > desired THEN 'invalid' WHEN generation = desired THEN 'applied' ELSE 'superseded' END AS verdict FROM c WHERE turn = 1)"""


@query("m3_generation_acks", f"{IN_ORDER} SELECT * FROM v")
def _(read):
    return backlog.dirty_generations(read("hints"), read("acks"), chunk_width=500)["acks"]


@query("m3_dirty_state", f"""{IN_ORDER}, d AS (SELECT project_id, count(*) AS desired FROM @hints GROUP BY 1), i AS (SELECT project_id, max(generation) AS g FROM v WHERE verdict = 'applied' GROUP BY 1)
SELECT project_id, desired, coalesce(g, 0) AS indexed, desired > coalesce(g, 0) AS dirty FROM d LEFT JOIN i USING (project_id)""")
def _(read):
    return backlog.dirty_generations(read("hints"), read("acks"), chunk_width=500)["state"]


relation("backend_events", """
SELECT 'p' || cast(user_id % 40 AS string) AS project_id, event_id AS seq, CASE event_id % 37 WHEN 0 THEN 'ack' WHEN 3 THEN 'overflow' WHEN 7 THEN 'disconnected' WHEN 9 THEN 'reconnected' WHEN 12 THEN 'branch_change' WHEN 20 THEN 'backend_switch' ELSE 'hints' END AS event FROM $events""")


@query("m4_sticky_full_scan", """
WITH a AS (SELECT project_id, max(seq) FILTER (event = 'ack') AS acked FROM @backend_events GROUP BY 1),
l AS (SELECT e.*, CASE event WHEN 'overflow' THEN 'backend_overflow' WHEN 'disconnected' THEN 'backend_reconnect' WHEN 'reconnected' THEN 'backend_reconnect' WHEN 'branch_change' THEN 'branch_change' WHEN 'backend_switch' THEN 'backend_switch' END AS why
  FROM @backend_events e JOIN a USING (project_id) WHERE acked IS NULL OR seq > acked),
f AS (SELECT project_id, min_by(why, seq) AS reason, min(seq) AS since FROM l WHERE why IS NOT NULL GROUP BY 1)
SELECT a.project_id, reason, since, reason IS NOT NULL AS full_scan_required FROM a LEFT JOIN f ON a.project_id = f.project_id""")
def _(read):
    return backlog.sticky_full_scan(read("backend_events"))


relation("observations", """SELECT 'r' || cast(user_id AS string) AS repo, event_id AS seq, event_type AS head, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'b' || cast(event_id % 3 AS string) END AS branch FROM $events""")


@query("m12_epoch_changes", """
WITH e AS (SELECT *, lag(head) OVER w AS h, lag(branch) OVER w AS b, row_number() OVER w AS n FROM @observations WINDOW w AS (PARTITION BY repo ORDER BY seq))
SELECT repo, seq, CASE WHEN head <> h AND branch IS DISTINCT FROM b THEN 'head_and_branch_changed' WHEN head <> h THEN 'head_moved' ELSE 'branch_changed' END AS change, h AS from_head, head AS to_head, b AS from_branch, branch AS to_branch, true AS full_scan_required
FROM e WHERE n > 1 AND (head <> h OR branch IS DISTINCT FROM b)""")
def _(read):
    return backlog.epoch_changes(read("observations"), chunk_width=500)


relation("results", """SELECT project_id, path, desired_generation - doc_id % 3 AS generation FROM @files WHERE doc_id % 5 <> 0 UNION ALL SELECT project_id, 'gone/' || path, cast(1 AS bigint) FROM @files WHERE doc_id % 50 = 0""")


@query("m13_late_results", """
SELECT r.project_id, r.path, generation, desired_generation, CASE WHEN f.path IS NULL THEN 'unknown_file' WHEN generation = desired_generation THEN 'applied' ELSE 'superseded' END AS verdict FROM @results r LEFT JOIN @files f ON r.project_id = f.project_id AND r.path = f.path""")
def _(read):
    return backlog.late_results(read("results"), read("files"))


relation("barrier_requests", """SELECT 'q' || cast(c_custkey AS string) AS request_id, c_custkey % 900 AS target_seq, c_custkey % 2 = 0 AS require_publication FROM $customer""")
relation("barrier_required", """SELECT 'q' || cast(o_custkey AS string) AS request_id, 'scope' || cast(o_orderkey % 300 AS string) AS scope FROM $orders""")
relation("barrier_progress", """SELECT 'scope' || cast(o_orderkey % 310 AS string) AS scope, o_orderkey % 1100 AS indexed_seq FROM $orders WHERE o_orderkey % 310 > 4""")
relation("barrier_publication", """SELECT 'q' || cast(c_custkey AS string) AS request_id, c_custkey % 7 <> 0 AS available, c_custkey % 11 <> 0 AS catalog_verified, 'f' AS fingerprint_before, CASE WHEN c_custkey % 13 = 0 THEN 'g' ELSE 'f' END AS fingerprint_after FROM $customer""")


@query("m9_freshness_barrier", """
WITH p AS (SELECT scope, max(indexed_seq) AS s FROM @barrier_progress GROUP BY 1), c AS (SELECT r.request_id, bool_and(coalesce(s >= target_seq, false)) AS covered FROM @barrier_required r JOIN @barrier_requests q USING (request_id) LEFT JOIN p USING (scope) GROUP BY 1),
x AS (SELECT request_id, CASE WHEN fingerprint_before <> fingerprint_after THEN 'fingerprint_changed' WHEN require_publication AND NOT available THEN 'publication_unavailable' WHEN NOT catalog_verified THEN 'catalog_not_verified' WHEN NOT covered THEN 'WORKTREE_BUSY' END AS reason
  FROM @barrier_requests JOIN c USING (request_id) JOIN @barrier_publication USING (request_id))
SELECT request_id, reason IS NULL AS verified, reason FROM x""")
def _(read):
    return backlog.freshness_barrier(read("barrier_requests"), read("barrier_required"), read("barrier_progress"), read("barrier_publication"))


# ---- generations --------------------------------------------------------------
@query("j19_manifest_verify", """
SELECT coalesce(m.generation_id, s.generation_id) AS generation_id, coalesce(m.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'not-in-manifest' WHEN m.sha256 <> s.sha256 OR m.bytes <> s.bytes THEN 'integrity' ELSE 'record-count' END AS problem
FROM @manifest m FULL JOIN @manifest_seen s ON m.generation_id = s.generation_id AND m.path = s.path WHERE m.path IS NULL OR s.path IS NULL OR m.sha256 <> s.sha256 OR m.bytes <> s.bytes OR m.records <> s.records""")
def _(read):
    return snapshots.verify_manifest(read("manifest"), read("manifest_seen"))


@query("j18_unpinned_members", """
SELECT DISTINCT 'proj' || c_nationkey AS project_id FROM $customer WHERE c_nationkey % 4 = 1 AND c_nationkey % 5 <> 2""")
def _(read):
    pinned = read("generations").select("project_id").distinct()
    number = F.regexp_extract("project_id", r"(\d+)$", 1).cast("int")
    return snapshots.unpinned_members(pinned, pinned.where(number % 4 != 1), pinned.where(number % 5 == 2))


@query("j20_checkpoint_classes", """
SELECT s.repo, 'partial-staging' AS class, s.path FROM @staged s JOIN @unstaged u ON s.repo = u.repo AND s.path = u.path
UNION SELECT repo, 'rename', path FROM @staged WHERE status = 'R' UNION SELECT repo, 'merge', NULL FROM @parents WHERE parents >= 2 UNION SELECT repo, 'untracked', path FROM @untracked""")
def _(read):
    return snapshots.checkpoint_classes(read("staged"), read("unstaged"), read("untracked"), read("parents"))


relation("fingerprints_before", """SELECT 'c' || cast(c_custkey % 60 AS string) AS checkpoint_id, 'proj' || cast(c_custkey AS string) AS project_id, sha2(c_name, 256) AS fingerprint FROM $customer WHERE c_custkey % 60 <> 17 OR c_custkey % 3 = 0""")
relation("fingerprints_after", """SELECT 'c' || cast(c_custkey % 60 AS string) AS checkpoint_id, 'proj' || cast(c_custkey AS string) AS project_id, CASE WHEN c_custkey % 60 BETWEEN 3 AND 9 AND c_custkey % 2 = 1 THEN sha2(c_mktsegment, 256) ELSE sha2(c_name, 256) END AS fingerprint FROM $customer""")
relation("checkpoint_payloads", """SELECT 'c' || cast(k AS string) AS checkpoint_id, CASE WHEN k % 20 = 11 THEN '' ELSE sha2(cast(k AS string), 256) END AS expected_sha, sha2(cast(CASE WHEN k % 12 = 5 THEN k + 1 ELSE k END AS string), 256) AS regenerated_sha, 'g' AS expected_generation,
  CASE WHEN k % 15 = 2 THEN 'h' ELSE 'g' END AS regenerated_generation, k % 7 <> 3 AS merge_usable FROM (SELECT DISTINCT c_custkey % 60 AS k FROM $customer) d""")


@query("j22_checkpoint_verify", """
WITH m AS (SELECT coalesce(b.checkpoint_id, a.checkpoint_id) AS checkpoint_id, count(*) AS n FROM @fingerprints_before b FULL JOIN @fingerprints_after a ON a.checkpoint_id = b.checkpoint_id AND a.project_id = b.project_id WHERE a.fingerprint IS DISTINCT FROM b.fingerprint GROUP BY 1),
s AS (SELECT p.*, coalesce(n, 0) AS mismatched, length(expected_sha) <> 64 AS missing, expected_sha <> regenerated_sha OR expected_generation <> regenerated_generation OR coalesce(n, 0) > 0 AS stale FROM @checkpoint_payloads p LEFT JOIN m USING (checkpoint_id))
SELECT checkpoint_id, CASE WHEN missing THEN 'missing' WHEN stale THEN 'stale' ELSE 'current' END AS status, mismatched, CASE WHEN missing THEN 'checkpoint-missing' ELSE concat_ws(',', CASE WHEN mismatched > 0 THEN 'fingerprint-mismatch' END, CASE WHEN NOT merge_usable THEN 'merge-conflicted' END,
   CASE WHEN stale THEN 'regenerate-required' END, CASE WHEN stale THEN 'stale-snapshot' END, CASE WHEN stale AND merge_usable THEN 'textual-merge-insufficient' END) END AS reasons FROM s""")
def _(read):
    out = snapshots.verify_checkpoint(read("fingerprints_before"), read("fingerprints_after"), read("checkpoint_payloads"))
    return out["verdict"].withColumn("reasons", F.array_join("reasons", ","))


@query("u3_retention_plan", """
WITH l AS (SELECT generation_id FROM @generations QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY published_at DESC, generation_id DESC) = 1)
SELECT generation_id, CASE WHEN generation_id IN (SELECT generation_id FROM l) OR k % 6 = 0 OR k % 10 = 1 THEN 'retain' ELSE 'delete' END AS action,
  CASE WHEN generation_id IN (SELECT generation_id FROM l) THEN 'gc-retains-current-generation' WHEN k % 6 = 0 THEN 'gc-retains-active-catalog' WHEN k % 10 = 1 THEN 'gc-retains-open-reader' END AS reason FROM @generations""")
def _(read):
    g = read("generations")
    current = g.groupBy("project_id").agg(F.max(F.struct("published_at", "generation_id")).alias("m")).select("m.generation_id")
    return snapshots.retention_plan(g.select("generation_id"), current, g.where("k % 6 = 0"), g.where("k % 10 = 1"))


relation("incoming_bytes", """SELECT solution_id, cast(5000000 * (1 + count(*) % 3) AS bigint) AS incoming FROM @generations GROUP BY solution_id UNION ALL SELECT 'new', cast(12 AS bigint) FROM $region WHERE r_regionkey = 0""")


@query("a13_retention_budget", """
WITH u AS (SELECT solution_id, cast(sum(bytes) AS bigint) AS used FROM @generations GROUP BY 1), p AS (SELECT i.solution_id, coalesce(used, 0) AS used, incoming, coalesce(used, 0) + incoming AS projected FROM @incoming_bytes i LEFT JOIN u USING (solution_id))
SELECT solution_id, used, incoming, CASE WHEN projected <= 160000000 THEN 'publish' ELSE 'defer' END AS decision, CASE WHEN projected > 160000000 THEN 'publication-deferred-retention-roots-exceed-budget' END AS reason, greatest(projected - 160000000, 0) AS shortfall FROM p""")
def _(read):
    return snapshots.retention_budget(read("generations"), read("incoming_bytes"), 161_000_000, 1_000_000)


relation("generated_roots", """SELECT DISTINCT project AS project_id, 'src/' || CASE WHEN length(project) = 4 THEN 'fr' ELSE 'bin' END AS root FROM @corpus""")


@query("u4_generated_split", """
SELECT c.project AS project_id, c.path, EXISTS (SELECT 1 FROM @generated_roots r WHERE r.project_id = c.project AND (c.path = r.root OR starts_with(c.path, r.root || '/'))) AS excluded FROM @corpus c""")
def _(read):
    inputs = read("corpus").select(F.col("project").alias("project_id"), "path")
    return snapshots.split_generated(inputs, read("generated_roots"))


relation("catalog_members", """SELECT 'sol' || cast(k % 3 AS string) AS solution_id, 'proj' || cast(k AS string) AS project_id, sha2(cast(k AS string), 256) AS generation_id, sha2(cast(k * 7 AS string), 256) AS source_fingerprint FROM (SELECT DISTINCT c_nationkey AS k FROM $customer) d""")


@query("s9_catalog", """
WITH l AS (SELECT DISTINCT solution_id, sha256(project_id || chr(31) || generation_id || chr(31) || source_fingerprint || chr(10)) AS h FROM @catalog_members),
f AS (SELECT solution_id, substr(h, 1, 6) AS place, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS leaf FROM l GROUP BY 1, 2),
m AS (SELECT solution_id, substr(place, 1, 3) AS top, sum(n) AS n, sha256(string_agg(place || ':' || leaf || chr(10), '' ORDER BY place)) AS mid FROM f GROUP BY 1, 2)
SELECT solution_id, cast(sum(n) AS bigint) AS members, sha256(string_agg(top || ':' || mid || chr(10), '' ORDER BY top)) AS catalog_id FROM m GROUP BY 1""")
def _(read):
    return snapshots.catalog_id(read("catalog_members"))["catalogs"]


@query("w7_shard_packing", """
WITH RECURSIVE p AS (SELECT CASE role WHEN 0 THEN 'nodes' ELSE 'edges' END AS role, id AS key, body AS line FROM @record_docs UNION ALL SELECT 'texts', cast(doc_id AS varchar), coalesce(text, '') FROM $documents),
k AS (SELECT role, key, strlen(line) + 1 AS n, cast(('0x' || substr(sha256(key), 1, 16))::UBIGINT % 512 AS int) AS bucket FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY role, bucket ORDER BY key) AS rn FROM k WHERE n <= 4000),
r AS (SELECT role, bucket, key, n, rn, 0 AS part, n AS filled FROM o WHERE rn = 1
  UNION ALL SELECT o.role, o.bucket, o.key, o.n, o.rn, CASE WHEN r.filled + o.n > 4000 THEN r.part + 1 ELSE r.part END, CASE WHEN r.filled + o.n > 4000 THEN o.n ELSE r.filled + o.n END FROM r JOIN o ON o.role = r.role AND o.bucket = r.bucket AND o.rn = r.rn + 1)
SELECT role, bucket, key, cast(part AS bigint) AS part, 'bucket-' || lpad(cast(bucket AS varchar), 3, '0') || CASE WHEN part > 0 THEN '/part-' || lpad(cast(part AS varchar), 3, '0') ELSE '' END AS shard, cast(n AS bigint) AS bytes FROM r
UNION ALL SELECT role, bucket, key, NULL, NULL, cast(n AS bigint) FROM k WHERE n > 4000""")
def _(read):
    records = graph.documents(read("pub_nodes"), read("pub_edges")).select(
        F.when(F.col("role") == 0, "nodes").otherwise("edges").alias("role"), F.col("id").alias("key"), graph.body().alias("line"))
    texts = read("documents").select(F.lit("texts").alias("role"), F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("line"))
    packed = packing.pack_shards(records.unionByName(texts), 4000, 512, by=["role"])  # many texts are over the cap
    return packed["plan"].select("role", "bucket", "key", "part", "shard", "bytes").unionByName(packed["too_large"], allowMissingColumns=True)


# ---- flushes of hints ---------------------------------------------------------
relation("flush_flags", """SELECT project_id, flush_id, flush_id % 17 = 0 AS overflowed, CASE WHEN flush_id % 13 = 0 THEN 'branch_change' END AS sticky_reason FROM (SELECT DISTINCT project_id, flush_id FROM @hints WHERE flush_id % 17 = 0 OR flush_id % 13 = 0) d""")
relation("known_hints", "SELECT DISTINCT project_id, path FROM @hints WHERE seq % 5 <> 0")

PAIRS = """
WITH RECURSIVE f AS (SELECT project_id, flush_id, list(path ORDER BY seq) FILTER (kind = 'renamed_from') AS o, list(path ORDER BY seq) FILTER (kind = 'renamed_to') AS t FROM @hints GROUP BY 1, 2),
p AS (SELECT project_id, flush_id, coalesce(o, []) AS o, t, 1 AS i, NULL::VARCHAR AS path, NULL::VARCHAR AS origin FROM f WHERE o IS NOT NULL OR t IS NOT NULL
  UNION ALL SELECT project_id, flush_id, list_filter(o, lambda x: x <> CASE WHEN list_contains(o, t[i]) THEN t[i] ELSE coalesce(o[1], '') END), t, i + 1, t[i], CASE WHEN list_contains(o, t[i]) THEN t[i] ELSE o[1] END FROM p WHERE i <= coalesce(len(t), 0))
"""


@query("j24_rename_pairs", PAIRS + "SELECT project_id, flush_id, cast(i - 2 AS int) AS position, path, origin FROM p WHERE i > 1")
def _(read):
    pairs = reconcile.pair_renames(read("hints"))
    return pairs.select("project_id", "flush_id", F.posexplode("pairs").alias("position", "p")).select("project_id", "flush_id", "position", "p.path", "p.origin")


@query("m1_normalized_hints", PAIRS + """
SELECT project_id, flush_id, CASE WHEN kind IN ('removed', 'renamed_from') THEN 0 ELSE 1 END AS phase, seq AS position, CASE WHEN kind IN ('removed', 'renamed_from') THEN 'remove' ELSE 'upsert' END AS action, path, NULL AS origin FROM @hints WHERE kind NOT IN ('other', 'renamed_to')
UNION ALL SELECT project_id, flush_id, 2, i - 2, 'upsert', path, origin FROM p WHERE i > 1""")
def _(read):
    return reconcile.normalize_hints(read("hints"))["actions"].select("project_id", "flush_id", "phase", "position", "action", "path", "origin")


DECISIONS = PAIRS + """
, last AS (SELECT project_id, flush_id, o AS rest FROM p WHERE i = coalesce(len(t), 0) + 1),
act AS (SELECT project_id, flush_id, CASE WHEN kind IN ('removed', 'renamed_from') THEN 'remove' ELSE 'upsert' END AS action, path FROM @hints WHERE kind NOT IN ('other', 'renamed_to') UNION ALL SELECT project_id, flush_id, 'upsert', path FROM p WHERE i > 1),
j AS (SELECT a.*, k.path IS NOT NULL AS known, CASE WHEN starts_with(a.path, 'src/obj/') THEN 'excluded' WHEN starts_with(a.path, 'Secrets/') THEN 'withheld' ELSE 'apply' END AS fate FROM act a LEFT JOIN @known_hints k ON a.project_id = k.project_id AND a.path = k.path),
c AS (SELECT project_id, flush_id, count(*) FILTER (fate = 'excluded') AS excluded, count(*) FILTER (fate = 'withheld') AS withheld, count(*) FILTER (fate = 'apply') AS applied, count(*) FILTER (fate = 'apply' AND action = 'upsert' AND NOT known) AS untracked FROM j GROUP BY 1, 2),
s AS (SELECT project_id, flush_id, count(*) AS hints FROM @hints GROUP BY 1, 2),
d AS (SELECT s.project_id, s.flush_id, hints, coalesce(excluded, 0) AS excluded, coalesce(withheld, 0) AS withheld, coalesce(applied, 0) AS applied, coalesce(untracked, 0) AS untracked, coalesce(overflowed, false) AS ov, sticky_reason, len(coalesce(rest, [])) > 0 AS unpaired
  FROM s LEFT JOIN c USING (project_id, flush_id) LEFT JOIN @flush_flags USING (project_id, flush_id) LEFT JOIN last USING (project_id, flush_id)),
e AS (SELECT *, CASE WHEN ov OR sticky_reason IS NOT NULL OR unpaired THEN 'full_scan' WHEN applied = 0 THEN 'apply' WHEN untracked > 0 THEN 'bounded_rescan' ELSE 'apply' END AS outcome FROM d)
"""


@query("m5_reconcile_decision", DECISIONS + """
SELECT project_id, flush_id, hints, outcome, CASE WHEN ov OR (sticky_reason IS NOT NULL) THEN 'backend_event' WHEN unpaired THEN 'unpaired_rename' WHEN outcome = 'bounded_rescan' THEN 'untracked_input' END AS trigger,
  CASE WHEN ov THEN 'backend_overflow' WHEN sticky_reason IS NOT NULL THEN sticky_reason WHEN unpaired THEN 'backend_overflow' END AS reason, excluded, withheld, applied FROM e""")
def _(read):
    return reconcile.reconcile_decision(read("hints"), read("known_hints"), read("flush_flags"))["decisions"]


@query("m5_rescan_paths", DECISIONS + """
SELECT DISTINCT j.project_id, j.flush_id, j.path FROM j JOIN e ON j.project_id = e.project_id AND j.flush_id = e.flush_id WHERE outcome = 'bounded_rescan' AND fate = 'apply' AND action = 'upsert' AND NOT known""")
def _(read):
    return reconcile.reconcile_decision(read("hints"), read("known_hints"), read("flush_flags"))["rescans"]
