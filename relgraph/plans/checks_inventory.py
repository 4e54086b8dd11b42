"""Registered queries: inventories, dirty sets, incremental replacement."""

from pyspark.sql import functions as F

from relgraph.operators import backlog, coverage, graph, inventory, snapshots
from relgraph.plans.registry import query, relation


@query("s2_known_inventory", "SELECT project_id, path, observed_hash FROM @files WHERE observed_hash IS NOT NULL")
def _(read):
    return inventory.known_inventory(read("files"))


@query("s3_dirty_scan", "SELECT project_id, path, observed_hash, desired_generation FROM @files WHERE desired_generation > indexed_generation")
def _(read):
    return inventory.dirty_files(read("files"))


@query("s5_poll_diff", """
SELECT project_id, path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS kind
FROM @stamps_before b FULL JOIN @stamps_after a USING (project_id, path)
WHERE b.path IS NULL OR a.path IS NULL OR a.size_bytes <> b.size_bytes OR a.modified_ns <> b.modified_ns""")
def _(read):
    return inventory.poll_diff(read("stamps_before"), read("stamps_after"))


@query("s11_publish_inputs", """
SELECT project_id, path FROM @files WHERE observed_hash IS NOT NULL AND NOT deleted AND regexp_matches(lower(path), '[.](cs|ts|tsx|mts|cts)$')""")
def _(read):
    return inventory.publish_inputs(read("files")).select("project_id", "path")


RECONCILED = """
WITH m AS (SELECT coalesce(f.project_id, o.project_id) AS project_id, coalesce(f.path, o.path) AS path, f.path IS NOT NULL AS stored, o.path IS NOT NULL AS seen,
             f.observed_hash, f.indexed_hash, f.desired_generation, f.indexed_generation, f.deleted, o.content_hash
           FROM @files f FULL JOIN @observed o ON f.project_id = o.project_id AND f.path = o.path),
v AS (SELECT *, CASE WHEN NOT stored THEN 'new-file' WHEN seen AND deleted THEN 'reappeared' WHEN seen AND observed_hash IS DISTINCT FROM content_hash THEN 'content-change'
        WHEN seen THEN 'unchanged' WHEN deleted THEN 'absent' ELSE 'deleted' END AS change FROM m)
"""


@query("j1_inventory_reconcile", RECONCILED + """
SELECT project_id, path, CASE WHEN seen THEN content_hash WHEN change = 'deleted' THEN NULL ELSE observed_hash END AS observed_hash, indexed_hash,
  CASE WHEN change IN ('unchanged', 'absent') THEN desired_generation ELSE 9 END AS desired_generation, coalesce(indexed_generation, 0) AS indexed_generation,
  NOT seen AS deleted FROM v""")
def _(read):
    return inventory.reconcile_inventory(read("files"), read("observed"), 9)["files"]


@query("j1_dirty_queue", RECONCILED + """
SELECT project_id, path, CAST(9 AS bigint) AS target_generation, change AS reason FROM v WHERE change NOT IN ('unchanged', 'absent')""")
def _(read):
    return inventory.reconcile_inventory(read("files"), read("observed"), 9)["dirty"]


relation("observed_twice", """SELECT project_id, path, content_hash FROM @observed
UNION ALL SELECT project_id, path, content_hash FROM @observed WHERE project_id IN ('src1', 'src2')""")


@query("j1_violations", """
SELECT DISTINCT project_id, 'duplicate-inventory-path' AS rule FROM (SELECT project_id FROM @observed_twice GROUP BY project_id, path HAVING count(*) > 1) d
UNION ALL SELECT project_id, 'generation-not-advancing' FROM @files GROUP BY project_id HAVING max(desired_generation) >= 5""")
def _(read):
    return inventory.reconcile_inventory(read("files"), read("observed_twice"), 5)["violations"]


@query("j3_dirty_paths", "SELECT project_id, path FROM @files WHERE desired_generation > indexed_generation")
def _(read):
    files = read("files")
    return inventory.dirty_paths(files, inventory.dirty_files(files))


@query("a10_inventory_report", RECONCILED + """
SELECT project_id, count(*) FILTER (change = 'new-file') AS added, count(*) FILTER (change IN ('content-change', 'reappeared')) AS changed,
  count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change NOT IN ('unchanged', 'absent')) AS queued
FROM v GROUP BY project_id""")
def _(read):
    return inventory.inventory_report(inventory.reconcile_inventory(read("files"), read("observed"), 9)["changes"])


@query("j21_inventory_differences", """
SELECT project_id, CASE WHEN f.path IS NULL THEN 'added:' WHEN o.path IS NULL THEN 'removed:' ELSE 'modified:' END || path AS difference
FROM (SELECT * FROM @files WHERE observed_hash IS NOT NULL) f FULL JOIN @observed o USING (project_id, path)
WHERE f.observed_hash IS DISTINCT FROM o.content_hash""")
def _(read):
    before = inventory.known_inventory(read("files")).withColumnRenamed("observed_hash", "content_hash")
    return inventory.inventory_differences(before, read("observed"))


@query("a12_inventory_digest", """
WITH l AS (SELECT DISTINCT project_id, sha256(path || chr(31) || content_hash || chr(10)) AS h FROM @observed),
f AS (SELECT project_id, substr(h, 1, 6) AS place, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS leaf FROM l GROUP BY 1, 2),
m AS (SELECT project_id, substr(place, 1, 3) AS top, sum(n) AS n, sha256(string_agg(place || ':' || leaf || chr(10), '' ORDER BY place)) AS mid FROM f GROUP BY 1, 2)
SELECT project_id, cast(sum(n) AS bigint) AS rows, sha256(string_agg(top || ':' || mid || chr(10), '' ORDER BY top)) AS digest FROM m GROUP BY 1""")
def _(read):
    return inventory.ordered_digest(read("observed"), ["project_id"], ["path", "content_hash"])


@query("a11_export_signatures")
def _(read):
    """No SQL twin: FNV. tests/ compares with a brute-force digest."""
    exports = read("nodes").select(F.col("owner_file").alias("file"), F.col("name"))
    return inventory.export_signatures(exports)


relation("facts_old", """SELECT owner_file AS file, sha2(owner_file, 256) AS digest, id AS key FROM @nodes WHERE start_line % 5 <> 0""")
relation("facts_new", """
SELECT owner_file AS file, CASE WHEN owner_file LIKE 'crm/orders/%7.ts' OR owner_file LIKE 'catalog%' THEN sha2(owner_file, 256) ELSE sha2(id, 256) END AS digest_raw, id AS key
FROM @nodes WHERE start_line % 7 <> 0 AND owner_file NOT LIKE 'geo%' AND owner_file NOT LIKE 'crm/orders/%9.ts'""")
relation("facts_after", """SELECT file, min(digest_raw) OVER (PARTITION BY file) AS digest, key FROM @facts_new""")


@query("u1_replacement_diff", """
WITH d AS (SELECT DISTINCT file, digest FROM @facts_after), same AS (SELECT d.file FROM d JOIN (SELECT DISTINCT file, digest FROM @facts_old) o ON d.file = o.file AND d.digest = o.digest),
j AS (SELECT coalesce(o.file, n.file) AS file, coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'retained' END AS status
  FROM (SELECT * FROM @facts_old WHERE file IN (SELECT file FROM d)) o FULL JOIN @facts_after n ON o.file = n.file AND o.key = n.key)
SELECT file, key, status FROM j WHERE file NOT IN (SELECT file FROM same)
UNION ALL SELECT file, key, 'skipped' FROM @facts_old WHERE file IN (SELECT file FROM same)""")
def _(read):
    return inventory.replacement_diff(read("facts_old"), read("facts_after"))


relation("signatures_before", """SELECT 'n' || cast(c_custkey AS string) AS file, sha2(c_name, 256) AS fingerprint FROM $customer WHERE c_custkey % 10 <> 3""")
relation("signatures_after", """SELECT 'n' || cast(c_custkey AS string) AS file, CASE WHEN c_custkey % 97 = 5 THEN sha2(c_mktsegment, 256) ELSE sha2(c_name, 256) END AS fingerprint
FROM $customer WHERE c_custkey % 101 <> 7""")
relation("file_deps", """
SELECT 'n' || cast(c_custkey AS string) AS target, 'n' || cast(c_custkey * 2 + 1 AS string) AS dependent FROM $customer
UNION ALL SELECT 'n' || cast(c_custkey AS string), 'n' || cast(c_custkey - 700 AS string) FROM $customer WHERE c_custkey % 9 = 0 AND c_custkey > 700""")

STALE = """
WITH RECURSIVE roots AS (
  SELECT coalesce(b.file, a.file) AS id, CASE WHEN b.file IS NULL THEN 'added' WHEN a.file IS NULL THEN 'removed' WHEN a.fingerprint <> b.fingerprint THEN 'changed' END AS part
  FROM @signatures_before b FULL JOIN @signatures_after a ON a.file = b.file),
r AS (SELECT id FROM roots WHERE part IN ('changed', 'removed') UNION SELECT dependent FROM r JOIN @file_deps d ON d.target = r.id)
"""


@query("u2_invalidation_plan", STALE + """
SELECT id AS file, part FROM roots WHERE part IS NOT NULL
UNION ALL SELECT id, 'stale' FROM r WHERE id NOT IN (SELECT id FROM roots WHERE part IN ('changed', 'removed'))""")
def _(read):
    plan = inventory.invalidation_plan(read("signatures_before"), read("signatures_after"), read("file_deps"))
    return snapshots.union_shards(
        [plan[part].select("file", F.lit(part).alias("part")) for part in ("changed", "removed", "added", "stale")]
    )


@query("j23_cleared_edges", """
SELECT DISTINCT d.dependent, d.target, d.dependent IN (SELECT file FROM @signatures_after) AS diagnosed FROM @file_deps d
WHERE d.target IN (SELECT file FROM @signatures_before) AND d.target NOT IN (SELECT file FROM @signatures_after)""")
def _(read):
    before, after = read("signatures_before"), read("signatures_after")
    removed = before.join(after, "file", "left_anti").select(F.col("file").alias("target"))
    return inventory.cleared_edges(removed, read("file_deps"), after)


# two projects with the same paths and ids; some edges of the second point into the first
relation("twin_nodes", """
SELECT 'a' AS project_id, id, owner_file, kind, qualified_name, start_line FROM @nodes
UNION ALL SELECT 'b', id, owner_file, kind, qualified_name, start_line FROM @nodes""")
relation("twin_edges", """
SELECT 'a' AS project_id, id, owner_file, source_id, kind, CASE WHEN target_id IS NULL THEN NULL ELSE 'a' END AS target_project_id, target_id, unresolved_target, resolution, line FROM @edges
UNION ALL SELECT 'b', id, owner_file, source_id, kind, CASE WHEN target_id IS NULL THEN NULL WHEN line % 3 = 0 THEN 'a' ELSE 'b' END, target_id, unresolved_target, resolution, line FROM @edges""")


@query("j17_invalidate_incoming", """
WITH gone AS (SELECT project_id, id, qualified_name, owner_file FROM @twin_nodes WHERE project_id = 'a' AND (owner_file LIKE 'catalog/%1.ts' OR owner_file LIKE 'crm/orders/%3.ts')),
j AS (SELECT e.*, g.qualified_name, g.id IS NOT NULL AND (g.project_id <> e.project_id OR g.owner_file <> e.owner_file) AS hit FROM @twin_edges e LEFT JOIN gone g ON e.target_project_id = g.project_id AND e.target_id = g.id)
SELECT project_id, id, CASE WHEN NOT hit THEN target_id END AS target_id, CASE WHEN hit THEN qualified_name ELSE unresolved_target END AS unresolved_target,
  CASE WHEN hit THEN 'unresolved' ELSE resolution END AS resolution FROM j""")
def _(read):
    owner = F.col("owner_file")
    gone = read("twin_nodes").where((owner.like("catalog/%1.ts") | owner.like("crm/orders/%3.ts")) & (F.col("project_id") == "a"))
    return inventory.invalidate_incoming(read("twin_edges"), gone).select("project_id", "id", "target_id", "unresolved_target", "resolution")


relation("done_files", """
SELECT DISTINCT 'a' AS project_id, owner_file, cast(CASE WHEN owner_file LIKE '%1.ts' THEN 2 ELSE 1 END AS bigint) AS generation, sha2(owner_file, 256) AS hash
FROM @nodes WHERE owner_file LIKE 'catalog/%' OR owner_file LIKE 'crm/orders/%3.ts'""")
relation("graph_files", """SELECT DISTINCT project_id, owner_file AS path, cast(2 AS bigint) AS desired_generation, cast(1 AS bigint) AS indexed_generation, cast(NULL AS string) AS indexed_hash FROM @twin_nodes""")


@query("m11_replace_facts", """
WITH n AS (SELECT n.*, d.generation IS NOT NULL AS done FROM @twin_nodes n LEFT JOIN @done_files d ON n.project_id = d.project_id AND n.owner_file = d.owner_file),
e AS (SELECT e.*, d.generation IS NOT NULL AS done FROM @twin_edges e LEFT JOIN @done_files d ON e.project_id = d.project_id AND e.owner_file = d.owner_file),
k AS (SELECT e.*, g.qualified_name FROM e LEFT JOIN n g ON g.done AND e.target_project_id = g.project_id AND e.target_id = g.id WHERE NOT e.done)
SELECT project_id, id, 'node' AS part, owner_file || '/' || qualified_name AS detail FROM n WHERE NOT done
UNION ALL SELECT project_id, id || '/v2', 'node', owner_file || '/' || qualified_name FROM n WHERE done AND start_line % 2 = 0
UNION ALL SELECT project_id, id, 'edge', CASE WHEN qualified_name IS NOT NULL THEN 'unresolved>' || qualified_name ELSE resolution || '>' || coalesce(target_id, unresolved_target) END FROM k
UNION ALL SELECT project_id, id || '/v2', 'edge', resolution || '>' || coalesce(target_id, unresolved_target) FROM e WHERE done AND line % 2 = 0
UNION ALL SELECT f.project_id, path, 'file', cast(CASE WHEN d.generation = 2 THEN 2 ELSE 1 END AS varchar) || coalesce(CASE WHEN d.generation = 2 THEN d.hash END, '')
  FROM @graph_files f LEFT JOIN @done_files d ON f.project_id = d.project_id AND f.path = d.owner_file""")
def _(read):
    nodes, edges, done = read("twin_nodes"), read("twin_edges"), read("done_files")
    owners = done.select("project_id", "owner_file")
    renewed = F.concat("id", F.lit("/v2"))
    fresh = nodes.join(owners, ["project_id", "owner_file"], "left_semi").where(F.col("start_line") % 2 == 0).withColumn("id", renewed)
    drawn = edges.join(owners, ["project_id", "owner_file"], "left_semi").where(F.col("line") % 2 == 0).withColumn("id", renewed)
    out = inventory.replace_facts(nodes, edges, read("graph_files"), done, fresh, drawn)
    target = F.coalesce("target_id", "unresolved_target")
    return snapshots.union_shards([
        out["nodes"].select("project_id", "id", F.lit("node").alias("part"), F.concat("owner_file", F.lit("/"), "qualified_name").alias("detail")),
        out["edges"].select("project_id", "id", F.lit("edge").alias("part"), F.concat("resolution", F.lit(">"), target).alias("detail")),
        out["files"].select("project_id", F.col("path").alias("id"), F.lit("file").alias("part"), F.concat(F.col("indexed_generation").cast("string"), F.coalesce("indexed_hash", F.lit(""))).alias("detail")),
    ])


relation("dirty_facts", """
SELECT project_id, id, owner_file, kind, CASE WHEN start_line % 97 = 0 THEN '' ELSE qualified_name END AS qualified_name FROM @twin_nodes WHERE project_id = 'a' OR start_line % 71 <> 0
UNION ALL SELECT project_id, id, owner_file, kind, qualified_name FROM @twin_nodes WHERE start_line % 89 = 0 AND project_id = 'a'""")
relation("dirty_edges", """
SELECT project_id, id, owner_file, source_id, kind, target_id, unresolved_target, CASE WHEN line % 83 = 0 THEN 'unresolved' ELSE resolution END AS resolution FROM @twin_edges
UNION ALL SELECT project_id, id, owner_file, source_id, '', target_id, unresolved_target, resolution FROM @twin_edges WHERE line % 79 = 0 AND project_id = 'b'""")


@query("p12_audit_facts", """
SELECT project_id, owner_file, 'too-many-nodes' AS rule, cast(count(*) AS varchar) AS subject FROM @dirty_facts GROUP BY project_id, owner_file HAVING count(*) > 80
UNION ALL SELECT project_id, owner_file, 'too-many-edges', cast(count(*) AS varchar) FROM @dirty_edges GROUP BY project_id, owner_file HAVING count(*) > 200
UNION ALL SELECT project_id, owner_file, 'incomplete-node', id FROM @dirty_facts WHERE qualified_name = ''
UNION ALL SELECT project_id, owner_file, 'duplicate-node', id FROM @dirty_facts GROUP BY project_id, owner_file, id HAVING count(*) > 1
UNION ALL SELECT project_id, owner_file, 'incomplete-edge', id FROM @dirty_edges WHERE kind = ''
UNION ALL SELECT project_id, owner_file, 'duplicate-edge', id FROM @dirty_edges GROUP BY project_id, owner_file, id HAVING count(*) > 1
UNION ALL SELECT project_id, owner_file, 'orphan-edge-source', id FROM @dirty_edges e WHERE NOT EXISTS (SELECT 1 FROM @dirty_facts n WHERE n.project_id = e.project_id AND n.owner_file = e.owner_file AND n.id = e.source_id)
UNION ALL SELECT project_id, owner_file, 'resolution-target-mismatch', id FROM @dirty_edges WHERE (unresolved_target IS NOT NULL) <> (resolution = 'unresolved')""")
def _(read):
    return inventory.audit_facts(read("dirty_facts"), read("dirty_edges"), max_nodes=80, max_edges=200)


relation("projects", """SELECT DISTINCT project_id AS id, 'sol' || cast(length(project_id) % 3 AS string) AS solution_id FROM @shared_nodes""", stored=True)
relation("owned_edges", """SELECT id, project_id AS owner_project, CASE WHEN line % 7 = 0 THEN target_project_id ELSE project_id END AS source_project, source_id FROM @shared_edges""")
relation("job_files", """SELECT j.id AS job_id, p.id AS project_id, j.id || '.cs' AS path FROM @jobs j JOIN @projects p ON length(j.id) % 5 = length(p.id) % 5""")
relation("revisions", """SELECT 'r' || cast(n_nationkey AS string) AS id, 'sol' || cast(n_nationkey % 4 AS string) AS solution_id FROM $nation""")
relation("outbox_rows", """SELECT 'o' || p.id || r.id AS id, p.id AS project_id, CASE WHEN length(p.id) > 5 THEN r.id END AS revision_id FROM @projects p JOIN @revisions r ON length(p.id) <> length(r.id)""")


@query("u7_remove_solution", """
WITH g AS (SELECT id FROM @projects WHERE solution_id = 'sol1'), j AS (SELECT id FROM @jobs WHERE solution_id = 'sol1'), r AS (SELECT id FROM @revisions WHERE solution_id = 'sol1')
SELECT 'edges' AS part, owner_project || id AS id FROM @owned_edges WHERE owner_project NOT IN (SELECT id FROM g) AND source_project NOT IN (SELECT id FROM g)
UNION ALL SELECT 'nodes', project_id || id FROM @shared_nodes WHERE project_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'files', project_id || path FROM @files WHERE project_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'dirty_files', project_id || path FROM @files WHERE desired_generation > indexed_generation AND project_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'job_files', project_id || path FROM @job_files WHERE project_id NOT IN (SELECT id FROM g) AND job_id NOT IN (SELECT id FROM j)
UNION ALL SELECT 'job_attempts', id FROM @jobs WHERE solution_id <> 'sol1'
UNION ALL SELECT 'publish_outbox', id FROM @outbox_rows WHERE project_id NOT IN (SELECT id FROM g) AND (revision_id IS NULL OR revision_id NOT IN (SELECT id FROM r))
UNION ALL SELECT t, id FROM (SELECT unnest(['catalog_refs', 'published_generations', 'projects']) AS t, id FROM @projects WHERE solution_id <> 'sol1')
UNION ALL SELECT t, id FROM (SELECT unnest(['graph_revisions', 'runtime_checkpoints']) AS t, id FROM @revisions WHERE solution_id <> 'sol1')
UNION ALL SELECT 'jobs', id FROM @jobs WHERE solution_id <> 'sol1'
UNION ALL SELECT 'solutions', id FROM (SELECT DISTINCT solution_id AS id FROM @projects) WHERE id <> 'sol1'""")
def _(read):
    projects, files = read("projects"), read("files")
    owned = projects.withColumn("project_id", F.col("id"))
    tables = {
        "projects": projects, "nodes": read("shared_nodes"), "edges": read("owned_edges", once=True), "files": files, "jobs": read("jobs"),
        "dirty_files": files.where("desired_generation > indexed_generation"), "job_files": read("job_files"),
        "job_attempts": read("jobs").withColumn("job_id", F.col("id")), "catalog_refs": owned, "published_generations": owned,
        "publish_outbox": read("outbox_rows"), "graph_revisions": read("revisions"), "runtime_checkpoints": read("revisions"),
        "solutions": projects.select(F.col("solution_id").alias("id")).distinct(),
    }
    shown = {"files": ["project_id", "path"], "dirty_files": ["project_id", "path"], "job_files": ["project_id", "path"],
             "nodes": ["project_id", "id"], "edges": ["owner_project", "id"]}
    left = inventory.remove_solution(tables, "sol1")
    return snapshots.union_shards([df.select(F.lit(t).alias("part"), F.concat(*shown.get(t, ["id"])).alias("id")) for t, df in left.items()])


@query("w1_occurrence_keys", """
SELECT file, line, base_key, CASE WHEN count(*) OVER (PARTITION BY file, base_key) > 1 THEN row_number() OVER (PARTITION BY file, base_key ORDER BY line) - 1 END AS occurrence FROM @decls""")
def _(read):
    return inventory.occurrence_keys(read("decls")).select("file", "line", "base_key", "occurrence")


@query("w5_anonymous_ordinals", """
SELECT file, line, CASE WHEN quality <> 'explicit' THEN cast(sum(CASE WHEN quality <> 'explicit' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line) AS bigint) END AS ordinal FROM @decls""")
def _(read):
    return inventory.anonymous_ordinals(read("decls")).select("file", "line", "ordinal")


# ---- coverage -----------------------------------------------------------------
@query("a1_publish_coverage", """
WITH f AS (SELECT *, regexp_matches(lower(path), '[.](cs|ts|tsx|mts|cts)$') AS ok FROM @files WHERE observed_hash IS NOT NULL AND NOT deleted)
SELECT project_id, count(*) FILTER (ok) AS input_files, count(*) FILTER (ok AND indexed_generation >= desired_generation) AS processed_files, count(*) FILTER (NOT ok) AS unsupported_inputs,
  CASE WHEN count(*) FILTER (ok) = count(*) FILTER (ok AND indexed_generation >= desired_generation) AND count(*) FILTER (NOT ok) = 0 THEN 'complete_for_profile' ELSE 'partial' END AS status
FROM f GROUP BY project_id""")
def _(read):
    return coverage.publish_coverage(read("files"))["coverage"]


def _reports(read):
    diagnostics = F.array_compact(F.array(F.when(F.col("code").isNotNull(), F.struct("code", "severity"))))
    return read("file_reports").withColumn("diagnostics", diagnostics)


@query("a2_file_coverage", """
SELECT project_id, count(*) AS input_files, count(*) FILTER (outcome = 'fresh' AND NOT stale) AS processed_files, count(*) FILTER (code IS NOT NULL AND severity = 'error') AS unresolved_references,
  CASE WHEN count(*) = count(*) FILTER (outcome = 'fresh' AND NOT stale) THEN 'complete_for_profile' ELSE 'partial' END AS status FROM @file_reports GROUP BY project_id""")
def _(read):
    return coverage.file_coverage(_reports(read))["coverage"]


@query("a2_coverage_patterns", """
WITH bad AS (SELECT project_id FROM @file_reports GROUP BY project_id HAVING count(*) <> count(*) FILTER (outcome = 'fresh' AND NOT stale)),
p AS (SELECT project_id, code AS pattern FROM @file_reports WHERE severity = 'error' AND code IS NOT NULL UNION SELECT project_id, skip_reason FROM @file_reports WHERE outcome = 'skipped'
  UNION SELECT project_id, 'file-retained-last-known-good' FROM @file_reports WHERE stale)
SELECT project_id, pattern FROM p WHERE project_id IN (SELECT project_id FROM bad)""")
def _(read):
    return coverage.file_coverage(_reports(read))["patterns"]


RULES = """
WITH s AS (SELECT *, CASE WHEN analysed = 0 AND unsupported = 0 THEN 'not_exercised' WHEN analysed = 0 THEN 'unsupported' WHEN unsupported = 0 THEN 'analysed' ELSE 'partially_analysed' END AS status,
  findings <= analysed AS consistent FROM @rule_counts) """


@query("a3_rule_coverage", RULES + "SELECT * FROM s")
def _(read):
    return coverage.rule_coverage(read("rule_counts"))["rules"]


@query("a3_rule_report", RULES + """, g AS (
SELECT report_id, CASE WHEN count(*) FILTER (status <> 'not_exercised') = 0 THEN 'unsupported' WHEN count(*) FILTER (status <> 'analysed') = 0 THEN 'complete_for_profile' ELSE 'partial' END AS status,
  cast(sum(analysed) AS bigint) AS analysed, cast(sum(unsupported) AS bigint) AS unsupported, cast(sum(findings) AS bigint) AS findings, bool_and(consistent) AS consistent,
  count(*) FILTER (status = 'not_exercised') AS unexercised_rules FROM s GROUP BY report_id)
SELECT *, status = 'complete_for_profile' AND findings > 0 AS claims_complete FROM g""")
def _(read):
    return coverage.rule_coverage(read("rule_counts"))["reports"]


relation("coverage_expected", """SELECT DISTINCT 'sol' || cast(cast(substr(source, 4) AS bigint) % 4 AS string) AS solution_id, source AS project_id FROM $documents""")
relation("coverage_docs", """
SELECT source AS project_id, CASE WHEN min(doc_id) % 4 = 1 THEN 'partial' WHEN source = 'src6' THEN 'unsupported' ELSE 'complete_for_profile' END AS status, count(*) AS input_files,
  cast(sum(doc_id % 2) AS bigint) AS processed_files, cast(sum(doc_id % 3) AS bigint) AS unresolved_references FROM $documents WHERE source <> 'src5' GROUP BY source""")


@query("a4_combined_coverage", """
SELECT solution_id, CASE WHEN count(*) <> count(d.project_id) THEN 'unknown' WHEN count(*) FILTER (status = 'unsupported') > 0 THEN 'unsupported' WHEN count(*) FILTER (status = 'partial') > 0 THEN 'partial' ELSE 'complete_for_profile' END AS status,
  count(*) = count(d.project_id) AS present, CASE WHEN count(*) = count(d.project_id) THEN cast(sum(input_files) AS bigint) END AS input_files, CASE WHEN count(*) = count(d.project_id) THEN cast(sum(processed_files) AS bigint) END AS processed_files,
  CASE WHEN count(*) = count(d.project_id) THEN cast(sum(unresolved_references) AS bigint) END AS unresolved_references
FROM @coverage_expected e LEFT JOIN @coverage_docs d ON e.project_id = d.project_id GROUP BY solution_id""")
def _(read):
    docs = read("coverage_docs").withColumn("patterns", F.array(F.lit("x")))
    return coverage.combine_coverage(read("coverage_expected"), docs, "solution_id")["coverage"]


@query("a5_index_coverage", """
SELECT project_id, count(*) AS total_files, count(*) FILTER (desired_generation > indexed_generation) AS pending_files FROM @files WHERE NOT deleted GROUP BY project_id""")
def _(read):
    return coverage.index_coverage(read("files"))


relation("outcomes", """
SELECT project AS project_id, count(*) AS added, cast(sum(doc_id % 2) AS bigint) AS changed, cast(sum(doc_id % 3) AS bigint) AS deleted, cast(sum(doc_id % 5) AS bigint) AS analyzed,
  cast(sum(bytes) AS bigint) AS nodes, cast(sum(doc_id) AS bigint) AS edges, CASE WHEN project = 'src3' THEN 'partial' ELSE 'complete_for_profile' END AS coverage,
  CASE WHEN project = 'src4' THEN NULL ELSE max(content_hash) END AS current_generation FROM @corpus GROUP BY project""")


@query("a9_cycle_totals", """
SELECT cast(sum(added + changed + deleted) AS bigint) AS files_changed, cast(sum(analyzed) AS bigint) AS files_analyzed, cast(sum(nodes) AS bigint) AS nodes, cast(sum(edges) AS bigint) AS edges,
  CASE WHEN count(*) FILTER (coverage <> 'complete_for_profile' OR current_generation IS NULL) > 0 THEN 'partial' ELSE 'success' END AS result FROM @outcomes""")
def _(read):
    return coverage.cycle_totals(read("outcomes"))
