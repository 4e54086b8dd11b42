"""Registered queries: bounded answers, reachability, publishing, diagrams."""

from pyspark.sql import functions as F

from relgraph.functions import kinds
from relgraph.operators import coverage, graph, inventory, publish, snapshots
from relgraph.plans.registry import query, relation

# Published records with their JSON text, written by hand.
relation("record_docs", """
SELECT 0 AS role, id, qualified_name AS readable, cast(NULL AS string) AS source_id, cast(NULL AS string) AS to_id, 'node' AS kind,
  '{"id":' || to_json(id) || ',"kind":' || to_json(kind) || ',"language":' || to_json(language) || ',"name":' || to_json(name) || ',"project_id":' || to_json(project_id)
  || ',"qualified_name":' || to_json(qualified_name) || ',"source":{"end_line":' || end_line || ',"file":' || to_json(file) || ',"start_line":' || start_line || '}}' AS body FROM @pub_nodes
UNION ALL
SELECT 1, id, NULL, source_id, coalesce(target_id, unresolved_target), 'edge',
  '{"analyzer_id":' || to_json(analyzer_id) || ',"evidence":[{"rule_id":"declaration-contains-v1","source":{"end_line":' || end_line || ',"file":' || to_json(file) || ',"start_line":' || start_line
  || '}}],"id":' || to_json(id) || ',"kind":' || to_json(kind) || ',"resolution":' || to_json(resolution) || ',"source_id":' || to_json(source_id)
  || coalesce(',"target_id":' || to_json(target_id), '') || ',"target_project_id":' || to_json(target_project_id) || coalesce(',"unresolved_target":' || to_json(unresolved_target), '') || '}' FROM @pub_edges""")


def _context_sql(symbol: str, tail: str, max_bytes: int, max_nodes: int) -> str:
    return f"""
WITH hit AS (SELECT * FROM @record_docs WHERE id = '{symbol}' OR readable = '{symbol}' OR list_contains(string_split(id, ':'), '{symbol}')),
seed AS (SELECT id AS s FROM hit UNION SELECT readable FROM hit WHERE readable IS NOT NULL),
cand AS (SELECT 0 AS phase, * FROM hit UNION ALL SELECT 1, * FROM @record_docs d WHERE role = 1 AND id NOT IN (SELECT id FROM hit WHERE role = 1) AND (source_id IN (SELECT s FROM seed) OR to_id IN (SELECT s FROM seed))),
num AS (SELECT *, row_number() OVER (ORDER BY phase, role, id) AS rn, strlen('{{"key":' || to_json(id) || ',"kind":"' || kind || '","body":' || body || '}}') AS length FROM cand),
run AS (SELECT *, sum(length) OVER (ORDER BY rn) AS running FROM num),
stop AS (SELECT min(rn) AS cut_at FROM run WHERE rn > {max_nodes} OR running + 1024 > {max_bytes}),
res AS (SELECT run.*, cut_at, cut_at IS NULL OR rn < cut_at AS taken FROM run, stop)
{tail}"""


RECORDS = "SELECT rn, id, kind AS record_kind, cast(length AS bigint) AS length, md5(body) AS body FROM res WHERE taken"
ENVELOPE = """SELECT count(*) FILTER (taken) AS records, cast(coalesce(sum(length) FILTER (taken), 0) AS bigint) AS bytes,
  CASE WHEN max(cut_at) IS NULL THEN 0 ELSE count(*) - count(*) FILTER (taken) END AS omitted, max(cut_at) IS NOT NULL AS truncated,
  CASE WHEN max(cut_at) IS NULL THEN '' WHEN max(cut_at) > {n} THEN 'node-limit' ELSE 'byte-limit' END AS reasons FROM res"""


@query("g1_context", _context_sql("Catalog.red widget", RECORDS, 60_000, 500))
def _(read):
    out = graph.context(read("pub_nodes"), read("pub_edges"), "Catalog.red widget", graph.Limits(60_000, 500, 1))
    return out["records"].select("rn", "id", "record_kind", "length", F.md5("body").alias("body"))


@query("g1_context_id_part", _context_sql("3", RECORDS, 1_000_000, 200))
def _(read):
    out = graph.context(read("pub_nodes"), read("pub_edges"), "3", graph.Limits(1_000_000, 200, 3))
    return out["records"].select("rn", "id", "record_kind", "length", F.md5("body").alias("body"))


@query("w6_answer_budget", _context_sql("nation:7", ENVELOPE.format(n=64), 8192, 64))
def _(read):
    out = graph.context(read("pub_nodes"), read("pub_edges"), "nation:7", graph.Limits())
    return out["envelope"].withColumn("reasons", F.array_join("reasons", ","))


@query("w6_node_limit", _context_sql("nation:7", ENVELOPE.format(n=9), 1_000_000, 9))
def _(read):
    out = graph.context(read("pub_nodes"), read("pub_edges"), "nation:7", graph.Limits(1_000_000, 9, 1))
    return out["envelope"].withColumn("reasons", F.array_join("reasons", ","))


IMPACT = """
WITH RECURSIVE s AS (SELECT DISTINCT coalesce(target_id, unresolved_target) AS to_id, source_id FROM @pub_edges),
r AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT s.source_id, r.depth + 1 FROM r JOIN s ON s.to_id = r.id WHERE r.depth < {depth})
"""


@query("g2_impact_reach", IMPACT.format(start="part:7", depth=6) + "SELECT id, cast(min(depth) AS bigint) AS depth FROM r GROUP BY id")
def _(read):
    reached = graph.impact_reach(read("pub_edges"), "part:7", 6)
    return reached.select("id", F.col("depth").cast("long").alias("depth"))


@query("g2_impact_two_hops", IMPACT.format(start="Catalog.blue bolt", depth=2) + """
, d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
SELECT e.id, 'edge' AS record_kind FROM @pub_edges e JOIN d ON e.source_id = d.id WHERE depth > 0
UNION ALL SELECT n.id, 'node' FROM @pub_nodes n WHERE n.id IN (SELECT id FROM d WHERE depth > 0) OR n.qualified_name IN (SELECT id FROM d WHERE depth > 0)""")
def _(read):
    nodes, edges = read("pub_nodes"), read("pub_edges")
    reached = graph.impact_reach(edges, "Catalog.blue bolt", 2)
    return graph.impact_candidates(nodes, edges, reached).select("id", "record_kind")


@query("g2_impact")
def _(read):
    """Rows in discovery order; tests/ compare it with a queue-based walk."""
    out = graph.impact(read("pub_nodes"), read("pub_edges"), "part:11", graph.Limits(200_000, 400, 3))
    return out["records"].select("rn", "id", "record_kind", "length")


@query("g3_dependents", """
WITH RECURSIVE r AS (SELECT 'part:' || p_partkey AS id FROM $part WHERE p_partkey % 400 = 1 UNION SELECT dependent FROM r JOIN @deps d ON d.target = r.id)
SELECT id FROM r WHERE id NOT IN (SELECT 'part:' || p_partkey FROM $part WHERE p_partkey % 400 = 1)""")
def _(read):
    roots = read("part").where("p_partkey % 400 = 1").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    return graph.dependents(read("deps"), roots).select("id")


relation("symbol_files", """SELECT id, owner_file AS file, cast(length(owner_file) * 100 AS bigint) AS bytes FROM @nodes""")

CLOSURE = """
WITH RECURSIVE r AS (SELECT 'region:1' AS id UNION SELECT target_id FROM r JOIN @edges e ON e.source_id = r.id WHERE target_id IS NOT NULL)
"""


@query("g4_closure", CLOSURE + "SELECT id FROM r")
def _(read):
    return graph.closure(read("edges"), read("symbol_files"), "region:1")["members"].select("id")


@query("g4_closure_summary", CLOSURE + """
SELECT (SELECT count(*) FROM r) AS nodes, count(*) AS files, cast(sum(bytes) AS bigint) AS bytes FROM (SELECT DISTINCT file, bytes FROM @symbol_files WHERE id IN (SELECT id FROM r))""")
def _(read):
    return graph.closure(read("edges"), read("symbol_files"), "region:1")["summary"]


relation("selection", """SELECT id FROM @nodes WHERE start_line % 3 = 0 UNION ALL SELECT 'node:absent' || cast(r_regionkey AS string) FROM $region""")


@query("p8_g5_induced_graph", """
WITH s AS (SELECT id FROM @selection)
SELECT 'node' AS part, id FROM @nodes WHERE id IN (SELECT id FROM s)
UNION ALL SELECT 'edge', id FROM @edges WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s)
UNION ALL SELECT 'missing', id FROM s WHERE id NOT IN (SELECT id FROM @nodes)""")
def _(read):
    out = graph.project_graph(read("nodes"), read("edges"), read("selection"))
    return snapshots.union_shards(
        [out["nodes"].select(F.lit("node").alias("part"), "id"), out["edges"].select(F.lit("edge").alias("part"), "id"),
         out["missing"].select(F.lit("missing").alias("part"), "id")]
    )


@query("p8_exact_projection", """
WITH s AS MATERIALIZED (SELECT DISTINCT id FROM @selection), w AS MATERIALIZED (SELECT id, source_id, target_id FROM @edges WHERE id LIKE 'e3:%'),
k AS MATERIALIZED (SELECT w.id FROM w JOIN s a ON a.id = w.source_id JOIN s b ON b.id = w.target_id)
SELECT 'edge' AS part, id FROM k
UNION ALL SELECT 'missing edge', w.id FROM w LEFT JOIN k ON k.id = w.id WHERE k.id IS NULL""")
def _(read):
    wanted = read("edges").where("id LIKE 'e3:%'").select("id")
    out = graph.project_graph(read("nodes"), read("edges"), read("selection"), wanted, exact=True)
    return out["edges"].select(F.lit("edge").alias("part"), "id").unionByName(
        out["missing"].where("kind = 'edge'").select(F.lit("missing edge").alias("part"), "id")
    )


relation("node_files", """SELECT project_id, owner_file AS path, cast(2 AS bigint) AS desired_generation, cast(CASE WHEN project_id = 'crm3' AND owner_file LIKE '%7.cs' THEN 1 ELSE 2 END AS bigint) AS indexed_generation,
  false AS deleted FROM @nodes GROUP BY project_id, owner_file""")


@query("j2_incoming_references", """
WITH t AS (SELECT id AS node_id, project_id, qualified_name FROM @nodes WHERE start_line % 50 = 0),
ready AS (SELECT project_id FROM @node_files GROUP BY project_id HAVING count(*) FILTER (desired_generation > indexed_generation) = 0)
SELECT DISTINCT t.node_id, e.id AS edge_id, e.source_id, e.kind, e.resolution, e.target_id, e.unresolved_target, n.project_id AS source_project_id
FROM @edges e JOIN t ON e.target_project_id = t.project_id AND (e.target_id = t.node_id OR e.unresolved_target = t.qualified_name) JOIN @nodes n ON n.id = e.source_id
WHERE t.project_id IN (SELECT project_id FROM ready)""")
def _(read):
    cov = coverage.index_coverage(read("node_files"))
    targets = read("nodes").where("start_line % 50 = 0").select("id")
    return graph.incoming_references(read("nodes"), read("edges"), cov, targets)["references"]


@query("j2_not_indexed", "SELECT id AS node_id, project_id AS target_project_id FROM @nodes WHERE start_line % 50 = 0 AND project_id = 'crm3'")
def _(read):
    cov = coverage.index_coverage(read("node_files"))
    targets = read("nodes").where("start_line % 50 = 0").select("id")
    return graph.incoming_references(read("nodes"), read("edges"), cov, targets)["not_indexed"]


PUBLISHED = """
WITH k AS (SELECT *, CASE kind WHEN 'namespace' THEN 'Namespace' WHEN 'class' THEN 'Class' WHEN 'interface' THEN 'Interface' WHEN 'method' THEN 'Method' WHEN 'function' THEN 'Function' WHEN 'variable' THEN 'Property' END AS ck FROM @shared_nodes),
o AS (SELECT *, row_number() OVER (PARTITION BY project_id, language, ck, qualified_name ORDER BY owner_file, start_line, id) AS occ FROM k WHERE ck IS NOT NULL),
p AS (SELECT *, qualified_name || CASE WHEN occ = 1 THEN '' ELSE '#' || occ END AS pkey FROM o),
n AS (SELECT *, sha256('[' || to_json(project_id) || ',' || to_json(language) || ',' || to_json(ck) || ',' || to_json(pkey) || ']') AS pub FROM p)
"""
PUBLISHED_EDGES = PUBLISHED + """
, e AS (SELECT e.project_id, s.pub AS source_id, t.pub AS target_id, CASE WHEN t.pub IS NULL THEN coalesce(e.unresolved_target, x.qualified_name, e.owner_file) END AS unresolved_target, e.target_project_id,
   CASE WHEN t.pub IS NULL THEN 'unresolved' WHEN resolution = 'unresolved' THEN 'exact_static' ELSE resolution END AS resolution, '[[' || to_json(e.owner_file) || ',' || line || ',' || line || ',"declaration-contains-v1"]]' AS ev
   FROM @shared_edges e JOIN n s ON e.source_id = s.id AND e.project_id = s.project_id LEFT JOIN n t ON e.target_id = t.id AND e.target_project_id = t.project_id
   LEFT JOIN @shared_nodes x ON e.target_id = x.id AND e.target_project_id = x.project_id WHERE e.kind = 'contains'),
d AS (SELECT DISTINCT sha256('[' || to_json(source_id) || ',"CONTAINS",' || to_json(coalesce(target_id, unresolved_target)) || ',' || to_json(ev) || ']') AS id, project_id, source_id, target_id, unresolved_target, target_project_id, resolution FROM e)
"""


@query("w2_occurrence_suffix", PUBLISHED + "SELECT project_id, id, occ AS occurrence, pkey AS published_key FROM p")
def _(read):
    return publish.occurrence_suffix(read("shared_nodes")).select("project_id", "id", "occurrence", "published_key")


@query("j16_published_nodes", PUBLISHED + "SELECT pub AS id, project_id, ck AS kind, name, pkey AS qualified_name, language, owner_file AS file, start_line FROM n")
def _(read):
    nodes = publish.publish_graph(read("shared_nodes"), read("shared_edges"))["nodes"]
    return nodes.select("id", "project_id", "kind", "name", "qualified_name", "language", F.col("source.file").alias("file"), "source.start_line")


@query("j16_published_edges", PUBLISHED_EDGES + "SELECT * FROM d")
def _(read):
    wanted = ["id", "project_id", "source_id", "target_id", "unresolved_target", "target_project_id", "resolution"]
    return publish.publish_graph(read("shared_nodes"), read("shared_edges", inline=("shared_edges",)), wanted)["edges"].select(*wanted)


@query("j16_publication_coverage", PUBLISHED_EDGES + """
, f AS (SELECT project_id, count(*) AS input_files, count(*) FILTER (indexed_generation >= desired_generation) AS processed_files FROM @node_files GROUP BY 1),
u AS (SELECT project_id, count(*) AS n FROM d WHERE unresolved_target IS NOT NULL GROUP BY 1)
SELECT f.project_id, CASE WHEN processed_files = input_files THEN 'complete_for_profile' ELSE 'partial' END AS status, input_files, processed_files, coalesce(n, 0) AS unresolved_references FROM f LEFT JOIN u USING (project_id)""")
def _(read):
    edges = publish.publish_graph(read("shared_nodes"), read("shared_edges", inline=("shared_edges",)), ["project_id", "unresolved_target"])["edges"]
    return publish.publication_coverage(edges, read("node_files"))


@query("t3_publish_order", "SELECT id, row_number() OVER (ORDER BY id) AS position FROM @nodes")
def _(read):
    """The rows as written, numbered in file order: each partition's count is added up on the small side."""
    ordered = publish.publish_order(read("nodes").select("id"), 8).withColumn("_at", F.monotonically_increasing_id())
    placed = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    from pyspark.sql import Window as W

    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(starts.withColumn("before", before), "_part").select("id", (F.col("_row") + F.col("before") + 1).alias("position"))


relation("edges_twice", "SELECT * FROM @edges UNION ALL SELECT * FROM @edges WHERE line % 4 = 0")


@query("u6_dedup_edges", "SELECT DISTINCT id, source_id, target_id FROM @edges_twice")
def _(read):
    return publish.dedup_edges(read("edges_twice", once=True), ["id", "source_id", "target_id"])


@query("u5_union_shards", "SELECT id, project_id FROM @nodes UNION ALL SELECT id, target_project_id FROM @edges")
def _(read):
    return snapshots.union_shards([read("nodes").select("id", "project_id"), read("edges", once=True).select("id", F.col("target_project_id").alias("project_id"))])


relation("shard_plan", "SELECT id AS key, line % 16 AS bucket, 'bucket-' || cast(line % 16 AS string) AS shard FROM @edges WHERE line % 100 <> 1")


@query("j14_edge_locators", """
SELECT e.id AS key, e.source_id AS from_id, coalesce(e.target_id, '') AS to_id, e.kind AS relation, p.bucket, p.shard, false AS complete FROM @edges e JOIN @shard_plan p ON e.id = p.key
UNION ALL SELECT id, 'missing', '', '', NULL, NULL, NULL FROM @edges WHERE line % 100 = 1""")
def _(read):
    facts = read("edges", once=True).select(F.col("id").alias("key"), F.col("source_id").alias("from_id"), F.coalesce("target_id", F.lit("")).alias("to_id"), F.col("kind").alias("relation"))
    both = publish.edge_locators(facts, read("shard_plan", once=True), complete=False)["both"]
    shown = {"from_id": "missing", "to_id": "", "relation": ""}
    return both.select("key", *[F.when(F.col("found"), F.col(c)).otherwise(gone).alias(c) for c, gone in shown.items()], "bucket", "shard", "complete")


# Nodes of a few projects only, so that both ends of edges go missing.
relation("diagram_nodes", """
SELECT id, project_id, kind, name, qualified_name FROM @pub_nodes WHERE project_id IN ('geo', 'catalog', 'crm0', 'crm1')
UNION ALL SELECT id, 'zz', 'Project', 'other', 'other' FROM @pub_nodes WHERE project_id = 'crm1'""")
relation("diagram_edges", """
SELECT id, project_id, source_id, target_id, unresolved_target, target_project_id, kind, resolution FROM @pub_edges
UNION ALL SELECT id, project_id, source_id, target_id, unresolved_target, target_project_id, kind, resolution FROM @pub_edges WHERE start_line % 6 = 0""")

COMPLETED = """
WITH real AS (SELECT DISTINCT id FROM @diagram_nodes),
e0 AS (SELECT *, CASE lower(resolution) WHEN 'exact_static' THEN 'exact_static' WHEN 'inferred_static' THEN 'inferred_static' WHEN 'annotated' THEN 'annotated' WHEN 'unresolved' THEN 'unresolved' ELSE 'unknown' END AS res FROM @diagram_edges),
e1 AS (SELECT e0.*, CASE WHEN res <> 'unresolved' THEN target_id END AS want FROM e0),
e2 AS (SELECT e1.*, s.id IS NULL AND source_id <> '' AS no_source, t.id IS NULL AS no_target, coalesce(want, unresolved_target, '') AS tname FROM e1 LEFT JOIN real s ON s.id = source_id LEFT JOIN real t ON t.id = want),
e3 AS (SELECT DISTINCT id, project_id, CASE WHEN no_source THEN 'unresolved:' || substr(sha256(source_id), 1, 16) ELSE source_id END AS source_id, CASE WHEN no_target THEN 'unresolved:' || substr(sha256(tname), 1, 16) ELSE want END AS target,
   CASE WHEN no_target THEN 'placeholder' ELSE 'resolved' END AS target_kind, CASE WHEN want IS NULL THEN tname END AS unresolved_target, target_project_id, upper(kind) AS kind, res AS resolution FROM e2),
made AS (SELECT 'unresolved:' || substr(sha256(source_id), 1, 16) AS node, project_id, id, source_id AS name, 'source-node-absent' AS reason, 0 AS side FROM e2 WHERE no_source
   UNION ALL SELECT 'unresolved:' || substr(sha256(tname), 1, 16), project_id, id, tname, CASE WHEN want IS NULL THEN 'unresolved-target' ELSE 'target-node-absent' END, 1 FROM e2 WHERE no_target),
allrows AS (SELECT id AS node, project_id, 0 AS rank, project_id AS p, id AS i, 0 AS side, CASE WHEN kind = 'Widget' THEN 'Widget' ELSE kind END AS kind, CASE WHEN kind = 'Widget' THEN 'extension' ELSE 'frozen' END AS vocabulary, name, qualified_name, false AS placeholder, NULL AS reason FROM @diagram_nodes
   UNION ALL SELECT node, project_id, 1, project_id, id, side, 'UnresolvedTarget', 'frozen', name, NULL, true, reason FROM made),
n0 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rank, p, i, side) AS rn FROM allrows),
pc AS (SELECT node, count(DISTINCT project_id) AS projects FROM allrows GROUP BY node),
n1 AS (SELECT n0.node AS id, kind, vocabulary, name, qualified_name, placeholder, reason AS placeholder_reason, projects FROM n0 JOIN pc ON n0.node = pc.node WHERE rn = 1)
"""


@query("j15_completed_nodes", COMPLETED + "SELECT * FROM n1")
def _(read):
    return publish.complete_placeholders(read("diagram_nodes"), read("diagram_edges"))["nodes"]


@query("j15_completed_edges", COMPLETED + "SELECT *, 'frozen' AS vocabulary FROM e3")
def _(read):
    return publish.complete_placeholders(read("diagram_nodes"), read("diagram_edges"))["edges"]


@query("a8_graph_summary", COMPLETED + """
SELECT (SELECT count(*) FROM n1) AS nodes, (SELECT count(*) FILTER (placeholder) FROM n1) AS placeholders, (SELECT count(DISTINCT kind) FROM n1) AS node_kinds, count(*) AS edges,
  count(*) FILTER (target_kind = 'placeholder') AS placeholder_edges, count(DISTINCT kind) AS edge_kinds, count(DISTINCT resolution) AS resolutions FROM e3""")
def _(read):
    done = publish.complete_placeholders(read("diagram_nodes"), read("diagram_edges"))
    return publish.graph_summary(done["nodes"], done["edge_kinds"])["counts"]


@query("a8_graph_legends", COMPLETED + """
, v AS (SELECT unnest(['Solution', 'Project', 'File', 'Namespace', 'Class', 'Interface', 'Function', 'Method', 'Property', 'ApiEndpoint', 'DataStore', 'Table', 'StoredProcedure', 'QueueTopic', 'ExternalService', 'TestCase', 'UnresolvedTarget']) AS kind, unnest(range(1, 18)) AS rank)
SELECT 'node' AS legend, coalesce(rank, 18) AS rank, n1.kind AS value, CASE WHEN rank IS NULL THEN 'extension' ELSE 'frozen' END AS vocabulary, count(*) AS rows FROM n1 LEFT JOIN v ON n1.kind = v.kind GROUP BY ALL
UNION ALL SELECT 'edge', CASE kind WHEN 'CONTAINS' THEN 1 WHEN 'REFERENCES' THEN 3 ELSE 4 END, kind, 'frozen', count(*) FROM e3 GROUP BY ALL
UNION ALL SELECT 'resolution', CASE resolution WHEN 'exact_static' THEN 1 WHEN 'inferred_static' THEN 2 WHEN 'annotated' THEN 3 ELSE 4 END, resolution, 'frozen', count(*) FROM e3 GROUP BY ALL""")
def _(read):
    done = publish.complete_placeholders(read("diagram_nodes"), read("diagram_edges"))
    return publish.graph_summary(done["nodes"], done["edge_kinds"])["legends"]
