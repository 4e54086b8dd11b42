"""The library's input relations, derived from the given tables."""

from relgraph.plans.registry import relation

relation("corpus", """
SELECT source AS project,
       CASE doc_id % 12 WHEN 0 THEN 'src/bin/' WHEN 1 THEN 'node_modules/pkg/' WHEN 2 THEN 'logs/'
            WHEN 3 THEN 'app/Secrets/' WHEN 4 THEN 'live/' WHEN 5 THEN '' ELSE 'src/' || lang || '/' END
       || CASE WHEN doc_id % 29 = 0 THEN '.env' WHEN doc_id % 31 = 0 THEN '~$doc' || cast(doc_id AS string)
            ELSE 'doc' || cast(doc_id AS string) END
       || CASE WHEN doc_id % 29 = 0 THEN '.d' || cast(doc_id AS string) ELSE CASE doc_id % 10 WHEN 0 THEN '.log' WHEN 1 THEN '.TMP'
            WHEN 2 THEN '.pem' WHEN 3 THEN '' WHEN 4 THEN '.tsx' WHEN 5 THEN '.py' WHEN 6 THEN '.ts'
            WHEN 7 THEN '.tmp.cs' ELSE '.cs' END END AS path,
       text AS content, sha2(text, 256) AS content_hash, octet_length(text) AS bytes, doc_id
FROM $documents""")

relation("files", """
SELECT 'sol' || cast(cast(substr(project, 4) AS bigint) % 4 AS string) AS solution_id, project AS project_id, path,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE content_hash END AS observed_hash,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE content_hash END AS indexed_hash,
       1 + doc_id % 5 AS desired_generation,
       CASE WHEN doc_id % 6 = 0 THEN doc_id % 5 ELSE 1 + doc_id % 5 END AS indexed_generation,
       doc_id % 17 = 0 AS deleted, bytes, doc_id
FROM @corpus""")

relation("observed", """
SELECT project AS project_id, path, CASE WHEN doc_id % 11 = 0 THEN sha2(path, 256) ELSE content_hash END AS content_hash
FROM @corpus WHERE doc_id % 7 <> 0
UNION ALL
SELECT project, 'added/' || path, content_hash FROM @corpus WHERE doc_id % 13 = 0""")

relation("stamps_before", """
SELECT project AS project_id, path, bytes AS size_bytes, 1000 + doc_id % 50 AS modified_ns FROM @corpus
WHERE doc_id % 9 <> 0""")

relation("stamps_after", """
SELECT project AS project_id, path, bytes + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS size_bytes,
       1000 + doc_id % 50 + CASE WHEN doc_id % 19 = 0 THEN 5 ELSE 0 END AS modified_ns FROM @corpus
WHERE doc_id % 10 <> 0""")

# Store-level graph: a containment tree region > nation > customer > order, parts and suppliers beside it.
relation("nodes", """
SELECT 'region:' || cast(r_regionkey AS string) AS id, 'geo' AS project_id, 'geo/regions.cs' AS owner_file,
       'namespace' AS kind, r_name AS name, r_name AS qualified_name, 'csharp' AS language,
       cast(r_regionkey * 10 + 1 AS bigint) AS start_line, cast(r_regionkey * 10 + 9 AS bigint) AS end_line
FROM $region
UNION ALL
SELECT 'nation:' || cast(n_nationkey AS string), 'geo', 'geo/nations' || cast(n_regionkey AS string) || '.cs', 'class',
       n_name, 'Geo.' || n_name, 'csharp', cast(n_nationkey + 1 AS bigint), cast(n_nationkey + 1 AS bigint) FROM $nation
UNION ALL
SELECT 'customer:' || cast(c_custkey AS string), 'crm' || cast(c_custkey % 4 AS string),
       'crm/' || c_mktsegment || '/' || cast(c_custkey % 200 AS string) || '.cs', 'class', c_name,
       'Crm.' || c_name, 'csharp', c_custkey + 1, c_custkey + 3 FROM $customer
UNION ALL
SELECT 'order:' || cast(o_orderkey AS string), 'crm' || cast(o_custkey % 4 AS string),
       'crm/orders/' || cast(o_orderkey % 500 AS string) || '.ts',
       CASE o_orderkey % 8 WHEN 0 THEN 'function' WHEN 1 THEN 'unmapped-kind' ELSE 'method' END,
       'Order' || cast(o_orderkey % 1000 AS string), 'Crm.Orders.' || o_orderpriority || '.Order' || cast(o_orderkey % 1000 AS string),
       'typescript', o_orderkey + 1, o_orderkey + 2 FROM $orders
UNION ALL
SELECT 'part:' || cast(p_partkey AS string), 'catalog', 'catalog/' || p_brand || '.ts',
       CASE p_partkey % 3 WHEN 0 THEN 'interface' WHEN 1 THEN 'variable' ELSE 'class' END,
       p_name, 'Catalog.' || p_name, 'typescript', p_partkey + 1, p_partkey + 1 FROM $part
UNION ALL
SELECT 'supplier:' || cast(s_suppkey AS string), 'supply', 'supply/' || cast(s_nationkey AS string) || '.cs', 'class',
       s_name, 'Supply.' || s_name, 'csharp', s_suppkey + 1, s_suppkey + 4 FROM $supplier""")

relation("edges", """
SELECT 'e1:' || cast(n_nationkey AS string) AS id, 'geo/regions.cs' AS owner_file,
       'region:' || cast(n_regionkey AS string) AS source_id, 'nation:' || cast(n_nationkey AS string) AS target_id,
       cast(NULL AS string) AS unresolved_target, 'geo' AS target_project_id, 'contains' AS kind,
       'exact_static' AS resolution, 'csharp-declarations-v1' AS analyzer_id,
       cast(n_nationkey + 1 AS bigint) AS line FROM $nation
UNION ALL
SELECT 'e2:' || cast(c_custkey AS string), 'geo/nations' || cast(n_regionkey AS string) || '.cs',
       'nation:' || cast(c_nationkey AS string), 'customer:' || cast(c_custkey AS string), NULL,
       'crm' || cast(c_custkey % 4 AS string), 'contains', 'exact_static', 'csharp-declarations-v1', c_custkey + 1
FROM $customer JOIN $nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 'e3:' || cast(o_orderkey AS string),
       'crm/' || c_mktsegment || '/' || cast(c_custkey % 200 AS string) || '.cs',
       'customer:' || cast(o_custkey AS string), CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'order:' || cast(o_orderkey AS string) END,
       CASE WHEN o_orderkey % 50 = 0 THEN 'Missing.Order' || cast(o_orderkey % 7 AS string) END,
       'crm' || cast(o_custkey % 4 AS string), 'contains',
       CASE WHEN o_orderkey % 50 = 0 THEN 'unresolved' ELSE 'exact_static' END, 'csharp-declarations-v1', o_orderkey + 1
FROM $orders JOIN $customer ON o_custkey = c_custkey
UNION ALL
SELECT 'e4:' || cast(l_orderkey AS string) || '-' || cast(l_partkey AS string),
       'crm/orders/' || cast(l_orderkey % 500 AS string) || '.ts', 'order:' || cast(l_orderkey AS string),
       CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE 'part:' || cast(l_partkey AS string) END,
       CASE WHEN l_partkey % 10 = 0 THEN 'Catalog.' || p_name END, 'catalog', 'references',
       CASE WHEN l_partkey % 10 = 0 THEN 'unresolved' ELSE 'inferred_static' END, 'typescript-declarations-v1', l_orderkey
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM $lineitem) l JOIN $part ON l_partkey = p_partkey
UNION ALL
SELECT 'e5:' || cast(l_suppkey AS string) || '-' || cast(l_partkey AS string),
       'supply/' || cast(s_nationkey AS string) || '.cs', 'supplier:' || cast(l_suppkey AS string),
       CASE WHEN l_partkey % 13 = 0 THEN 'part:gone' || cast(l_partkey AS string) ELSE 'part:' || cast(l_partkey AS string) END,
       NULL, 'catalog', 'calls', CASE WHEN l_partkey % 2 = 0 THEN 'Exact_Static' ELSE 'annotated' END,
       'csharp-declarations-v1', l_suppkey
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM $lineitem) l JOIN $supplier ON l_suppkey = s_suppkey""", stored=True, dealt={"lineitem": "l_partkey"})

# The published form of the graph: what the bounded queries read.
# Two projects more that hold the same files, ids and names as two others.
relation("shared_nodes", """
SELECT * FROM @nodes UNION ALL
SELECT id, 'twin-' || project_id, owner_file, kind, name, qualified_name, language, start_line, end_line FROM @nodes WHERE project_id IN ('geo', 'crm0')""")

relation("shared_edges", """
SELECT e.id, n.project_id, e.owner_file, source_id, target_id, unresolved_target, target_project_id, e.kind, resolution, analyzer_id, line FROM @edges e JOIN @nodes n ON e.source_id = n.id
UNION ALL
SELECT e.id, 'twin-' || n.project_id, e.owner_file, source_id, target_id, unresolved_target, CASE WHEN target_project_id IN ('geo', 'crm0') THEN 'twin-' || target_project_id ELSE target_project_id END,
       e.kind, resolution, analyzer_id, line FROM @edges e JOIN @nodes n ON e.source_id = n.id WHERE n.project_id IN ('geo', 'crm0')""", stored=True)

relation("pub_nodes", """
SELECT id, project_id, CASE kind WHEN 'namespace' THEN 'Namespace' WHEN 'interface' THEN 'Interface'
         WHEN 'variable' THEN 'Property' WHEN 'method' THEN 'Method' WHEN 'function' THEN 'Function'
         WHEN 'unmapped-kind' THEN 'Widget' ELSE 'Class' END AS kind,
       name, qualified_name, language, owner_file AS file, start_line, end_line
FROM @nodes""")

relation("pub_edges", """
SELECT id, CASE WHEN id LIKE 'e4:%' OR id LIKE 'e3:%' THEN 'crm0' WHEN id LIKE 'e5:%' THEN 'supply' ELSE 'geo' END AS project_id,
       source_id, target_id, unresolved_target, target_project_id,
       CASE kind WHEN 'contains' THEN 'CONTAINS' WHEN 'references' THEN 'References' ELSE 'CALLS' END AS kind,
       resolution, analyzer_id, owner_file AS file, line AS start_line, line AS end_line
FROM @edges""")

relation("deps", """SELECT coalesce(target_id, unresolved_target) AS target, source_id AS dependent FROM @edges""")

relation("jobs", """
SELECT 'job' || cast(o_orderkey AS string) AS id, 'sol' || cast(o_custkey % 5 AS string) AS solution_id,
       CASE o_orderkey % 9 WHEN 0 THEN 'INVENTORY_SCAN' WHEN 1 THEN 'PARSE_BATCH' WHEN 2 THEN 'RESOLVE_AFFECTED'
            WHEN 3 THEN 'PUBLISH_PROJECT' WHEN 4 THEN 'PUBLISH_CATALOG' WHEN 5 THEN 'CHECKPOINT_EXPORT'
            WHEN 6 THEN 'VERIFY_CHECKPOINT' WHEN 7 THEN 'SNAPSHOT_GC' ELSE 'REPAIR' END AS kind,
       'project:' || cast(o_custkey % 40 AS string) AS scope_key,
       CASE o_orderkey % 10 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'LEASED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'SUCCEEDED'
            WHEN 4 THEN 'FAILED' WHEN 5 THEN 'RETRY_WAIT' WHEN 6 THEN 'CANCEL_REQUESTED' WHEN 7 THEN 'CANCELLED'
            WHEN 8 THEN 'SUPERSEDED' ELSE 'PENDING' END AS state,
       o_orderkey % 4 * 50 AS priority, o_orderkey AS target_event_seq,
       unix_millis(cast(o_orderdate AS timestamp)) AS created_at,
       unix_millis(cast(o_orderdate AS timestamp)) + (o_orderkey % 100) * 86400000 AS ready_at
FROM $orders""")

relation("job_events", """
SELECT 'job' || cast(user_id AS string) AS job_id, event_id AS seq,
       CASE event_id % 11 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'LEASED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'SUCCEEDED'
            WHEN 4 THEN 'FAILED' WHEN 5 THEN 'RETRY_WAIT' WHEN 6 THEN 'CANCEL_REQUESTED' WHEN 7 THEN 'CANCELLED'
            WHEN 8 THEN 'SUPERSEDED' WHEN 9 THEN 'PENDING' ELSE 'RUNNING' END AS state
FROM $events""")

relation("hints", """
SELECT 'p' || cast(user_id % 8 AS string) AS project_id, event_id div 40 AS flush_id, event_id AS seq,
       unix_millis(cast(ts AS timestamp)) AS ts_ms,
       CASE event_id % 12 WHEN 0 THEN 'src/obj/' WHEN 1 THEN 'Secrets/' ELSE 'src/' END
       || 'f' || cast(cast(floor(value) AS bigint) AS string) || '.cs' AS path,
       CASE WHEN event_id % 29 = 0 THEN 'other' WHEN event_type = 'click' THEN 'modified' WHEN event_type = 'view' THEN 'created'
            WHEN event_type = 'error' THEN 'removed' WHEN event_id % 40 < 20 THEN 'renamed_from' ELSE 'renamed_to' END AS kind
FROM $events""")

relation("http_clients", """
SELECT 'web' || cast(page_id % 5 AS string) AS project, 'client' || cast(page_id AS string) || '.ts' AS file, page_id AS line,
       CASE page_id % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS verb,
       CASE WHEN page_id % 11 = 0 THEN NULL ELSE url END AS absolute_url,
       CASE WHEN page_id % 11 = 0 THEN '/api/' || cast(page_id AS string) END AS path
FROM $pages""")

relation("page_hosts", r"""
SELECT DISTINCT substr(rest, 1, CASE WHEN strpos_ > 0 THEN strpos_ - 1 ELSE length(rest) END) AS host
FROM (SELECT rest, instr(rest, '/') AS strpos_ FROM (SELECT substr(url, instr(url, '://') + 3) AS rest FROM $pages) a) b""")

relation("host_aliases", """
SELECT 'http' AS protocol, host, 'svc' || cast(length(host) % 6 AS string) AS project FROM @page_hosts WHERE length(host) % 7 <> 0
UNION ALL
SELECT 'http', host, 'svc' || cast((length(host) + 1) % 6 AS string) FROM @page_hosts WHERE length(host) % 11 = 0
UNION ALL
SELECT 'http', host, 'svc' || cast(length(host) % 6 AS string) FROM @page_hosts WHERE length(host) % 5 = 0""")

relation("endpoints", """
SELECT DISTINCT 'svc' || cast(k AS string) AS project, 'svc' || cast(k AS string) || '/' || cast(tag AS string) || '.cs' AS file,
       CASE tag WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'POST' ELSE 'GET' END AS verb,
       CASE tag WHEN 0 THEN '{lang}/{id}' WHEN 1 THEN 'EN//{id}' WHEN 2 THEN 'fr/{id}/' WHEN 3 THEN 'de/{*rest}' ELSE '{lang}' END AS template
FROM (SELECT c_custkey % 6 AS k, (c_custkey div 6) % 5 AS tag FROM $customer) s
WHERE NOT (k = 3 AND tag < 2)""")

relation("service_addresses", """
SELECT 'a' || cast(page_id AS string) AS site, 'http' AS protocol, url AS address FROM $pages""")

relation("service_aliases", """
SELECT protocol, '//' || host AS alias_key, project FROM @host_aliases
UNION ALL
SELECT 'http', '//' || host || '/en', 'svc' || cast((length(host) + 2) % 6 AS string) FROM @page_hosts WHERE length(host) % 3 = 0""")

relation("topic_bindings", """
SELECT 'app' || cast(user_id % 23 AS string) AS project, 'f' || cast(user_id AS string) || '.cs' AS file, event_id AS line,
       CASE WHEN user_id % 3 = 0 THEN 'producer' ELSE 'consumer' END AS role,
       event_type || '.' || cast(user_id % 17 AS string) AS topic
FROM $events""")

relation("topic_owners", """
SELECT DISTINCT event_type || '.' || cast(user_id % 17 AS string) AS topic, 'own' || cast(user_id % 17 % 5 AS string) AS project
FROM $events WHERE user_id % 17 <> 4
UNION ALL
SELECT DISTINCT event_type || '.' || cast(user_id % 17 AS string), 'other' FROM $events WHERE user_id % 17 = 9""")

relation("call_targets", """
SELECT 'part:' || cast(p_partkey AS string) AS key, 'Catalog.' || p_brand || '.' || p_type || '.M' || cast(p_size AS string) AS qualified,
       'Catalog.' || p_brand || '.' || p_type AS container, 'M' || cast(p_size AS string) AS member,
       CASE p_partkey % 7 WHEN 0 THEN 'delegate' WHEN 1 THEN 'interface_method' WHEN 2 THEN 'function' ELSE 'method' END AS kind
FROM $part""")

relation("call_sites", """
SELECT 'f' || cast(l_orderkey AS string) || '.cs' AS file, cast(l_linenumber AS bigint) AS line, 'order:' || cast(l_orderkey AS string) AS caller,
       CASE WHEN l_suppkey % 31 = 0 THEN NULL WHEN l_suppkey % 29 = 0 THEN 'Nowhere.M1'
            ELSE 'Catalog.' || p_brand || '.' || p_type || '.M' || cast(p_size AS string) END AS callee,
       CASE WHEN l_suppkey % 23 = 0 THEN 'dynamic' WHEN l_suppkey % 2 = 0 THEN 'interface_member' ELSE 'direct' END AS kind
FROM $lineitem JOIN $part ON l_partkey = p_partkey""")

relation("implements", """
SELECT DISTINCT 'Catalog.' || p_brand || '.' || p_type AS implementor,
       'Catalog.' || p_brand || '.' || CASE WHEN p_size % 3 = 0 THEN 'ECONOMY' ELSE 'SMALL' END AS interface
FROM $part WHERE p_type NOT IN ('ECONOMY', 'SMALL')""")

relation("types", """
SELECT 'customer:' || cast(c_custkey AS string) AS key, 'crm/' || cast(c_custkey AS string) || '.cs' AS file,
       CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Crm.' || c_mktsegment END AS namespace,
       'T' || cast(c_custkey % 700 AS string) AS name,
       CASE c_custkey % 4 WHEN 0 THEN 'interface' WHEN 1 THEN 'struct' ELSE 'class' END AS kind,
       CASE c_custkey % 5 WHEN 0 THEN 'T' || cast((c_custkey + 1) % 700 AS string)
            WHEN 1 THEN 'Crm.' || c_mktsegment || '.T' || cast(c_custkey % 700 AS string)
            WHEN 2 THEN 'System.Object' WHEN 3 THEN 'T' || cast((c_custkey + 9) % 700 AS string) || '|T' || cast(c_custkey % 700 AS string)
            ELSE 'Crm.' || c_mktsegment || '.T' || cast((c_custkey + 5) % 700 AS string) END AS base_list
FROM $customer""")

relation("known_ts", """
SELECT DISTINCT 'catalog' AS project, CASE p_partkey % 4 WHEN 0 THEN 'lib/' || lower(p_type) || '/index.ts'
       WHEN 1 THEN 'lib/' || lower(p_type) || '.ts' WHEN 2 THEN 'lib/' || lower(p_type) || '/' || 'm' || cast(p_size AS string) || '.ts'
       ELSE 'lib/' || lower(p_type) || '/' || 'm' || cast(p_size AS string) || '.tsx' END AS path FROM $part""")

relation("imports", """
SELECT 'catalog' AS project, 'lib/app/' || cast(l_orderkey AS string) || '.ts' AS file, cast(l_linenumber AS bigint) AS line,
       CASE l_suppkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN './../' || lower(p_type) WHEN 3 THEN '../' || lower(p_type) || '/m' || cast(p_size AS string)
            WHEN 4 THEN '~lib/' || lower(p_type) || '/./m' || cast(p_size AS string) WHEN 5 THEN '../../../' || lower(p_type)
            WHEN 6 THEN 'rxjs/' || lower(p_type) WHEN 7 THEN '~two/' || lower(p_type) ELSE '~lib' END AS specifier
FROM $lineitem JOIN $part ON l_partkey = p_partkey""")

relation("facts", """
SELECT 'customer:' || cast(o_custkey AS string) AS from_id, 'part:' || cast(o_orderkey % 400 AS string) AS to_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'CALLS' ELSE 'READS' END AS relation, 'p' || cast(o_orderkey % 4 AS string) AS pattern,
       CASE WHEN o_orderkey % 2 = 0 THEN 'exact_static' ELSE 'inferred_static' END AS quality, o_orderkey AS ordinal
FROM $orders WHERE o_orderkey % 2 = 0""")

relation("annotations", """
SELECT o_orderkey AS ordinal, 'customer:' || cast(o_custkey AS string) AS from_id, 'part:' || cast(o_orderkey % 400 AS string) AS to_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'WRITES' WHEN o_orderkey % 3 = 0 THEN 'CALLS' ELSE 'READS' END AS relation,
       o_orderpriority AS source, 'v' || cast(o_orderkey % 3 AS string) AS version
FROM $orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 16 <> 8""")

relation("generations", """
SELECT 'proj' || cast(c_nationkey AS string) AS project_id, sha2(c_name, 256) AS generation_id,
       CASE WHEN c_custkey % 5 = 0 THEN 'checkpoint' ELSE 'live' END AS lane, 1000 + c_custkey % 97 AS published_at,
       cast(c_custkey % 1000 AS bigint) * 1000 AS bytes, 'sol' || cast(c_nationkey % 5 AS string) AS solution_id, c_custkey AS k
FROM $customer""")

relation("manifest", """
SELECT generation_id, role || '/' || cast(k AS string) || '.json' AS path, sha2(role || cast(k AS string), 256) AS sha256,
       100 + k % 40 AS bytes, 5 + k % 3 AS records, k
FROM (SELECT generation_id, k, 'nodes' AS role FROM @generations UNION ALL SELECT generation_id, k, 'edges' FROM @generations) r""")

relation("manifest_seen", """
SELECT generation_id, path, CASE WHEN k % 13 = 0 THEN sha2(path, 256) ELSE sha256 END AS sha256,
       bytes + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS bytes, records + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS records
FROM @manifest WHERE k % 23 <> 0
UNION ALL SELECT generation_id, 'extra/' || path, sha256, bytes, records FROM @manifest WHERE k % 29 = 0""")

relation("staged", """
SELECT project AS repo, path, CASE doc_id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'M' ELSE 'A' END AS status FROM @corpus WHERE doc_id % 2 = 0""")
relation("unstaged", """SELECT project AS repo, path, 'M' AS status FROM @corpus WHERE doc_id % 3 = 0""")
relation("untracked", """SELECT project AS repo, path, '?' AS status FROM @corpus WHERE doc_id % 5 = 1 OR (doc_id % 2 <> 0 AND doc_id % 3 <> 0)""")
relation("parents", """SELECT DISTINCT project AS repo, cast(cast(substr(project, 4) AS bigint) % 3 AS bigint) AS parents FROM @corpus""")

relation("decls", """
SELECT 'o/' || cast(o_orderkey % 700 AS string) || '.ts' AS file, o_orderkey AS line,
       sha2('Order' || cast(o_orderkey % 1000 AS string) || '.' || o_orderstatus, 256) AS base_key,
       CASE o_orderkey % 6 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'computed' ELSE 'explicit' END AS quality,
       'o/' || o_orderpriority AS scope, 'Order' || cast(o_orderkey % 1000 AS string) AS name
FROM $orders""")

relation("file_reports", """
SELECT source AS project_id, doc_id, CASE doc_id % 9 WHEN 0 THEN 'skipped' WHEN 1 THEN 'parse_error' ELSE 'fresh' END AS outcome,
       CASE WHEN doc_id % 9 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'file-binary' ELSE 'file-too-large' END END AS skip_reason,
       doc_id % 9 = 1 AND doc_id % 2 = 0 AS stale,
       CASE WHEN doc_id % 9 = 1 THEN 'csharp-unbalanced-braces' WHEN doc_id % 9 = 3 AND lang = 'fr' THEN 'csharp-missing-namespace' END AS code,
       CASE WHEN doc_id % 9 = 1 THEN 'error' ELSE 'warning' END AS severity
FROM $documents""")

relation("rule_counts", """
SELECT o_orderpriority || '-' || cast(o_custkey % 9 AS string) AS rule_id, 'r' || cast(o_custkey % 12 AS string) AS report_id,
       cast(sum(CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 4 <> 1 THEN 1 ELSE 0 END) AS bigint) AS analysed,
       cast(sum(CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 12 < 6 THEN 1 ELSE 0 END) AS bigint) AS unsupported,
       cast(sum(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) AS bigint) AS findings
FROM $orders GROUP BY o_orderpriority || '-' || cast(o_custkey % 9 AS string), 'r' || cast(o_custkey % 12 AS string)""")

# Source text made from single rows of orders; the rows themselves are the expected facts.
relation("cs_source", """
SELECT 'orders' AS project, 'src/o' || cast(o_orderkey AS string) || '.cs' AS path,
       CASE o_orderkey % 3
       WHEN 0 THEN 'using System; // {' || chr(10) || 'namespace N' || cast(o_custkey AS string) || '.Orders;' || chr(10) || chr(10)
         || 'public class O' || cast(o_orderkey AS string) || ' : Base' || o_orderstatus || ', IKeyed<int>' || chr(10) || '{' || chr(10)
         || '    public int Get' || o_orderstatus || '(int id)' || chr(10) || '    {' || chr(10) || '        if (id > 0) { return id; }' || chr(10)
         || '        db.Query("SELECT * FROM sales.T' || cast(o_custkey AS string) || ' WHERE id = 1");' || chr(10)
         || '    }' || chr(10) || '    public enum Kind { A, B }' || chr(10) || '}' || chr(10)
       WHEN 1 THEN 'namespace N' || cast(o_custkey AS string) || chr(10) || '{' || chr(10) || '  public interface IO' || cast(o_orderkey AS string) || ' {' || chr(10)
         || '    void Run(string a);' || chr(10) || '    void Run(int b);' || chr(10) || '  }' || chr(10)
         || '  public record struct R' || cast(o_orderkey AS string) || '(int X);' || chr(10)
         || '  // class Hidden {' || chr(10) || '}' || chr(10)
       ELSE 'public static class S' || cast(o_orderkey AS string) || chr(10) || '{' || chr(10)
         || '  public class Inner<T> where T : class {' || chr(10) || '    void Deep() { var q = "DELETE FROM [dbo].[D' || cast(o_custkey AS string) || ']"; }' || chr(10)
         || '  }' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '}' ELSE '' END || chr(10) END AS content,
       o_orderkey, o_custkey, o_orderstatus
FROM $orders""")

relation("ts_source", """
SELECT 'orders' AS project, 'web/o' || cast(o_orderkey AS string) || '.ts' AS path,
       'export interface W' || cast(o_orderkey AS string) || ' {' || chr(10) || '  run(): void;' || chr(10) || '}' || chr(10)
       || 'export default class {' || chr(10) || '  const inner' || cast(o_custkey AS string) || ' = 1;' || chr(10) || '}' || chr(10)
       || 'const { a, b } = load();' || chr(10) || 'export async function build' || o_orderstatus || '(x: number) {' || chr(10)
       || '  let y = 2;' || chr(10) || '}' || chr(10)
       || 'class P' || cast(o_orderkey AS string) || ' extends Q' || o_orderstatus || ' implements W' || cast(o_orderkey AS string) || ', IKeyed {' || chr(10)
       || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '}' || chr(10) END || 'type Id = string;' || chr(10) AS content,
       o_orderkey, o_custkey, o_orderstatus
FROM $orders""")
