"""Registered queries: imports, calls, base types, routes, services, topics, annotations."""

from pyspark.sql import functions as F

from relgraph.operators import resolve
from relgraph.plans.registry import query, relation

ALIASES = [("~lib", ["lib/"]), ("~two", ["lib", "other/lib"])]

IMPORTS = r"""
WITH s AS (SELECT *, CASE WHEN specifier IS NULL OR specifier = '' THEN 'unsupported' WHEN starts_with(specifier, './') OR starts_with(specifier, '../') THEN 'relative'
     WHEN specifier IN ('~lib', '~two') OR starts_with(specifier, '~lib/') OR starts_with(specifier, '~two/') THEN 'alias' ELSE 'external' END AS kind FROM @imports),
j AS (SELECT *, CASE WHEN kind = 'relative' THEN CASE WHEN starts_with(specifier, './../') THEN ['lib/' || substr(specifier, 6)] WHEN starts_with(specifier, '../../../') THEN [] ELSE ['lib/' || substr(specifier, 4)] END
     WHEN kind = 'alias' THEN CASE WHEN specifier = '~lib' THEN ['lib'] WHEN starts_with(specifier, '~lib/') THEN ['lib/' || replace(substr(specifier, 6), '/./', '/')] ELSE ['lib/' || substr(specifier, 6), 'other/lib/' || substr(specifier, 6)] END END AS roots FROM s),
w AS (SELECT DISTINCT array_to_string(roots, '|') AS lookup, unnest(roots) AS root FROM j WHERE len(roots) > 0),
c AS (SELECT DISTINCT lookup, k.path FROM w JOIN @known_ts k ON k.path IN (root, root || '.ts', root || '.tsx', root || '/index.ts', root || '/index.tsx')),
a AS (SELECT lookup, count(*) AS n, min(path) AS low FROM c GROUP BY lookup)
"""


def _imports(read):
    return resolve.resolve_imports(read("imports"), read("known_ts"), ALIASES, ["ts", "tsx"])


@query("j4_import_resolution", IMPORTS + """
SELECT file, line, specifier, kind, CASE WHEN coalesce(n, 0) = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN low END AS target,
  CASE WHEN kind = 'unsupported' THEN 'unresolved-not-a-literal' WHEN kind = 'external' THEN 'unresolved-external-package' WHEN len(roots) = 0 THEN 'unresolved-outside-project' WHEN n IS NULL THEN 'unresolved-missing-target' END AS reason, coalesce(n, 0) AS candidates
FROM j LEFT JOIN a ON array_to_string(roots, '|') = a.lookup""")
def _(read):
    return _imports(read)["outcomes"].select("file", "line", "specifier", "kind", "status", "target", "reason", "candidates")


@query("j4_import_candidates", IMPORTS + "SELECT lookup, path FROM c WHERE lookup IN (SELECT lookup FROM a WHERE n > 1)")
def _(read):
    return _imports(read)["candidates"].select("lookup", "path")


CALLS = """
WITH t AS (SELECT qualified, count(*) AS n, min(key) AS low, min_by(kind, key) AS tkind, min_by(container, key) AS container, min_by(member, key) AS member FROM @call_targets GROUP BY qualified),
s AS (SELECT c.*, n, low, tkind, container, member, CASE WHEN c.kind = 'dynamic' THEN 'call-dynamic-dispatch' WHEN callee IS NULL THEN 'call-not-literal' WHEN n IS NULL THEN 'call-missing-target' WHEN n > 1 THEN 'call-ambiguous-target' WHEN tkind = 'delegate' THEN 'call-dynamic-dispatch' END AS reason
  FROM @call_sites c LEFT JOIN t ON c.callee = t.qualified)
"""


@query("j5_call_resolution", CALLS + """
SELECT file, line, caller, callee, CASE reason WHEN 'call-ambiguous-target' THEN 'ambiguous' ELSE CASE WHEN reason IS NULL THEN 'resolved' ELSE 'unresolved' END END AS status, CASE WHEN reason IS NULL THEN low END AS target, reason,
  CASE WHEN reason = 'call-dynamic-dispatch' AND kind <> 'dynamic' THEN low END AS candidate, CASE WHEN reason = 'call-ambiguous-target' THEN n ELSE 0 END AS candidates FROM s""")
def _(read):
    out = resolve.resolve_calls(read("call_sites"), read("call_targets"))["outcomes"]
    return out.select("file", "line", "caller", "callee", "status", "target", "reason", "candidate", "candidates")


@query("j5_call_candidates", CALLS + "SELECT qualified, key FROM @call_targets WHERE qualified IN (SELECT qualified FROM t WHERE n > 1)")
def _(read):
    return resolve.resolve_calls(read("call_sites"), read("call_targets"))["candidates"]


IMPLEMENTATIONS = CALLS + """
, called AS (SELECT low AS target, container, member, count(*) AS sites FROM s WHERE reason IS NULL AND tkind = 'interface_method' GROUP BY ALL),
m AS (SELECT container AS implementor, member, min(key) AS implementation FROM @call_targets GROUP BY ALL),
f AS (SELECT c.target, i.implementor, m.implementation, c.sites FROM called c JOIN @implements i ON i.interface = c.container JOIN m ON m.implementor = i.implementor AND m.member = c.member)
"""


@query("j6_possible_implementations", IMPLEMENTATIONS + "SELECT * FROM f")
def _(read):
    targets = read("call_targets")
    calls = resolve.resolve_calls(read("call_sites"), targets)["outcomes"]
    return resolve.possible_implementations(calls, targets, read("implements"))["implementations"]


@query("j6_implementation_counters", IMPLEMENTATIONS + """
SELECT cast(sum(CASE WHEN coalesce(n, 0) <> 1 THEN sites ELSE 0 END) AS bigint) AS ambiguous_sets, cast(sum(sites) AS bigint) AS unproven_sets FROM called c LEFT JOIN (SELECT target, count(*) AS n FROM f GROUP BY target) x ON c.target = x.target""")
def _(read):
    targets = read("call_targets")
    calls = resolve.resolve_calls(read("call_sites"), targets)["outcomes"]
    return resolve.possible_implementations(calls, targets, read("implements"))["counters"]


BASES = """
WITH d AS (SELECT *, CASE WHEN namespace = '' THEN name ELSE namespace || '.' || name END AS dotted FROM @types),
n AS (SELECT dotted AS base, key, kind FROM d UNION ALL SELECT name, key, kind FROM d),
a AS (SELECT base, count(*) AS n, count(DISTINCT key) AS k, min(key) AS low, min(kind) AS kind FROM n GROUP BY base),
r AS (SELECT key, file, unnest(string_split(base_list, '|')) AS base, generate_subscripts(string_split(base_list, '|'), 1) - 1 AS position FROM d)
"""


@query("j7_base_types", BASES + """
SELECT r.key, r.file, position, r.base, CASE WHEN n = 1 THEN low END AS target, CASE WHEN n = 1 THEN CASE WHEN a.kind = 'interface' THEN 'IMPLEMENTS' ELSE 'INHERITS' END END AS edge_kind,
  CASE WHEN n IS NULL THEN 'type-base-not-in-project' WHEN n = 1 THEN NULL WHEN k > 1 THEN 'type-base-ambiguous' ELSE 'type-duplicate-declaration' END AS reason
FROM r LEFT JOIN a ON r.base = a.base WHERE NOT (coalesce(n, 0) = 1 AND low = r.key)""")
def _(read):
    types = read("types").withColumn("bases", F.split("base_list", r"\|"))
    return resolve.resolve_bases(types)["outcomes"].select("key", "file", F.col("position").cast("long").alias("position"), "base", "target", "edge_kind", "reason")


relation("scoped", """
SELECT 'p' AS project, 'f' || cast(o_custkey % 300 AS string) || '.cs' AS file, o_orderkey AS ordinal, 'order:' || cast(o_orderkey AS string) AS key,
  CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A|S' || o_orderstatus ELSE 'A|S' || o_orderstatus || '|K' || cast(o_orderkey % 4 AS string) END AS scopes,
  CASE o_orderkey % 3 WHEN 0 THEN 'S' || o_orderstatus WHEN 1 THEN 'K' || cast(o_orderkey % 4 AS string) ELSE 'leaf' END AS name FROM $orders""")


@query("j8_containment", """
WITH o AS (SELECT project, file, replace(scopes, '|', '/') || '|' || name AS scope, max_by(key, ordinal) AS parent FROM @scoped GROUP BY ALL)
SELECT s.file, s.ordinal, o.parent AS source_key, s.key AS target_key FROM @scoped s JOIN o ON s.file = o.file
  AND o.scope = array_to_string(list_slice(string_split(scopes, '|'), 1, len(string_split(scopes, '|')) - 1), '/') || '|' || list_last(string_split(scopes, '|'))""")
def _(read):
    decls = read("scoped").withColumn("semantic_path", F.split("scopes", r"\|"))
    return resolve.containment(decls).select("file", "ordinal", "source_key", "target_key")


HTTP = r"""
WITH al AS (SELECT lower(host) AS host, min(project) AS server_project FROM @host_aliases GROUP BY 1 HAVING count(DISTINCT project) = 1),
c AS (SELECT *, split_part(split_part(split_part(substr(absolute_url, instr(absolute_url, '://') + 3), '/', 1), '?', 1), '#', 1) AS host,
   trim(regexp_replace(regexp_extract(coalesce(absolute_url, 'x://h' || path), '://[^/]*(/[^?#]*)', 1), '/+', '/', 'g'), '/') AS rp FROM @http_clients),
p AS (SELECT c.*, al.server_project, lower(rp) AS low, len(string_split(rp, '/')) AS seg FROM c LEFT JOIN al ON c.host = al.host),
h AS (SELECT p.file AS cf, e.file AS server_file, trim(replace(e.template, '//', '/'), '/') AS template FROM p JOIN @endpoints e ON e.project = p.server_project AND e.verb = p.verb AND CASE e.template
   WHEN '{lang}/{id}' THEN seg = 2 WHEN 'EN//{id}' THEN seg = 2 AND starts_with(low, 'en/') WHEN 'fr/{id}/' THEN seg = 2 AND starts_with(low, 'fr/') WHEN 'de/{*rest}' THEN seg >= 2 AND starts_with(low, 'de/') ELSE seg = 1 AND rp <> '' END),
a AS (SELECT cf, count(*) AS n, min(server_file) AS sf, min(template) AS tp FROM h GROUP BY cf)
"""


@query("j9_http_join", HTTP + """
SELECT project, file, verb, CASE WHEN server_project IS NOT NULL THEN rp END AS request_path, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
 CASE WHEN absolute_url IS NULL THEN 'unresolved-runtime-base-url' WHEN server_project IS NULL THEN 'unresolved-no-configured-alias' WHEN n IS NULL THEN 'unresolved-no-matching-route' WHEN n > 1 THEN 'unresolved-ambiguous-route-candidate' END AS reason,
 server_project, CASE WHEN n = 1 THEN sf END AS server_file, CASE WHEN n = 1 THEN tp END AS endpoint_template, coalesce(n, 0) AS candidates FROM p LEFT JOIN a ON p.file = a.cf""")
def _(read):
    out = resolve.join_http(read("endpoints"), read("http_clients"), read("host_aliases"))["outcomes"]
    return out.select("project", "file", "verb", "request_path", "status", "reason", "server_project", "server_file", "endpoint_template", "candidates")


@query("j9_route_candidates", HTTP + """
SELECT DISTINCT p.server_project, p.verb, p.rp AS request_path, h.server_file, h.template AS endpoint_template FROM h JOIN p ON h.cf = p.file JOIN a ON a.cf = h.cf WHERE n > 1""")
def _(read):
    return resolve.join_http(read("endpoints"), read("http_clients"), read("host_aliases"))["candidates"]


@query("j10_host_alias", "SELECT host, min(project) AS project FROM @host_aliases GROUP BY host HAVING count(DISTINCT project) = 1")
def _(read):
    return resolve.alias_projects(read("host_aliases"))


@query("j11_service_alias", r"""
WITH k AS (SELECT site, protocol, '//' || rtrim(regexp_replace(substr(address, instr(address, '://') + 3), '/+', '/', 'g'), '/') AS address_key FROM @service_addresses),
m AS (SELECT k.site, a.project FROM k JOIN @service_aliases a ON a.protocol = k.protocol AND (k.address_key = a.alias_key OR starts_with(k.address_key, a.alias_key || '/')))
SELECT k.site, k.address_key, CASE WHEN count(project) = 0 THEN 'unresolved' WHEN count(DISTINCT project) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT project) = 1 THEN min(project) END AS project
FROM k LEFT JOIN m ON k.site = m.site GROUP BY k.site, k.address_key""")
def _(read):
    return resolve.resolve_service(read("service_addresses"), read("service_aliases")).select("site", "address_key", "status", "project")


TOPICS = """
WITH o AS (SELECT topic, min(project) AS topic_project FROM @topic_owners GROUP BY topic HAVING count(DISTINCT project) = 1),
s AS (SELECT DISTINCT b.topic, topic_project, role, project FROM @topic_bindings b JOIN o ON b.topic = o.topic),
c AS (SELECT topic, count(*) FILTER (role = 'producer') AS producers, count(*) FILTER (role = 'consumer') AS consumers FROM s GROUP BY topic)
"""


@query("j12_topic_sides", TOPICS + """
SELECT s.*, producers, consumers, CASE WHEN producers = 1 AND consumers = 1 THEN 'exact_static' ELSE 'inferred_static' END AS quality FROM s JOIN c ON s.topic = c.topic WHERE producers > 0 AND consumers > 0""")
def _(read):
    return resolve.link_topics(read("topic_bindings"), read("topic_owners"))["sides"]


@query("j12_topic_links", TOPICS + """
SELECT p.topic, p.topic_project, p.project AS producer_project, q.project AS consumer_project, CASE WHEN producers = 1 AND consumers = 1 THEN 'exact_static' ELSE 'inferred_static' END AS quality
FROM s p JOIN s q ON p.topic = q.topic AND p.role = 'producer' AND q.role = 'consumer' AND p.project <> q.project JOIN c ON c.topic = p.topic""")
def _(read):
    return resolve.link_topics(read("topic_bindings"), read("topic_owners"))["links"]


@query("j12_unlinked_topics", TOPICS + """
SELECT project, file, line, role, topic, 'unresolved-topic-not-configured' AS reason FROM @topic_bindings WHERE topic NOT IN (SELECT topic FROM o)
UNION ALL SELECT NULL, NULL, NULL, 'unmatched', topic, NULL FROM c WHERE producers = 0 OR consumers = 0""")
def _(read):
    out = resolve.link_topics(read("topic_bindings"), read("topic_owners"))
    return out["unlinked"].unionByName(out["unmatched"].withColumn("role", F.lit("unmatched")), allowMissingColumns=True)


MERGED = """
WITH u AS (SELECT from_id, to_id, 0 AS rank, ordinal, relation, pattern, quality FROM @facts UNION ALL SELECT from_id, to_id, 1, ordinal, relation, NULL, 'exact_static' FROM @annotations),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY from_id, to_id ORDER BY rank, ordinal) = 1),
j AS (SELECT a.*, d.relation AS drel, d.pattern AS dpat FROM @annotations a JOIN d ON a.from_id = d.from_id AND a.to_id = d.to_id),
k AS (SELECT from_id, to_id, count(*) AS n FROM j WHERE relation = drel GROUP BY ALL)
"""


@query("j13_merged_edges", MERGED + """
SELECT u.from_id, u.to_id, u.ordinal, u.relation, u.pattern, u.quality, CASE WHEN u.rank = d.rank AND u.ordinal = d.ordinal THEN coalesce(n, 0) ELSE 0 END AS annotations
FROM u JOIN d ON u.from_id = d.from_id AND u.to_id = d.to_id LEFT JOIN k ON k.from_id = u.from_id AND k.to_id = u.to_id WHERE u.rank = 0 OR (d.rank = 1 AND u.ordinal = d.ordinal)""")
def _(read):
    return resolve.merge_annotations(read("facts"), read("annotations"))["edges"]


@query("j13_contradictions", MERGED + """
SELECT from_id, to_id, ordinal, relation, source, version, drel AS generated_relation, coalesce(dpat, 'generated') AS generated_pattern FROM j WHERE relation <> drel""")
def _(read):
    return resolve.merge_annotations(read("facts"), read("annotations"))["contradictions"]


@query("j13_confirmations", MERGED + "SELECT from_id, to_id, ordinal, source, version FROM j WHERE relation = drel")
def _(read):
    return resolve.merge_annotations(read("facts"), read("annotations"))["confirmations"]
