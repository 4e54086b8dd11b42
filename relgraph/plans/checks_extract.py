"""Registered queries: extraction from source text generated out of single order rows.

The text is made from the rows by the relations, so plain SQL over the rows says
what must come back.
"""

from pyspark.sql import functions as F

from relgraph.extract import declarations, endpoints, manifests, scopes, usage
from relgraph.plans.registry import query, relation

K, C, S = "cast(o_orderkey AS varchar)", "cast(o_custkey AS varchar)", "o_orderstatus"


@query("x1_w4_csharp_declarations", f"""
WITH o AS (SELECT *, 'N' || {C} || '.Orders' AS n0, 'N' || {C} AS n1 FROM @cs_source)
SELECT path, 2 AS line, 'namespace' AS kind, n0 AS name, '' AS semantic_path, NULL AS occurrence FROM o WHERE o_orderkey % 3 = 0
UNION ALL SELECT path, 4, 'class', 'O' || {K}, n0, NULL FROM o WHERE o_orderkey % 3 = 0
UNION ALL SELECT path, 6, 'method', 'Get' || {S}, n0 || '/O' || {K}, NULL FROM o WHERE o_orderkey % 3 = 0
UNION ALL SELECT path, 11, 'enum', 'Kind', n0 || '/O' || {K}, NULL FROM o WHERE o_orderkey % 3 = 0
UNION ALL SELECT path, 1, 'namespace', n1, '', NULL FROM o WHERE o_orderkey % 3 = 1
UNION ALL SELECT path, 3, 'interface', 'IO' || {K}, n1, NULL FROM o WHERE o_orderkey % 3 = 1
UNION ALL SELECT path, 4, 'method', 'Run', n1 || '/IO' || {K}, 0 FROM o WHERE o_orderkey % 3 = 1
UNION ALL SELECT path, 5, 'method', 'Run', n1 || '/IO' || {K}, 1 FROM o WHERE o_orderkey % 3 = 1
UNION ALL SELECT path, 7, 'struct', 'R' || {K}, n1, NULL FROM o WHERE o_orderkey % 3 = 1
UNION ALL SELECT path, 1, 'class', 'S' || {K}, '', NULL FROM o WHERE o_orderkey % 3 = 2
UNION ALL SELECT path, 3, 'class', 'Inner', 'S' || {K}, NULL FROM o WHERE o_orderkey % 3 = 2
UNION ALL SELECT path, 4, 'method', 'Deep', 'S' || {K} || '/Inner', NULL FROM o WHERE o_orderkey % 3 = 2""")
def _(read):
    found = declarations.csharp_declarations(read("cs_source"))
    return found.select("path", "line", "kind", "name", F.array_join("semantic_path", "/").alias("semantic_path"), "occurrence")


@query("x1_csharp_diagnostics", """
SELECT path, 'csharp-unbalanced-braces' AS code FROM @cs_source WHERE o_orderkey % 3 = 2 AND o_orderkey % 2 = 1
UNION ALL SELECT path, 'csharp-missing-namespace' FROM @cs_source WHERE o_orderkey % 3 = 2""")
def _(read):
    return declarations.csharp_diagnostics(read("cs_source")).select("path", "code")


@query("x2_typescript_declarations", f"""
SELECT path, 1 AS line, 'interface' AS kind, 'W' || {K} AS name, 'explicit' AS quality, NULL AS ordinal, '' AS semantic_path FROM @ts_source
UNION ALL SELECT path, 4, 'default-export', NULL, 'anonymous', 1, '' FROM @ts_source
UNION ALL SELECT path, 5, 'variable', 'inner' || {C}, 'explicit', NULL, '<>' FROM @ts_source
UNION ALL SELECT path, 7, 'variable', NULL, 'computed', 2, '' FROM @ts_source
UNION ALL SELECT path, 8, 'function', 'build' || {S}, 'explicit', NULL, '' FROM @ts_source
UNION ALL SELECT path, 9, 'variable', 'y', 'explicit', NULL, 'build' || {S} FROM @ts_source
UNION ALL SELECT path, 11, 'class', 'P' || {K}, 'explicit', NULL, '' FROM @ts_source
UNION ALL SELECT path, CASE WHEN o_orderkey % 4 = 0 THEN 12 ELSE 13 END, 'type-alias', 'Id', 'explicit', NULL, CASE WHEN o_orderkey % 4 = 0 THEN 'P' || {K} ELSE '' END FROM @ts_source""")
def _(read):
    found = declarations.typescript_declarations(read("ts_source"))
    shown = F.when(F.size("semantic_path") == 0, "").otherwise(
        F.array_join(F.transform("semantic_path", lambda s: F.when(s == "", "<>").otherwise(s)), "/")
    )
    return found.select("path", "line", "kind", "name", "quality", "ordinal", shown.alias("semantic_path"))


@query("x2_typescript_diagnostics", "SELECT path, 'typescript-unbalanced-braces' AS code FROM @ts_source WHERE o_orderkey % 4 = 0")
def _(read):
    return declarations.typescript_diagnostics(read("ts_source")).select("path", "code")


@query("w3_brace_depth", """
WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, ' de ', ' { '), ' the ', ' } '), chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM $documents),
d AS (SELECT doc_id, line, len(t) - len(replace(t, '{', '')) - (len(t) - len(replace(t, '}', ''))) AS delta FROM (SELECT doc_id, line, split_part(t, '//', 1) AS t FROM l) x)
SELECT doc_id, line, cast(sum(delta) OVER (PARTITION BY doc_id ORDER BY line) AS bigint) AS depth FROM d""")
def _(read):
    content = F.replace(F.replace("text", F.lit(" de "), F.lit(" { ")), F.lit(" the "), F.lit(" } "))
    docs = read("documents").select(F.lit("d").alias("project"), F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    coded = scopes.lines(docs).withColumn("delta", scopes.naive_delta(F.substring_index("raw", "//", 1)))
    return scopes.brace_depth(coded).select(F.col("path").cast("long").alias("doc_id"), "line", F.col("depth_after").cast("long").alias("depth"))


@query("x9_sql_literals", f"""
SELECT path, 9 AS line, 'select' AS operation, 'sales' AS "schema", 'T' || {C} AS object, 'access' AS status FROM @cs_source WHERE o_orderkey % 3 = 0
UNION ALL SELECT path, 4, 'delete', 'dbo', 'D' || {C}, 'access' FROM @cs_source WHERE o_orderkey % 3 = 2""")
def _(read):
    return usage.sql_literals(read("cs_source")).select("path", "line", "operation", "schema", "object", "status")


@query("x13_base_names", f"""
SELECT path, 'Base' || {S} || '|IKeyed' AS bases FROM @cs_source WHERE o_orderkey % 3 = 0
UNION ALL SELECT path, '' FROM @cs_source WHERE o_orderkey % 3 = 1
UNION ALL SELECT path, '' FROM @cs_source WHERE o_orderkey % 3 = 1
UNION ALL SELECT path, '' FROM @cs_source WHERE o_orderkey % 3 = 2
UNION ALL SELECT path, 'class' FROM @cs_source WHERE o_orderkey % 3 = 2
UNION ALL SELECT path, '' FROM @cs_source WHERE o_orderkey % 3 = 0
UNION ALL SELECT path, 'Q' || {S} || '|IKeyed|W' || {K} || '|IKeyed' FROM @ts_source""")
def _(read):
    types = declarations.csharp_declarations(read("cs_source")).where(F.col("kind").isin("class", "interface", "struct", "record", "enum"))
    cs = types.select("path", declarations.base_names(F.col("header"), F.lit("csharp")).alias("bases"))
    ts = declarations.typescript_declarations(read("ts_source")).where("kind = 'class'").select(
        "path", declarations.base_names(F.col("header"), F.lit("typescript")).alias("bases")
    )
    return cs.unionByName(ts).select("path", F.array_join("bases", "|").alias("bases"))


# ---- one generated file per row for each further extractor ---------------------
relation("csproj_source", """
SELECT 'parts' AS project, 'p' || cast(p_partkey AS string) || '.csproj' AS path, p_partkey, p_size, p_brand,
  '<Project><PropertyGroup><TargetFramework>' || CASE WHEN p_partkey % 5 = 0 THEN '$(Tfm)' ELSE 'net8.0' END || '</TargetFramework></PropertyGroup><ItemGroup>' || chr(10)
  || '<PackageReference Include="' || p_brand || '" ' || CASE p_partkey % 3 WHEN 0 THEN 'Version="1.' || cast(p_size AS string) || '"' WHEN 1 THEN 'Version="$(V)"' ELSE '' END || ' />' || chr(10)
  || CASE WHEN p_partkey % 7 = 0 THEN '<PackageReference Version="2" />' ELSE '' END || '<ProjectReference Include="../' || p_type || '.csproj" />' || chr(10) || '</ItemGroup></Project>' AS content, p_type
FROM $part""", stored=True)


@query("x3_build_files", """
SELECT path, 'dependency:' || p_brand AS key, p_brand AS value, 'resolved' AS status, NULL AS reason FROM @csproj_source
UNION ALL SELECT path, 'dependency-version:' || p_brand, CASE p_partkey % 3 WHEN 0 THEN '1.' || p_size WHEN 1 THEN '$(V)' ELSE '' END, CASE p_partkey % 3 WHEN 0 THEN 'resolved' ELSE 'unresolved' END, CASE p_partkey % 3 WHEN 1 THEN 'msbuild-property' WHEN 2 THEN 'version-not-declared' END FROM @csproj_source
UNION ALL SELECT path, 'csproj-missing-include', NULL, 'error', NULL FROM @csproj_source WHERE p_partkey % 7 = 0
UNION ALL SELECT path, 'project-reference:../' || p_type || '.csproj', '../' || p_type || '.csproj', 'resolved', NULL FROM @csproj_source
UNION ALL SELECT path, 'property:TargetFramework', CASE WHEN p_partkey % 5 = 0 THEN '$(Tfm)' ELSE 'net8.0' END, CASE WHEN p_partkey % 5 = 0 THEN 'unresolved' ELSE 'resolved' END, CASE WHEN p_partkey % 5 = 0 THEN 'msbuild-property' END FROM @csproj_source""")
def _(read):
    return manifests.build_file_facts(read("csproj_source")).select("path", "key", "value", "status", "reason")


relation("npm_source", """
SELECT 'parts' AS project, 'p' || cast(p_partkey AS string) || '/package.json' AS path, p_partkey, p_size, p_type,
  CASE WHEN p_partkey % 50 = 0 THEN '{broken' ELSE '{"name":"x","dependencies":{"a' || cast(p_size AS string) || '":"' || CASE WHEN p_partkey % 2 = 0 THEN '^1.0' ELSE 'workspace:*' END || '","n":3},"scripts":{"build":"' || p_type || '"}}' END AS content
FROM $part""", stored=True)


@query("x4_package_files", """
SELECT path, 'dependencies:a' || p_size AS key, CASE WHEN p_partkey % 2 = 0 THEN '^1.0' ELSE 'workspace:*' END AS value, CASE WHEN p_partkey % 2 = 0 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN p_partkey % 2 = 1 THEN 'requires-resolution' END AS reason FROM @npm_source WHERE p_partkey % 50 <> 0
UNION ALL SELECT path, 'dependencies:n', '', 'unresolved', 'requires-resolution' FROM @npm_source WHERE p_partkey % 50 <> 0
UNION ALL SELECT path, 'script:build', p_type, 'unresolved', 'requires-execution' FROM @npm_source WHERE p_partkey % 50 <> 0
UNION ALL SELECT path, NULL, NULL, 'error', 'manifest-parse-failed' FROM @npm_source WHERE p_partkey % 50 = 0""")
def _(read):
    return manifests.package_file_facts(read("npm_source")).drop("project")


relation("controller_source", """
SELECT 'web' AS project, 'c' || cast(o_orderkey AS string) || '.cs' AS path, o_orderkey, o_orderstatus,
  '[ApiController]' || chr(10) || '[Route(' || CASE WHEN o_orderkey % 5 = 0 THEN 'Prefix' ELSE '"api/[controller]"' END || ')]' || chr(10) || 'public class O' || cast(o_orderkey AS string) || 'Controller : Base' || chr(10) || '{' || chr(10)
  || '    [HttpGet("{id}")]' || chr(10) || '    public IActionResult Get' || o_orderstatus || '(int id) { return Ok("}"); }' || chr(10)
  || '    [HttpPut("x/[action]")], [HttpPatch]' || chr(10) || '    public Task<List<int>> Both<T>(T v) => null;' || chr(10)
  || '    [HttpPost]' || chr(10) || '    int gap = 1;' || chr(10) || '    public void NotRouted() { }' || chr(10)
  || '    [HttpDelete(name + "/x")]' || chr(10) || '    public void Computed() { }' || chr(10) || '}' || chr(10) || '[HttpGet("late")]' || chr(10) || 'public void Outside() { }' AS content
FROM $orders""")


@query("x5_controller_routes", f"""
SELECT path, 6 AS line, 'Get' || {S} AS action, CASE WHEN o_orderkey % 5 <> 0 THEN 'api/O' || {K} || '/{{id}}' END AS template, CASE WHEN o_orderkey % 5 <> 0 THEN 'GET' END AS verbs, CASE WHEN o_orderkey % 5 = 0 THEN 'unresolved' ELSE 'endpoint' END AS status FROM @controller_source
UNION ALL SELECT path, 8, 'Both', CASE WHEN o_orderkey % 5 <> 0 THEN 'api/O' || {K} || '/x/Both' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'PUT,PATCH' END, CASE WHEN o_orderkey % 5 = 0 THEN 'unresolved' ELSE 'endpoint' END FROM @controller_source
UNION ALL SELECT path, 13, 'Computed', NULL, NULL, 'unresolved' FROM @controller_source
UNION ALL SELECT path, 3, NULL, NULL, NULL, 'unresolved' FROM @controller_source WHERE o_orderkey % 5 = 0""")
def _(read):
    found = endpoints.controller_routes(read("controller_source"))
    return found.select("path", "line", "action", "template", F.array_join("verbs", ",").alias("verbs"), "status")


relation("minimal_source", """
SELECT 'web' AS project, 'm' || cast(o_orderkey AS string) || '.cs' AS path, o_orderkey, o_orderstatus, o_custkey,
  'var builder = WebApplication.CreateBuilder(args);' || chr(10) || 'builder.MapGet("/early", () => 1);' || chr(10) || 'var app = builder.Build();' || chr(10)
  || 'var g' || cast(o_custkey AS string) || ' = app.MapGroup(' || CASE WHEN o_orderkey % 4 = 0 THEN 'root' ELSE '"/api//v1/"' END || ');' || chr(10)
  || 'app.MapGet("/h/' || o_orderstatus || '", (int a, int b) => "x,)");' || chr(10) || 'g' || cast(o_custkey AS string) || '.MapPost("/items/{id}", Create);' || chr(10)
  || 'app.MapControllers();' || chr(10) || 'other.MapPut("/x", F);' || chr(10) || 'app.MapDelete("/only");' || chr(10) || 'app.MapPatch(pattern, F);' || chr(10) || 'app.MapGet("/a", F).MapPost("/b", F);' AS content
FROM $orders""")


@query("x6_minimal_api", f"""
WITH m AS (SELECT * FROM @minimal_source)
SELECT path, 2 AS line, NULL AS verb, NULL AS template, 'minimal-api-app-not-built' AS pattern, 'unresolved-unknown-receiver' AS reason FROM m
UNION ALL SELECT path, 4, NULL, NULL, 'minimal-api-dynamic-map-group', 'unresolved-dynamic-route' FROM m WHERE o_orderkey % 4 = 0
UNION ALL SELECT path, 5, 'GET', 'h/' || {S}, NULL, NULL FROM m
UNION ALL SELECT path, 6, CASE WHEN o_orderkey % 4 <> 0 THEN 'POST' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'api/v1/items/{{id}}' END, CASE WHEN o_orderkey % 4 = 0 THEN 'minimal-api-dynamic-map-group' END, CASE WHEN o_orderkey % 4 = 0 THEN 'unresolved-dynamic-route' END FROM m
UNION ALL SELECT path, 7, NULL, NULL, 'minimal-api-map-controllers', 'unsupported-convention-pattern' FROM m
UNION ALL SELECT path, 8, NULL, NULL, 'minimal-api-unknown-receiver', 'unresolved-unknown-receiver' FROM m
UNION ALL SELECT path, 9, NULL, NULL, 'minimal-api-missing-handler', 'unresolved-missing-handler' FROM m
UNION ALL SELECT path, 10, NULL, NULL, 'MapPatch', 'unresolved-dynamic-route' FROM m
UNION ALL SELECT path, 11, 'GET', 'a', NULL, NULL FROM m""")
def _(read):
    return endpoints.minimal_api_routes(read("minimal_source")).select("path", "line", "verb", "template", "pattern", "reason")


relation("client_source", """
SELECT 'web' AS project, 's' || cast(o_orderkey AS string) || '.ts' AS path, o_orderkey, o_orderstatus,
  'this.http.get<Map<string, Item[]>>("/api//o/' || cast(o_orderkey AS string) || '/");' || chr(10) || 'this.cache.get("k");' || chr(10) || 'apiClient.request("post", "https://x.example//y?z=1");' || chr(10)
  || 'http.delete(`/t/$' || '{id}`);' || chr(10) || 'http.put(url, body);' || chr(10) || 'http.request(verb, "/x");' || chr(10) || 'const baseUrl = "https://h.example/' || o_orderstatus || '"; // x' || chr(10) || 'baseUrl: env.url,' AS content
FROM $orders""", stored=True)


@query("x7_http_calls", f"""
SELECT path, 1 AS line, 'this.http' AS client, 'GET' AS verb, 'api/o/' || {K} AS route, NULL AS absolute_url, NULL AS pattern, NULL AS reason FROM @client_source
UNION ALL SELECT path, 2, 'this.cache', NULL, NULL, NULL, 'angular-http-non-client-receiver', 'unresolved-not-an-http-client' FROM @client_source
UNION ALL SELECT path, 3, 'apiClient', 'POST', 'https:/x.example/y?z=1', 'https:/x.example/y?z=1', NULL, NULL FROM @client_source
UNION ALL SELECT path, 4, 'http', NULL, NULL, NULL, 'angular-http-template-literal', 'unresolved-dynamic-route' FROM @client_source
UNION ALL SELECT path, 5, 'http', NULL, NULL, NULL, 'angular-http-dynamic-route', 'unresolved-dynamic-route' FROM @client_source
UNION ALL SELECT path, 6, 'http', NULL, NULL, NULL, 'angular-http-request-verb', 'unresolved-non-literal-verb' FROM @client_source""")
def _(read):
    return usage.http_calls(read("client_source")).select("path", "line", "client", "verb", "route", "absolute_url", "pattern", "reason")


@query("x7_base_urls", f"""
SELECT path, 7 AS line, 'https://h.example/' || {S} AS value FROM @client_source UNION ALL SELECT path, 8, NULL FROM @client_source""")
def _(read):
    return usage.base_urls(read("client_source")).select("path", "line", "value")


relation("entity_source", """
SELECT 'db' AS project, 'e' || cast(o_orderkey AS string) || '.cs' AS path, o_orderkey, o_orderstatus,
  '[Table("T' || cast(o_orderkey AS string) || '", Schema = "s' || o_orderstatus || '")]' || chr(10) || 'public class E1 { }' || chr(10) || '[Table("lost")]' || chr(10) || '[Table(Name)]' || chr(10) || 'public record E2' || chr(10) || '{' || chr(10)
  || '  public DbSet<Shop.Order> Orders { get; set; }' || chr(10) || '  b.Entity<A.Customer>().ToTable("C", "crm");' || chr(10) || '  b.Entity<Product>().ToTable(name);' || chr(10) || '  b.ToTable("Own");' || chr(10) || '  b.Entity<Solo>();' || chr(10) || '}' || chr(10) || '[Table]' || chr(10) || 'class E3 { }' AS content
FROM $orders""", stored=True)


@query("x8_entity_tables", f"""
SELECT path, 1 AS line, 'mapping' AS status, 'E1' AS entity, 'T' || {K} AS "table", 's' || {S} AS "schema", 'attribute' AS evidence, NULL AS pattern FROM @entity_source
UNION ALL SELECT path, 3, 'mapping', NULL, 'lost', NULL, 'attribute', NULL FROM @entity_source
UNION ALL SELECT path, 4, 'unresolved', 'E2', NULL, NULL, NULL, 'ef-dynamic-table-name' FROM @entity_source
UNION ALL SELECT path, 7, 'unresolved', 'Order', NULL, NULL, NULL, 'ef-dbset-convention' FROM @entity_source
UNION ALL SELECT path, 8, 'mapping', 'Customer', 'C', 'crm', 'fluent', NULL FROM @entity_source
UNION ALL SELECT path, 9, 'unresolved', 'Product', NULL, NULL, NULL, 'ef-dynamic-table-name' FROM @entity_source
UNION ALL SELECT path, 10, 'mapping', 'E2', 'Own', NULL, 'fluent', NULL FROM @entity_source
UNION ALL SELECT path, 11, 'unresolved', 'Solo', NULL, NULL, NULL, 'ef-entity-convention' FROM @entity_source
UNION ALL SELECT path, 13, 'unresolved', 'E3', NULL, NULL, NULL, 'ef-dbset-convention' FROM @entity_source""")
def _(read):
    return usage.entity_tables(read("entity_source")).select("path", "line", "status", "entity", "table", "schema", "evidence", "pattern")


relation("topic_source", """
SELECT 'app' || cast(o_custkey % 9 AS string) AS project, 't' || cast(o_orderkey AS string) || '.cs' AS path, o_orderkey, o_orderstatus,
  'await bus.PublishAsync("o.' || o_orderstatus || '", new Msg("a, b"));' || chr(10) || 'bus.Publish(topic);' || chr(10) || '[KafkaTopic("k.' || cast(o_orderkey % 7 AS string) || '")]' || chr(10)
  || 'bus.Subscribe<Order>("x");' || chr(10) || 'bus.Consume("c") ; bus.Produce("p");' || chr(10) || 'bus.PublishAsync();' || chr(10) || '[Topic()]' || chr(10) || '// bus.Publish("no")' AS content
FROM $orders""", stored=True)


@query("x10_topic_bindings", """
SELECT path, 1 AS line, 'producer' AS role, 'o.' || o_orderstatus AS topic, 'bound' AS status, NULL AS pattern FROM @topic_source
UNION ALL SELECT path, 2, 'producer', NULL, 'unresolved', 'messaging-publish' FROM @topic_source
UNION ALL SELECT path, 3, 'consumer', 'k.' || o_orderkey % 7, 'bound', NULL FROM @topic_source
UNION ALL SELECT path, 5, 'consumer', 'c', 'bound', NULL FROM @topic_source
UNION ALL SELECT path, 5, 'producer', 'p', 'bound', NULL FROM @topic_source
UNION ALL SELECT path, 7, 'consumer', NULL, 'unresolved', 'messaging-topic-attribute' FROM @topic_source""")
def _(read):
    return usage.topic_bindings(read("topic_source")).select("path", "line", "role", "topic", "status", "pattern")


relation("compose_source", """
SELECT 'ops' AS project, 'd' || cast(o_orderkey AS string) || '/docker-compose.yml' AS path, o_orderkey, o_orderstatus,
  'version: "3"' || chr(10) || 'services:' || chr(10) || '  web' || o_orderstatus || ':' || chr(10) || '    image: "img:' || cast(o_orderkey AS string) || '" # tag' || chr(10) || '    url: $' || '{HOST}' || chr(10) || '    host: db' || chr(10)
  || '    depends_on:' || chr(10) || '      - db' || chr(10) || '    ports:' || chr(10) || '      - "80:80"' || chr(10) || '    environment:' || chr(10) || '      - MODE=prod' || chr(10) || '      - DB_PASSWORD=x' || chr(10) || '      - EMPTY' || chr(10)
  || '      - name: LEVEL' || chr(10) || '        value: info' || chr(10) || '      LATE: $X' || chr(10) || '  short: here' || chr(10) || '    image: second' AS content
FROM $orders""")


@query("x11_w8_manifest_hints", f"""
WITH m AS (SELECT path, 'compose:services.web' || {S} AS own, {K} AS k FROM @compose_source)
SELECT path, 4 AS line, 'hint' AS status, 'image' AS hint, 'image' AS key, 'img:' || k AS value, own || '.image' AS provenance FROM m
UNION ALL SELECT path, 5, 'unsupported', NULL, 'url', NULL, NULL FROM m
UNION ALL SELECT path, 6, 'hint', 'service_reference', 'host', 'db', own || '.host' FROM m
UNION ALL SELECT path, 8, 'hint', 'dependency', 'db', 'db', own || '.depends_on' FROM m
UNION ALL SELECT path, 10, 'hint', 'port', '80:80', '80:80', own || '.ports' FROM m
UNION ALL SELECT path, 12, 'hint', 'environment', 'MODE', 'prod', own || '.environment.MODE' FROM m
UNION ALL SELECT path, 13, 'redacted', NULL, 'DB_PASSWORD', NULL, own || '.environment.DB_PASSWORD' FROM m
UNION ALL SELECT path, 16, 'hint', 'environment', 'LEVEL', 'info', own || '.environment.LEVEL' FROM m
UNION ALL SELECT path, 17, 'unsupported', NULL, 'LATE', NULL, NULL FROM m
UNION ALL SELECT path, 19, 'hint', 'image', 'image', 'second', 'compose:services.short.image' FROM m""")
def _(read):
    return manifests.manifest_hints(read("compose_source")).select("path", "line", "status", "hint", "key", "value", "provenance")


relation("note_source", """
SELECT 'notes' AS project, 'n' || cast(o_orderkey AS string) || '.txt' AS path, o_orderkey, o_orderstatus,
  'a' || cast(o_orderkey AS string) || ' -> b : CALLS ; source=me; version=1 ; source = you' || chr(10) || '// comment' || chr(10) || 'x -> : READS; source=a; version=1' || chr(10) || 'x -> y : READS; source=a' || chr(10)
  || 'x -> y : READS; source=generated; version=' || o_orderstatus || chr(10) || 'no arrow here' || chr(10) || 'p:q -> r ; source=a; version=b' AS content
FROM $orders""", stored=True)


@query("x12_annotations", f"""
SELECT path, 1 AS line, 'a' || {K} AS from_id, 'b' AS to_id, 'CALLS' AS relation, 'you' AS source, '1' AS version, NULL AS reason FROM @note_source
UNION ALL SELECT path, 3, 'x', '', 'READS', 'a', '1', 'rejected-malformed-annotation' FROM @note_source
UNION ALL SELECT path, 4, 'x', 'y', 'READS', 'a', NULL, 'rejected-missing-provenance' FROM @note_source
UNION ALL SELECT path, 5, 'x', 'y', 'READS', 'generated', {S}, 'rejected-reserved-source' FROM @note_source
UNION ALL SELECT path, 6, NULL, NULL, NULL, NULL, NULL, 'rejected-malformed-annotation' FROM @note_source
UNION ALL SELECT path, 7, NULL, NULL, 'q -> r', 'a', 'b', 'rejected-malformed-annotation' FROM @note_source""")
def _(read):
    return usage.annotations(read("note_source")).select("path", "line", "from_id", "to_id", "relation", "source", "version", "reason")
