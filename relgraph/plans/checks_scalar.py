"""Registered queries: paths, routes, identities, text rules."""

from pyspark.sql import functions as F

from relgraph.functions import identity, kinds, paths, redact, routes, text
from relgraph.operators import snapshots
from relgraph.plans.registry import query, relation

EXT = "lower(CASE WHEN instr(path, '.') > 0 THEN list_last(string_split(path, '.')) END)"
NAME = "list_last(string_split(path, '/'))"
NAME_EXT = f"CASE WHEN instr({NAME}, '.') > 0 THEN list_last(string_split({NAME}, '.')) END"
DIRS = "list_slice(string_split(path, '/'), 1, -2)"


@query("p1_ignore_reason", f"""
WITH p AS (SELECT path, string_split(path, '/') AS s, {NAME} AS n, lower({NAME_EXT}) AS e, {DIRS} AS d FROM @corpus),
r AS (SELECT path, CASE
  WHEN s[1] = 'live' THEN 'generated_graph_data/policy.graph-output-root'
  WHEN s[1] IN ('.staging', 'temp') THEN 'staging_area/policy.project-root-directory'
  WHEN s[1] IN ('queue', 'leases', 'locks') THEN 'queue_state/policy.project-root-directory'
  WHEN s[1] = 'logs' THEN 'log_file/policy.project-root-directory'
  WHEN s[1] = 'backups' THEN 'backup_artifact/policy.project-root-directory'
  WHEN s[1] = 'credentials' THEN 'credential_store/policy.project-root-directory'
  WHEN list_has_any(d, ['bin', 'obj', 'node_modules', '.git']) THEN
    CASE (list_filter(d, lambda x: x IN ('bin', 'obj', 'node_modules', '.git')))[1] WHEN 'node_modules' THEN 'dependency_cache'
      WHEN '.git' THEN 'version_control_metadata' ELSE 'build_output' END || '/policy.any-depth-directory'
  WHEN e IN ('db', 'db-wal', 'db-shm', 'sqlite', 'sqlite3', 'wal', 'shm') THEN 'database_file/policy.extension'
  WHEN e = 'log' THEN 'log_file/policy.extension'
  WHEN e IN ('swp', 'tmp', 'orig', 'rej') THEN 'editor_temporary_file/policy.extension'
  WHEN starts_with(n, '~$') OR (starts_with(n, '.') AND n LIKE '%.swp') THEN 'editor_temporary_file/policy.editor-temporary-name'
  WHEN n LIKE '%.tmp' OR contains(n, '.tmp.') THEN 'editor_temporary_file/policy.atomic-replace-scratch' END AS v FROM p)
SELECT path, string_split(v, '/')[1] AS reason, string_split(v, '/')[2] AS rule FROM r""")
def _(read):
    verdict = paths.ignore_reason(F.col("path"))
    return read("corpus").select("path", verdict["reason"].alias("reason"), verdict["rule"].alias("rule"))


relation("links", """
SELECT project AS project_id, path, doc_id,
       CASE doc_id % 6 WHEN 0 THEN '/repo/p/x' WHEN 1 THEN '/repo/pp' WHEN 2 THEN cast(NULL AS string) WHEN 3 THEN '/repo/p' ELSE '/etc/passwd' END AS target,
       CASE WHEN doc_id % 3 = 1 THEN 'file' ELSE 'symlink' END AS entry_kind
FROM @corpus""")


@query("p2_input_skip", f"""
WITH p AS (SELECT path, entry_kind, target, lower({NAME}) AS n, lower({NAME_EXT}) AS e, {DIRS} AS d FROM @links),
q AS (SELECT *, CASE
  WHEN len(list_filter(d, lambda x: lower(x) IN ('.secrets', 'secrets', 'credentials'))) > 0 THEN (list_filter(d, lambda x: lower(x) IN ('.secrets', 'secrets', 'credentials')))[1]
  WHEN n IN ('.env', 'credentials', 'credentials.json', 'secrets.json', 'id_rsa', 'id_ed25519', '.npmrc', '.pypirc', '.netrc') THEN n
  WHEN e IN ('pfx', 'p12', 'key', 'pem', 'kdbx') THEN e
  WHEN substr(n, 1, length(n) - length(e) - 1) = '.env' THEN '.env' END AS secret FROM p),
r AS (SELECT *, CASE WHEN secret IS NOT NULL THEN 'secret' WHEN entry_kind <> 'symlink' THEN NULL
  WHEN target IS NULL THEN 'symlink_unresolved' WHEN target = '/repo/p' OR starts_with(target, '/repo/p/') THEN NULL
  ELSE 'symlink_escape' END AS skip FROM q)
SELECT path, entry_kind, skip, CASE skip WHEN 'secret' THEN secret WHEN 'symlink_escape' THEN target END AS detail FROM r""")
def _(read):
    verdict = paths.input_skip(F.col("path"), F.col("entry_kind"), F.col("target"), "/repo/p/")
    return read("links").select("path", "entry_kind", verdict["skip"].alias("skip"), verdict["detail"].alias("detail"))


relation("odd_paths", r"""
SELECT doc_id, CASE doc_id % 14 WHEN 0 THEN '/' || path WHEN 1 THEN 'C:/x' || path WHEN 2 THEN replace(path, '/', '\')
         WHEN 3 THEN 'a//' || path WHEN 4 THEN './' || path WHEN 5 THEN 'a/../' || path WHEN 6 THEN '' WHEN 7 THEN path || '/'
         WHEN 8 THEN 'con/' || path WHEN 9 THEN 'a/Lpt1.txt' WHEN 10 THEN 'trail./' || path WHEN 11 THEN 'a:b/' || path
         WHEN 12 THEN path || chr(9) ELSE path END AS path
FROM @corpus""".replace("'\\'", "chr(92)"))


@query("p3_portable_path", """
WITH u AS (SELECT doc_id, path AS raw, replace(path, chr(92), '/') AS path FROM @odd_paths),
s AS (SELECT *, (list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..')))[1] AS bad FROM u),
r AS (SELECT *, CASE WHEN raw = '' THEN 'path-empty' WHEN starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') THEN 'path-absolute'
   WHEN bad = '' THEN 'path-empty-segment' WHEN bad IS NOT NULL THEN 'path-traversal' END AS reason FROM s),
t AS (SELECT *, string_split(raw, '/') AS seg FROM r)
SELECT doc_id, CASE WHEN reason IS NULL THEN path END AS portable, reason,
  CASE WHEN raw = '' THEN 'path-empty' WHEN contains(raw, chr(9)) THEN 'path-control-character' WHEN contains(raw, chr(92)) THEN 'path-backslash'
    WHEN starts_with(raw, '/') OR regexp_matches(raw, '^[A-Za-z]:') THEN 'path-absolute'
    ELSE (list_filter(list_transform(seg, lambda x: CASE WHEN x = '' THEN 'path-empty-segment' WHEN x IN ('.', '..') THEN 'path-traversal'
      WHEN right(x, 1) IN ('.', ' ') THEN 'path-trailing-dot-or-space' WHEN contains(x, ':') THEN 'path-stream-syntax'
      WHEN upper(string_split(x, '.')[1]) IN ('CON', 'LPT1') THEN 'path-reserved-name' END), lambda y: y IS NOT NULL))[1] END AS strict_reason
FROM t""")
def _(read):
    verdict = paths.portable_path(F.col("path"))
    return read("odd_paths").select(
        "doc_id", verdict["path"].alias("portable"), verdict["reason"].alias("reason"),
        paths.strict_path_reason(F.col("path")).alias("strict_reason"),
    )


@query("p4_language_support", f"""
SELECT path, CASE WHEN {EXT} = 'cs' THEN 'csharp' WHEN {EXT} IN ('ts', 'tsx', 'mts', 'cts') THEN 'typescript' END AS language,
  CASE WHEN coalesce({EXT}, '') NOT IN ('cs', 'ts', 'tsx', 'mts', 'cts') THEN 'unsupported-language:' || coalesce({EXT}, '<none>') END AS pattern
FROM @corpus""")
def _(read):
    path = F.col("path")
    return read("corpus").select(
        "path", paths.language(path).alias("language"), paths.unsupported_pattern(path).alias("pattern")
    )


relation("config_paths", """
SELECT doc_id, CASE doc_id % 16 WHEN 0 THEN 'app.SLN' WHEN 1 THEN 'a/b.csproj' WHEN 2 THEN 'package.json' WHEN 3 THEN 'x/package-lock.json'
  WHEN 4 THEN 'tsconfig.app.json' WHEN 5 THEN 'Directory.Build.props' WHEN 6 THEN 'annotations/' || source || '.txt' WHEN 7 THEN 'bin/app.sln'
  WHEN 8 THEN 'routes.json' WHEN 9 THEN 'nuget.config' WHEN 10 THEN 'pyproject.toml' WHEN 11 THEN 'annotations' WHEN 12 THEN 'x.slnf'
  WHEN 13 THEN 'tsconfig.json.bak' WHEN 14 THEN 'yarn.lock' ELSE 'src/' || cast(doc_id AS string) || '.cs' END AS path,
  CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN source ELSE sha2(text, 256) END AS previous, sha2(text, 256) AS fingerprint
FROM $documents""")


@query("p5_config_scope", f"""
WITH k AS (SELECT doc_id, path, previous, fingerprint, CASE
  WHEN len(list_filter({DIRS}, lambda x: lower(x) = 'annotations')) > 0 THEN 'annotation'
  WHEN lower({NAME}) IN ('directory.build.props', 'directory.build.targets') THEN 'shared_build_config'
  WHEN lower({NAME}) IN ('directory.packages.props', 'nuget.config', 'packages.lock.json', 'package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', 'bun.lockb') THEN 'package_lock'
  WHEN lower(path) LIKE '%.sln' OR lower(path) LIKE '%.slnx' OR lower(path) LIKE '%.slnf' THEN 'solution_file'
  WHEN lower(path) LIKE '%.csproj' THEN 'project_manifest'
  WHEN lower({NAME}) IN ('package.json', 'pyproject.toml') THEN 'package_manifest'
  WHEN lower({NAME}) = 'tsconfig.json' OR (lower({NAME}) LIKE 'tsconfig.%' AND lower({NAME}) LIKE '%.json') THEN 'typescript_config'
  WHEN lower({NAME}) IN ('routes.json', 'endpoints.json') THEN 'route_config' END AS kind FROM @config_paths)
SELECT doc_id, kind, CASE WHEN kind IS NULL OR starts_with(path, 'bin/') THEN 'none' WHEN kind IN ('solution_file', 'shared_build_config') THEN 'solution'
  ELSE 'project' END AS scope, previous IS NULL OR previous <> fingerprint AS changed FROM k""")
def _(read):
    path = F.col("path")
    return read("config_paths").select(
        "doc_id", paths.config_kind(path).alias("kind"), paths.config_scope(path).alias("scope"),
        paths.fingerprint_changed(F.col("previous"), F.col("fingerprint")).alias("changed"),
    )


@query("p6_kind_vocabulary", """
SELECT n.id, CASE n.kind WHEN 'namespace' THEN 'Namespace' WHEN 'class' THEN 'Class' WHEN 'interface' THEN 'Interface' WHEN 'method' THEN 'Method'
   WHEN 'function' THEN 'Function' WHEN 'variable' THEN 'Property' END AS contract,
   CASE WHEN p.kind = 'Widget' THEN 'Widget' ELSE p.kind END AS shown, CASE WHEN p.kind = 'Widget' THEN 'extension' ELSE 'frozen' END AS vocabulary
FROM @nodes n JOIN @pub_nodes p ON n.id = p.id""")
def _(read):
    shown = kinds.vocabulary_kind(F.lower(F.col("shown_kind")), kinds.NODE_KINDS)
    both = read("nodes").join(read("pub_nodes").select("id", F.col("kind").alias("shown_kind")), "id")
    shown = kinds.vocabulary_kind(F.when(F.col("shown_kind") == "Widget", F.col("shown_kind")).otherwise(F.upper("shown_kind")), kinds.NODE_KINDS)
    return both.select("id", kinds.contract_kind(F.col("kind")).alias("contract"), shown["kind"].alias("shown"), shown["vocabulary"].alias("vocabulary"))


relation("records", """
SELECT id, cast(NULL AS string) AS source_id, qualified_name FROM @nodes
UNION ALL SELECT id, source_id, CASE WHEN id LIKE 'e1:%' THEN 'odd' END FROM @edges""")


@query("p7_record_shape", "SELECT id, source_id IS NOT NULL AND qualified_name IS NULL AS is_edge FROM @records")
def _(read):
    return read("records").select("id", kinds.is_edge(F.col("source_id"), F.col("qualified_name")).alias("is_edge"))


@query("p9_split_oversize", """
SELECT project, path, bytes, CASE WHEN bytes > 4000 THEN 'oversized' ELSE 'accepted' END AS outcome FROM @corpus""")
def _(read):
    out = snapshots.split_oversize(read("corpus").select("project", "path", "bytes"), 4000)
    return snapshots.union_shards(
        [df.select("project", "path", "bytes", F.lit(name).alias("outcome")) for name, df in out.items()]
    )


relation("versions", """
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '*' WHEN 1 THEN 'Latest' WHEN 2 THEN '' WHEN 3 THEN 'git+ssh://' || p_name WHEN 4 THEN 'file:../' || p_name
  WHEN 5 THEN 'HTTPS://x/' || p_name WHEN 6 THEN 'gitfoo' WHEN 7 THEN 'workspace:*' ELSE '^1.' || cast(p_size AS string) END AS version,
  CASE p_partkey % 7 WHEN 0 THEN 'DB_PASSWORD' WHEN 1 THEN 'Sas_Url' WHEN 2 THEN 'tokenizer' WHEN 3 THEN 'ConnectionStringX' WHEN 4 THEN 'LOG_LEVEL' ELSE p_name END AS key
FROM $part""")


@query("p10_version_resolution", """
SELECT p_partkey, lower(version) IN ('*', 'latest', '') OR regexp_matches(lower(version), '^(file:|link:|portal:|workspace:|npm:|git[+]|git:|http:|https:|github:)') AS needed FROM @versions""")
def _(read):
    return read("versions").select("p_partkey", kinds.requires_resolution(F.col("version")).alias("needed"))


@query("p11_secret_keys", """
SELECT p_partkey, contains(lower(key), 'password') OR contains(lower(key), 'sas') OR contains(lower(key), 'token') OR contains(lower(key), 'connectionstring')
  OR contains(lower(key), 'secret') OR contains(lower(key), 'credential') AS secret FROM @versions""")
def _(read):
    return read("versions").select("p_partkey", kinds.is_secret_key(F.col("key")).alias("secret"))


relation("urls", """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN replace(url, '.com/', '.com:80//') WHEN 2 THEN 'HTTPS://User:pw@' || substr(url, instr(url, '://') + 3)
  WHEN 3 THEN '//' || substr(url, instr(url, '://') + 3) WHEN 4 THEN '/only/path' WHEN 5 THEN replace(url, '.com/', '.com:80:443/') WHEN 6 THEN 'http://bare.example'
  WHEN 7 THEN replace(replace(url, '.com/', '.com:443/'), '.org/', '.org:443/') ELSE '  ' || url || ' ' END AS url FROM $pages""")


@query("f1_f3_hosts_and_paths", r"""
WITH a AS (SELECT page_id, url, lower(trim(url)) AS t FROM @urls),
b AS (SELECT *, CASE WHEN contains(t, '://') THEN substr(t, instr(t, '://') + 3) ELSE t END AS rest FROM a),
c AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS auth FROM b),
d AS (SELECT *, list_last(string_split(auth, '@')) AS h FROM c),
e AS (SELECT *, CASE WHEN h LIKE '%:80' THEN left(h, length(h) - 3) ELSE h END AS h1 FROM d),
f AS (SELECT *, CASE WHEN h1 LIKE '%:443' THEN left(h1, length(h1) - 4) ELSE h1 END AS h2 FROM e)
SELECT page_id, CASE WHEN (contains(t, '://') OR starts_with(t, '//')) AND h2 <> '' THEN h2 END AS host,
  trim(regexp_replace(regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE url END, '^[^/]*(/[^?#]*)', 1), '/+', '/', 'g'), '/') AS request_path
FROM f""")
def _(read):
    url = F.col("url")
    return read("urls").select(
        "page_id", routes.host_of(url).alias("host"), routes.request_path(url, F.lit(None).cast("string")).alias("request_path")
    )


@query("f4_path_matches", r"""
WITH a AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '{lang}/{id}' WHEN 1 THEN '/EN/{id}' WHEN 2 THEN '{*all}' WHEN 3 THEN 'en/{*rest}' WHEN 4 THEN 'fr/{id}/' ELSE '{lang}' END AS template,
  trim(regexp_replace(split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]*', ''), '?', 1), '#', 1), '/+', '/', 'g'), '/') AS path FROM $pages),
b AS (SELECT *, lower(path) AS p, len(string_split(path, '/')) AS n, path <> '' AS nonempty FROM a)
SELECT page_id, template, CASE template WHEN '{lang}/{id}' THEN n = 2 WHEN '/EN/{id}' THEN n = 2 AND starts_with(p, 'en/') WHEN '{*all}' THEN nonempty
   WHEN 'en/{*rest}' THEN n >= 2 AND starts_with(p, 'en/') WHEN 'fr/{id}/' THEN n = 2 AND starts_with(p, 'fr/') ELSE n = 1 AND nonempty END AS matches FROM b""")
def _(read):
    template = (
        F.when(F.col("page_id") % 6 == 0, "{lang}/{id}").when(F.col("page_id") % 6 == 1, "/EN/{id}")
        .when(F.col("page_id") % 6 == 2, "{*all}").when(F.col("page_id") % 6 == 3, "en/{*rest}")
        .when(F.col("page_id") % 6 == 4, "fr/{id}/").otherwise("{lang}")
    )
    pages = read("pages").withColumn("template", template)
    path = routes.request_path(F.col("url"), F.lit(None).cast("string"))
    return pages.select("page_id", "template", routes.path_matches(F.col("template"), path).alias("matches"))


@query("f5_service_key", r"""
WITH a AS (SELECT page_id, lower(trim(url)) AS t FROM @urls),
b AS (SELECT *, regexp_extract(t, '^([a-z][a-z0-9+.-]*)://', 1) AS scheme FROM a),
c AS (SELECT *, CASE WHEN scheme <> '' THEN '//' || substr(t, length(scheme) + 4) ELSE t END AS u FROM b),
d AS (SELECT *, CASE scheme WHEN 'http' THEN regexp_replace(u, '^//([^/:]+):80(/|$)', '//\1\2') WHEN 'https' THEN regexp_replace(u, '^//([^/:]+):443(/|$)', '//\1\2') ELSE u END AS v FROM c),
e AS (SELECT *, CASE WHEN starts_with(v, '//') THEN '//' || regexp_replace(substr(v, 3), '/+', '/', 'g') ELSE regexp_replace(v, '/+', '/', 'g') END AS w FROM d)
SELECT page_id, CASE WHEN length(w) > 1 AND right(w, 1) = '/' THEN left(w, length(w) - 1) ELSE w END AS key FROM e""")
def _(read):
    return read("urls").select("page_id", routes.normalize_service_key(F.col("url")).alias("key"))


@query("f8_declaration_keys")
def _(read):
    """No SQL twin: DuckDB has no FNV hash. tests/ checks it against published vectors."""
    parts = F.array("lang", "source")
    return read("documents").select(
        "doc_id", identity.declaration_key(F.col("source"), F.lit("class"), parts).alias("key"),
        identity.canonical_tuple(parts).alias("canonical"),
    )


@query("f9_node_and_edge_ids", """
WITH e AS (SELECT id, source_id, coalesce(target_id, unresolved_target) AS target, '[[' || to_json(owner_file) || ',' || line || ',' || line || ',"declaration-contains-v1"]]' AS ev FROM @edges)
SELECT id, 'edge' AS record, sha256('["' || source_id || '","CONTAINS",' || to_json(target) || ',' || to_json(ev) || ']') AS identity FROM e
UNION ALL SELECT id, 'node', sha256('[' || to_json(project_id) || ',' || to_json(language) || ',' || to_json(kind) || ',' || to_json(qualified_name) || ']') FROM @nodes
UNION ALL SELECT 'doc' || doc_id, 'text', sha256('[' || to_json(source) || ',' || to_json(lang) || ',' || to_json(replace(text, chr(10), ' ')) || ',""]') FROM $documents""")
def _(read):
    line = F.col("line")
    evidence = identity.evidence_key(
        F.array(F.struct(F.struct(F.col("owner_file").alias("file"), line.alias("start_line"), line.alias("end_line")).alias("source"),
                         F.lit("declaration-contains-v1").alias("rule_id")))
    )
    edges = read("edges").select(
        "id", F.lit("edge").alias("record"),
        identity.edge_id(F.col("source_id"), F.lit("CONTAINS"), F.coalesce("target_id", "unresolved_target"), evidence).alias("identity"),
    )
    nodes = read("nodes").select(
        "id", F.lit("node").alias("record"),
        identity.node_id(F.col("project_id"), F.col("language"), F.col("kind"), F.col("qualified_name")).alias("identity"),
    )
    texts = read("documents").select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("id"), F.lit("text").alias("record"),
        identity.node_id(F.col("source"), F.col("lang"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("")).alias("identity"),
    )
    return edges.unionByName(nodes).unionByName(texts)


@query("f11_buckets", """
SELECT id, cast(('0x' || substr(sha256(id), 1, 16))::UBIGINT % 256 AS bigint) AS bucket, 'bucket-' || lpad(cast(('0x' || substr(sha256(id), 1, 16))::UBIGINT % 256 AS varchar), 3, '0') AS name,
       cast(('0x' || substr(sha256(id), 1, 16))::UBIGINT % 1000003 AS bigint) AS wide FROM @nodes""")
def _(read):
    number = identity.bucket(F.col("id"), 256)
    return read("nodes").select(
        "id", number.cast("long").alias("bucket"), identity.bucket_name(number, 256).alias("name"),
        identity.bucket(F.col("id"), 1_000_003).cast("long").alias("wide"),
    )


relation("action_routes", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'api/[controller]' WHEN 1 THEN '' WHEN 2 THEN 'v1//[Controller]/' ELSE 'x/[action]/' END AS prefix,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Order' ELSE 'Item' END || CASE WHEN o_orderkey % 2 = 0 THEN 'Controller' ELSE '' END AS controller, 'Get' || o_orderstatus AS action,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '/root/[action]' WHEN 2 THEN '{id}' WHEN 3 THEN '[controller]/{id}//x' ELSE '' END AS method_route FROM $orders""")


@query("f14_compose_route", r"""
WITH a AS (SELECT *, CASE WHEN controller LIKE '%Controller' THEN left(controller, length(controller) - 10) ELSE controller END AS tok FROM @action_routes),
b AS (SELECT *, replace(replace(coalesce(method_route, action), '[controller]', tok), '[action]', action) AS m, replace(replace(prefix, '[controller]', tok), '[action]', action) AS p FROM a)
SELECT o_orderkey, trim(regexp_replace(CASE WHEN starts_with(m, '/') OR p = '' THEN m ELSE rtrim(p, '/') || '/' || ltrim(m, '/') END, '/+', '/', 'g'), '/') AS route FROM b""")
def _(read):
    return read("action_routes").select(
        "o_orderkey", routes.compose_route(F.col("prefix"), F.col("controller"), F.col("action"), F.col("method_route")).alias("route")
    )


relation("folded_paths", """
SELECT project, path, doc_id FROM @corpus
UNION ALL SELECT project, upper(path), doc_id FROM @corpus WHERE doc_id % 6 = 0
UNION ALL SELECT project, path, doc_id FROM @corpus WHERE doc_id % 10 = 0
UNION ALL SELECT project, path || 'é', doc_id FROM @corpus WHERE doc_id % 15 = 1
UNION ALL SELECT project, path || 'é', doc_id FROM @corpus WHERE doc_id % 30 = 1""")


@query("f16_path_collisions", """
WITH k AS (SELECT project, path, nfc_normalize(lower(path)) AS key FROM @folded_paths)
SELECT project, count(*) AS rows, cast(count(DISTINCT path) AS bigint) AS spellings, CASE WHEN count(DISTINCT path) = 1 THEN 'duplicate'
  WHEN count(DISTINCT lower(path)) > 1 THEN 'normalization' ELSE 'case-only' END AS kind
FROM k GROUP BY project, key HAVING count(*) > 1""")
def _(read):
    from relgraph.operators.collisions import path_collisions

    return path_collisions(read("folded_paths"), ["project"]).select("project", "rows", "spellings", "kind")


@query("f17_scrub")
def _(read):
    """Whole texts. The rules need a scanner, so tests/ compare with a brute-force one."""
    return read("documents").select("doc_id", redact.scrub(F.col("text")).alias("text"))


@query("f18_leaf_and_lines", """
SELECT id, regexp_extract(qualified_name, '([^./:]*)$', 1) AS leaf FROM @nodes
UNION ALL SELECT 'doc' || doc_id, cast(1 + length(left(text, cast(n_chars // 2 AS int))) - length(replace(left(text, cast(n_chars // 2 AS int)), chr(10), '')) AS varchar) FROM $documents""")
def _(read):
    leaves = read("nodes").select("id", text.leaf_name(F.col("qualified_name")).alias("leaf"))
    lines = read("documents").select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("id"),
        text.line_at(F.col("text"), F.floor(F.col("n_chars") / 2)).cast("string").alias("leaf"),
    )
    return leaves.unionByName(lines)
