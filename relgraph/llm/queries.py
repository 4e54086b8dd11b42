"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.llm import decontaminate, fim, html, jaccard, minhash, packing, quality, repeats, sentences, sharding, tokenfile, trie, urls
from relgraph.llm.common import table
from relgraph.session import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

_URL_SQL = """
WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT u.*, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, url, host, path, rule, coalesce(action, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS alias_of,
  CASE WHEN action IS NULL THEN 'default' ELSE 'rule' END AS decided_by FROM m WHERE k = 1
"""


# The SQL leaves out the aliases: the given pages hold no canonical link and no redirect.
@query("op1_url_redirects", _URL_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.rules_frame(spark, URL_RULES), urls.page_links(pages))


_STOP_SQL = " ".join(
    f"WHEN lang = '{lang}' THEN len(list_filter(w, lambda x: list_contains({listed!r}, lower(x))))" for lang, listed in quality.STOP_WORDS.items()
)
_QUALITY_SQL = rf"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x),
z AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM y WHERE c > 1) GROUP BY doc_id),
f AS (SELECT b.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(z.n, 0) AS n_repeat_words, CASE {_STOP_SQL} END AS stops FROM b LEFT JOIN z USING (doc_id)),
h AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars / nullif(n_words, 0) AS mean_word_length,
  n_symbols / nullif(n_words, 0) AS symbol_ratio, stops / nullif(n_words, 0) AS stop_word_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(mean_word_length BETWEEN 2.5 AND 12, true) AND coalesce(symbol_ratio <= 0.1, true)
  AND coalesce(stop_word_ratio >= 0.02, true) AND coalesce(dup_line_ratio <= 0.5, true) AS kept FROM h
"""


@query("op2_quality_rules", _QUALITY_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_label_propagation")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


@query("op3_retrieval_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/relgraph-llm/{uuid.uuid4().hex}/tokens"
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), folder)
    return tokenfile.digests(tokenfile.read_tokens(spark, folder))


@query("op10_sentence_spans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sentences.drop_repeated_spans(table(spark, sf_dir, "documents"))
    return kept.withColumns({"n_bytes": F.octet_length("text").cast("long"), "kept_sha256": F.sha2("text", 256)})


@query("op5_repeated_strings")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 200).drop("kept")


@query("op4_consensus_paths")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op6_edit_matching")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match_items(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_items", "best_item", "best_distance", (F.col("n_items") > 0).alias("contaminated"))


_FIM_SQL = """
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
b AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
  CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT doc_id, n, t, form, array_to_string(u[1:x], '') AS p, array_to_string(u[x + 1:y], '') AS m, array_to_string(u[y + 1:], '') AS s FROM c),
e AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM d),
f AS (SELECT *, CASE form WHEN 'spm' THEN strpos(o, '<P>') ELSE strpos(o, '<S>') END AS two, strpos(o, '<M>') AS three FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(o) AS output_sha256, sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN substr(o, 4, two - 4) || substr(o, three + 3) || substr(o, two + 3, three - two - 3)
    ELSE substr(o, two + 3, three - two - 3) || substr(o, three + 3) || substr(o, 4, two - 4) END) AS restored_sha256
FROM f
"""


@query("op11_fill_in_middle", _FIM_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


_TRIE_SQL = """
WITH RECURSIVE crc(v, k, x) AS (SELECT DISTINCT conv_id, 0, CAST(4294967295 AS BIGINT) FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT v, k + 1, list_reduce([xor(x, CAST(ascii(substr(CAST(v AS VARCHAR), k + 1, 1)) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1))) FROM crc WHERE k < length(CAST(v AS VARCHAR))),
h AS (SELECT v AS c, v - v % 5 AS base, xor(x, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE k = length(CAST(v AS VARCHAR))),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
  coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT c, p, r, x FROM h JOIN t ON t.conv_id = base AND p <= h UNION ALL SELECT c, p, r, x FROM h JOIN t ON t.conv_id = c AND p > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, sha256(length(r) || ':' || r || x) AS k, strlen(x) AS b FROM u),
path AS (SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path, b, count(*) OVER (PARTITION BY c) AS n FROM s
  UNION ALL SELECT c, 0, '', 0, (SELECT count(*) FROM s WHERE s.c = h.c) FROM h),
node AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, max(n) > d AS inner_node,
  sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM path GROUP BY path, d),
up AS (SELECT a.path, sum(CASE WHEN o.inner_node THEN 0 ELSE 1 END) AS n_leaves, sum((o.n_convs - 1) * o.b) AS saved_tokens,
  sum(CASE WHEN o.d = a.d + 1 THEN 1 ELSE 0 END) AS n_children FROM node o JOIN path a ON a.c = o.conv_id AND a.d <= o.d GROUP BY a.path)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, node.n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN up USING (path) LEFT JOIN node parent ON node.d > 0 AND parent.path = substr(node.path, 1, length(node.path) - 64)
"""


@query("op12_prefix_trie", _TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = trie.rebuild(trie.number_turns(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, members)


@query("op13_tensored_minhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
