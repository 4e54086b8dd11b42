"""URL filters: rules by host and path, and decisions that follow redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import stored
from relgraph.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> Column:
    """Struct of ``host``, ``path`` and ``query`` (with its mark); null or no ``://``: all empty."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    part = lambda k: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    return F.struct(F.translate(part(1), _UPPER, _LOWER).alias("host"), part(2).alias("path"), part(3).alias("query"))


def url_key(parts: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment."""
    return F.concat(parts["host"], parts["path"], parts["query"])


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table (``host, path, action``) from ``(action, host, path)`` tuples."""
    made = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for a, h, p in rules]
    empty = F.array().cast("array<struct<host:string,path:string,action:string>>")
    return spark.range(1).select(F.inline(F.array(*made) if made else empty))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct ``(host, path)``: ``host, path, rule, action``.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    Each host is spelled out as its suffixes, so that this is an equi-join however
    long the rule table is. URLs without a rule give no row.
    """
    named = urls.select("host", "path").where("host is not null and path is not null").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    listed = rules.where("host is not null and path is not null").select(
        F.col("host").alias("suffix"), F.col("path").alias("start"), "action"
    )
    fits = named.withColumn("suffix", F.explode(suffix)).join(listed, "suffix").where(F.startswith("path", "start"))
    rule = F.concat("suffix", "start")
    best = F.max(F.struct(F.length(rule).alias("n"), F.when(F.col("action") == "allow", 1).otherwise(0), rule.alias("rule"), "action"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.action")


def page_links(pages: DataFrame) -> DataFrame:
    """Redirect edges of pages (``url, target``): canonical links and refresh redirects.

    Relative targets are resolved against the page's URL. Null or empty HTML, or none
    of both tags, gives no row.
    """
    canonical = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
    found = pages.where(r"html rlike '(?i)canonical|http-equiv'").select(
        "url", F.explode(F.array(F.regexp_extract("html", canonical, 1), F.regexp_extract("html", refresh, 1))).alias("raw")
    ).where("raw <> '' and url is not null")
    raw = F.replace("raw", F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract("url", r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    target = (
        F.when(raw.contains("://"), raw)
        .when(raw.startswith("//"), F.concat(F.lit("http:"), raw))
        .when(raw.startswith("/"), F.concat(root, raw))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), raw))
    )
    return found.select("url", target.alias("target"))


def filter_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``pages`` (``page_id, url``) with ``host, path, rule, verdict, alias_of, decided_by``.

    ``links`` holds redirect and canonical-link edges (``url, target``). URLs that
    these connect are aliases. The longest fitting rule decides a URL. A URL without
    a rule takes what its aliases' rules say: allow if any of them is allowed,
    else block if any is blocked, else ``default``. Targets that are no page take
    part. Null or malformed URLs have no rule and no alias; repeated rows are all
    returned; other columns of ``pages`` are left out.
    """
    seen = pages.select("page_id", "url", url_parts(F.col("url")).alias("u"))
    seen = seen.select("page_id", "url", "u.host", "u.path", url_key(F.col("u")).alias("key"))
    own = match_rules(seen, rules)
    judged = seen.join(own, ["host", "path"], "left")
    if links is None:
        links = seen.sparkSession.createDataFrame([], "url string, target string")
    ends = links.select(url_parts(F.col("url")).alias("a"), url_parts(F.col("target")).alias("b"))
    edges = stored(
        ends.select(url_key(F.col("a")).alias("a"), url_key(F.col("b")).alias("b"), F.col("a.host").alias("host_a"),
                    F.col("a.path").alias("path_a"), F.col("b.host").alias("host_b"), F.col("b.path").alias("path_b"))
        .where("a <> '' and b <> '' and a <> b").distinct(),
        "edges",
    )
    if edges.isEmpty():
        return judged.select(
            "page_id", "url", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"),
            F.lit(None).cast("string").alias("alias_of"), F.when(F.col("action").isNull(), "default").otherwise("rule").alias("decided_by"),
        )
    groups = components(edges.select("a", "b"))
    nodes = edges.select(F.col("a").alias("node"), F.col("host_a").alias("host"), F.col("path_a").alias("path")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("host_b").alias("host"), F.col("path_b").alias("path"))
    ).distinct()
    ruled = nodes.join(match_rules(nodes, rules), ["host", "path"])
    # allow before block: "allow" is the smaller word
    said = groups.join(ruled, "node").groupBy("component").agg(F.min("action").alias("passed_on"))
    alias = stored(groups.join(said, "component", "left").withColumnRenamed("node", "key"), "aliases")
    return judged.join(alias, "key", "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("action", "passed_on", F.lit(default)).alias("verdict"), F.col("component").alias("alias_of"),
        F.when(F.col("action").isNotNull(), "rule").when(F.col("passed_on").isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )
