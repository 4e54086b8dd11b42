"""Name resolution with three outcomes: resolved, ambiguous, unresolved.

Every resolver first reduces the candidate side to one row per lookup key (a count
and its extreme members, combined map-side), so the referring side, which may be
skewed, joins a unique key and never multiplies. Candidate lists of ambiguous keys
come back as a relation keyed by the lookup key, not as arrays on every referrer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.functions import routes
from relgraph.functions.paths import fold_relative, fold_target

IMPORT_LINE = ["project", "file", "line", "specifier"]


def candidate_summary(candidates: DataFrame, keys: list[str], member: str, carried: list[str] | None = None) -> DataFrame:
    """Rows and extreme members per lookup key; ``only`` holds the carried columns of the smallest member."""
    carried = carried or []
    return candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(member).alias("low"),
        F.max(member).alias("high"),
        F.min_by(F.struct(F.col(member), *carried), F.col(member)).alias("only"),
    )


# ---- imports ------------------------------------------------------------------
def resolve_imports(
    statements: DataFrame,
    known_files: DataFrame,
    aliases: list[tuple[str, list[str]]],
    extensions: list[str],
    index_names: list[str] = ["index"],
) -> dict[str, DataFrame]:
    """Resolve literal specifiers against the files a project really has.

    ``outcomes`` has one row per statement; ``candidates`` lists the files of every
    ambiguous ``(project, roots)``.
    """
    spec = F.col("specifier")

    def owns(prefix: str) -> Column:
        return (spec == prefix) | spec.startswith(prefix + "/")

    is_alias = F.lit(False)
    alias_roots = []
    for prefix, targets in aliases:
        is_alias = is_alias | owns(prefix)
        rest = F.regexp_replace(F.substring(spec, F.lit(len(prefix) + 1), F.length(spec)), "^/", "")
        for target in targets:
            alias_roots.append(F.when(owns(prefix), fold_target(F.lit(target), rest)))
    kind = (
        F.when(spec.isNull() | (spec == ""), "unsupported")
        .when(spec.startswith("./") | spec.startswith("../") | (spec == "."), "relative")
        .when(is_alias, "alias")
        .otherwise("external")
    )
    roots = F.when(F.col("kind") == "relative", F.array_compact(F.array(fold_relative(F.col("file"), spec)))).when(
        F.col("kind") == "alias",
        F.array_sort(F.array_distinct(F.array_compact(F.array(*alias_roots)))) if alias_roots else F.lit(None),
    )
    typed = statements.withColumn("kind", kind).withColumn("roots", roots)

    def files_for(root: Column) -> Column:
        tails = [""] + [f".{e}" for e in extensions] + [f"/{i}.{e}" for i in index_names for e in extensions]
        return F.array(*[F.concat(root, F.lit(t)) for t in tails])

    wanted = typed.where(F.size("roots") > 0).select("project", "roots").distinct()
    guesses = wanted.select("project", "roots", F.explode(F.flatten(F.transform("roots", files_for))).alias("path")).distinct()
    hits = guesses.join(known_files.select("project", "path").distinct(), ["project", "path"])
    summary = candidate_summary(hits, ["project", "roots"], "path")
    joined = typed.join(summary, ["project", "roots"], "left")
    count = F.coalesce("rows", F.lit(0))
    outside = (F.col("kind") == "relative") & (F.size("roots") == 0)
    reason = (
        F.when(F.col("kind") == "unsupported", "unresolved-not-a-literal")
        .when(F.col("kind") == "external", "unresolved-external-package")
        .when(outside, "unresolved-outside-project")
        .when(count == 0, "unresolved-missing-target")
    )
    status = F.when(reason.isNotNull(), "unresolved").when(count == 1, "resolved").otherwise("ambiguous")
    outcomes = joined.select(
        *IMPORT_LINE,
        "kind",
        status.alias("status"),
        F.when(status == "resolved", F.col("low")).alias("target"),
        F.when(status != "unresolved", F.col("kind")).alias("rule"),
        F.when(status == "resolved", "exact_static").alias("quality"),
        reason.alias("reason"),
        count.alias("candidates"),
        F.array_join("roots", "|").alias("lookup"),
    )
    several = summary.where("rows > 1").select("project", "roots")
    candidates = hits.join(several, ["project", "roots"], "left_semi").select(
        "project", F.array_join("roots", "|").alias("lookup"), "path"
    )
    return {"outcomes": outcomes, "candidates": candidates}


# ---- calls --------------------------------------------------------------------
def resolve_calls(sites: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """Resolve call sites to declared members by qualified name.

    A callee is ambiguous when several declarations carry its name, counted as rows.
    """
    summary = candidate_summary(targets, ["qualified"], "key", ["kind", "container", "member"])
    joined = sites.withColumnRenamed("kind", "site_kind").join(
        summary.withColumnRenamed("qualified", "callee"), "callee", "left"
    )
    count = F.coalesce("rows", F.lit(0))
    dynamic = F.col("site_kind") == "dynamic"
    reason = (
        F.when(F.col("callee").isNull() & ~dynamic, "call-not-literal")
        .when(dynamic, "call-dynamic-dispatch")
        .when(count == 0, "call-missing-target")
        .when(count > 1, "call-ambiguous-target")
        .when(F.col("only.kind") == "delegate", "call-dynamic-dispatch")
    )
    via_delegate = (reason == "call-dynamic-dispatch") & ~dynamic
    outcomes = joined.select(
        "file", "line", "caller", "callee", "site_kind",
        F.when(reason.isNull(), "resolved").when(count > 1, F.when(dynamic, "unresolved").otherwise("ambiguous"))
        .otherwise("unresolved").alias("status"),
        F.when(reason.isNull(), F.col("low")).alias("target"),
        F.when(reason.isNull(), "exact_static").alias("quality"),
        reason.alias("reason"),
        F.when(via_delegate, F.col("low")).alias("candidate"),
        F.when(reason == "call-ambiguous-target", count).otherwise(F.lit(0)).alias("candidates"),
        F.when(reason.isNull(), F.col("only.kind")).alias("target_kind"),
        F.when(reason.isNull(), F.col("only.container")).alias("container"),
        F.when(reason.isNull(), F.col("only.member")).alias("member"),
    )
    several = summary.where("rows > 1").select("qualified")
    return {
        "outcomes": outcomes,
        "candidates": targets.join(several, "qualified", "left_semi").select("qualified", "key"),
    }


def possible_implementations(outcomes: DataFrame, targets: DataFrame, implements: DataFrame) -> dict[str, DataFrame]:
    """Declared implementations of every interface member that is called.

    ``implementations`` is per called member, so a popular member does not repeat its
    list per call; ``counters`` says how many call sites have no single implementation.
    """
    called = (
        outcomes.where(F.col("target_kind") == "interface_method")
        .groupBy("target", "container", "member")
        .agg(F.count(F.lit(1)).alias("sites"))
    )
    members = targets.groupBy(F.col("container").alias("implementor"), "member").agg(F.min("key").alias("implementation"))
    # each declared fact counts, also a repeated one
    found = (
        called.where(F.col("container").isNotNull())
        .join(implements.withColumnRenamed("interface", "container"), "container")
        .join(members, ["implementor", "member"])
        .select("target", "implementor", "implementation", "sites")
    )
    added = found.groupBy("target").agg(F.count(F.lit(1)).alias("added"))
    counted = called.join(added, "target", "left").withColumn("added", F.coalesce("added", F.lit(0)))
    has_container = F.col("container").isNotNull()
    counters = counted.agg(
        F.coalesce(F.sum(F.when(~has_container | (F.col("added") != 1), F.col("sites"))), F.lit(0)).alias("ambiguous_sets"),
        F.coalesce(F.sum(F.when(has_container, F.col("sites"))), F.lit(0)).alias("unproven_sets"),
    )
    return {"implementations": found, "counters": counters}


# ---- base types ---------------------------------------------------------------
def resolve_bases(types: DataFrame) -> dict[str, DataFrame]:
    """Link base names to declared types, by dotted or simple name.

    A type without a namespace has both names equal and so counts twice under it,
    which makes every reference to it a duplicate.
    """
    dotted = F.when(F.col("namespace") == "", F.col("name")).otherwise(F.concat_ws(".", "namespace", "name"))
    names = types.select(F.explode(F.array(dotted, F.col("name"))).alias("base"), "key", "kind")
    summary = candidate_summary(names, ["base"], "key", ["kind"])
    refs = types.select("key", "file", F.posexplode("bases").alias("position", "base"))
    joined = refs.join(summary, "base", "left")
    count = F.coalesce("rows", F.lit(0))
    linked = count == 1
    reason = (
        F.when(count == 0, "type-base-not-in-project")
        .when(linked, F.lit(None))
        .when(F.col("low") != F.col("high"), "type-base-ambiguous")
        .otherwise("type-duplicate-declaration")
    )
    outcomes = joined.where(~(linked & (F.col("low") == F.col("key")))).select(
        "key", "file", "position", "base",
        F.when(linked, F.col("low")).alias("target"),
        F.when(linked, F.when(F.col("only.kind") == "interface", "IMPLEMENTS").otherwise("INHERITS")).alias("edge_kind"),
        F.when(linked, "exact_static").alias("quality"),
        reason.alias("reason"),
    )
    several = summary.where("rows > 1").select("base")
    return {
        "outcomes": outcomes,
        "candidates": names.select("base", "key").distinct().join(several, "base", "left_semi"),
    }


# ---- containment --------------------------------------------------------------
def containment(declarations: DataFrame) -> DataFrame:
    """Edges from the declaration that opened a scope to those inside it.

    ``declarations(project, file, ordinal, key, semantic_path, name)``; when a scope was
    declared more than once in its file the last one owns its members.
    """
    scope = F.concat(F.array_join("semantic_path", "/"), F.lit("|"), F.coalesce("name", F.lit("")))
    owners = declarations.groupBy("project", "file", scope.alias("scope")).agg(F.max_by("key", "ordinal").alias("parent"))
    depth = F.size("semantic_path")
    parent_scope = F.concat(
        F.array_join(F.slice("semantic_path", F.lit(1), F.greatest(depth - 1, F.lit(0))), "/"),
        F.lit("|"),
        F.get("semantic_path", depth - 1),
    )
    inner = declarations.where(depth > 0).select("project", "file", "ordinal", "key", parent_scope.alias("scope"))
    return inner.join(owners, ["project", "file", "scope"]).select(
        "project", "file", "ordinal", F.col("parent").alias("source_key"), F.col("key").alias("target_key")
    )


# ---- hosts, routes, services --------------------------------------------------
def alias_projects(aliases: DataFrame) -> DataFrame:
    """Hosts that name exactly one project; repeating the same project is fine."""
    return (
        aliases.select(routes.normalize_host(F.col("host")).alias("host"), "project")
        .groupBy("host")
        .agg(F.min("project").alias("project"), F.max("project").alias("_high"))
        .where(F.col("project") == F.col("_high"))
        .drop("_high")
    )


def join_http(endpoints: DataFrame, clients: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Join client requests with declared endpoints through the host aliases.

    Requests are made distinct before they meet templates. A template can only be met by
    a request of its verb, project, segment count (unless it is open-ended) and first
    literal segment, so each request probes four keys of an equi-join and the segment
    comparison runs on what is left.
    """
    hosts = alias_projects(aliases).withColumnRenamed("project", "server_project")
    placed = (
        clients.withColumn("host", routes.host_of(F.col("absolute_url")))
        .withColumn("request_path", routes.request_path(F.col("absolute_url"), F.col("path")))
        .join(hosts, "host", "left")
    )
    requests = placed.where(F.col("server_project").isNotNull()).select("server_project", "verb", "request_path").distinct()
    star = F.lit("*")
    probe = lambda a, b: F.concat(a, F.lit("/"), b)
    first = F.lower(F.coalesce(F.get("given", F.lit(0)), F.lit("")))
    count = F.size("given").cast("string")
    probes = F.array(probe(count, first), probe(count, star), probe(star, first), probe(star, star))
    probed = requests.withColumn("given", routes.route_segments(F.col("request_path"))).withColumn("probe", F.explode(probes))
    shape = routes.route_shape(F.col("template"))
    own = probe(F.coalesce(shape["segments"].cast("string"), star), F.coalesce(shape["head"], star))
    declared = endpoints.select(
        F.col("project").alias("server_project"), "verb", own.alias("probe"),
        routes.route_segments(F.col("template")).alias("wanted"),
        F.struct(F.col("file").alias("server_file"), routes.normalize_route(F.col("template")).alias("endpoint_template")).alias("endpoint"),
    )
    hits = probed.join(declared, ["server_project", "verb", "probe"]).where(
        routes.segments_match(F.col("wanted"), F.col("given"))
    )
    keys = ["server_project", "verb", "request_path"]
    summary = candidate_summary(hits, keys, "endpoint")
    judged = placed.join(summary, keys, "left")
    matched = F.coalesce("rows", F.lit(0))
    pattern = (
        F.when(F.col("host").isNull(), "http-join-relative-client")
        .when(F.col("server_project").isNull(), "http-join-unconfigured-host")
        .when(matched == 0, "http-join-no-route-candidate")
        .when(matched > 1, "http-join-ambiguous-route")
    )
    reason = (
        F.when(F.col("host").isNull(), "unresolved-runtime-base-url")
        .when(F.col("server_project").isNull(), "unresolved-no-configured-alias")
        .when(matched == 0, "unresolved-no-matching-route")
        .when(matched > 1, "unresolved-ambiguous-route-candidate")
    )
    exact = pattern.isNull()
    outcomes = judged.select(
        "project", "file", "line", "verb",
        F.when(F.col("server_project").isNotNull(), F.col("request_path")).alias("request_path"),
        F.when(exact, "resolved").when(matched > 1, "ambiguous").otherwise("unresolved").alias("status"),
        pattern.alias("pattern"),
        reason.alias("reason"),
        "server_project",
        F.when(exact, F.col("low.server_file")).alias("server_file"),
        F.when(exact, F.col("low.endpoint_template")).alias("endpoint_template"),
        matched.alias("candidates"),
    )
    several = summary.where("rows > 1").select(*keys)
    return {
        "outcomes": outcomes,
        "candidates": hits.join(several, keys, "left_semi").select(*keys, "endpoint.server_file", "endpoint.endpoint_template"),
    }


def resolve_service(addresses: DataFrame, aliases: DataFrame) -> DataFrame:
    """Project of a service address: every alias that equals it or is a ``/`` prefix counts."""
    keyed = addresses.withColumn("address_key", routes.normalize_service_key(F.col("address")))
    distinct = keyed.select("protocol", "address_key").distinct()
    prefixes = distinct.withColumn("alias_key", F.explode(routes.address_prefixes(F.col("address_key"))))
    declared = aliases.select("protocol", routes.normalize_service_key(F.col("alias_key")).alias("alias_key"), "project")
    summary = (
        prefixes.join(declared, ["protocol", "alias_key"])
        .groupBy("protocol", "address_key")
        .agg(F.min("project").alias("low"), F.max("project").alias("high"))
    )
    status = F.when(F.col("low").isNull(), "unresolved").when(F.col("low") == F.col("high"), "resolved").otherwise("ambiguous")
    return keyed.join(summary, ["protocol", "address_key"], "left").select(
        *addresses.columns, "address_key", status.alias("status"), F.when(status == "resolved", F.col("low")).alias("project")
    )


# ---- topics -------------------------------------------------------------------
def link_topics(bindings: DataFrame, owners: DataFrame) -> dict[str, DataFrame]:
    """Link producers and consumers of topics that have exactly one owner.

    ``sides`` holds the distinct projects of every linked topic with their role and is what
    scales: a link is a producer and another consumer of one topic. ``links`` spells the
    pairs out, over distinct projects, as the result of the join.
    """
    owned = (
        owners.groupBy("topic")
        .agg(F.min("project").alias("topic_project"), F.max("project").alias("_high"))
        .where(F.col("topic_project") == F.col("_high"))
        .drop("_high")
    )
    known = bindings.join(owned, "topic", "left")
    unlinked = known.where(F.col("topic_project").isNull()).select(
        "project", "file", "line", "role", "topic", F.lit("unresolved-topic-not-configured").alias("reason")
    )
    sides = known.where(F.col("topic_project").isNotNull()).select("topic", "topic_project", "role", "project").distinct()
    counts = sides.groupBy("topic").agg(
        F.count_if(F.col("role") == "producer").alias("producers"), F.count_if(F.col("role") == "consumer").alias("consumers")
    )
    complete = counts.where("producers > 0 AND consumers > 0").withColumn(
        "quality",
        F.when((F.col("producers") == 1) & (F.col("consumers") == 1), "exact_static").otherwise("inferred_static"),
    )
    linked = sides.join(complete, "topic")
    producers = linked.where("role = 'producer'").withColumnRenamed("project", "producer_project")
    consumers = linked.where("role = 'consumer'").select("topic", F.col("project").alias("consumer_project"))
    links = producers.join(consumers, "topic").where(F.col("producer_project") != F.col("consumer_project"))
    return {
        "sides": linked.select("topic", "topic_project", "role", "project", "quality", "producers", "consumers"),
        "links": links.select("topic", "topic_project", "producer_project", "consumer_project", "quality"),
        "unlinked": unlinked,
        "unmatched": counts.where("producers = 0 OR consumers = 0").select("topic"),
    }


# ---- annotations --------------------------------------------------------------
def merge_annotations(facts: DataFrame, annotations: DataFrame) -> dict[str, DataFrame]:
    """Merge human annotations into generated facts.

    The first generated fact of a pair, or else its first annotation, defines the pair's
    relation. An annotation that agrees confirms that edge; one that does not is a
    contradiction and changes nothing. ``facts(from_id, to_id, relation, pattern, quality,
    ordinal)``, ``annotations(ordinal, from_id, to_id, relation, source, version)``.
    """
    pair = ["from_id", "to_id"]
    rows = facts.select(*pair, F.lit(0).alias("rank"), "ordinal", "relation", "pattern", "quality").unionByName(
        annotations.select(
            *pair, F.lit(1).alias("rank"), "ordinal", "relation", F.lit(None).cast("string").alias("pattern"),
            F.lit("exact_static").alias("quality"),
        )
    )
    defining = rows.groupBy(*pair).agg(
        F.min_by(F.struct("rank", "ordinal", "relation", "pattern", "quality"), F.struct("rank", "ordinal")).alias("def")
    )
    judged = annotations.join(defining, pair)
    agrees = F.col("relation") == F.col("def.relation")
    confirmations = judged.where(agrees).select(*pair, "ordinal", "source", "version")
    contradictions = judged.where(~agrees).select(
        *pair, "ordinal", "relation", "source", "version", F.col("def.relation").alias("generated_relation"),
        F.coalesce("def.pattern", F.lit("generated")).alias("generated_pattern"),
    )
    counts = confirmations.groupBy(*pair).agg(F.count(F.lit(1)).alias("confirmed"))
    added = defining.where("def.rank = 1").select(*pair, "def.*")
    edges = (
        facts.select(*pair, F.lit(0).alias("rank"), "ordinal", "relation", "pattern", "quality")
        .unionByName(added.select(*pair, "rank", "ordinal", "relation", "pattern", "quality"))
        .join(defining.select(*pair, F.struct("def.rank", "def.ordinal").alias("first")), pair)
        .join(counts, pair, "left")
    )
    is_first = F.struct("rank", "ordinal") == F.col("first")
    return {
        "edges": edges.select(
            *pair, "ordinal", "relation", "pattern", "quality",
            F.when(is_first, F.coalesce("confirmed", F.lit(0))).otherwise(F.lit(0)).alias("annotations"),
        ),
        "confirmations": confirmations,
        "contradictions": contradictions,
    }
