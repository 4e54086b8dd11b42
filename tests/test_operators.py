"""Operators against brute force, plus their refusals and invariants."""

import os
import random
from collections import deque

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relgraph.operators import backlog, graph, inventory, ordered, packing, publish, reconcile, resolve, snapshots
from tests.helpers import rows

NODE = "id string, project_id string, kind string, name string, qualified_name string, language string, file string, start_line long, end_line long"
EDGE = "id string, source_id string, target_id string, unresolved_target string, target_project_id string, kind string, resolution string, analyzer_id string, file string, start_line long, end_line long"


def small_graph(spark, seed=1, nodes=30, edges=70):
    rng = random.Random(seed)
    ns = [(f"n{i:02d}", "p", "Class", f"C{i}", f"A.C{i}", "csharp", "f.cs", i, i) for i in range(nodes)]
    es = [
        (f"e{i:03d}", f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}", None, "p", "CALLS", "exact_static", "x", "f.cs", 1, 1)
        for i in range(edges)
    ]
    return ns, es, spark.createDataFrame(ns, NODE), spark.createDataFrame(es, EDGE)


def queue_walk(edges, start, depth):
    """Breadth-first by a queue; returns nodes in discovery order and the last-one-wins flag."""
    seen, found, flag, queue = {start}, [], False, deque([(start, 0)])
    by_id = sorted(edges)
    while queue:
        current, d = queue.popleft()
        for e in by_id:
            if (e[2] or e[3]) != current or e[1] in seen:
                continue
            seen.add(e[1])
            found.append(e[1])
            if d + 1 < depth:
                queue.append((e[1], d + 1))
            elif d + 1 == depth:
                flag = any((c[2] or c[3]) == e[1] for c in by_id)
    return found, flag


@pytest.mark.parametrize("seed,depth", [(1, 1), (2, 2), (3, 3), (4, 6), (5, 2)])
def test_impact_matches_a_queue_walk(spark, seed, depth):
    ns, es, nodes, edges = small_graph(spark, seed, nodes=25, edges=30)
    found, flag = queue_walk(es, "n03", depth)
    out = graph.impact(nodes, edges, "n03", graph.Limits(1_000_000, 4096, depth))
    got = [r.id for r in out["records"].orderBy("rn").collect()]
    want = [e[0] for e in sorted(es) if e[1] in found] + found
    assert got == want
    assert ("depth-limit" in out["envelope"].first().reasons) == flag


def test_limits_are_refused_not_clamped():
    for bad in ({"max_bytes": 100}, {"max_nodes": 0}, {"depth": 7}, {"max_nodes": 5000}, {"depth": 0}):
        with pytest.raises(ValueError, match="limit-unbounded"):
            graph.Limits(**bad)


def test_unknown_symbols(spark):
    _, _, nodes, edges = small_graph(spark)
    with pytest.raises(graph.SymbolNotFound):
        graph.context(nodes, edges, "nothing")
    with pytest.raises(graph.SymbolNotFound):
        graph.impact(nodes, edges, "nothing")


def test_exact_projection_with_no_edges(spark):
    _, _, nodes, edges = small_graph(spark)
    ids = nodes.select("id")
    assert graph.project_graph(nodes, edges, ids, None, exact=True)["edges"].count() == 0
    with pytest.raises(ValueError):
        graph.project_graph(nodes, edges, None)


def test_dependents_leave_out_roots_on_cycles(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "target string, dependent string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.dependents(deps, roots), "id") == [("b",), ("c",)]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_ordered_helpers_equal_plain_windows(spark, width):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", s, rng.choice([None, 1, 2, 3])) for s in range(300)]
    df = spark.createDataFrame(data, "k string, seq long, v long").repartition(5)
    w = W.partitionBy("k").orderBy("seq")
    chunk = ordered.number_chunks("seq", width)
    want = df.withColumn("r", F.row_number().over(w)).withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(w)).withColumn("p", F.lag("seq").over(w))
    want = want.withColumn("l", F.last("v", ignorenulls=True).over(w)).withColumn("b", F.last("v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    got = ordered.rank_in_order(df, ["k"], ["seq"], chunk, "r")
    got = ordered.running_sum(got.withColumn("z", F.coalesce("v", F.lit(0))), ["k"], ["seq"], chunk, "z", "s")
    got = ordered.lag_in_order(got, ["k"], ["seq"], chunk, ["seq"], "q").withColumn("p", F.col("q.seq"))
    got = ordered.last_in_order(got, ["k"], ["seq"], chunk, F.col("v"), "l", True)
    got = ordered.last_in_order(got, ["k"], ["seq"], chunk, F.col("v"), "b", False)
    columns = ("k", "seq", "r", "s", "p", "l", "b")
    assert rows(got, *columns) == rows(want, *columns)


def test_range_chunks_keep_order_and_ties(spark):
    df = spark.createDataFrame([(f"path/{i % 97:03d}",) for i in range(3000)], "f string")
    chunked = df.withColumn("c", ordered.range_chunks(df, "f", 8)).groupBy("f").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).orderBy("f").collect()
    assert all(r.lo == r.hi for r in chunked)
    assert [r.lo for r in chunked] == sorted(r.lo for r in chunked)
    assert len({r.lo for r in chunked}) > 4


def test_tree_digest_depends_only_on_the_set(spark):
    data = [("p", f"f{i}", f"h{i}") for i in range(500)]
    df = spark.createDataFrame(data, "project_id string, path string, content_hash string")
    group, columns = ["project_id"], ["path", "content_hash"]
    digest = lambda d: rows(inventory.ordered_digest(d, group, columns))
    assert digest(df.repartition(1)) == digest(df.repartition(6).orderBy(F.rand(1))) == digest(df.unionByName(df))
    # stored leaves: only those of a changed row differ, and the digest is that of all rows
    other = df.withColumn("content_hash", F.when(F.col("path") == "f7", "new").otherwise(F.col("content_hash")))
    before, after = (inventory.digest_leaves(d, group, columns) for d in (df, other))
    assert before.exceptAll(after).count() <= 2 and rows(inventory.digest_of(after, group)) == digest(other)
    assert digest(df) != digest(df.where("path <> 'f7'"))


def test_incremental_equals_full(spark):
    """Replacing files in several batches gives what one batch gives."""
    node = "project_id string, id string, owner_file string, qualified_name string"
    edge = "project_id string, id string, owner_file string, source_id string, target_project_id string, target_id string, unresolved_target string, resolution string"
    file = "project_id string, path string, desired_generation long, indexed_generation long, indexed_hash string"
    nodes = spark.createDataFrame([("p", f"n{i}", f"f{i % 4}", f"Q{i}") for i in range(12)], node)
    edges = spark.createDataFrame([("p", f"e{i}", f"f{i % 4}", f"n{i}", "p", f"n{(i * 4) % 12}" if i % 4 == 0 else f"n{i}", None, "exact_static") for i in range(12)], edge)
    files = spark.createDataFrame([("p", f"f{i}", 2, 1, None) for i in range(4)], file)

    def step(state, names):
        done = spark.createDataFrame([("p", n, 2, "h") for n in names], "project_id string, owner_file string, generation long, hash string")
        fresh_n = spark.createDataFrame([("p", f"new-{n}", n, "New") for n in names], node)
        fresh_e = spark.createDataFrame([("p", f"ne-{n}", n, f"new-{n}", "p", f"new-{n}", None, "exact_static") for n in names], edge)
        return inventory.replace_facts(state["nodes"], state["edges"], state["files"], done, fresh_n, fresh_e)

    start = {"nodes": nodes, "edges": edges, "files": files}
    once = step(start, ["f0", "f1", "f2"])
    many = step(step(step(start, ["f2"]), ["f0"]), ["f1"])
    for part in ("nodes", "edges", "files"):
        assert rows(once[part]) == rows(many[part])


def test_stale_ack_leaves_the_file_dirty(spark):
    files = spark.createDataFrame([("p", "f", 3, 1, None)], "project_id string, path string, desired_generation long, indexed_generation long, indexed_hash string")
    none_n = spark.createDataFrame([], "project_id string, id string, owner_file string, qualified_name string")
    none_e = spark.createDataFrame([], "project_id string, id string, owner_file string, source_id string, target_project_id string, target_id string, unresolved_target string, resolution string")
    done = spark.createDataFrame([("p", "f", 2, "h")], "project_id string, owner_file string, generation long, hash string")
    out = inventory.replace_facts(none_n, none_e, files, done, none_n, none_e)
    assert rows(out["files"]) == [("p", "f", 3, 1, None)]


def test_acks_are_judged_where_they_stand(spark):
    """Mark, mark, acknowledge 2, mark: 2 was applied, and the project is dirty again."""
    marks = spark.createDataFrame([("p", 1), ("p", 2), ("p", 4)], "project_id string, seq long")
    acks = spark.createDataFrame([("p", 3, 2), ("p", 5, 2), ("p", 6, 4), ("q", 1, 1)], "project_id string, seq long, generation long")
    out = backlog.dirty_generations(marks, acks, chunk_width=2)
    assert rows(out["state"]) == [("p", 3, 2, True)]
    assert [a.verdict for a in out["acks"].orderBy("project_id", "seq").collect()] == ["applied", "superseded", "invalid", "invalid"]


def test_renames_pair_by_name_then_by_order(spark):
    data = [("p", 1, i, path, kind) for i, (path, kind) in enumerate([
        ("old/A.cs", "renamed_from"), ("b.cs", "renamed_from"), ("B.CS", "renamed_to"), ("c.cs", "renamed_to"), ("d.cs", "renamed_to")])]
    hints = spark.createDataFrame(data, "project_id string, flush_id long, seq long, path string, kind string")
    pairs = lambda fold: [(p.path, p.origin, p.case_only) for p in reconcile.pair_renames(hints, fold).first().pairs]
    assert pairs(True) == [("B.CS", "b.cs", True), ("c.cs", "old/A.cs", False), ("d.cs", None, False)]
    assert pairs(False) == [("B.CS", "old/A.cs", False), ("c.cs", "b.cs", False), ("d.cs", None, False)]


def test_an_oversized_flush_asks_for_a_scan(spark):
    hints = spark.range(5000).select(
        F.lit("p").alias("project_id"), F.lit(1).cast("long").alias("flush_id"), F.col("id").alias("seq"), F.lit("a.cs").alias("path"), F.lit("modified").alias("kind"))
    flags = spark.createDataFrame([], "project_id string, flush_id long, overflowed boolean, sticky_reason string")
    known = spark.createDataFrame([("p", "a.cs")], "project_id string, path string")
    got = reconcile.reconcile_decision(hints, known, flags)["decisions"].first()
    assert (got.outcome, got.trigger, got.reason) == ("full_scan", "save_all_burst", "buffer_overflow")


def test_boundary_links_and_case_only_renames_bound_the_rescan(spark):
    hints = spark.createDataFrame(
        [("p", 1, 0, "A.cs", "renamed_from"), ("p", 1, 1, "a.cs", "renamed_to"), ("p", 2, 2, "l.cs", "modified"), ("p", 2, 3, "k.cs", "modified")],
        "project_id string, flush_id long, seq long, path string, kind string")
    flags = spark.createDataFrame([], "project_id string, flush_id long, overflowed boolean, sticky_reason string")
    known = spark.createDataFrame([("p", "a.cs"), ("p", "k.cs"), ("p", "l.cs")], "project_id string, path string")
    links = spark.createDataFrame([("p", "l.cs", "/etc/x")], "project_id string, path string, target string")
    out = reconcile.reconcile_decision(hints, known, flags, links, "/repo", case_insensitive=True)
    got = {r.flush_id: (r.outcome, r.trigger) for r in out["decisions"].collect()}
    assert got == {1: ("bounded_rescan", "case_only_rename"), 2: ("bounded_rescan", "symlink_boundary")}
    assert rows(out["rescans"], "flush_id", "path") == [(1, "a.cs"), (2, "l.cs")]


def test_record_over_the_cap_is_reported(spark):
    records = spark.createDataFrame([("a", "x" * 50), ("b", "y" * 5)], "key string, line string")
    out = packing.pack_shards(records, 20, 4)
    assert rows(out["too_large"], "key", "bytes") == [("a", 51)]
    assert rows(out["plan"], "key", "part") == [("b", 0)]
    assert packing.pack_shards(records.limit(0), 20, 4)["plan"].count() == 0


@pytest.mark.parametrize("cap, chunk_bits", [(40, 3), (40, 18), (300, 2), (10_000, 3)])
def test_parts_of_one_bucket_over_many_tasks(spark, cap, chunk_bits):
    """One bucket of many records, cut into chunks far smaller and far larger than a part."""
    values = random.Random(cap)
    data = [(role, f"k{i:04d}", "x" * values.randrange(40)) for role in ("nodes", "edges") for i in range(400)]
    df = spark.createDataFrame(data, "role string, key string, line string").repartition(5)
    out = packing.pack_shards(df, cap, 1, by=["role"], carry=["line"], chunk_bits=chunk_bits)["plan"]
    want, at = [], {}
    for role, key, line in sorted(data):
        part, filled = at.get(role, (0, 0))
        part, filled = (part + 1, 0) if filled and filled + len(line) + 1 > cap else (part, filled)
        at[role] = (part, filled + len(line) + 1)
        want.append((role, key, line, part, "bucket-000" + (f"/part-{part:03d}" if part else "")))
    assert rows(out, "role", "key", "line", "part", "shard") == sorted(want, key=repr)


def test_ranks_in_ranges(spark):
    data = [(None if i % 3 else "k", 7 if i % 2 else None, i) for i in range(300)]
    df = spark.createDataFrame(data, "key string, at int, id int").repartition(6)
    got = {r.id: r.rank for r in ordered.rank_in_ranges(df, ["key"], ["at", "id"]).collect()}
    for key in (None, "k"):
        ids = sorted((i for k, _, i in data if k == key), key=lambda i: (i % 2 == 1, i))
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_occurrence_ranks_ignore_partitioning(spark):
    data = [(f"id{i:03d}", "p", "class", "A.Same" if i % 3 else "A.Other", "csharp", f"f{i % 50:02d}.cs", i) for i in range(200)]
    df = spark.createDataFrame(data, "id string, project_id string, kind string, qualified_name string, language string, owner_file string, start_line long")
    key = lambda d: rows(publish.occurrence_suffix(d), "id", "published_key")
    assert key(df.repartition(1)) == key(df.repartition(9).orderBy(F.rand(2)))


def test_namespace_free_type_is_always_a_duplicate(spark):
    types = spark.createDataFrame([("k1", "f", "", "Base", "class", []), ("k2", "f", "N", "D", "class", ["Base", "N.D", "Gone"])],
                                  "key string, file string, namespace string, name string, kind string, bases array<string>")
    assert rows(resolve.resolve_bases(types)["outcomes"], "base", "reason") == [("Base", "type-duplicate-declaration"), ("Gone", "type-base-not-in-project")]


def test_a_later_annotation_sees_an_earlier_one(spark):
    facts = spark.createDataFrame([], "from_id string, to_id string, relation string, pattern string, quality string, ordinal long")
    notes = spark.createDataFrame([(1, "a", "b", "CALLS", "me", "1"), (2, "a", "b", "READS", "you", "1"), (3, "a", "b", "CALLS", "we", "2")],
                                  "ordinal long, from_id string, to_id string, relation string, source string, version string")
    out = resolve.merge_annotations(facts, notes)
    assert rows(out["edges"], "from_id", "relation", "annotations") == [("a", "CALLS", 2)]
    assert rows(out["contradictions"], "ordinal", "generated_relation", "generated_pattern") == [(2, "CALLS", "generated")]


@pytest.mark.parametrize("hub_steps", [1, 3, 1000])
def test_reach_splits_hubs(spark, hub_steps):
    steps = [("hub", f"n{k}") for k in range(40)] + [(f"n{k}", f"m{k % 5}") for k in range(40)] + [("m1", "hub"), (None, "x"), ("m2", None), ("hub", "n1")]
    frame = spark.createDataFrame(steps, "from_id string, to_id string")
    roots = spark.createDataFrame([("hub",), ("absent",)], "id string")
    got = {(r.id, r.depth) for r in graph.reach(frame, roots, hub_steps=hub_steps).collect()}
    assert got == {("hub", 0), ("absent", 0)} | {(f"n{k}", 1) for k in range(40)} | {(f"m{k}", 2) for k in range(5)}


def test_stored_steps_move_the_frontier_only_and_are_removed(spark, tmp_path):
    frame = spark.createDataFrame([(f"a{k}", f"b{k}") for k in range(50)], "from_id string, to_id string")
    level = spark.createDataFrame([("a1", 0)], "id string, depth int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with graph.adjacency(frame) as (stored, hubs):
            hop = graph._hop(stored, hubs, level)
            plan = hop._jdf.queryExecution().sparkPlan().toString() + hop._jdf.queryExecution().executedPlan().toString()
            assert hubs is None and hop.count() == 1
            assert plan.count("Exchange hashpartitioning") == 1
            name, path = stored.inputFiles()[0].rsplit("/", 2)[1], stored.inputFiles()[0].rsplit("/", 1)[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not spark.catalog.tableExists(name) and not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
