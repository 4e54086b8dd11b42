"""What moves, and what is written, by operators over whole graphs; results beside plain forms of them."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.helpers import rows
from relgraph import session
from relgraph.extract import scopes
from relgraph.operators import graph, ordered, packing, publish
from relgraph.plans import load, registry
from relgraph.sources import snapshots

NODES = "id string, project_id string, kind string, name string, qualified_name string, language string, file string, start_line long, end_line long"
EDGES = ("id string, project_id string, source_id string, target_id string, unresolved_target string, target_project_id string, kind string, "
         "resolution string, analyzer_id string, file string, start_line long, end_line long")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_a_symbol_are_found_without_a_shuffle(spark):
    nodes = spark.createDataFrame([("a:1", "p", "Class", "A", "N.A", "cs", "a.cs", 1, 2), ("b:1", "p", "Class", "B", None, "cs", "b.cs", 1, 2)], NODES)
    edge = lambda i, s, t, u: (i, "p", s, t, u, "p", "CALLS", "exact_static", "x", "a.cs", 1, 1)
    edges = spark.createDataFrame([edge("1", "a:1", "b:1", None), edge("2", "b:1", "a:1", None), edge("2", "b:1", "a:1", None), edge("3", "a:1", "a:1", None),
                                   edge("4", "b:1", None, "N.A"), edge("5", "b:1", None, None), edge("6", None, "b:1", None), edge("7", None, None, "N.A")], EDGES)
    held, joined = (graph.context_candidates(nodes, edges, "N.A", n) for n in (200_000, 0))
    assert "Exchange hashpartitioning" not in plan(held) and "Exchange RoundRobin" not in plan(held)
    assert rows(held, "phase", "role", "id") == rows(joined, "phase", "role", "id")
    assert [r[2] for r in rows(held, "phase", "role", "id")] == ["a:1", "1", "2", "2", "3", "4", "7"]


def test_projections_are_not_stored_and_stored_rows_lie_in_pieces(spark, sf_dir, monkeypatch):
    load()
    assert not registry.STORED & {"nodes", "pub_nodes", "pub_edges", "shared_nodes", "cs_source", "ts_source", "minimal_source"}
    monkeypatch.setattr(registry, "FILE_ROWS", 40)
    monkeypatch.setattr(registry, "_written", {})
    stored = registry.rows(spark, sf_dir, "npm_source")
    assert len(stored.inputFiles()) == 5 and stored.count() == 200


def test_references_of_equal_edges_and_of_ids_in_two_projects(spark):
    nodes = spark.createDataFrame(
        [("t", "p", "N.T"), ("u", "p", "N.T"), ("t", "q", "N.T"), ("s", "p", "S"), ("s", "q", "S"), ("v", "p", "V"), ("w", "p", None), ("w", "p", None)],
        "id string, project_id string, qualified_name string")
    edge = "id string, source_id string, kind string, resolution string, target_id string, unresolved_target string, target_project_id string"
    edges = spark.createDataFrame(
        [("1", "s", "c", "r", "t", None, "p"), ("1", "s", "c", "r", "t", None, "q"), ("2", "s", "c", "r", None, "N.T", "p"), ("2", "s", "c", "r", None, "N.T", "p"),
         ("3", "s", "c", "r", "v", "V", "p"), ("4", "v", "c", "r", "w", "N.T", "p"), ("5", "x", "c", "r", "t", None, "p"), ("6", "s", None, None, "u", "N.T", "p")], edge)
    files = spark.createDataFrame([("p", 1, 0), ("q", 1, 0)], "project_id string, total_files long, pending_files long")
    targets = spark.createDataFrame([(i,) for i in "tuvw"], "id string")
    got = graph.incoming_references(nodes, edges, files, targets)["references"].select(
        "node_id", "edge_id", "source_id", "kind", "resolution", "target_id", "unresolved_target", "source_project_id")
    nodes.createOrReplaceTempView("ref_n"), edges.createOrReplaceTempView("ref_e")
    want = spark.sql("""SELECT d.*, s.project_id FROM (SELECT DISTINCT n.id AS node_id, e.id, e.source_id, e.kind, e.resolution, e.target_id, e.unresolved_target
        FROM ref_e e JOIN ref_n n ON e.target_project_id = n.project_id AND (e.target_id = n.id OR e.unresolved_target = n.qualified_name) WHERE n.id IN ('t', 'u', 'v', 'w')) d
        JOIN ref_n s ON s.id = d.source_id""")
    assert rows(got) == rows(want) and got.count() > 10


def test_references_by_name_are_not_moved_after_they_are_spelled_out(spark):
    nodes = spark.createDataFrame([(f"t{i}", "p", "N.T") for i in range(300)] + [("s", "p", "S")], "id string, project_id string, qualified_name string")
    edges = spark.createDataFrame([(f"e{i}", "s", "c", "r", None, "N.T", "p") for i in range(200)],
                                  "id string, source_id string, kind string, resolution string, target_id string, unresolved_target string, target_project_id string")
    files = spark.createDataFrame([("p", 1, 0)], "project_id string, total_files long, pending_files long")
    out = graph.incoming_references(nodes, edges, files, nodes.select("id"))["references"]
    assert out.count() == 60_000
    spelled = next(line for line in plan(out).splitlines() if "Join" in line and "_slice" in line)
    above = plan(out).split(spelled)[0].splitlines()
    depth = len(spelled) - len(spelled.lstrip(" :+-"))
    over = [line for line in above if len(line) - len(line.lstrip(" :+-")) < depth]
    assert not any("Exchange" in line or "Aggregate" in line for line in over)


@pytest.mark.parametrize("pieces", [1, 3, 7])
def test_ranks_over_ranges_move_rows_once(spark, pieces):
    keys = [None, "a", "b"]
    given = [(keys[i % 3] if i % 5 else "a", 7 if i % 4 else None, i % 9, i) for i in range(400)]
    df = spark.createDataFrame(given, "k string, m int, at int, id int")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    try:
        ranked = ordered.rank_in_ranges(df, ["k", "m"], ["at", "id"])
        rows_side = plan(ranked).split("BroadcastExchange")[0]
        assert "BroadcastHashJoin" in rows_side and "hashpartitioning" not in rows_side and "SortMergeJoin" not in rows_side
        want = df.withColumn("rank", F.row_number().over(W.partitionBy("k", "m").orderBy(F.col("at").asc_nulls_first(), "id")))
        assert rows(ranked, "id", "rank") == rows(want, "id", "rank")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_tasks_of_ordered_lines_grow_with_the_text(spark, monkeypatch):
    files = spark.createDataFrame([("p", f"f{i}", "x\n" * 500) for i in range(64)], "project string, path string, content string")
    monkeypatch.setattr(scopes, "TEXT_BYTES", 2000, raising=False)
    found = scopes.lines(files, ordered=True)
    assert found.rdd.getNumPartitions() == 32 and found.count() == 64 * 501


STEPS = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a"), ("x", "y"), (None, "b"), ("b", None)]


@pytest.mark.parametrize("held", [0, 1, 2, 1000])
def test_walks_find_steps_of_a_level_where_they_lie(spark, held, monkeypatch):
    """Steps are stored in buckets for levels of more than ``held`` ids only; what is found is the same."""
    made = []
    kept = graph.adjacency
    monkeypatch.setattr(graph, "adjacency", lambda *a: made.append(1) or kept(*a))
    steps = spark.createDataFrame([(s, t, f"{s}{t}") for s, t in STEPS], "from_id string, to_id string, edge string")
    roots = spark.createDataFrame([("a",)], "id string")
    found = graph.reach(steps, roots, with_path=True, held=held)
    assert rows(found, "id", "depth", "path") == [("a", 0, ()), ("b", 1, ("ab",)), ("c", 1, ("ac",)), ("d", 2, ("ac", "cd"))]
    assert len(made) == (held < 2)
    moved = plan(graph.near(steps, "from_id", roots))
    assert "Exchange hashpartitioning(from_id" not in moved and "BroadcastHashJoin" in moved


def test_buckets_of_steps_grow_with_the_steps(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUCKET_STEPS", 100)
    steps = spark.range(1000).selectExpr("cast(id AS string) AS from_id", "cast(id + 1 AS string) AS to_id")
    with graph.adjacency(steps) as (stored, _):
        made = int(next(r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {stored.inputFiles()[0].split('/')[-2]}").collect() if r.col_name == "Num Buckets"))
    assert made == 10


def test_one_edge_of_each_id_moves_no_column_behind_the_wanted_ones(spark):
    edges = spark.createDataFrame([("1", "b", "s", "t", "z"), ("1", "a", "u", None, "y"), ("1", "a", None, "t", "x"), ("2", None, "s", "t", "x"), (None, "a", "s", "t", "x")],
                                  "id string, owner_file string, source_id string, target_id string, kind string")
    whole, some = publish.dedup_edges(edges), publish.dedup_edges(edges, ["source_id", "id"])
    assert rows(some) == rows(whole, "source_id", "id") and rows(some, "id", "source_id") == [("1", None), ("2", "s"), (None, "s")]
    assert "target_id" not in plan(some).split("Exchange")[1].splitlines()[0] and rows(publish.dedup_edges(edges, ["id"])) == [("1",), ("2",), (None,)]


def test_completed_edges_are_counted_without_their_sources(spark):
    nodes = spark.createDataFrame([("a", "p", "Class", "A", "N.A"), ("a", "q", "Method", "B", None), ("b", "p", "Class", "B", None), ("unresolved:2d711642b726b044", "p", "Class", "X", None)],
                                  "id string, project_id string, kind string, name string, qualified_name string")
    shape = ("id string, project_id string, source_id string, target_id string, unresolved_target string, target_project_id string, kind string, resolution string")
    edge = lambda i, s, t, u=None, r="exact_static", p="p": (i, p, s, t, u, "p", "calls", r)
    given = [edge("1", "a", "b"), edge("1", "a", "b", r="Exact_Static"), edge("2", "gone", "b"), edge("2", "gone", "b", p="q"), edge("3", "a", "lost"), edge("4", None, None, "N.T"),
             edge("5", "a", "b", "N.T", "unresolved"), edge("6", "", None), edge(None, "gone", "lost")]
    for more in ([], [edge("7", "x", "b"), edge("7", "unresolved:2d711642b726b044", "b")]):  # sha256 of x: both are one edge afterwards
        done = publish.complete_placeholders(nodes, spark.createDataFrame(given + more, shape))
        kinds = ["kind", "resolution", "target_kind"]
        assert rows(done["edge_kinds"], *kinds) == rows(done["edges"], *kinds)
        assert done["edges"].count() == 8 + bool(more)
        assert done["absent"].first()[0] == 5 + bool(more)
        assert rows(done["nodes"].where("placeholder"), "name", "placeholder_reason", "projects") == [
            ("", "unresolved-target", 1), ("N.T", "unresolved-target", 1), ("gone", "source-node-absent", 2), ("lost", "target-node-absent", 1)]
        assert rows(done["nodes"].where("id = 'a'"), "kind", "name", "projects") == [("Class", "A", 2)]
    assert "source_id" not in "".join(line for line in plan(publish.graph_summary(done["nodes"], publish.complete_placeholders(
        nodes, spark.createDataFrame(given, shape))["edge_kinds"])["counts"].select("edges", "placeholder_edges")).splitlines() if "SortMergeJoin" in line)


def test_rows_read_once_are_not_stored_and_dealt_tables_move_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(registry, "_written", {})
    load().QUERIES["u5_union_shards"](spark, sf_dir).count()
    assert not registry._written
    read = plan(registry.rows(spark, sf_dir, "edges", once=True).where("id LIKE 'e4:%'").select("id"))
    assert "hashpartitioning(l_partkey" in read and "hashpartitioning(l_orderkey" not in read
    assert rows(registry.rows(spark, sf_dir, "edges", once=True)) == rows(registry.rows(spark, sf_dir, "edges"))


def test_a_generation_leaves_no_lines_beside_its_own(spark, tmp_path, monkeypatch):
    kept = tmp_path / "shared"
    monkeypatch.setattr("relgraph.session.shared_dir", lambda spark: str(kept))
    nodes = spark.range(300).selectExpr("concat('n', id) AS id", "repeat('x', 1000) AS kind")
    edges = spark.range(300).selectExpr("concat('e', id) AS id", "'n1' AS source_id")
    generation = snapshots.write_generation(nodes, edges, str(tmp_path / "root"), "p", 1, buckets=2, max_bytes=5000)
    assert sum(f.stat().st_size for f in kept.rglob("*") if f.is_file()) < 100_000
    found = snapshots.read_snapshot(spark, str(tmp_path / "root"), {"p": generation}, {"nodes": "id string, kind string", "edges": "id string, source_id string"})
    assert rows(found["nodes"]) == rows(nodes) and rows(found["edges"]) == rows(edges)


def test_parts_are_numbered_without_their_lines_in_python(spark):
    """Only sizes go to Python; a chunk of wide rows would be held there several times over."""
    records = spark.createDataFrame([(f"k{i}", "x" * 30) for i in range(50)], "key string, line string")
    plan = packing.pack_shards(records, 100, 2, carry=["line"])["plan"]
    steps = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    in_python = [s for s in steps if "InArrow" in s]
    assert in_python and not [s for s in in_python if "line#" in s]


def test_tables_of_large_rows_have_small_row_groups(spark, tmp_path):
    """Compression makes a row group of default size hold gigabytes of equal-looking text, which a reader takes in thousands of rows at once."""
    texts = spark.range(0, 600, 1, 1).select(F.repeat(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("\n")), 1000).alias("text"))
    stored = session.compressed(texts, str(tmp_path / "parts"), session.SMALL_GROUP >> 4)
    files = [pq.ParquetFile(p) for p in (tmp_path / "parts").glob("part-*")]
    assert max(f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)) < 300
    assert sorted(r.text for r in stored.collect()) == sorted(r.text for r in texts.collect())


def test_edge_locators_move_edges_once(spark):
    edges = spark.createDataFrame([("a", "f", "t", "calls"), ("b", "f", "t", "calls"), ("b", "f", "u", "calls"), (None, "f", "t", "calls")],
                                  "key string, from_id string, to_id string, relation string")
    shards = spark.createDataFrame([("a", 1, "s1"), ("a", 2, "s2"), (None, 3, "s3")], "key string, bucket int, shard string")
    out = publish.edge_locators(edges, shards, complete=True)
    assert rows(out["locators"], "key", "to_id", "bucket", "shard", "complete") == [("a", "t", 1, "s1", True), ("a", "t", 2, "s2", True)]
    assert sorted(map(str, rows(out["missing"], "key"))) == ["('b',)", "('b',)", "(None,)"]
    assert sorted(map(str, rows(out["both"], "key", "found", "complete"))) == [
        "('a', True, True)", "('a', True, True)", "('b', False, None)", "('b', False, None)", "(None, False, None)"]
    logical = out["both"]._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Join") == 1


def test_completed_edges_move_once_for_each_end(spark):
    nodes = spark.createDataFrame([("a", "p", "Class", "A", None), ("=b", "p", "Class", "B", None)], "id string, project_id string, kind string, name string, qualified_name string")
    edges = spark.createDataFrame([("1", "p", "a", "=b", None, "p", "calls", "annotated"), ("1", "p", "a", "=b", None, "p", "CALLS", "Annotated"), ("2", "p", "a", "b", None, "p", "other", "odd"),
                                   ("3", "p", "a", None, "N.X", "p", "", None), (None, "p", None, None, None, None, None, "unresolved"), (None, "p", None, None, None, None, None, "unresolved")],
                                  "id string, project_id string, source_id string, target_id string, unresolved_target string, target_project_id string, kind string, resolution string")
    done = publish.complete_placeholders(nodes, edges)["edges"]
    got = {r.id: (r.target_kind, r.unresolved_target, r.kind, r.vocabulary, r.resolution) for r in done.collect()}
    assert done.count() == 4 and got == {
        "1": ("resolved", None, "CALLS", "frozen", "annotated"), "2": ("placeholder", None, "other", "extension", "unknown"),
        "3": ("placeholder", "N.X", "unknown", "extension", "unknown"), None: ("placeholder", "", "unknown", "extension", "unresolved")}
    moves = [line for line in plan(done).split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in line]
    assert not [m for m in moves if "_h0" in m] and "hashpartitioning(source_id" in "".join(moves)


def _published(spark, wanted=None):
    node = "id string, project_id string, owner_file string, kind string, name string, qualified_name string, language string, start_line long, end_line long"
    nodes = spark.createDataFrame([
        ("a", "p", "f", "class", "A", "N.A", "cs", 1, 2), ("b", "p", "f", "class", "B", "N.B", "cs", 3, 4), ("b", "q", "f", "class", "B", "N.B", "cs", 3, 4),
        ("u", "p", "f", "odd", "U", "N.U", "cs", 5, 6), ("b", "p", "g", "odd", "B", "N.Other", "cs", 7, 8), (None, "p", "f", "class", "C", "N.C", "cs", 9, 9)], node)
    edge = "id string, project_id string, owner_file string, source_id string, target_id string, unresolved_target string, target_project_id string, kind string, resolution string, analyzer_id string, line long"
    edges = spark.createDataFrame([
        ("2", "p", "f", "a", "b", None, "p", "contains", "unresolved", "x", 1), ("1", "p", "f", "a", "b", None, "p", "contains", "annotated", "y", 1), ("1", "p", "f", "a", "b", None, "p", "contains", "annotated", "x", 1),
        ("3", "p", "f", "a", "u", None, "p", "contains", "annotated", "x", 1), ("4", "p", "f", "a", None, "N.Z", "p", "contains", "annotated", "x", 1), ("5", "p", "f", "a", None, None, "p", "contains", "annotated", "x", 2),
        ("6", "p", "f", "gone", "b", None, "p", "contains", "annotated", "x", 1), ("7", "p", "f", "a", "b", None, "p", "calls", "annotated", "x", 1), (None, "p", "f", "a", "lost", "", "p", "contains", None, "x", 3)], edge)
    return publish.publish_graph(nodes, edges, wanted)["edges"]


def test_published_edges_move_ids_as_bytes_and_only_what_is_wanted(spark):
    whole = _published(spark)
    ids = {r.qualified_name: r.id for r in publish.publish_graph(*[spark.createDataFrame(d, s) for d, s in (
        ([("a", "p", "f", "class", "A", "N.A", "cs", 1, 2), ("b", "p", "f", "class", "B", "N.B", "cs", 3, 4)], "id string, project_id string, owner_file string, kind string, name string, qualified_name string, language string, start_line long, end_line long"),
        ([], "id string, project_id string, owner_file string, source_id string, target_id string, unresolved_target string, target_project_id string, kind string, resolution string, analyzer_id string, line long"))])["nodes"].collect()}
    assert sorted(map(str, rows(whole, "source_id", "target_id", "unresolved_target", "resolution", "analyzer_id"))) == sorted(map(str, [
        (ids["N.A"], ids["N.B"], None, "annotated", "x"), (ids["N.A"], None, "N.U", "unresolved", "x"), (ids["N.A"], None, "N.Z", "unresolved", "x"), (ids["N.A"], None, "f", "unresolved", "x")]))
    some = _published(spark, ["project_id", "unresolved_target"])
    assert some.columns == ["project_id", "unresolved_target", "id"]
    assert sorted(map(str, rows(some))) == sorted(map(str, rows(whole, *some.columns)))
    moved = [line for line in plan(some).split("Initial Plan")[-1].splitlines() if "SortAggregate(key=[id" in line]
    assert moved and "analyzer_id" not in "".join(moved) and "evidence" not in "".join(moved)


def test_projects_are_found_once_for_a_removal(spark, sf_dir):
    """Each part of the removal looks projects up; found again for each, they made a plan that filled the driver."""
    assert plan(load().QUERIES["u7_remove_solution"](spark, sf_dir)).count("FileScan parquet") < 80
