"""Build cycles: full, no-op, incremental, deletions, files that do not parse."""

import pytest
from pyspark.sql import functions as F

from relgraph.plans import build
from tests.helpers import rows


def corpus(spark, files):
    df = spark.createDataFrame([("p", path, text) for path, text in files.items()], "project string, path string, content string")
    return df.withColumn("content_hash", F.sha2("content", 256))


def klass(name, body=""):
    return f"namespace A\n{{\n  public class {name}\n  {{\n    public void Run(int a) {{ {body} }}\n  }}\n}}\n"


def state(spark, root):
    live = build.live_facts(spark, root)
    return rows(live["nodes"], "owner_file", "qualified_name", "kind", "id"), rows(live["edges"], "source_id", "target_id")


def test_incremental_cycles_equal_one_full_build(spark, tmp_path):
    files = {f"src/f{i}.cs": klass(f"C{i}") for i in range(6)} | {"src/a.ts": "export class T {\n  let x = 1;\n}\n", "logs/x.cs": klass("No"), "readme.md": "x"}
    step = str(tmp_path / "step")
    first = build.cycle(corpus(spark, files), step)
    assert (first["dirty"], first["analysed"], first["errors"]) == (7, 7, 0)
    assert build.cycle(corpus(spark, files), step) == {"generation": 1, "dirty": 0, "analysed": 0, "errors": 0}
    files["src/f1.cs"] = klass("Changed", "int b = 1;")
    files["src/new.cs"] = klass("New")
    del files["src/f2.cs"]
    second = build.cycle(corpus(spark, files), step)
    assert (second["generation"], second["dirty"], second["analysed"]) == (2, 3, 2)
    full = str(tmp_path / "full")
    build.cycle(corpus(spark, files), full)
    assert state(spark, step) == state(spark, full)
    a, b = build.published(spark, step), build.published(spark, full)
    assert rows(a["nodes"], "id", "qualified_name") == rows(b["nodes"], "id", "qualified_name")
    assert rows(a["edges"], "id", "source_id", "target_id") == rows(b["edges"], "id", "source_id", "target_id")


def test_a_broken_file_keeps_its_old_facts_and_stays_dirty(spark, tmp_path):
    root = str(tmp_path / "s")
    files = {"a.cs": klass("A1"), "b.cs": klass("B1")}
    build.cycle(corpus(spark, files), root)
    before = state(spark, root)
    files["a.cs"] = klass("A2") + "{"
    got = build.cycle(corpus(spark, files), root)
    assert (got["errors"], got["analysed"]) == (1, 0)
    assert state(spark, root) == before
    with pytest.raises(build.ParseErrors):
        build.cycle(corpus(spark, files), root, strict=True)
    files["a.cs"] = klass("A2")
    build.cycle(corpus(spark, files), root)
    assert any(n[1] == "A.A2" for n in state(spark, root)[0]) and not any(n[1] == "A.A1" for n in state(spark, root)[0])


def test_deleted_and_reappeared(spark, tmp_path):
    root = str(tmp_path / "s")
    files = {"a.cs": klass("A1"), "b.cs": klass("B1")}
    build.cycle(corpus(spark, files), root)
    first = state(spark, root)
    build.cycle(corpus(spark, {"b.cs": files["b.cs"]}), root)
    assert all(n[0] == "b.cs" for n in state(spark, root)[0])
    build.cycle(corpus(spark, files), root)
    assert state(spark, root) == first


def corpora(spark, projects):
    df = spark.createDataFrame([(p, path, text) for p, files in projects.items() for path, text in files.items()], "project string, path string, content string")
    return df.withColumn("content_hash", F.sha2("content", 256))


def test_two_projects_with_the_same_files(spark, tmp_path):
    files = {"a.cs": klass("A1"), "b.ts": "export class T {\n  let x = 1;\n}\n"}
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    build.cycle(corpus(spark, files), one)
    build.cycle(corpora(spark, {"p": files, "q": files}), two)
    single, both = build.published(spark, one), build.published(spark, two)
    mine = both["edges"].where("project_id = 'p'")
    assert rows(mine, "id", "source_id", "target_id") == rows(single["edges"], "id", "source_id", "target_id")
    assert both["edges"].count() == 2 * single["edges"].count() and both["nodes"].count() == 2 * single["nodes"].count()
    ends = both["edges"].join(both["nodes"].selectExpr("id AS target_id", "project_id AS owner"), "target_id")
    assert ends.count() == both["edges"].count() and ends.where("owner <> project_id").count() == 0
    build.cycle(corpora(spark, {"p": files, "q": {"b.ts": files["b.ts"]}}), two)
    assert build.live_facts(spark, two)["nodes"].where("project_id = 'q' AND owner_file = 'a.cs'").count() == 0
    assert build.live_facts(spark, two)["nodes"].where("project_id = 'p' AND owner_file = 'a.cs'").count() > 0


def tree(root):
    return sorted(str(p) for p in root.rglob("*"))


def test_delta_log_and_compaction(spark, tmp_path):
    root, files = tmp_path / "s", {f"f{i}.cs": klass(f"C{i}") for i in range(8)}
    build.cycle(corpus(spark, files), str(root), compact_every=3)
    before = tree(root)
    assert build.cycle(corpus(spark, files), str(root))["generation"] == 1 and tree(root) == before
    files["f3.cs"] = klass("D3")
    build.cycle(corpus(spark, files), str(root), compact_every=3)
    delta = spark.read.parquet(f"{root}/files/generation=2")
    assert rows(delta, "path", "indexed_generation") == [("f3.cs", 2)]
    assert spark.read.parquet(f"{root}/nodes/generation=2").select("owner_file").distinct().count() == 1
    del files["f5.cs"]
    files["f9.cs"] = klass("C9") + "{"
    got = build.cycle(corpus(spark, files), str(root), compact_every=3)  # a tombstone, a file that stays dirty, and a new base
    assert got["errors"] == 1 and build.latest_commit(spark, str(root)) == (3, 3)
    files["f9.cs"] = klass("C9")
    assert build.cycle(corpus(spark, files), str(root))["analysed"] == 1
    whole = tmp_path / "whole"
    build.cycle(corpus(spark, files), str(whole))
    assert state(spark, str(root)) == state(spark, str(whole))
    kept = state(spark, str(root))
    assert build.compact(spark, str(root)) == 4 and state(spark, str(root)) == kept
    assert build.cycle(corpus(spark, files), str(root))["dirty"] == 0


def test_a_path_seen_twice_fails_the_cycle(spark, tmp_path):
    twice = corpus(spark, {"a.cs": klass("A1")})
    with pytest.raises(ValueError, match="duplicate-inventory-path"):
        build.cycle(twice.unionByName(twice), str(tmp_path / "s"))
