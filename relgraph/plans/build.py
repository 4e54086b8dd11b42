"""One build cycle: inventory, extraction of dirty files, facts, published graph.

State is a log of deltas over a base. ``files/generation=N`` holds the inventory rows that
cycle N changed, deleted files included; ``nodes``/``edges``/``generation=N`` the facts of the
files analysed in it. ``base=N`` folders hold the whole state as of cycle N and are written by
``compact``. Readers take the base, leave out what later deltas name, and add the latest
delta of each file; a fact is live when its generation is the one its file is indexed at. So a
cycle writes in proportion to the dirty files. A commit is one empty file, named by its
generation and base, and made last; folders of cycles that were never committed are written over.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relgraph.extract import declarations
from relgraph.functions import text
from relgraph.functions.paths import ignore_reason, language, secret_match
from relgraph.operators.inventory import reconcile_inventory
from relgraph.operators.publish import publish_graph
from relgraph.operators.resolve import containment

FILES = ("project_id string, path string, observed_hash string, indexed_hash string, desired_generation long, "
         "indexed_generation long, deleted boolean")
NODES = ("id string, project_id string, owner_file string, kind string, name string, qualified_name string, "
         "language string, start_line long, end_line long, generation long")
EDGES = ("id string, project_id string, owner_file string, source_id string, target_id string, unresolved_target string, "
         "target_project_id string, kind string, resolution string, analyzer_id string, line long, generation long")


class ParseErrors(RuntimeError):
    pass


def admitted(corpus: DataFrame) -> DataFrame:
    """Tracked, non-secret files of a supported language."""
    path = F.col("path")
    return corpus.where(
        ignore_reason(path)["reason"].isNull() & secret_match(path).isNull() & language(path).isNotNull()
    )


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


_COMMIT = re.compile(r"generation=(\d+)-base=(\d+)$")


def latest_commit(spark: SparkSession, root: str) -> tuple[int, int]:
    """Last committed generation and the base below it, from file names alone; 0 where there is none."""
    fs, target = _folder(spark, f"{root}/commits")
    if not fs.exists(target):
        return 0, 0
    found = [_COMMIT.search(f.getPath().getName()) for f in fs.listStatus(target)]
    return max(((int(m[1]), int(m[2])) for m in found if m), default=(0, 0))


def _commit(spark: SparkSession, root: str, generation: int, base: int) -> None:
    fs, target = _folder(spark, f"{root}/commits/generation={generation}-base={base}")
    fs.create(target, True).close()


def _stored(spark: SparkSession, root: str, part: str, names: list[str]) -> list[str]:
    """Those folders of a table that hold data files; a cycle without facts of a kind leaves none."""
    fs, _ = _folder(spark, root)
    return [p for n in names if fs.exists((path := _folder(spark, p := f"{root}/{part}/{n}")[1])) and len(fs.listStatus(path)) > 1]


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """The committed inventory: the base without what later deltas name, and the latest delta of each file."""
    generation, base = latest_commit(spark, root)
    key = ["project_id", "path"]
    rest = [c.split()[0] for c in FILES.split(", ")][2:]
    log = _stored(spark, root, "files", [f"generation={g}" for g in range(base + 1, generation + 1)])
    whole = _stored(spark, root, "files", [f"base={base}"])
    state = spark.read.schema(FILES).parquet(*whole) if whole else spark.createDataFrame([], FILES)
    if not log:
        return state
    deltas = spark.read.schema(f"{FILES}, generation long").option("basePath", f"{root}/files").parquet(*log)
    last = deltas.groupBy(*key).agg(F.max_by(F.struct(*rest), "generation").alias("s")).select(*key, "s.*")
    return state.join(last.select(*key), key, "left_anti").unionByName(last) if whole else last


def analyse(files: DataFrame, staging: str) -> dict[str, DataFrame]:
    """Declarations and error files of ``(project, path, content)`` rows.

    The lines of a language are classified once and written to ``staging``; declarations and
    diagnostics read them there. The two languages are independent jobs and run side by side.
    """
    spark, lang = files.sparkSession, language(F.col("path"))
    shape = ["project", "path", "line", "kind", "name", "semantic_path", "key"]

    def one(name: str, lines, declared, diagnosed) -> tuple[DataFrame, DataFrame]:
        mine = files.where(lang == name)
        coded = lines(mine)
        coded.write.mode("overwrite").parquet(f"{staging}/lines-{name}")
        coded = spark.read.schema(coded.schema).parquet(f"{staging}/lines-{name}")
        faults = diagnosed(mine, coded).where("severity = 'error'").select("project", "path", "code")
        found = declared(mine, coded).select(*shape, F.lit(name).alias("language"))
        found.write.mode("overwrite").parquet(f"{staging}/declarations-{name}")
        return spark.read.schema(found.schema).parquet(f"{staging}/declarations-{name}"), faults

    with ThreadPoolExecutor(2) as pool:
        jobs = [
            pool.submit(one, "csharp", declarations.csharp_lines, declarations.csharp_declarations, declarations.csharp_diagnostics),
            pool.submit(one, "typescript", declarations.typescript_lines, declarations.typescript_declarations, declarations.typescript_diagnostics),
        ]
        (cs, cs_faults), (ts, ts_faults) = (job.result() for job in jobs)
    return {"declarations": cs.unionByName(ts), "errors": cs_faults.unionByName(ts_faults)}


def facts(decls: DataFrame) -> dict[str, DataFrame]:
    """Nodes and containment edges of declarations."""
    name = F.coalesce("name", F.lit(""))
    scope = F.array_join("semantic_path", ".")
    qualified = F.when(scope == "", name).otherwise(F.concat(scope, F.lit("."), name))
    analyzer = F.concat("language", F.lit("-declarations-v1"))
    nodes = decls.select(
        F.col("key").alias("id"), F.col("project").alias("project_id"), F.col("path").alias("owner_file"), "kind",
        F.when(name == "", text.leaf_name(qualified)).otherwise(name).alias("name"), qualified.alias("qualified_name"), "language",
        F.col("line").alias("start_line"), F.col("line").alias("end_line"),
    )
    inside = containment(decls.select("project", F.col("path").alias("file"), F.col("line").alias("ordinal"), "key", "semantic_path", "name"))
    lang = decls.select("project", F.col("path").alias("file"), F.col("line").alias("ordinal"), analyzer.alias("analyzer_id"))
    edges = inside.join(lang, ["project", "file", "ordinal"]).select(
        F.concat("source_key", F.lit("->contains->"), "target_key").alias("id"), F.col("project").alias("project_id"),
        F.col("file").alias("owner_file"), F.col("source_key").alias("source_id"), F.col("target_key").alias("target_id"),
        F.lit(None).cast("string").alias("unresolved_target"), F.col("project").alias("target_project_id"),
        F.lit("contains").alias("kind"), F.lit("exact_static").alias("resolution"), "analyzer_id", F.col("ordinal").alias("line"),
    )
    return {"nodes": nodes, "edges": edges}


def _touched(known: DataFrame, observed: DataFrame) -> DataFrame:
    """Paths that a cycle has to look at: new, changed, gone, seen twice, or dirty since an earlier cycle.

    One aggregation over both sides; all other paths end there.
    """
    state = [c.split()[0] for c in FILES.split(", ")][2:]
    both = known.select("project_id", "path", F.struct(*state).alias("s"), F.lit(None).cast("string").alias("hash"), F.lit(0).alias("seen")).unionByName(
        observed.select("project_id", "path", F.lit(None).cast(known.select(F.struct(*state).alias("s")).schema["s"].dataType).alias("s"),
                        F.col("content_hash").alias("hash"), F.lit(1).alias("seen")))
    met = both.groupBy("project_id", "path").agg(F.max("s").alias("s"), F.max("hash").alias("hash"), F.sum("seen").alias("seen"))
    stored = F.col("s").isNotNull()
    settled = stored & (F.col("s.desired_generation") <= F.col("s.indexed_generation"))
    same = settled & (F.col("seen") == 1) & ~F.col("s.deleted") & F.col("s.observed_hash").eqNullSafe(F.col("hash"))
    away = settled & (F.col("seen") == 0) & F.col("s.deleted")
    return met.where(~F.coalesce(same | away, F.lit(False)))


def cycle(corpus: DataFrame, root: str, strict: bool = False, compact_every: int = 32) -> dict[str, int]:
    """Run one cycle over a corpus of ``(project, path, content, content_hash)`` and commit it.

    A file that does not parse keeps its old facts and stays dirty, or with ``strict``
    fails the cycle before anything is committed. A cycle without changes writes nothing.
    Every ``compact_every`` cycles the log is folded into a new base.
    """
    spark = corpus.sparkSession
    last, base = latest_commit(spark, root)
    generation = last + 1
    staging = f"{root}/work/generation={generation}"
    observed = admitted(corpus).select(F.col("project").alias("project_id"), "path", "content_hash")
    seen = Observation()
    touched = _touched(inventory(spark, root), observed).observe(seen, F.count(F.lit(1)).alias("rows"))
    touched.write.mode("overwrite").parquet(f"{staging}/touched")
    if not seen.get["rows"]:
        fs, target = _folder(spark, staging)
        fs.delete(target, True)
        return {"generation": last, "dirty": 0, "analysed": 0, "errors": 0}
    touched = spark.read.schema(touched.schema).parquet(f"{staging}/touched")
    files = touched.where("s is not null").select("project_id", "path", "s.*")
    again = touched.where("seen > 0").select("project_id", "path", F.col("hash").alias("content_hash"), F.explode(F.sequence(F.lit(1), "seen")))
    plan = reconcile_inventory(files, again.drop("col"), generation)
    bad = plan["violations"].limit(1).collect()  # of the touched paths alone
    if bad:
        raise ValueError(f"{bad[0].project_id}: {bad[0].rule}")
    plan["files"].where("desired_generation > indexed_generation").write.mode("overwrite").parquet(f"{staging}/dirty")
    dirty = spark.read.schema(FILES).parquet(f"{staging}/dirty")
    wanted = dirty.where(~F.col("deleted")).select(F.col("project_id").alias("project"), "path")
    # the contents of dirty files are taken out of the corpus once
    corpus.select("project", "path", "content").join(wanted, ["project", "path"], "left_semi").write.mode("overwrite").parquet(f"{staging}/content")
    found = analyse(spark.read.schema("project string, path string, content string").parquet(f"{staging}/content"), staging)
    broken_in = Observation()
    errors = found["errors"].observe(broken_in, F.count(F.lit(1)).alias("rows"))
    made = facts(found["declarations"])

    def write(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    # independent jobs of a small cycle run side by side
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(write, errors, f"{staging}/errors"), *(pool.submit(write, made[part], f"{staging}/{part}") for part in ("nodes", "edges"))]
        for job in jobs:
            job.result()
    errors = spark.read.schema("project string, path string, code string").parquet(f"{staging}/errors")
    failed = errors.select(F.col("project").alias("project_id"), "path").distinct()
    any_failed = broken_in.get["rows"] > 0
    failures = failed.count() if any_failed else 0
    if failures and strict:
        raise ParseErrors(f"{failures} files do not parse")
    counts = Observation()
    state = dirty.observe(
        counts, F.count(F.lit(1)).alias("dirty"), F.count_if(~F.col("deleted")).alias("analyse"))
    settled = state.join(failed.withColumn("_broken", F.lit(True)), ["project_id", "path"], "left") if any_failed else state.withColumn(
        "_broken", F.lit(None).cast("boolean"))
    done = F.col("_broken").isNull()
    # a file is indexed at the cycle that analysed it, also when it was dirty since an earlier one
    after = settled.select(
        "project_id", "path", "observed_hash", F.when(done, F.col("observed_hash")).otherwise(F.col("indexed_hash")).alias("indexed_hash"),
        F.when(done, F.lit(generation).cast("long")).otherwise(F.col("desired_generation")).alias("desired_generation"),
        F.when(done, F.lit(generation).cast("long")).otherwise(F.col("indexed_generation")).alias("indexed_generation"), "deleted",
    )

    def settle(part: str, schema: str) -> None:
        fresh = spark.read.schema(schema).parquet(f"{staging}/{part}")
        if any_failed:
            fresh = fresh.join(failed.withColumnRenamed("path", "owner_file"), ["project_id", "owner_file"], "left_anti")
        write(fresh.withColumn("generation", F.lit(generation).cast("long")).select(*(c.split()[0] for c in schema.split(", "))),
              f"{root}/{part}/generation={generation}")

    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(write, after, f"{root}/files/generation={generation}"), pool.submit(settle, "nodes", NODES), pool.submit(settle, "edges", EDGES)]
        for job in jobs:
            job.result()
    _commit(spark, root, generation, base)
    fs, target = _folder(spark, staging)
    fs.delete(target, True)
    if generation - base >= compact_every:
        compact(spark, root)
    return {"generation": generation, "dirty": counts.get["dirty"], "analysed": counts.get["analyse"] - failures, "errors": failures}


def compact(spark: SparkSession, root: str) -> int:
    """Fold the log into a new base and return its generation; the answers stay the same."""
    generation, base = latest_commit(spark, root)
    if generation > base:
        live = live_facts(spark, root)
        inventory(spark, root).write.mode("overwrite").parquet(f"{root}/files/base={generation}")
        for part in ("nodes", "edges"):
            live[part].write.mode("overwrite").parquet(f"{root}/{part}/base={generation}")
        _commit(spark, root, generation, generation)
    return generation


def live_facts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Nodes and edges of the committed state. Only generations that some file is indexed at are opened."""
    generation, base = latest_commit(spark, root)
    live = inventory(spark, root).where("NOT deleted").select(
        "project_id", F.col("path").alias("owner_file"), F.col("indexed_generation").alias("generation")
    )
    # at most one number for each cycle since the last compaction
    used = sorted(r.generation for r in live.where(F.col("generation") > base).select("generation").distinct().collect()) if generation > base else []
    folders = [*([f"base={base}"] if base else []), *(f"generation={g}" for g in used)]
    keys = ["project_id", "owner_file", "generation"]

    def read(part: str, schema: str) -> DataFrame:
        paths = _stored(spark, root, part, folders)
        # the generation is a column of the files; the folder's name says the same for a delta
        return (spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)).join(live, keys, "left_semi")

    return {"nodes": read("nodes", NODES), "edges": read("edges", EDGES)}


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The published graph of the committed state."""
    live = live_facts(spark, root)
    return publish_graph(live["nodes"], live["edges"])
