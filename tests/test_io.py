"""Sources, sinks and streams: round trips, tampering, replays, batch = stream."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from relgraph.sources import hints as hint_source
from relgraph.sources import inventory, snapshots, status
from relgraph.streaming import publish, stateful, windows
from tests.helpers import rows

NODES = "id string, kind string"
EDGES = "id string, source_id string, target_id string"


def small(spark, n=40):
    nodes = spark.createDataFrame([(f"n{i}", "Class") for i in range(n)], NODES)
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{(i * 7) % n}") for i in range(n)], EDGES)
    return nodes, edges


def test_inventory_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.cs").write_text("hello")
    (tmp_path / "b.txt").write_text("é")
    out = inventory.scan_inventory(spark, str(tmp_path), "p")
    want = sorted([("src/a.cs", 5, hashlib.sha256(b"hello").hexdigest()), ("b.txt", 2, hashlib.sha256("é".encode()).hexdigest())])
    assert rows(out["files"], "path", "bytes", "content_hash") == want
    assert out["unreadable"].count() == 0 and out["truncated"].first().truncated is False


def test_generation_is_content_addressed_and_verified(spark, tmp_path):
    root = str(tmp_path / "store")
    nodes, edges = small(spark)
    first = snapshots.write_generation(nodes, edges, root, "p", 1, buckets=4)
    again = snapshots.write_generation(nodes.repartition(7), edges.orderBy(F.rand(1)), root, "p", 2, buckets=4)
    assert first == again and spark.read.parquet(f"{root}/registry").count() == 1
    schemas = {"nodes": NODES, "edges": EDGES}
    found = snapshots.read_snapshot(spark, root, {"p": first}, schemas)
    assert rows(found["nodes"]) == rows(nodes) and rows(found["edges"]) == rows(edges)
    victim = glob.glob(f"{root}/generations/generation_id={first}/role=nodes/bucket=*/part=*/part-*")[0]
    with open(victim, "a") as f:
        f.write('{"id":"zz","kind":"Class"}\n')
    os.remove(os.path.join(os.path.dirname(victim), "." + os.path.basename(victim) + ".crc"))
    with pytest.raises(snapshots.SnapshotError, match="integrity"):
        snapshots.read_snapshot(spark, root, {"p": first}, schemas)
    with pytest.raises(snapshots.SnapshotError, match="not published"):
        snapshots.read_snapshot(spark, root, {"p": "0" * 64}, schemas)


def test_generations_in_capped_parts(spark, tmp_path):
    root = str(tmp_path / "store")
    nodes, edges = small(spark, 200)
    first = snapshots.write_generation(nodes, edges, root, "p", 1, buckets=2, max_bytes=400)
    other = snapshots.write_generation(nodes.limit(0), edges.where("id < 'e5'"), root, "q", 1, buckets=2, max_bytes=400)
    manifest = spark.read.parquet(f"{root}/manifests/generation_id={first}")
    assert manifest.agg(F.max("bytes")).first()[0] <= 400 and manifest.groupBy("role", "bucket").count().agg(F.min("count")).first()[0] > 5
    schemas = {"nodes": NODES, "edges": EDGES}
    vector = spark.createDataFrame([("p", first), ("q", other)], "project_id string, generation_id string")
    found = snapshots.read_snapshot(spark, root, vector, schemas)
    assert rows(found["nodes"]) == rows(nodes)
    assert rows(found["edges"]) == rows(edges.unionByName(edges.where("id < 'e5'")))
    assert snapshots.read_snapshot(spark, root, vector.limit(0), schemas)["nodes"].count() == 0
    with pytest.raises(snapshots.SnapshotError, match="nodes n1 needs"):
        snapshots.write_generation(nodes.where("id = 'n1'"), edges, root, "p", 1, buckets=2, max_bytes=10)


def test_publishing_again_mends_what_a_crash_left(spark, tmp_path):
    root = str(tmp_path / "store")
    nodes, edges = small(spark)
    first = snapshots.write_generation(nodes, edges, root, "p", 1, buckets=4)
    for part in ("registry", f"manifests/generation_id={first}"):  # written last, and before that
        os.rename(f"{root}/{part}", f"{tmp_path}/{part.split('/')[0]}-lost")
        assert snapshots.write_generation(nodes, edges, root, "p", 2, buckets=4) == first
        assert spark.read.parquet(f"{root}/registry").select("generation_id").collect() == [(first,)]
        assert rows(snapshots.read_snapshot(spark, root, {"p": first}, {"nodes": NODES})["nodes"]) == rows(nodes)


def test_export_refuses_existing_destinations_and_unknown_ids(spark, tmp_path):
    nodes, edges = small(spark)
    ids = spark.createDataFrame([("n1",), ("n7",)], "id string")
    receipts = snapshots.export_graph(nodes, edges, ids, None, str(tmp_path / "out")).collect()
    for r in receipts:
        data = open(tmp_path / "out" / r.name, "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
    assert rows(spark.read.schema(NODES).json(str(tmp_path / "out/nodes")), "id") == [("n1",), ("n7",)]
    with pytest.raises(FileExistsError):
        snapshots.export_graph(nodes, edges, ids, None, str(tmp_path / "out"))
    with pytest.raises(snapshots.SnapshotError, match="unknown node"):
        snapshots.export_graph(nodes, edges, spark.createDataFrame([("nope",)], "id string"), None, str(tmp_path / "new"))


def test_name_status(spark):
    log = spark.createDataFrame([("r", "M\ta.cs\x00R100\tnew.cs\x00old.cs\x00D\tgone.cs\x00")], "repo string, output string")
    assert rows(status.decode_name_status(log, ["repo"]), "status", "path", "origin") == [("D", "gone.cs", None), ("M", "a.cs", None), ("R", "new.cs", "old.cs")]


def run(query_df, spark, tmp_path, mode="append"):
    """Drive a stream to its end into files and read them back."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    query_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
        availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out)


HINTS = "project_id string, ts_ms long, seq long, path string, ts timestamp"


def hint_rows(spark, n=60):
    data, t = [], 1_700_000_000_000
    for i in range(n):
        t += [100, 300, 900, 50, 2500][i % 5] + (9000 if i % 11 == 10 else 0)
        data.append((f"p{i % 2}", t, i, f"f{i % 7}.cs"))
    base = spark.createDataFrame(data, "project_id string, ts_ms long, seq long, path string")
    return base.withColumn("ts", F.timestamp_millis("ts_ms"))


def as_stream(spark, df, tmp_path, parts=3):
    """The rows as a file stream, a few files per run so that state crosses micro-batches."""
    folder = tmp_path / "in"
    ordered = df.orderBy("seq").collect()
    size = -(-len(ordered) // parts)
    for i in range(parts):
        spark.createDataFrame(ordered[i * size:(i + 1) * size], df.schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def test_pressure_stream_equals_a_plain_fold(spark, tmp_path):
    stateful.use_rocksdb(spark)
    df = hint_rows(spark)
    got = rows(run(stateful.pressure_stream(as_stream(spark, df, tmp_path), 5), spark, tmp_path), "project_id", "seq", "decision", "distinct")
    want, state = [], {}
    for r in df.orderBy("seq").collect():
        full, paths = state.setdefault(r.project_id, [False, set()])
        if full:
            want.append((r.project_id, r.seq, "coalesced", 0))
            continue
        paths.add(r.path)
        if len(paths) >= 5:
            state[r.project_id] = [True, set()]
            want.append((r.project_id, r.seq, "high_water", 0))
        else:
            want.append((r.project_id, r.seq, "normal", len(paths)))
    assert got == sorted(want, key=repr)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    stateful.use_rocksdb(spark)
    df = hint_rows(spark).withColumnRenamed("project_id", "target")
    got = run(stateful.rate_limit_stream(as_stream(spark, df, tmp_path), 2, 10), spark, tmp_path)
    batch = windows.rate_limit(df.select("target", "ts_ms", "seq"), 2, 10)
    columns = ("target", "ts_ms", "seq", "outcome")
    assert rows(got, *columns) == rows(batch, *columns)
    assert {r.outcome for r in batch.collect()} == {"recorded", "notice", "suppressed"}


def test_debounce_stream_equals_batch(spark, tmp_path):
    stateful.use_rocksdb(spark)
    df = hint_rows(spark)
    # a last hint far ahead moves the watermark past every earlier deadline
    closing = spark.createDataFrame([("end", 1_800_000_000_000, 10_000, "x")], "project_id string, ts_ms long, seq long, path string")
    full = df.unionByName(closing.withColumn("ts", F.timestamp_millis("ts_ms")))
    got = run(stateful.debounce_stream(as_stream(spark, full, tmp_path), 3000, 4000), spark, tmp_path).where("project_id <> 'end'")
    columns = ("project_id", "flush_ms", "trigger", "path")
    assert rows(got, *columns) == rows(windows.debounce(df, 3000, 4000), *columns)
    assert {r.trigger for r in got.collect()} == {"quiet_period", "maximum_wait"}


def test_hint_stream(spark, tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    (folder / "a.json").write_text('{"project_id":"p","reason":"git","paths":["a.cs","b.cs"]}')
    (folder / "b.json").write_text("nope")
    out = hint_source.read_hints(spark, str(folder), "sol")
    assert rows(run(out["hints"], spark, tmp_path), "project_id", "path") == [("p", "a.cs"), ("p", "b.cs")]
    (tmp_path / "r").mkdir()
    assert rows(run(out["rejects"], spark, tmp_path / "r"), "rule") == [("hint-document-invalid",)]


def test_publishing_is_idempotent_under_replay(spark, tmp_path):
    folder = str(tmp_path / "outbox")
    write = publish.publish_once(folder)
    schema = "id string, idempotency_key string, project_id string, generation_id string"
    first = spark.createDataFrame([("i1", "k1", "p", "g1"), ("i2", "k2", "p", "g2")], schema)
    second = spark.createDataFrame([("i2", "k2", "p", "g2"), ("i3", "k1", "p", "g9"), ("i4", "k4", "p", "g4")], schema)
    write(first, 0)
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert rows(publish.outbox(spark, folder), "id", "idempotency_key") == [("i1", "k1"), ("i2", "k2"), ("i4", "k4")]
    plan = publish.plan_publish(second, publish.outbox(spark, folder).where("batch_id < 1"))
    assert rows(plan["conflicts"]) == [("i3", "k1", "i1")]


def test_refused_intents_are_kept(spark, tmp_path):
    """A key of another intent is refused in writing, once, also when its batch is replayed."""
    folder = str(tmp_path / "outbox")
    write = publish.publish_once(folder)
    shape = "id string, idempotency_key string, project_id string, generation_id string"
    first = spark.createDataFrame([("a", "k1", "p", "g")], shape)
    second = spark.createDataFrame([("a", "k1", "p", "g"), ("b", "k1", "p", "g"), ("c", "k2", "p", "g"), ("d", "k2", "p", "g")], shape)
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        write(batch, number)
    assert sorted(r.id for r in publish.outbox(spark, folder).collect()) == ["a", "c"]
    assert sorted(tuple(r) for r in publish.conflicts(spark, folder).collect()) == [("b", "k1", "a", 1), ("d", "k2", "c", 1)]
