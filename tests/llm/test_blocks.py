import time

import pyarrow as pa
from pyspark.sql import functions as F

from relgraph.llm import blocks, jaccard
from relgraph.llm.common import release, stored

KIND = pa.list_(pa.struct([("rep", pa.int64()), ("comp", pa.int64()), ("text", pa.string())]))


def test_leaves_of_texts_meet(monkeypatch):
    """Leaves carry texts; their sets are made where two leaves meet, once for rows of one leaf that follow one another."""
    monkeypatch.setattr(jaccard, "_PIECE", 200)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1:]]) for k in (0, 3, 59, 30)] + [" ".join(words), "other words only", ""]
    member = [{"rep": k, "comp": k, "text": t} for k, t in enumerate(texts)]
    made, real = [], jaccard._sets_of(3)

    def counted(side):
        made.append(side.field("rep").to_pylist())
        return real(side)

    x, y = [member[4], member[0], member[5]], [member[1], member[2], member[3], member[6]]
    rows = pa.RecordBatch.from_arrays([pa.array([x, x, y], KIND), pa.array([x, y, y], KIND)], ["x", "y"])
    run, _ = blocks.meet_blocks(85, counted)
    found = [list(zip(*b.to_pydict().values())) for b in run(iter([rows]))]
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for t in texts]
    sets[5] = {tuple(texts[5].split())}

    def links(left, right):
        return {(a, b) for a in left for b in right if a != b and sets[a] and sets[b]
                and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}

    def groups(pairs):
        name = list(range(len(texts)))
        for _ in name:
            for a, b in pairs:
                name[a] = name[b] = min(name[a], name[b])
        return name

    for got, (left, right) in zip(found, (((4, 0, 5),) * 2, ((4, 0, 5), (1, 2, 3, 6)), ((1, 2, 3, 6),) * 2)):
        assert groups(got) == groups(links(left, right))
    assert made == [[4, 0, 5], [1, 2, 3, 6], [1, 2, 3, 6]]


def test_files_of_a_shuffle_go_once_its_table_is_stored(spark, tmp_path):
    """A driver with room to spare collects no garbage, and what only garbage refers to fills the disk."""
    env = spark._jvm.org.apache.spark.SparkEnv
    lying = lambda: sum(".data" in part for part in env.get().blockManager().diskBlockManager().getAllFiles().toString().split(","))
    release(spark.range(1))
    before = lying()
    kept = stored(spark.range(2000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts", str(tmp_path))
    made = lying()
    assert made > before and release(kept) is kept
    for _ in range(100):
        if lying() < made:
            break
        time.sleep(0.1)
    assert lying() < made and kept.count() == 7
