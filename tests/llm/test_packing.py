"""Retrieval packing: neighbours against brute force, and documents that belong together in one shard."""

import numpy as np
import pytest

from relgraph.llm import packing

R = np.random.default_rng(5)


def some_docs(n, terms=60):
    return [R.integers(0, terms, R.integers(1, 40)).astype(np.uint16) for _ in range(n)]


def statistics(docs, size):
    df = np.zeros(size, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    return packing.Weights(df, len(docs), float(np.mean([len(d) for d in docs])))


@pytest.mark.parametrize("count,nearest", [(1, 64), (50, 64), (300, 8)])
def test_neighbours_are_those_of_brute_force(count, nearest, monkeypatch):
    monkeypatch.setattr(packing, "NEAREST", nearest)
    docs = some_docs(count)
    weights = statistics(docs + some_docs(200), 60)
    index = packing.Index(docs, weights)
    by_doc = [dict(zip(*map(np.ndarray.tolist, weights.of(d)))) for d in docs]
    unused = np.ones(count, bool)
    for seed in range(count):
        unused[seed] = False
        unused[R.integers(0, count, 3)] = False
        index.keep(unused)
        score = {k: sum(w for t, w in by_doc[k].items() if t in by_doc[seed]) for k in np.flatnonzero(unused).tolist()}
        want = sorted((k for k, s in score.items() if s > 0), key=lambda k: -score[k])
        got = list(index.neighbours(seed, unused))
        assert sorted(got) == sorted(want) and np.allclose([score[k] for k in got], [score[k] for k in want])


def test_a_long_shard_is_cut_and_every_id_is_packed_once(spark):
    rows = [(k % 50, f"word{k} " * (k % 90)) for k in range(400)] + [(None, "same text")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, window=64, shard_bytes=3000).toPandas()
    full = got.groupby("sequence_id").length.sum()
    shards = -(-sum(len(t) for _, t in rows) // 3000)
    assert full.max() <= 64 and (full < 64).sum() <= 1.5 * shards  # one window of each shard has padding
    assert got.length.sum() == sum(len(i) + 1 for i in packing.encode([t for _, t in rows]))
    assert got.doc_id.isna().sum() >= 300


def test_near_copies_lie_together(spark):
    """Windows take near copies of their seed, though shards hold a fortieth of all rows; documents dealt by hash would not meet."""
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for group in range(200):
        base = list(R.choice(words, 60))
        for copy in range(5):
            rows.append((group * 5 + copy, " ".join([*base[: 58 - copy], str(R.choice(words))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(t) for _, t in rows)
    got = packing.pack(docs, window=700, shard_bytes=total // 40).toPandas()
    got["group"], got["shard"] = got.doc_id // 5, got.sequence_id // 2**32
    assert got.shard.nunique() > 20
    pairs = got.merge(got, on="group")
    pairs = pairs[pairs.doc_id_x < pairs.doc_id_y].drop_duplicates(["doc_id_x", "doc_id_y", "shard_x", "shard_y"])
    together = pairs[pairs.shard_x == pairs.shard_y].drop_duplicates(["doc_id_x", "doc_id_y"])
    assert len(together) > 0.5 * 2000  # by hash: about 50 of 2,000
