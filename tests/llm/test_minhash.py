"""Tensored MinHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from relgraph.llm import blocks, minhash

R = random.Random(13)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randrange(2, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, n_shingles string, rep string, items string"


def prose(n):
    return [R.choice(VOCABULARY) for _ in range(n)]


def edited(words, k):
    out = list(words)
    for _ in range(k):
        out[R.randrange(len(out))] = R.choice(VOCABULARY)
    return " ".join(out)


def corpus():
    rows = [(k, " ".join(prose(R.randrange(1, 120)))) for k in range(60)]
    rows += [(100 + k, rows[k][1].upper()) for k in range(10)] + [(120 + k, rows[0][1]) for k in range(15)]
    base, other = prose(150), prose(90)
    rows += [(200 + k, edited(base, k % 14)) for k in range(150)]  # many are linked only through others, many not at all
    rows += [(400 + k, edited(other, k % 5)) for k in range(25)]
    shared = prose(40)
    rows += [(450 + k, " ".join(prose(20) + shared + prose(20))) for k in range(20)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one two"), (905, "ONE  two"), (906, "é漢字 " * 4000), (907, "é漢字 " * 9000)]
    return rows + [(None, rows[0][1]), (200, rows[85][1]), (-3, rows[90][1])]


ROWS = corpus()


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k: k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def components(rows, share):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("share, block_items", [(85, 1 << 16), (85, 500), (90, 1 << 16)])
def test_components(spark, share, block_items):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in ROWS], SCHEMA).repartition(3)
    got = minhash.near_duplicates(docs, share=share, block_items=block_items).collect()
    assert len(got) == len(ROWS)
    want = components([r for r in ROWS if r[0] is not None], share)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_ids_of_two_texts(spark):
    one, two = edited(prose(60), 0), edited(prose(90), 0)
    docs = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two), (4, one + " x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(alone).collect()) == [(1, 2, 1, True), (2, 0, 2, True)]


def test_common_items(monkeypatch):
    monkeypatch.setattr(blocks, "_COLUMNS", 7)
    sets = [np.unique(np.array([R.randrange(60) for _ in range(R.randrange(30))], np.uint64)) for _ in range(40)]
    got = blocks.common_items([s.tobytes() for s in sets[:25]], [s.tobytes() for s in sets[25:]])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]


def test_half_keys_over_runs(monkeypatch):
    sets = [np.unique(np.array([R.randrange(1 << 60) for _ in range(R.randrange(30))], np.uint64)) for _ in range(30)]
    value, row = np.concatenate(sets), np.repeat(np.arange(30), [len(s) for s in sets])
    whole = minhash.half_keys(value, row, 30, 4, 3)
    monkeypatch.setattr(minhash, "_RUN", 11)
    assert (minhash.half_keys(value, row, 30, 4, 3) == whole).all()


def test_links_come_from_the_trees(spark, monkeypatch):
    """Of a set of near copies, the traversals give the links; without them every set stays alone."""
    from relgraph.llm import jaccard

    base = prose(120)
    rows = [(k, edited(base, k % 4)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows, 85)
    found, traverse = [], jaccard.traverse

    def counted(*args, **kwargs):
        out = traverse(*args, **kwargs)
        found.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "traverse", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 85).collect()}
    assert got == want and found[0] > 80 and len({c for _, c in want.values()}) < 20
    monkeypatch.setattr(jaccard, "traverse", lambda *a, **k: traverse(*a, **k).limit(0))
    alone = {r.component_id for r in jaccard.jaccard_components(docs, 3, 85).collect()}
    assert len(alone) == len({t for _, t in rows})
