"""The prefix trie against a brute-force version."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from relgraph.llm import trie

R = random.Random(12)
SCHEMA = "conv_id long, turn int, role string, text string, depth int, bytes string, part string"


def brute(rows, rebuilt):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:3])] for c, v in convs.items()}
    said = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuilt else 0
        said[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    ends = {n: ",".join(map(str, sorted(c for c in m if said[c] == n))) for n, m in members.items()}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest())
        for n, m in members.items()
    )


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in df.collect())


def conversation(conv, texts, role="user"):
    return [(conv, k, role, t, 1, "x", "y") for k, t in enumerate(texts)]


def corpus():
    rows = []
    for conv in range(120):  # a few common openings, and whole conversations that a third share
        texts = ["hello", "é 漢字"] + [R.choice("abc") for _ in range(R.randrange(4))]
        rows += conversation(conv, ["hello", "how", "are", "you"] if conv % 3 == 0 else texts[R.randrange(2):])
    common = [f"turn {k}" for k in range(150)]
    for conv in range(200, 212):  # longer than two segments, parting at and beside their ends
        rows += conversation(conv, common[: (64, 128, 129, 150, 63, 150)[conv % 6]] + ["tail", f"{conv % 4}"][: conv % 3])
    rows += [(300, None, None, None, 0, "", ""), (300, None, None, None, 0, "", ""), (300, 2, "user", "", 0, "", ""), (301, 1, None, "", 0, "", "")]
    rows += [(-7, 0, "user", "hello", 0, "", ""), (-5, 0, "user", "minus", 0, "", ""), (None, 0, "user", "hello", 0, "", "")]
    rows += [(400, 1, role, "same turn number", 0, "", "") for role in ("b", "a")] + conversation(405, ["x" * 500_000, ""])
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def convs(spark):
    rows = list(ROWS)
    R.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("shard_rows", [3, 8192])
def test_trie(convs, shard_rows):
    turns = trie.number_turns(convs)
    assert nodes(trie.prefix_trie(turns, shard_rows=shard_rows, shard_turns=1 << 18)) == brute(ROWS, False)


@pytest.mark.parametrize("shard_turns", [100, 1 << 18])
def test_rebuilt_trie(convs, shard_turns):
    turns, members = trie.rebuild(trie.number_turns(convs))
    assert nodes(trie.prefix_trie(turns, members, shard_turns=shard_turns)) == brute(ROWS, True)


def test_turnless(spark):
    rows = [(7, 0, "user", "only"), (8, 0, "user", "two"), (8, 1, "user", "three")]
    turns, members = trie.rebuild(trie.number_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    assert nodes(trie.prefix_trie(turns, members)) == brute(rows, True)
    none = trie.number_turns(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert trie.prefix_trie(none).count() == 0


def test_only_turnless(spark):
    rows = [(7, 0, "user", "only"), (7, 1, "user", "x")]
    turns, members = trie.rebuild(trie.number_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    got = nodes(trie.prefix_trie(turns, members))
    assert got == brute(rows, True) and zlib.crc32(b"7") % 9 >= 2 and len(got) == 1
