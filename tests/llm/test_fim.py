"""Fill-in-middle against a brute-force version, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relgraph.llm import fim

R = random.Random(11)
ODD = ["", "a", "<P>x", "x <M>", "one two three", "é漢字 ok", "<", "ab<S", "S>xx", "P><", "日本語" * 50, "\U0001f600a\U0001f600", " \n\t "]
TEXTS = ODD + ["".join(R.choice("ab <>PSM.é漢\n") for _ in range(R.randrange(60))) for _ in range(200)] + ["word, " * 300_000]


def brute(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, name = len(units), "" if doc_id is None else doc_id
    digest = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k: 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def draws(ids):
    digests = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in ids]
    return np.array([[int(d[8 * k: 8 * k + 8], 16) for d in digests] for k in range(4)], np.int64)


def kernel(texts, first=0):
    encoded = [t.encode() for t in texts]
    body = np.frombuffer(b"".join(encoded), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded], dtype=np.int64)])
    ids = range(first, first + len(texts))
    form, n, plain, chars, out, ends = fim.cut_and_scatter(body, offsets, draws(ids), 90, 20)
    for k, (i, text) in enumerate(zip(ids, texts)):
        got = (n[k], form[k], *((None, None) if plain[k] else chars[k]), out[ends[k]: ends[k + 1]].tobytes().decode())
        assert got == brute(i, text)
    back, again = fim.gather_back(out, ends, plain, form == "spm")
    assert back.tobytes() == body.tobytes() and list(again) == list(offsets)


@pytest.mark.parametrize("step", [1 << 20, 5])
def test_kernel_in_pieces(step, monkeypatch):
    monkeypatch.setattr(fim, "_STEP", step)
    kernel(TEXTS[:-1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB<>PSM é漢"), min_size=1, max_size=6), st.integers(0, 1000))
def test_kernel_round_trip(texts, first):
    kernel(texts, first)


def test_rows(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, "no id here", "y", 1), (7, None, "z", 2), (5, TEXTS[5], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long").repartition(3)
    made = fim.fill_in_middle(docs)
    got = sorted((tuple(r) for r in fim.restore(made).collect()), key=repr)
    assert got == sorted(((i, *brute(i, t or ""), t or "") for i, t, *_ in rows), key=repr)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.fill_in_middle(none)).count() == 0
    given_rows = [("a<M>b", None, 1), (None, "psm", 2), ("<S>c<P>a<M>b", "spm", 3)]
    outputs = spark.createDataFrame([given_rows[0], given_rows[2]], "output string, form string, restored int")
    assert {r.restored for r in fim.restore(outputs).collect()} == {"a<M>b", "abc"}
    with pytest.raises(Exception, match="three marks"):
        fim.restore(spark.createDataFrame([given_rows[1]], "output string, form string, restored int")).collect()
