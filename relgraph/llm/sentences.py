"""Substring deduplication by sliding sentence spans."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import lean, rows_out, stored

_END = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_SPAN = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int32()), ("length", pa.int32()), ("span", pa.binary())])
_KEPT = pa.schema([
    ("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("text", pa.string()),
])


def sentences(text: str) -> list[str]:
    """The text in sentences, with the white space after each; joined they are the text."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def runs(pieces: list[str], least: int, least_words: int):
    """``(first, count, hash)`` of the shortest run from each sentence on, and up to each sentence, with enough sentences and words.

    Any run that is long enough is covered by those of these that lie in it: a sentence
    whose own run would reach beyond the end lies in the shortest run up to that end.
    """
    split = [p.lower().split() for p in pieces]
    joined = [" ".join(w).encode() for w in split]

    def run(a, b):
        return a, b - a, blake2b(b" ".join(joined[a:b]), digest_size=16).digest()

    ends = set()
    to = words = 0
    for at in range(len(pieces)):
        while to < len(pieces) and (to - at < least or words < least_words):
            words += len(split[to])
            to += 1
        if to - at < least or words < least_words:
            break
        ends.add(to)
        yield run(at, to)
        words -= len(split[at])
    # where a run from some sentence on ends, the shortest one up to there is among the above
    at = words = 0
    for to in range(1, len(pieces) + 1):
        words += len(split[to - 1])
        while to - at > least and words - len(split[at]) >= least_words:
            words -= len(split[at])
            at += 1
        if to not in ends and to - at >= least and words >= least_words:
            yield run(at, to)


def _spans(least: int, least_words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [[], [], [], [], []]
            for i, c, text in zip(ids, batch.column("copy").to_pylist(), batch.column("text").to_pylist()):
                for at, n, key in runs(sentences(text or ""), least, least_words):
                    for column, value in zip(out, (i, c, at, n, key)):
                        column.append(value)
                if len(out[0]) > 50_000:
                    yield rows_out(_SPAN, *out)
                    out = [[], [], [], [], []]
            yield rows_out(_SPAN, *out)

    return run


def _rebuild(batches):
    for batch in batches:
        out = [[], [], [], [], []]
        for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            pieces = sentences(text or "")
            gone = np.zeros(len(pieces) + 1, bool)
            for s in spans or ():
                gone[s["at"]: s["at"] + s["length"]] = True
            starts = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
            rest = "".join(p for p, g in zip(pieces, gone) if not g)
            for column, value in zip(out, (i, len(pieces), int(gone.sum()), starts, rest)):
                column.append(value)
        yield rows_out(_KEPT, *out)


def drop_repeated_spans(docs: DataFrame, least: int = 2, least_words: int = 12, text: str = "text") -> DataFrame:
    """``doc_id, n_sentences, n_removed, n_spans, text`` for every row of ``docs``; ``text`` is what is left.

    From each sentence on, and up to each sentence, the shortest run of at least
    ``least`` sentences and ``least_words`` words is hashed, with A-Z and other case
    and white space levelled; together they cover what all longer runs of the same
    sentences cover. Of equal runs in all documents the first one, by ``doc_id`` and place,
    stays; every sentence that lies in any other one goes. Runs are judged on the
    input, so a run may go although part of its first occurrence goes too.

    The first place of a run is a minimum, combined before the shuffle; runs seen
    once are dropped there, so a passage in a third of all documents is one row.
    The runs then meet these rows in a join that Spark can split.

    Null texts count as empty. Rows that repeat an id count as its copies in the
    order of their hashes; equal rows of one id are one and the same document. Null
    ids come first. Other columns of ``docs`` are left out; an empty table gives no rows.
    """
    whole = lean(docs).select("doc_id", F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    spans = whole.mapInArrow(_spans(least, least_words), "doc_id long, copy long, at int, length int, span binary")
    spans = stored(spans, "spans")
    place = F.struct("doc_id", "copy", "at")
    first = spans.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("span", "first")
    first = stored(first, "first")
    later = spans.join(first, "span").where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("at", "length")).alias("spans"))
    gone = stored(gone.select(F.col("doc_id").alias("gone_id"), F.col("copy").alias("gone_copy"), "spans"), "gone")
    met = whole.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("copy") == F.col("gone_copy")), "left")
    return met.select("doc_id", "text", "spans").mapInArrow(
        _rebuild, "doc_id long, n_sentences long, n_removed long, n_spans long, text string"
    )
