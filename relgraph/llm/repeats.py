"""Removal of repeated byte strings by sampled, named and merged suffixes.

The work follows the difference-cover construction: sample positions, name their
prefixes by sorting, recurse where names are not enough, merge the suffixes that were
not sampled, and compare neighbours in sorted order. Two things differ, see README:
the sample is a content-defined cover (the smallest hash in each sliding window), so
that equal strings are sampled at equal places, and suffixes are only ordered as far
as prefixes of the asked length tell them apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import BYTE, flat, lean, mix, rows_out, slices, stored, text_bytes, Spans

_SECOND = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
#: An entry: a sampled position, and the starts of strings it stands for, as distances before it.
ENTRY = np.dtype([("core", "<u8"), ("hull", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("near", "<u2"), ("far", "<u2"), ("known", "<u2")])
_BLOB = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("copies", pa.binary()), ("entries", pa.binary())])
_BLOB_SQL = "part int, ids binary, nulls binary, copies binary, entries binary"
_ROW = pa.schema([
    ("doc_id", pa.int64()), ("copy", pa.int64()), ("at", pa.int32()), ("near", pa.int32()), ("far", pa.int32()),
    ("covered", pa.bool_()), ("deeper", pa.bool_()),
])
_ROW_SQL = "doc_id long, copy long, at int, near int, far int, covered boolean, deeper boolean"
_PIECE = 1 << 20


def sample(spans: Spans, offsets: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Sampled positions: document, place, and the nearest and farthest string start each stands for.

    A string of ``length`` bytes is stood for by that of its first positions whose
    ``prefix`` bytes have the smallest hash, the leftmost of equal ones. Strings that
    are equal have it at the same distance, and the starts of a sampled position are
    next to each other.
    """
    size, width = int(offsets[-1]), length - prefix + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if size < length:
        return none
    at = np.arange(size - prefix + 1)
    bits = np.uint64(width.bit_length())
    low = np.uint64((1 << int(bits)) - 1)
    # the place in its block of ``width`` goes with each hash, so that no place in the text has to fit into it
    value = (spans.hash(at, at + prefix) & ~low) | (at % width).astype(np.uint64)
    # smallest of each sliding window: running minima from both ends of blocks of its width
    windows = len(value) - width + 1
    blocks = -(-len(value) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(value)] = value
    grid = grid.reshape(blocks, width)
    after = np.minimum.accumulate(grid, axis=1).ravel()[width - 1: width - 1 + windows]
    before = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    # a window ends one block and begins the next; of equal hashes the left one counts
    left = (before >> bits) <= (after >> bits)
    block = np.where(left, at[:windows], at[width - 1: width - 1 + windows]) // width
    chosen = block * width + (np.where(left, before, after) & low).astype(np.int64)
    starts = np.concatenate([np.arange(a, max(a, b - length + 1)) for a, b in zip(offsets[:-1], offsets[1:])])
    if not len(starts):
        return none
    chosen = chosen[starts]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    place = chosen[first]
    return doc[first], place, place - starts[last], place - starts[first]


def _named(spans, second, doc, place, near, far, width, length):
    """Entries of ranges of ``width`` starts: the bytes that all of its strings share, and those that they span."""
    pieces = far // width - near // width + 1
    own = np.repeat(np.arange(len(doc)), pieces)
    level = near[own] // width + np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo, hi = np.maximum(level * width, near[own]), np.minimum(level * width + width - 1, far[own])
    out = np.zeros(len(own), ENTRY)
    p = place[own]
    # the farthest start of the whole range ends the shared bytes, the nearest begins them
    core_from, core_to = p - level * width, p - (level * width + width - 1) + length
    out["core"] = mix(spans.hash(core_from, core_to) + mix(level.astype(np.uint64)))
    out["hull"] = mix(second.hash(p - hi, p - lo + length) + (lo * 4096 + hi).astype(np.uint64))
    out["doc"], out["near"], out["far"] = doc[own], lo, hi
    return out, p


def _combine(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal ones in one piece of text, one goes on and the others are known to repeat."""
    order = np.lexsort((entries["hull"], entries["core"]))
    e = entries[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["core"][1:] != e["core"][:-1]) | (e["hull"][1:] != e["hull"][:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(e)))
    e["known"] = np.repeat(count > 1, count)
    return e[new], e[~new]


def _emit(width: int, length: int, prefix: int, parts: int, sampled: bool):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                body, offsets = flat(piece.column("text"))
                spans, second = Spans(body, BYTE), Spans(body, _SECOND)
                if sampled:
                    doc, place, near, far = sample(spans, offsets, length, prefix)
                else:
                    lists = piece.column("entries")
                    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    inner = lists.flatten()
                    doc = np.repeat(np.arange(piece.num_rows), count)
                    place = inner.field("at").to_numpy(zero_copy_only=False).astype(np.int64) + offsets[doc]
                    near, far = (inner.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("near", "far"))
                entries, p = _named(spans, second, doc, place, near, far, width, length)
                entries["at"] = p - offsets[entries["doc"]]
                sent, settled = _combine(entries)
                settled["known"] = 2
                every = np.concatenate([sent, settled])
                part = ((every["core"] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                # what is settled only passes through, spread by document
                part[len(sent):] = mix(settled["doc"].astype(np.uint64) + settled["hull"]) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                every, part = every[order], part[order]
                cuts = np.searchsorted(part, np.arange(parts + 1))
                ids = piece.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                copies = piece.column("copy").to_numpy(zero_copy_only=False).astype("<i8")
                rows = [[], [], [], [], []]
                for k in np.flatnonzero(np.diff(cuts)):
                    some = every[cuts[k]: cuts[k + 1]].copy()
                    docs, some["doc"] = np.unique(some["doc"], return_inverse=True)
                    for column, v in zip(rows, (k, ids[docs].tobytes(), null[docs].tobytes(), copies[docs].tobytes(), some.tobytes())):
                        column.append(v)
                yield rows_out(_BLOB, *rows)

    return run


def _settle(rows, last: bool) -> pa.RecordBatch:
    """Sort the entries of one part by shared and spanned bytes, and compare neighbours."""
    ids, null, copies, entries, base = [], [], [], [], 0
    for i, n, c, e in rows:
        e = np.frombuffer(e, ENTRY).copy()
        e["doc"] += base
        base += len(i) // 8
        ids.append(i), null.append(n), copies.append(c), entries.append(e)
    ids, null, copies = np.frombuffer(b"".join(ids), "<i8"), np.frombuffer(b"".join(null), bool), np.frombuffer(b"".join(copies), "<i8")
    e = np.concatenate(entries)
    done = e[e["known"] == 2]
    e = e[e["known"] < 2]
    e = e[np.lexsort((e["hull"], e["core"]))]
    new_core = np.ones(len(e), bool)
    new_core[1:] = e["core"][1:] != e["core"][:-1]
    new_hull = new_core.copy()
    new_hull[1:] |= e["hull"][1:] != e["hull"][:-1]
    hull_of = np.cumsum(new_hull) - 1
    size = np.bincount(hull_of)
    known = np.bincount(hull_of, e["known"]) > 0
    covered = (size[hull_of] > 1) | known[hull_of] if len(e) else np.zeros(0, bool)
    core_of = np.cumsum(new_core) - 1
    hulls = np.bincount(core_of, new_hull) if len(e) else np.zeros(0)
    deeper = new_hull & (hulls[core_of] > 1) & (not last) if len(e) else np.zeros(0, bool)
    keep = covered | deeper
    e, covered, deeper = (np.concatenate(x) for x in (
        (e[keep], done), (covered[keep], np.ones(len(done), bool)), (deeper[keep], np.zeros(len(done), bool))))
    return rows_out(_ROW, pa.array(ids[e["doc"]], mask=null[e["doc"]]), copies[e["doc"]], e["at"].astype(np.int32), e["near"].astype(np.int32),
                    e["far"].astype(np.int32), covered, deeper)


def _reduce(last: bool):
    def run(batches):
        at, rows = None, []
        for batch in batches:
            for part, *blobs in zip(*(batch.column(c).to_pylist() for c in _BLOB.names)):
                if part != at and rows:
                    yield _settle(rows, last)
                    rows = []
                at = part
                rows.append(blobs)
        if rows:
            yield _settle(rows, last)

    return run


def _without(text: bytes, spans) -> tuple[bytes, int, int]:
    """The text without its spans, and the bytes and the runs of bytes that went."""
    if not spans.is_valid or not len(spans.values):
        return text, 0, 0
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, spans.values.field("lo").to_numpy(), 1)
    np.add.at(edge, spans.values.field("hi").to_numpy(), -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


_CUT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("kept", pa.binary()),
])


def _cut(batches):
    for batch in batches:
        out = [[] for _ in _CUT]
        for i, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_spans")):
            kept, removed, runs = _without(text or b"", spans)
            for column, value in zip(out, (i, len(text or b""), removed, runs, hashlib.sha256(kept).hexdigest(), kept)):
                column.append(value)
        yield rows_out(_CUT, *out)


def _strip(names: list[str], text: str):
    def run(batches):
        for batch in batches:
            texts, stays, lengths = [], [], []
            for old, spans in zip(batch.column(text), batch.column("_spans")):
                value, kept, removed = old.as_py(), None, 0
                if spans.is_valid:
                    kept, removed, _ = _without(value.encode(), spans)
                    value = kept.decode("utf-8", "ignore")
                texts.append(value)
                stays.append(not removed or bool(value.strip()))
                lengths.append(None if value is None else len(value))
            columns = {n: batch.column(n) for n in names} | {text: pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(stays))

    return run


def repeated_spans(docs: DataFrame, length: int = 200, prefix: int = 100, text: str = "text", part_bytes: int = 8 << 20) -> DataFrame:
    """Byte spans (``doc_id, copy, lo, hi``) of strings of ``length`` bytes that also start elsewhere.

    ``copy`` is the hash of the text, so rows that repeat an id are told apart.
    1. Every document is sampled (``sample``); a sampled position is named by its
       ``prefix`` bytes. Names that come once drop out, and with them all text that
       nowhere repeats.
    2. Where all positions of a name also agree in everything their strings span, all
       these strings repeat. Else one position of each kind goes on: its strings are
       named in ranges of twelve, and what is still open one by one. These last
       names are whole strings, so equal neighbours are repeats.
    Names travel packed by the part that sorts them; equal ones of one piece of text
    are combined before, so a passage in a third of all documents is one entry a piece.
    """
    whole = lean(docs).select("doc_id", F.xxhash64(text).alias("copy"), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    total = text_bytes(whole)
    widths = [length - prefix + 1, 12, 1]
    found, work = None, whole
    for level, width in enumerate(widths):
        parts = max(1, -(-total * (40 if level == 0 else 12) // 64 // part_bytes))
        last = width == 1
        blobs = work.mapInArrow(_emit(width, length, prefix, parts, level == 0), _BLOB_SQL)
        rows = stored(blobs.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(_reduce(last), _ROW_SQL), f"level{level}")
        spans = rows.where("covered").select("doc_id", "copy", (F.col("at") - F.col("far")).alias("lo"), (F.col("at") - F.col("near") + length).alias("hi"))
        found = spans if found is None else found.unionByName(spans)
        if not last:
            entry = F.collect_set(F.struct("at", "near", "far")).alias("entries")
            lists = rows.where("deeper").groupBy("doc_id", "copy").agg(entry)
            texts = work.select("doc_id", "copy", "text").dropDuplicates(["doc_id", "copy"]) if level else whole.select("doc_id", "copy", "text")
            lists = lists.select(F.col("doc_id").alias("on_id"), F.col("copy").alias("on_copy"), "entries")
            met = texts.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("on_id")) & (F.col("copy") == F.col("on_copy")))
            work = stored(met.select("doc_id", "copy", "text", "entries"), f"work{level}")
    return found


def remove_repeats(docs: DataFrame, length: int = 200, prefix: int = 100, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else,
    in the same document or another one, is removed; ``kept`` is the rest. Strings are
    judged on the input (``repeated_spans``), matches never cross documents. Equal
    texts remove each other whole. Null texts count as empty; null and repeated ids
    are rows as any other; other columns of ``docs`` are left out.
    """
    whole = docs.select("doc_id", F.col(text).alias("text"))
    return _marked(whole, repeated_spans(docs, length, prefix, text), "text").select("doc_id", "text", "_spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _marked(docs: DataFrame, spans: DataFrame, text: str) -> DataFrame:
    """Rows of ``docs`` with the list of their spans, null if there are none."""
    lists = spans.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "_spans")
    mine = docs.withColumn("_mine", F.xxhash64(text))
    return mine.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mine") == F.col("_copy")), "left").select(*docs.columns, "_spans")


def strip_repeats(docs: DataFrame, length: int = 200, prefix: int = 100, text: str = "text") -> DataFrame:
    """``docs`` with what ``remove_repeats`` leaves of each text, all other columns kept.

    Where a cut falls inside of a character, the rest of that character goes too.
    Documents of which nothing but white space is left go; texts that lose nothing,
    null and empty ones too, stay as they are. A column ``n_chars`` follows the text.
    """
    marked = _marked(docs, repeated_spans(docs, length, prefix, text), text)
    return marked.mapInArrow(_strip(docs.columns, text), docs.schema)
