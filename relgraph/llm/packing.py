"""Packing into windows by lexical retrieval."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relgraph.llm.common import lean, rows_out, slices, stored
from relgraph.llm.tokens import DEFAULT, encode

K1, B = 1.2, 0.75
#: Heaviest terms by which a document is put in order, and the share of a shard's rows that must have such a term.
ROUTES, COMMON = 3, 0.2
#: Neighbours that are sorted at first; the others follow when the window has room left.
NEAREST = 64
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
COUNTS = pa.schema([("token", pa.int64()), ("rows", pa.int64())])


class Weights:
    """BM25 weights by the statistics of all documents: rows of each term, number of rows, mean length."""

    def __init__(self, df: np.ndarray, rows: int, mean: float):
        self.df, self.mean = df, mean
        self.idf = np.log1p((rows - df + 0.5) / (df + 0.5))

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms of a document and their weights."""
        terms, tf = np.unique(ids, return_counts=True)
        return terms, self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / self.mean))

    def route(self, ids: np.ndarray, common: float) -> list[int]:
        """The heaviest of the terms that at least ``common`` rows have, then the heaviest that another row has; -1 for none."""
        terms, weight = self.of(ids)
        order = terms[np.argsort(-weight, kind="stable")]
        found = order[self.df[order] >= max(2.0, common)][:ROUTES].tolist()
        return found + [-1] * (ROUTES - len(found)) + (order[self.df[order] > 1][:1].tolist() or [-1])


class Index:
    """An inverted index of one shard with the BM25 weight of each posting."""

    def __init__(self, docs: list[np.ndarray], weights: Weights):
        self.terms, values = zip(*(weights.of(d) for d in docs))
        self._doc = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        self._term, self._weight = np.concatenate(self.terms).astype(np.int64), np.concatenate(values)
        order = np.argsort(self._term, kind="stable")
        self._doc, self._term, self._weight = self._doc[order], self._term[order], self._weight[order]
        self.rows = self.held = len(docs)
        self._size = len(weights.df)
        self._begin = np.searchsorted(self._term, np.arange(self._size + 1))

    def keep(self, unused: np.ndarray) -> None:
        """Leave out postings of used documents once they are the half of all."""
        left = int(np.count_nonzero(unused))
        if 2 * left <= self.held:
            kept = unused[self._doc]
            self._doc, self._term, self._weight = self._doc[kept], self._term[kept], self._weight[kept]
            self.held = left
            self._begin = np.searchsorted(self._term, np.arange(self._size + 1))

    def neighbours(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with ``doc``, best first."""
        parts = [slice(a, b) for a, b in zip(self._begin[self.terms[doc]], self._begin[self.terms[doc] + 1]) if b > a]
        if not parts:
            return
        found = np.concatenate([self._doc[p] for p in parts])
        score = np.bincount(found, np.concatenate([self._weight[p] for p in parts]), minlength=self.rows)
        hit = np.flatnonzero((score > 0) & unused)
        near, rest = hit, hit[:0]
        if len(hit) > NEAREST:
            least = np.partition(score[hit], -NEAREST)[-NEAREST]
            near, rest = hit[score[hit] >= least], hit[score[hit] < least]
        for some in (near, rest):
            yield from some[np.argsort(-score[some], kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], window: int, weights: Weights):
    """``(doc, start, length, sequence, offset)`` of every piece of one shard.

    Whole windows are cut off the front of long documents. Each rest is then a seed,
    longest first: its window takes the unused rests that the index returns, best
    first, and after them any unused ones. What no longer fits is cut, and the
    remainder stays unused. So only the last window of a shard has padding.
    """
    sequence = 0
    begin = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs], np.int64)
    for k in range(len(docs)):
        while left[k] >= window:
            yield k, int(begin[k]), window, sequence, 0
            begin[k] += window
            left[k] -= window
            sequence += 1
    index = Index(docs, weights)
    queue = np.argsort(-left, kind="stable")
    at = 0

    def unused():
        nonlocal at
        while at < len(queue) and not left[queue[at]]:
            at += 1
        return queue[at] if at < len(queue) else None

    while (seed := unused()) is not None:
        full = int(left[seed])
        yield int(seed), int(begin[seed]), full, sequence, 0
        begin[seed] += full
        left[seed] = 0
        index.keep(left > 0)
        near = index.neighbours(int(seed), left > 0)
        while full < window:
            other = next(near, None)
            if other is None and (other := unused()) is None:
                break
            take = int(min(left[other], window - full))
            yield int(other), int(begin[other]), take, sequence, full
            begin[other] += take
            left[other] -= take
            full += take
        sequence += 1


def _encode(path: str, end_id: int, width: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = part.column("text").to_pylist()
                rows = [np.append(ids, np.uint32(end_id)).astype(width) for ids in encode(texts, path)]
                sizes = [len((t or "").encode()) for t in texts]
                yield rows_out(ENCODED, part.column("doc_id"), [r.tobytes() for r in rows], [len(r) for r in rows], sizes)

    return run


def _count(size: int, width: str):
    def run(batches):
        rows = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                rows[np.unique(np.frombuffer(ids.as_buffer(), width))] += 1
        tokens = np.flatnonzero(rows)
        yield rows_out(COUNTS, tokens, rows[tokens])

    return run


def _routed(weights: Weights, common: float, width: str):
    def run(batches):
        for batch in batches:
            routes = [weights.route(np.frombuffer(ids.as_buffer(), width), common) for ids in batch.column("ids")]
            for k in range(ROUTES + 1):
                batch = batch.append_column(f"route{k}", pa.array([r[k] for r in routes], pa.int64()))
            yield batch

    return run


def _pack(window: int, weights: Weights, most: int, width: str):
    def shard(names: list, docs: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        rows = [
            (names[k], start, length, zlib.crc32(docs[k][start: start + length].astype("<u4").tobytes()), len(docs[k]), first + sequence, offset)
            for k, start, length, sequence, offset in pack_shard(docs, window, weights)
        ]
        return rows_out(SCHEMA, *zip(*rows)), rows[-1][5] + 1

    def run(batches):
        names, docs, held = [], [], 0
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                names.append(name)
                docs.append(np.frombuffer(ids.as_py(), width))
                held += len(docs[-1])
                if held >= most:
                    out, at = shard(names, docs, at)
                    yield out
                    names, docs, held = [], [], 0
        if docs:
            yield shard(names, docs, at)[0]

    return run


def pack(docs: DataFrame, path: str = DEFAULT, end_id: int = 1, window: int = 2048, shard_bytes: int = 8 << 20, text: str = "text") -> DataFrame:
    """Pieces of all ``docs`` in windows: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Documents are encoded once, into the shared folder. Rows of each term, number of
    rows and mean length are counted over all of them; what comes to the driver has a
    row for each id of the vocabulary at most. Documents are put in one order by their
    heaviest terms that are common enough for a shard, so those that share such terms
    lie together, and the order is cut into ranges of about ``shard_bytes`` of text.
    Row numbers end the order, so copies of any number are cut as well. A range is one
    shard, or several where it holds more than twice that size, so a task holds
    twice a shard and its longest document. Each shard is indexed by all of its terms and
    packed (``pack_shard``).

    Null texts count as empty and give the end id alone. Rows with null or repeated
    ids are documents as any other. An empty table gives no rows; other columns of
    ``docs`` are left out.
    """
    size = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows = lean(docs).select("doc_id", F.col(text).alias("text"))
    ids = stored(rows.mapInArrow(_encode(path, end_id, width), "doc_id long, ids binary, n_ids long, n_bytes long"), "ids")
    n, n_ids, n_bytes = ids.agg(F.count(F.lit(1)), F.sum("n_ids"), F.sum("n_bytes")).first()
    n_ids = n_ids or 0
    shards = max(1, -(-(n_bytes or 0) // shard_bytes))
    df = np.zeros(size, np.int64)
    counted = ids.select("ids").mapInArrow(_count(size, width), "token long, rows long")
    for token, found in counted.groupBy("token").agg(F.sum("rows")).collect():
        df[token] = found
    weights = Weights(df, n, n_ids / max(n, 1))
    routes = [f"route{k}" for k in range(ROUTES + 1)]
    routed = ids.select("doc_id", "ids").mapInArrow(
        _routed(weights, COMMON * n / shards, width), "doc_id long, ids binary, " + ", ".join(f"{r} long" for r in routes)
    )
    order = [*routes, "doc_id", "_row"]
    ranges = routed.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return ranges.select("doc_id", "ids").mapInArrow(
        _pack(window, weights, 2 * max(1, n_ids // shards), width),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
