"""Token files of directly addressable codes.

A file set is a Parquet table of segments. A segment holds the ids of documents one
after the other. Each id is cut into chunks of bits, lowest first, with no more chunks
than it needs. Level k holds the k-th chunks of all ids that have one; a bitmap says
for each of them whether a next chunk follows, and a rank directory holds the ones of
the bitmap before every 512th bit. So any id is read by one look at each level:
position, bit, rank, and on to the next level.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relgraph.llm.common import lean, rows_out, slices, stored, text_bytes
from relgraph.llm.tokens import DEFAULT, encode

BLOCK = 512  # bits between two entries of a rank directory
SCHEMA = (
    "part int, segment int, n_tokens long, doc_ids binary, nulls binary, doc_starts binary, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)


class Codes:
    """Ids as levels of chunks; ``widths`` are the bits of each level."""

    def __init__(self, widths, chunks, bitmaps, ranks, size):
        self.widths, self.chunks, self.bitmaps, self.ranks, self.size = widths, chunks, bitmaps, ranks, size

    @classmethod
    def build(cls, ids: np.ndarray, widths=(8, 8, 16)) -> Codes:
        rest, chunks, bitmaps, ranks = ids.astype(np.uint32), [], [], []
        for level, width in enumerate(widths):
            chunks.append((rest & np.uint32((1 << width) - 1)).astype("<u1" if width <= 8 else "<u2"))
            rest = rest >> np.uint32(width)
            more = (rest > 0) if level < len(widths) - 1 else np.zeros(len(rest), bool)
            ones = np.concatenate([[0], np.cumsum(more)])
            bitmaps.append(np.packbits(more, bitorder="little"))
            ranks.append(ones[:: BLOCK].astype("<u4"))
            rest = rest[more]
        return cls(widths, chunks, bitmaps, ranks, len(ids))

    def _follow(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a next chunk follows at these places, and its place in the next level."""
        bits = self.bitmaps[level]
        on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        at = at[on]
        rank = self.ranks[level][at // BLOCK].astype(np.int64)
        # ones between the directory entry and the place: whole bytes, then the bits of the last one
        first, last = at // BLOCK * (BLOCK // 8), at >> 3
        ones = np.concatenate([[0], np.cumsum(_ONES[bits])])
        rank += ones[last] - ones[first] + _ONES[bits[last] & ((1 << (at & 7)) - 1).astype(np.uint8)]
        return on, rank

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, each by its own way through the levels."""
        at, whole = np.asarray(places, np.int64), np.arange(len(places))
        out, shift = np.zeros(len(places), np.uint32), 0
        for level, width in enumerate(self.widths):
            if not len(at):
                break
            out[whole] |= self.chunks[level][at].astype(np.uint32) << np.uint32(shift)
            shift += width
            if level + 1 < len(self.widths):
                on, at = self._follow(level, at)
                whole = whole[on]
        return out

    def one(self, place: int) -> int:
        """A single id, from a few bytes of each level."""
        value = shift = 0
        for level, width in enumerate(self.widths):
            value |= int(self.chunks[level][place]) << shift
            shift += width
            bits = self.bitmaps[level]
            if not bits[place >> 3] >> (place & 7) & 1:
                return value
            block = place // BLOCK
            ones = _ONES[bits[block * (BLOCK // 8): place >> 3]].sum() + _ONES[bits[place >> 3] & ((1 << (place & 7)) - 1)]
            place = int(self.ranks[level][block]) + int(ones)
        return value


_ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)


def _segment(part, number, docs, widths):
    ids = np.concatenate([d[1] for d in docs])
    starts = np.concatenate([[0], np.cumsum([len(d[1]) for d in docs])]).astype("<i8")
    codes = Codes.build(ids, widths)
    names = np.array([0 if d[0] is None else d[0] for d in docs], "<i8")
    return (part, number, len(ids), names.tobytes(), np.array([d[0] is None for d in docs]).tobytes(), starts.tobytes(),
            [c.tobytes() for c in codes.chunks], [b.tobytes() for b in codes.bitmaps], [r.tobytes() for r in codes.ranks])


def _write(path: str, end_id: int, widths, segment_tokens: int):
    schema = pa.schema([
        ("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()),
        ("doc_starts", pa.binary()), *((n, pa.list_(pa.binary())) for n in ("chunks", "bitmaps", "ranks")),
    ])

    def run(batches):
        docs, held, number, part = [], 0, 0, 0
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                texts = piece.column("text").to_pylist()
                part = piece.column("part")[0].as_py()
                for i, ids in zip(piece.column("doc_id").to_pylist(), encode(texts, path)):
                    docs.append((i, np.append(ids, np.uint32(end_id))))
                    held += len(ids) + 1
                    if held >= segment_tokens:
                        yield rows_out(schema, *([v] for v in _segment(part, number, docs, widths)))
                        docs, held, number = [], 0, number + 1
        if docs:
            yield rows_out(schema, *([v] for v in _segment(part, number, docs, widths)))

    return run


def write_tokens(docs: DataFrame, out: str, path: str = DEFAULT, end_id: int = 0, widths=(8, 8, 16),
                 segment_tokens: int = 1 << 19, text: str = "text", part_bytes: int = 16 << 20) -> None:
    """Write the ids of ``docs`` to the folder ``out``, in ascending order of ``doc_id``.

    Documents are put in order by ranges of ids, and each range is encoded where it
    lies. ``end_id`` follows each document. Segments end after ``segment_tokens`` ids
    at the next end of a document. Null texts count as empty, null ids come first,
    rows that repeat an id lie next to each other in the order of their texts; an empty
    table gives an empty folder of files. Other columns are left out.
    """
    ranges = max(1, -(-text_bytes(lean(docs), text) // part_bytes))
    ordered = docs.select("doc_id", F.col(text).alias("text")).repartitionByRange(ranges, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select(
        F.spark_partition_id().alias("part"), "doc_id", "text"
    )
    ordered.mapInArrow(_write(path, end_id, widths, segment_tokens), SCHEMA).write.parquet(out)


def _read(widths):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kinds = ["<u1" if w <= 8 else "<u2" for w in widths]
                codes = Codes(
                    widths, [np.frombuffer(c, k) for c, k in zip(row["chunks"], kinds)], [np.frombuffer(b, np.uint8) for b in row["bitmaps"]],
                    [np.frombuffer(r, "<u4") for r in row["ranks"]], row["n_tokens"],
                )
                starts = np.frombuffer(row["doc_starts"], "<i8")
                names = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["nulls"], bool))
                at = 0
                while at < len(names):
                    to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 18), side="right")) - 1)
                    ids = codes.take(np.arange(starts[at], starts[to]))
                    cuts = starts[at: to + 1] - starts[at]
                    yield rows_out(schema, names[at:to], starts[at:to] + row["start"], np.diff(cuts),
                                   [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])])
                    at = to

    return run


def _with_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with the number of ids before each; summed up by part, then inside of the part."""
    segments = spark.read.schema(SCHEMA).parquet(folder)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    parts = parts.select("part", before.alias("before"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = segments.select("part", "segment", "n_tokens").withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    # three numbers a segment; written, so that their size decides how they are joined
    starts = stored(sums.join(parts, "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("start")), "starts")
    return segments.join(starts, ["part", "segment"])


def read_tokens(spark: SparkSession, folder: str, widths=(8, 8, 16)) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents; ids as little-endian unsigned 32-bit integers."""
    return _with_starts(spark, folder).mapInArrow(_read(widths), "doc_id long, start long, n_tokens long, ids binary")


def read_at(spark: SparkSession, folder: str, places: DataFrame, widths=(8, 8, 16)) -> DataFrame:
    """The ids at any ``place`` of all ids: ``place, id``, without decoding what lies around them."""
    segments = _with_starts(spark, folder)
    spans = segments.select("part", "segment", "start", (F.col("start") + F.col("n_tokens")).alias("stop"))
    # places are matched by blocks of positions, so that the range join stays an equi-join
    width = 1 << 19
    blocks = spans.withColumn("block", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(stop - 1) div {width}"))))
    asked = places.select("place").where("place >= 0").withColumn("block", F.expr(f"place div {width}"))
    found = asked.join(blocks, "block").where("place >= start and place < stop").groupBy("part", "segment").agg(
        F.collect_list("place").alias("places")
    )
    schema = pa.schema([("place", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kinds = ["<u1" if w <= 8 else "<u2" for w in widths]
                codes = Codes(
                    widths, [np.frombuffer(c, k) for c, k in zip(row["chunks"], kinds)], [np.frombuffer(b, np.uint8) for b in row["bitmaps"]],
                    [np.frombuffer(r, "<u4") for r in row["ranks"]], row["n_tokens"],
                )
                yield rows_out(schema, row["places"], [codes.one(p - row["start"]) for p in row["places"]])

    return segments.join(found, ["part", "segment"]).mapInArrow(run, "place long, id long")


def digests(tokens: DataFrame) -> DataFrame:
    """CRC-32 of the ids of each document in place of the ids."""
    return tokens.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
