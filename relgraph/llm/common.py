"""What the operators share: stored tables, text batches and byte kernels."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.session import shared_dir

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
# workers live on between stages; this pool gives what a batch took back at once
pa.set_memory_pool(pa.system_memory_pool())
#: White space between words: blank and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, folder: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage there.

    In a ``folder`` of ``session.scratch`` it is removed with that folder.
    """
    path = f"{folder or shared_dir(df.sparkSession) + '/relgraph-llm'}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> DataFrame:
    """``df``, read from a table, after shuffle files that nobody reads any more were let go.

    Spark removes them when the driver has collected its garbage, and a driver with room to spare does so after the disk is
    full. What the first collection lets go of refers to the rest.
    """
    for _ in range(2):
        gc.collect()
        df.sparkSession._jvm.java.lang.System.gc()
    return df


def lean(df: DataFrame) -> DataFrame:
    """``df`` itself, after a smaller bound on the rows of an Arrow batch: whole texts may be long."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts hold about ``limit`` bytes, one row at least."""
    sizes = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at, rows = 0, batch.num_rows
    while at < rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets of each; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, (offsets - offsets[0]) if len(offsets) else np.zeros(1, np.int64)


_RNG = np.random.default_rng(20240229)
#: One random number per byte; ``FOLDED`` takes A-Z as a-z.
BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        size = max(size, 1 << 20)
        both = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        _powers[:] = both
    return _powers[0][:size], _powers[1][:size]


class Spans:
    """Hashes of any span of a byte array, each in constant time."""

    def __init__(self, body: np.ndarray, values: np.ndarray = BYTE):
        up, self.down = powers(len(body) + 1)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(values[body] * up[: len(body)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + np.asarray(end - start).astype(np.uint64))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in all texts, and the number of words of each text."""
    inside = np.zeros(len(body) + 1, bool)
    inside[:-1] = ~_IS_SPACE[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(body)]
    first[cuts] = inside[cuts]
    last = ~inside
    last[cuts] = True
    last[1:] &= inside[:-1]
    last[0] = False
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, counts


def rows_out(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
