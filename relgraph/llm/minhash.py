"""MinHash near-duplicates by tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import lean, mix, rows_out, slices, stored
from relgraph.llm.blocks import meet_blocks, unpack_sets
from relgraph.llm.components import components
from relgraph.llm.jaccard import shingle_sets

_PIECE = 1 << 20  # bytes of text hashed at once
_REST = "rest"  # the cell of components without blocks of their own
_RUN = 1 << 17  # shingles whose minima are taken at once


def half_keys(value: np.ndarray, row: np.ndarray, rows: int, keys: int, hashes: int) -> np.ndarray:
    """Two collections of ``keys`` keys for each row, each of the minima of ``hashes`` hash functions."""
    out = np.zeros((rows, 2 * keys), np.uint64)
    least = np.full((rows, 2 * keys * hashes), np.iinfo(np.uint64).max, np.uint64)
    seeds = mix(np.arange(1, 2 * keys * hashes + 1, dtype=np.uint64)) | np.uint64(1)
    for lo in range(0, len(value), _RUN):
        part, of = value[lo: lo + _RUN], row[lo: lo + _RUN]
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for k, seed in enumerate(seeds):
            mixed = (part ^ (part >> np.uint64(29))) * seed
            mixed ^= mixed >> np.uint64(32)
            low = np.minimum.reduceat(mixed, starts)
            least[of[starts], k] = np.minimum(least[of[starts], k], low)
    for key in range(2 * keys):
        for h in range(hashes):
            out[:, key] = mix(out[:, key] * np.uint64(0x2545F4914F6CDD1D) + least[:, key * hashes + h] + np.uint64(key + 1))
    return out


def _cards(width: int, keys: int, hashes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                        ("halves", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _PIECE):
                value, row = shingle_sets(part.column("text"), width)
                n = np.bincount(row, minlength=part.num_rows)
                sums = _set_sums(value, n)
                halves = half_keys(value, row, part.num_rows, keys, hashes).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, halves.size + 1, 2 * keys, dtype=np.int32), pa.array(halves.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n), *map(pa.array, sums), lists], schema=schema)

    return run, "doc_id long, n_shingles long, set_a long, set_b long, halves array<long>"


def _set_sums(value: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes that stand for each set."""
    ends, out = np.cumsum(n), []
    for seed in (31, 37):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value + np.uint64(seed)), dtype=np.uint64)])
        out.append((total[ends] - total[ends - n]).view(np.int64))
    return out


def _sets(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("items", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _PIECE):
                value, row = shingle_sets(part.column("text"), width)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield rows_out(schema, part.column("doc_id"), *_set_sums(value, np.diff(cuts)), [value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])

    return run, "doc_id long, set_a long, set_b long, items binary"


def _confirm(share: int):
    """The pairs of sets that link, by the sets themselves."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            for half in slices(batch, "items_a", _PIECE):
                for part in slices(half, "items_b", _PIECE):
                    (va, ra), (vb, rb) = (unpack_sets(part.column(c).to_pylist()) for c in ("items_a", "items_b"))
                    value, row = np.concatenate([va, vb]), np.concatenate([ra, rb])
                    order = np.lexsort((value, row))
                    value, row = value[order], row[order]
                    both = np.bincount(row[1:][(value[1:] == value[:-1]) & (row[1:] == row[:-1])], minlength=part.num_rows)
                    linked = pa.array(100 * both >= share * (np.bincount(row, minlength=part.num_rows) - both))
                    yield rows_out(schema, part.column("a").filter(linked), part.column("b").filter(linked))

    return run, "a long, b long"


def tables(reps: DataFrame, keys: int) -> DataFrame:
    """``rep, n, key``: the table keys of sets that can meet another one.

    A table key is a key of the first collection with one of the second, ``keys`` squared
    in all. Only those halves are combined that two sets have, since no table has others.
    """
    halves = reps.select("rep", "n", F.posexplode("halves").alias("at", "half"))
    shared = halves.groupBy("at", "half").agg(F.count("*").alias("k")).where("k > 1").select("at", "half")
    half = F.struct("at", "half")
    sides = [F.collect_list(F.when(F.col("at") < keys, half)).alias("first"), F.collect_list(F.when(F.col("at") >= keys, half)).alias("second")]
    met = halves.join(shared, ["at", "half"]).groupBy("rep", "n").agg(*sides)  # at most ``keys`` entries each
    met = met.select("rep", "n", F.explode("first").alias("x"), "second").select("rep", "n", "x", F.explode("second").alias("y"))
    return met.select("rep", "n", F.xxhash64("x", "y").alias("key"))


def _blocks(members: DataFrame, sets: DataFrame, share: int, block_items: int) -> tuple[DataFrame, DataFrame]:
    """Members of each lead (``lead, rep, n, comp``) in blocks of about ``block_items`` items, and the pairs of blocks to compare.

    Sets of different size bands that are not next to each other can't link, and a
    component with items for a block has blocks of its own, which need no comparison
    with each other.
    """
    cell = ["lead", "band", "cell"]
    rows = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / share))))
    large = rows.groupBy("lead", "band", "comp").agg(F.sum("n").alias("items")).where(f"items >= {block_items}")
    rows = rows.join(large.select("lead", "band", "comp", F.col("comp").alias("own")), ["lead", "band", "comp"], "left")
    rows = rows.withColumn("cell", F.coalesce(F.col("own").cast("string"), F.lit(_REST)))
    dealt = rows.groupBy(*cell).agg(F.ceil(F.sum("n") / block_items).alias("blocks"))
    rows = rows.join(dealt, cell).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    rows = rows.join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep")
    blocks = stored(rows.groupBy(*cell, "block").agg(F.collect_list(F.struct("rep", "comp", "items")).alias("members")), "blocks")
    names = blocks.select(*cell, "block")
    x, y = names.alias("x"), names.alias("y")
    near = (F.col("x.lead") == F.col("y.lead")) & F.col("y.band").between(F.col("x.band"), F.col("x.band") + 1)
    once = (F.col("x.band") < F.col("y.band")) | (F.struct("x.cell", "x.block") <= F.struct("y.cell", "y.block"))
    differ = (F.col("x.cell") != F.col("y.cell")) | (F.col("x.cell") == _REST)
    pairs = x.join(y, near & once & differ).select(
        *(F.col(f"x.{c}").alias(c) for c in (*cell, "block")), *(F.col(f"y.{c}").alias(f"to_{c}") for c in ("band", "cell", "block")))
    return blocks, stored(pairs, "block_pairs")


def near_duplicates(docs: DataFrame, width: int = 3, share: int = 85, keys: int = 10, hashes: int = 3, text: str = "text",
                    block_items: int = 1 << 16) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; of each component its smallest id is kept.

    A document's set are the distinct ``width``-word shingles of its text, A-Z lower-cased;
    two documents link when their sets share ``share`` % or more of their union. Equal sets
    are one class from the start.

    Two collections of ``keys`` keys, each of ``hashes`` minima, take 2 * keys * hashes hash functions
    and give keys * keys tables of 2 * hashes minima each; as many tables of their own would take
    keys times as many functions. Sets of similarity s meet in a table with probability
    (1 - (1 - s^hashes)^keys)^2: 0.9998 at 0.85 with the defaults, more above it.

    The sets of a table that meet are compared with the smallest of them, by all their
    shingles. So thousands of near copies take a comparison each, not one for each pair.
    Where sets of one table are still in different components after that, all sets of the
    tables with the same smallest one are compared, in blocks, as products of 0/1 matrices
    that give all overlaps of two blocks without a row for each pair. So every pair that
    meets in a table is decided, by full sets.

    Null and empty texts have no shingles and stay alone; null ids are alone with a null
    component and are kept. Repeated rows are returned as often as they come; where rows
    with different texts bear one id, the first of them by hash of its set stands for it.
    Other columns are left out; an empty table gives no rows.
    """
    whole = lean(docs).select("doc_id", F.col(text).alias("text"))
    run, schema = _cards(width, keys, hashes)
    cards = stored(whole.mapInArrow(run, schema), "cards")
    same = ["n_shingles", "set_a", "set_b"]
    named = cards.where("doc_id is not null and n_shingles > 0")
    reps = stored(named.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves")), "reps")
    # an id that is the smallest of several sets stands for one of them
    chosen = reps.groupBy("rep").agg(F.min_by("halves", F.struct(*same)).alias("halves"), F.min(F.struct(*same)).alias("s"))
    chosen = stored(chosen.select("rep", F.col("s.n_shingles").alias("n"), "s.set_a", "s.set_b", "halves"), "chosen")
    made = stored(tables(chosen, keys), "tables")
    leads = made.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("k")).where("k > 1").select("key", "lead")
    met = stored(made.join(leads, "key").where("rep <> lead"), "met")
    pairs = stored(met.select("lead", "rep").distinct(), "pairs")

    ids = pairs.select(F.col("lead").alias("rep")).unionByName(pairs.select("rep")).distinct().join(chosen, "rep").select(
        F.col("rep").alias("doc_id"), "set_a", "set_b")
    run, schema = _sets(width)
    texts = whole.join(ids.select("doc_id").hint("merge"), "doc_id")
    drawn = stored(texts.mapInArrow(run, schema), "drawn")
    sets = drawn.join(ids, ["doc_id", "set_a", "set_b"]).groupBy("doc_id").agg(F.first("items").alias("items"))
    sets = stored(sets, "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    size_a, size_b = F.octet_length("items_a"), F.octet_length("items_b")
    near = pairs.select(F.col("lead").alias("a"), F.col("rep").alias("b")).join(one.hint("merge"), "a").join(two.hint("merge"), "b")
    run, schema = _confirm(share)
    links = stored(near.where(F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * share).mapInArrow(run, schema), "links")
    groups = stored(components(links), "groups").withColumnRenamed("node", "rep")

    placed = met.join(groups, "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key")
    members = stored(placed.join(mixed, "key").select("lead", "rep", "n", "comp").distinct(), "members")
    blocks, both = _blocks(members, sets, share, block_items)
    here = ["lead", "band", "cell", "block"]
    there = blocks.select("lead", *(F.col(c).alias(f"to_{c}") for c in here[1:]), F.col("members").alias("y"))
    joined = both.join(blocks.withColumnRenamed("members", "x"), here).join(there, ["lead", "to_band", "to_cell", "to_block"])
    run, schema = meet_blocks(share)
    more = stored(joined.select("x", "y").mapInArrow(run, schema), "more")
    links = links.unionByName(more.distinct())
    groups = stored(components(links), "groups").withColumnRenamed("node", "rep")

    class_of = reps.select(*same, "rep").join(groups, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    found = cards.join(class_of, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
