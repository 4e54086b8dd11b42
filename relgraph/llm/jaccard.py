"""N-gram Jaccard join by signature trees."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.blocks import meet_blocks
from relgraph.llm.common import FOLDED, flat, lean, mix, release, rows_out, slices, stored, text_bytes, words, Spans
from relgraph.llm.components import components
from relgraph.session import scratch

WORDS = 16  # 64-bit words of a bitmap
_SHARED = "shared"  # the cell of components without leaves of their own
_SET = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64())])
_PIECE = 1 << 20  # bytes of text hashed at once


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the row of each."""
    body, offsets = flat(column)
    starts, ends, counts = words(body, offsets)
    word = Spans(body, FOLDED).hash(starts, ends)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    each = np.maximum(counts - width + 1, (counts > 0).astype(counts.dtype))
    shingle_row = np.repeat(np.arange(len(counts)), each)
    at = first[shingle_row] + np.arange(len(shingle_row)) - np.repeat(np.cumsum(each) - each, each)
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        place = np.minimum(at + k, len(word) - 1)
        inside = (at + k < len(word)) & (row[place] == shingle_row) if len(word) else np.zeros(0, bool)
        value = np.where(inside, mix(value * np.uint64(0x2545F4914F6CDD1D) + word[place] + np.uint64(k + 1)), value)
    order = np.lexsort((value, shingle_row))
    value, shingle_row = value[order], shingle_row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (shingle_row[1:] != shingle_row[:-1])
    return value[new], shingle_row[new]


def _sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sum of 64-bit values by row, modulo 2^64; rows are in order."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    ends = np.searchsorted(row, np.arange(rows), side="right")
    begins = np.searchsorted(row, np.arange(rows), side="left")
    return total[ends] - total[begins]


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _PIECE):
                value, row = shingle_sets(part.column("text"), width)
                n = np.bincount(row, minlength=part.num_rows)
                a, b = (_sums(mix(value + np.uint64(s)), row, part.num_rows).view(np.int64) for s in (11, 23))
                yield rows_out(_SET, part.column("doc_id"), n, a, b)

    return run


class Classes:
    """Size classes: sets of ``share`` % or more in common are in one class or in two next to each other."""

    def __init__(self, share: int, largest: int):
        self.share, self.bounds = share, [1]
        while len(self.bounds) < 3 or self.bounds[-3] <= largest:
            self.bounds.append(self.bounds[-1] * 100 // share + 1)
        self.bounds = np.array(self.bounds, np.int64)
        both = self.bounds[1:-1] + self.bounds[2:] - 2
        least = both * (100 - share) // (100 + share) + 1
        # parts without a shingle say nothing: as many parts more as are likely to be empty
        self.spare = np.zeros(len(least), np.int64)
        for _ in range(8):
            empty = (least + self.spare) * np.exp(-self.bounds[: len(least)] / (least + self.spare))
            self.spare = np.where(least > 2, np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64), 0)
        self.count = least + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, side="right") - 1

    def parts(self, k: np.ndarray) -> np.ndarray:
        """Over the elements in which two linked sets of class ``k`` and ``k + 1`` can differ, by one and by the spare parts.

        So one part is equal, and one with shingles in it if either set has no more
        than ``spare`` empty ones.
        """
        return self.count[np.minimum(k, len(self.count) - 1)]


def _entries(width: int, share: int, largest: int, shares: int):
    """For each set the roots it hangs under, packed by the partition that reads them."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("ns", pa.binary()), ("own", pa.binary())])
    classes = Classes(share, largest)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                value, row = shingle_sets(piece.column("text"), width)
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.bincount(row, minlength=len(ids))
                # of equal sets in this piece, one is enough
                same = np.stack([n.astype(np.uint64), *(_sums(mix(value + np.uint64(s)), row, len(ids)) for s in (11, 23))])
                alone = np.zeros(len(ids), bool)
                alone[np.unique(same, axis=1, return_index=True)[1]] = True
                found = []
                for step in (0, 1):
                    group = classes.of(n) - step
                    use = alone & (n > 0) & (group >= 0)
                    parts = np.where(use, classes.parts(np.maximum(group, 0)), 0)
                    base = np.cumsum(parts) - parts
                    chosen = use[row]
                    slot = base[row[chosen]] + (mix(value[chosen] + np.uint64(5)) % np.maximum(parts[row[chosen]], 1).astype(np.uint64)).astype(np.int64)
                    content = np.zeros(int(parts.sum()), np.uint64)
                    np.add.at(content, slot, mix(value[chosen] + np.uint64(77)))
                    owner = np.repeat(np.arange(len(ids)), parts)
                    filled = np.zeros(len(content), bool)
                    filled[slot] = True
                    hollow = np.bincount(owner, ~filled, minlength=len(ids))
                    said = filled | (hollow > classes.spare[np.clip(group, 0, len(classes.spare) - 1)])[owner]
                    place = np.arange(len(owner)) - base[owner]
                    key = mix(content + mix((group[owner] * 1_000_003).astype(np.uint64) + mix(place.astype(np.uint64))))
                    found.append((key[said], ids[owner][said], n[owner][said].astype(np.int32), np.full(int(said.sum()), step == 0)))
                key, who, size, own = (np.concatenate(x) for x in zip(*found))
                part = (key >> np.uint64(40)) % np.uint64(shares)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(shares + 1))
                key, who, size, own = key[order], who[order], size[order], own[order]
                spans = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield rows_out(schema, *([f(p, a, b) for p, a, b in spans] for f in (
                    lambda p, a, b: p, lambda p, a, b: key[a:b].tobytes(), lambda p, a, b: who[a:b].tobytes(),
                    lambda p, a, b: size[a:b].tobytes(), lambda p, a, b: own[a:b].tobytes())))

    return run, "part int, keys binary, ids binary, ns binary, own binary"


def _roots(share: int):
    """Members of roots with company: ``root, doc_id``."""
    schema = pa.schema([("root", pa.int64()), ("doc_id", pa.int64())])

    def joined(rows):
        key, who, size, own = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate((np.uint64, np.int64, np.int32, bool)))
        order = np.lexsort((who, ~own, key))
        key, who, size, own = key[order], who[order], size[order], own[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        run_of = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(key)))
        # two members of the next class meet under that class's own roots
        keep = (count[run_of] > 1) & own[first][run_of]
        return rows_out(schema, key[keep].view(np.int64), who[keep])

    def run(batches):
        at, rows = None, []
        for batch in batches:
            for part, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "ids", "ns", "own"))):
                if part != at and rows:
                    yield joined(rows)
                    rows = []
                at = part
                rows.append(blobs)
        if rows:
            yield joined(rows)

    return run, "root long, doc_id long"


def _signatures(width: int):
    """A bitmap for each set, with its size and what its bits leave uncounted."""
    names = [f"w{k}" for k in range(WORDS)]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("slack", pa.int32()), *((w, pa.int64()) for w in names)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _PIECE):
                value, row = shingle_sets(part.column("text"), width)
                bit = (mix(value + np.uint64(99)) % np.uint64(64 * WORDS)).astype(np.int64)
                grid = np.zeros((part.num_rows, 64 * WORDS), np.uint8)
                grid[row, bit] = 1
                n = np.bincount(row, minlength=part.num_rows)
                packed = np.packbits(grid, axis=1, bitorder="little").view(np.int64)
                yield rows_out(schema, part.column("doc_id"), n, n - grid.sum(axis=1), *packed.T)

    return run, "doc_id long, n int, slack int, " + ", ".join(f"{w} long" for w in names)


def _bound(share: int):
    """Whether two nodes can hold linked sets: sizes near enough, and enough bits in common."""
    common = sum((F.bit_count(F.col(f"x.w{k}").bitwiseAND(F.col(f"y.w{k}"))) for k in range(1, WORDS)),
                 F.bit_count(F.col("x.w0").bitwiseAND(F.col("y.w0"))))
    most = F.least(F.col("x.slack") + common, F.col("y.slack") + common, F.col("x.hi"), F.col("y.hi"))
    sizes = (F.col("x.lo") * share <= F.col("y.hi") * 100) & (F.col("y.lo") * share <= F.col("x.hi") * 100)
    return sizes & (most * (100 + share) >= (F.col("x.lo") + F.col("y.lo")) * share)


def _nodes(members: DataFrame, *by: str) -> DataFrame:
    """Inner nodes: OR of the bitmaps, largest slack and range of sizes."""
    return members.groupBy(*by).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("slack").alias("slack"),
        *(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)),
    )


def _sets_of(width: int):
    """The sets of a leaf as bytes, made from its texts."""
    def made(members: pa.StructArray) -> list[bytes]:
        items = []
        for part in slices(pa.RecordBatch.from_arrays([members.field("text")], ["text"]), "text", _PIECE):
            value, row = shingle_sets(part.column("text"), width)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            items += [value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return items

    return made


def traverse(members: DataFrame, texts: DataFrame, width: int, share: int, fan: int = 64, first: bool = False) -> DataFrame:
    """Links (``a, b``) between sets of one tree that are in different components, as many as join these.

    ``members``: tree, doc_id, comp, n, lo, hi, slack and bitmap words; ``texts``: doc_id, text.
    In a tree, sets hang by band of sizes, then in leaves of about ``fan``; a component with
    as many sets has leaves of its own, all others share leaves. Traversal pairs bands,
    then the leaves of open band pairs; a pair of leaves is closed when sizes or bits leave no
    room for a link, or when both hold one and the same component. What is left
    of them is compared leaf against leaf, by the sets themselves (``meet_blocks``), so a
    group of near copies costs a row for each pair of leaves, not of sets. With ``first``,
    only each leaf with itself and with the first open leaf of its tree: linear in the sets, and enough
    to make most of a group of near copies one component, which needs no comparison with itself in a whole traversal.
    What it writes is removed when the links are.
    """
    with scratch(members.sparkSession, uuid.uuid4().hex) as folder:
        return _links(members, texts, width, share, fan, first, folder)


def _links(members: DataFrame, texts: DataFrame, width: int, share: int, fan: int, first: bool, folder: str) -> DataFrame:
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / share)).cast("int")  # linked sets: one band or two next to each other
    sets = members.withColumn("band", band)
    large = sets.groupBy("tree", "band", "comp").agg(F.count("*").alias("k")).where(f"k >= {fan}")
    sets = sets.join(large.select("tree", "band", "comp", F.col("comp").cast("string").alias("own")), ["tree", "band", "comp"], "left")
    sets = sets.withColumn("cell", F.coalesce("own", F.lit(_SHARED))).drop("own")
    count = sets.groupBy("tree", "band", "cell").agg(F.ceil(F.count("*") / fan).alias("dealt"))
    sets = release(stored(sets.join(count, ["tree", "band", "cell"]).withColumn("node", F.pmod(F.xxhash64("doc_id"), "dealt")).drop("dealt"), "sets", folder))
    leaf = ["tree", "band", "cell", "node"]
    nodes = stored(_nodes(sets, *leaf), "nodes", folder)
    bands = stored(_nodes(nodes, "tree", "band"), "bands", folder)
    x, y = bands.alias("x"), bands.alias("y")
    open_bands = x.join(y, (F.col("x.tree") == F.col("y.tree")) & (F.col("x.band") <= F.col("y.band")) & _bound(share)).select(
        "x.tree", F.col("x.band").alias("band"), F.col("y.band").alias("to_band")
    )
    x, y = nodes.join(open_bands, ["tree", "band"]).alias("x"), nodes.alias("y")
    met = (F.col("x.tree") == F.col("y.tree")) & (F.col("x.to_band") == F.col("y.band"))
    differ = (F.col("x.cell") != F.col("y.cell")) | (F.col("x.cell") == _SHARED)
    once = (F.col("x.band") < F.col("y.band")) | (F.struct("x.cell", "x.node") <= F.struct("y.cell", "y.node"))
    if first:
        place = F.struct("band", "cell", "node")
        y = nodes.join(nodes.groupBy("tree", "band").agg(F.min(place).alias("head")), ["tree", "band"]).alias("y")
        of_x, of_y = (F.struct(*(f"{side}.{c}" for c in leaf[1:])) for side in "xy")
        once = (of_x == of_y) | (F.col("y.head") == of_y)
    open_nodes = stored(x.join(y, met & differ & once & _bound(share)).select(
        *(f"x.{c}" for c in leaf), *(F.col(f"y.{c}").alias(f"to_{c}") for c in leaf[1:])
    ), "open_nodes", folder)
    # only the leaves of open pairs are filled, and with texts: they take a fraction of the bytes of their sets
    used = open_nodes.select(*leaf).unionByName(open_nodes.select("tree", *(F.col(f"to_{c}").alias(c) for c in leaf[1:]))).distinct()
    held = sets.select(*leaf, "doc_id", "comp").join(used, leaf)
    lying = held.join(texts.hint("merge"), "doc_id").groupBy(*leaf)
    blocks = release(stored(lying.agg(F.collect_list(F.struct(F.col("doc_id").alias("rep"), "comp", "text")).alias("x")), "leaves", folder, "zstd"))
    there = blocks.select("tree", *(F.col(c).alias(f"to_{c}") for c in leaf[1:]), F.col("x").alias("y"))
    run, schema = meet_blocks(share, _sets_of(width))
    itself = F.struct(*leaf[1:]) == F.struct(*(F.col(f"to_{c}").alias(c) for c in leaf[1:]))
    # most leaves meet themselves alone and need no second move
    alone = open_nodes.where(itself).select(*leaf).join(blocks, leaf).select("x", F.col("x").alias("y"))
    pairs = open_nodes.where(~itself).join(blocks, leaf).join(there, ["tree", *(f"to_{c}" for c in leaf[1:])]).select("x", "y").unionByName(alone)
    return release(stored(pairs.mapInArrow(run, schema).distinct(), "links"))


def _trees(sets: DataFrame) -> DataFrame:
    """Sets (``root, doc_id, comp``) by the tree that they hang in.

    Roots that share sets are one tree where that takes fewer comparisons than the
    same sets under each of the roots, else each root is a tree of its own.
    """
    heads = sets.groupBy("root").agg(F.min("doc_id").alias("a"), F.count("*").alias("k"))
    grown = components(sets.join(heads, "root").select("a", F.col("doc_id").alias("b")))
    grown = stored(grown.select(F.col("node").alias("doc_id"), F.col("component").alias("grove")), "groves")
    apart = heads.join(grown, F.col("a") == F.col("doc_id")).groupBy("grove").agg(F.sum(F.col("k") * F.col("k")).alias("apart"))
    whole = grown.groupBy("grove").agg((F.count("*") * F.count("*")).alias("whole"))
    chosen = stored(apart.join(whole, "grove").select("grove", (F.col("whole") <= F.col("apart")).alias("one")), "chosen")
    tree = F.when(F.col("one"), F.xxhash64("grove")).otherwise(F.col("root")).alias("tree")
    return sets.join(grown, "doc_id").join(chosen, "grove").select(tree, "doc_id", "comp").distinct()


def _groups(whole: DataFrame, cards: DataFrame, reps: DataFrame, width: int, share: int, part_bytes: int, folder: str) -> DataFrame:
    """Components (``node, component``) of the sets that are linked; what else it writes lies in ``folder``."""
    key = ["n_shingles", "set_a", "set_b"]
    largest = reps.agg(F.max("n_shingles")).first()[0] or 1
    shares = max(1, -(-text_bytes(whole) * 3 // 4 // part_bytes))
    run, schema = _entries(width, share, largest, shares)
    entries = whole.where("doc_id is not null").mapInArrow(run, schema)
    run, schema = _roots(share)
    members = entries.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(run, schema)
    alias = reps.join(cards.where("doc_id is not null"), key).select("doc_id", "rep").distinct()
    members = release(stored(members, "members", folder))
    named = stored(members.join(alias, "doc_id").select("root", F.col("rep").alias("doc_id")).distinct(), "named", folder)
    several = named.groupBy("root").agg(F.count("*").alias("k")).where("k > 1").select("root")
    named = stored(named.join(several, "root"), "several", folder)
    ids = named.select("doc_id").distinct()
    texts = release(stored(whole.join(ids.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "texts", folder, "zstd"))
    run, schema = _signatures(width)
    drawn = stored(texts.mapInArrow(run, schema).withColumns({"lo": F.col("n"), "hi": F.col("n")}), "signatures", folder)
    hung = release(stored(_trees(named.select("root", "doc_id", F.col("doc_id").alias("comp"))).join(drawn, "doc_id"), "hung", folder))
    links = traverse(hung, texts, width, share, first=True)
    groups = stored(components(links), "groups")
    placed = hung.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    placed = placed.withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    mixed = placed.groupBy("tree").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("tree")
    more = traverse(placed.join(mixed, "tree"), texts, width, share)
    return stored(components(links.unionByName(more)), "groups")


def jaccard_components(docs: DataFrame, width: int = 3, share: int = 90, text: str = "text",
                       part_bytes: int = 12 << 20) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Sets are the distinct ``width``-word shingles of the text with A-Z lower-cased;
    two documents link when they share ``share`` % or more of their union.

    Equal sets are one from the start. A forest of signature trees holds the rest.
    The roots come from the sets themselves: linked sets of one size class differ in
    at most d shingles, so of d + 1 hashed parts of both sets one is equal; a set
    hangs under a root for each of its parts. Nearly all roots hold one set and go.
    Roots that share sets are one tree. The trees are traversed twice, in pairs of nodes under OR-ed
    bitmaps and size ranges, and the leaves that stay open are compared by their sets: first each
    leaf with itself and the first one, then, with what this links as components, all leaves that
    hold different ones (``traverse``). So a group of thousands of near copies costs a few
    comparisons per copy, and no link between different components is left out.

    Null and empty texts have no shingles and stay alone. Null ids are alone too,
    with a null component. Repeated rows are returned as often as they come; where
    rows with different texts bear one id, the smallest text stands for it. Other
    columns of ``docs`` are left out.
    """
    whole = lean(docs).select("doc_id", F.col(text).alias("text"))
    cards = stored(whole.mapInArrow(_set_rows(width), "doc_id long, n_shingles long, set_a long, set_b long"), "cards")
    key = ["n_shingles", "set_a", "set_b"]
    reps = stored(
        cards.where("doc_id is not null and n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")), "reps"
    )
    with scratch(docs.sparkSession, uuid.uuid4().hex) as folder:
        groups = _groups(whole, cards, reps, width, share, part_bytes, folder)
    found = reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    return cards.join(found, key, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )
