"""Prefix trie of conversations from padded matrices of turn ids.

Conversations are cut into segments of at most ``SPAN`` turns. A segment is a row of
ids, one for each turn and its place, behind a key of all that comes before it. Rows
are put in order by ranges and dealt into shards of bounded size; a shard is a padded
matrix. Its rows are sorted, changes of a column against the row above are OR-ed along
the row, and where the result is set a node starts; reductions between the starts give
the figures of all nodes of a depth at once. Only nodes of the first and the last row
of a shard can have members elsewhere: these are recombined by key.

Sums over a subtree are sums over members. Each node is borne by its smallest member,
so what a conversation bears at or below a depth, summed over the members of a node
there, is the sum over the subtree; no level has to wait for another one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relgraph.llm.common import lean, rows_out, stored

SPAN = 64  # turns of a segment
SHARD_ROWS, SHARD_TURNS = 8192, 1 << 18
_CHUNK = 1024  # segments summed up in one step
_EMPTY = hashlib.sha256().hexdigest()
_KEY = ["depth", "key_a", "key_b"]


def number_turns(convs: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_a, turn_b, bytes`` of all turns, and ``turns``, how many their conversation has.

    Turns are ordered by ``turn``, null first, then by role and by the hashes of role and text that stand
    for the turn. All rows are put in one order by ranges, so that a conversation of any
    length is dealt over tasks; its rows in each task are counted and carried on.
    Rows without a ``conv_id`` are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("turn_a"),
        F.xxhash64(F.lit(1), text, role).alias("turn_b"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("turn_a"), F.col("turn_b")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows.select("conv_id", "turn_a", "turn_b", "bytes", "row", F.shiftright("row", 33).alias("part")), "turns")
    runs = rows.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("conv_id")  # a row for each task that holds some of its turns
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    runs = runs.select("conv_id", "part", (F.col("first") - before - 1).alias("base"), F.sum("n").over(own).alias("turns"))
    return rows.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("row") - F.col("base")).alias("pos"), "turn_a", "turn_b", "bytes", "turns")


def rebuild(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first one of their group of ``every`` ids does: turns, and members (``conv_id, turns``).

    The first h turns are those of conversation c - c % every, as far as it has them,
    with h the CRC-32 of the decimal c modulo ``most``; then c's own turns after its first h follow.
    """
    turns = stored(turns, "numbered")
    body = F.struct("pos", "turn_a", "turn_b", "bytes")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(body)).alias("head"))  # below ``most`` entries
    members = turns.groupBy("conv_id").agg(F.max("turns").alias("own")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "base": F.col("conv_id") - F.col("conv_id") % every,
    })
    members = members.join(heads, "base", "left").withColumn("head", F.filter("head", lambda t: t["pos"] <= F.col("h")))
    members = members.withColumn("kept", F.coalesce(F.size("head"), F.lit(0)).cast("long")).withColumn(
        "kept", F.greatest("kept", F.lit(0).cast("long")))  # the size of null may be -1
    members = stored(members.select("conv_id", "h", "head", "kept", (F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "members")
    late = turns.drop("turns").join(members.select("conv_id", "h", "kept", "turns"), "conv_id").where("pos > h")
    late = late.select("conv_id", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"), "turn_a", "turn_b", "bytes", "turns")
    early = members.select("conv_id", F.explode("head").alias("t"), "turns").select("conv_id", "t.*", "turns")
    return late.unionByName(early), members.select("conv_id", "turns")


def _before(df: DataFrame, columns: list[str], total, join, reverse: bool = False) -> DataFrame:
    """``columns`` combined over the segments of the conversation before this one, or after it; 0 where there are none.

    ``df``: conv_id, seg and the columns. Done inside of chunks of segments, with one row
    a chunk carried on.
    """
    way = (lambda c: F.col(c).desc()) if reverse else F.col
    cut = df.withColumn("chunk", F.expr(f"seg div {_CHUNK}"))
    chunks = cut.groupBy("conv_id", "chunk").agg(*(total(c).alias(c) for c in columns))
    over = Window.partitionBy("conv_id").orderBy(way("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv_id", "chunk", *(F.coalesce(total(c).over(over), F.lit(0)).alias(f"of_{c}") for c in columns))
    over = Window.partitionBy("conv_id", "chunk").orderBy(way("seg")).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select("conv_id", "seg", "chunk", *(F.coalesce(total(c).over(over), F.lit(0)).alias(c) for c in columns))
    both = inside.join(chunks, ["conv_id", "chunk"])
    return both.select("conv_id", "seg", *(join(F.col(c), F.col(f"of_{c}")).alias(c) for c in columns))


def segments(turns: DataFrame) -> DataFrame:
    """``conv_id, seg, turns, from_a, from_b, path, bytes``: ids of at most ``SPAN`` turns behind a key of the earlier ones.

    An id is a pair of hashes of turn and place; the key is the XOR of all earlier pairs.
    """
    rows = turns.select(
        "conv_id", F.expr(f"(pos - 1) div {SPAN}").alias("seg"), "turns",
        F.struct("pos", F.xxhash64("turn_a", "turn_b", "pos").alias("a"), F.xxhash64("pos", "turn_b", "turn_a").alias("b"), "bytes").alias("t"),
    )
    rows = rows.groupBy("conv_id", "seg").agg(F.max("turns").alias("turns"), F.sort_array(F.collect_list("t")).alias("t"))
    rows = stored(rows.select(
        "conv_id", "seg", "turns", F.flatten(F.transform("t", lambda t: F.array(t["a"], t["b"]))).alias("path"), F.col("t.bytes").alias("bytes"),
        *(F.aggregate(f"t.{k}", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias(f"from_{k}") for k in "ab"),
    ), "segments")
    keys = _before(rows.where(f"turns > {SPAN}").select("conv_id", "seg", "from_a", "from_b"), ["from_a", "from_b"], F.bit_xor, Column.bitwiseXOR)
    first = rows.where(f"turns <= {SPAN}").withColumns({"from_a": F.lit(0).cast("long"), "from_b": F.lit(0).cast("long")})
    later = rows.where(f"turns > {SPAN}").drop("from_a", "from_b").join(keys, ["conv_id", "seg"])
    return first.unionByName(later)


_FIELDS = {"conv_id": "<i8", "seg": "<i8", "turns": "<i8", "from_a": "<u8", "from_b": "<u8", "lengths": "<i4", "path": "<u8", "bytes": "<i8"}
_PACKED = "shard long, " + ", ".join(f"{f} binary" for f in _FIELDS)


def _pack(shard_rows: int, shard_turns: int):
    """Rows that come in order, as shards: one row each with the columns as bytes."""
    schema = pa.schema([("shard", pa.int64()), *((f, pa.binary()) for f in _FIELDS)])

    def shard(part, number, held):
        columns = [np.concatenate([h[f] for h in held]).astype(kind).tobytes() for f, kind in _FIELDS.items()]
        return rows_out(schema, *([v] for v in [(part << 31) + number, *columns]))

    def run(batches):
        step = min(256, shard_rows)
        held, rows, turns, number, part = [], 0, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for at in range(0, batch.num_rows, step):
                few = batch.slice(at, step)
                one = {f: few.column(f).to_numpy(zero_copy_only=False) for f in ("conv_id", "seg", "turns")}
                one |= {f: few.column(f).to_numpy(zero_copy_only=False).view(np.uint64) for f in ("from_a", "from_b")}
                one["lengths"] = pc.list_value_length(few.column("bytes")).to_numpy(zero_copy_only=False)
                one["path"] = few.column("path").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                one["bytes"] = few.column("bytes").flatten().to_numpy(zero_copy_only=False)
                held.append(one)
                rows, turns = rows + few.num_rows, turns + len(one["bytes"])
                if rows >= shard_rows or turns >= shard_turns:
                    yield shard(part, number, held)
                    held, rows, turns, number = [], 0, 0, number + 1
        if held:
            yield shard(part, number, held)

    return run


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 1 on, equal where all columns are."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), np.int32)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new) + 1
    return out


class Shard:
    """The sorted matrix of a shard and where its nodes start."""

    def __init__(self, row: dict):
        got = {f: np.frombuffer(row[f], kind) for f, kind in _FIELDS.items()}
        n, lengths = len(got["conv_id"]), got["lengths"].astype(np.int64)
        width = int(lengths.max())
        at = np.repeat(np.arange(n), lengths)
        column = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        a, b = got["path"][0::2], got["path"][1::2]

        def grid(values):
            out = np.zeros((n, width), values.dtype)
            out[at, column] = values
            return out

        ids = grid(_dense(b, a))
        lead = _dense(got["from_b"], got["from_a"], got["seg"])
        order = np.lexsort((got["conv_id"], *ids.T[::-1], lead))
        ids, lead = ids[order], lead[order]
        change = np.ones((n, width), bool)
        change[1:] = ids[1:] != ids[:-1]
        change[1:, 0] |= lead[1:] != lead[:-1]
        self.new = np.logical_or.accumulate(change, axis=1)
        self.filled = ids > 0
        self.width, self.size = width, n
        self.conv, self.seg, self.turns = (got[f][order] for f in ("conv_id", "seg", "turns"))
        self.lengths, self.bytes = lengths[order], grid(got["bytes"])[order]
        self.keys = [np.bitwise_xor.accumulate(grid(v)[order], axis=1) ^ got[f][order][:, None] for v, f in ((a, "from_a"), (b, "from_b"))]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.edges = place[[0, n - 1]]  # only what these two rows are in can go on in another shard

    def depth(self, c: int, rows) -> np.ndarray:
        return self.seg[rows] * SPAN + c + 1

    def column(self, c: int):
        """First rows, ends, smallest members, whether a member goes on, and which may go on elsewhere: of the nodes of a column."""
        runs = np.flatnonzero(self.new[:, c])
        ends = np.append(runs[1:], self.size)
        low = np.minimum.reduceat(self.conv, runs)
        more = np.logical_or.reduceat(self.turns > self.depth(c, slice(None)), runs)
        real = self.filled[runs, c]
        at_edge = np.zeros(len(runs), bool)
        at_edge[np.searchsorted(runs, self.edges, side="right") - 1] = True
        return runs, ends, low, more, real, at_edge & real

    def key(self, c: int, rows) -> list[np.ndarray]:
        return [self.depth(c, rows), *(k[rows, c].view(np.int64) for k in self.keys)]


def _edges(batches):
    """Figures of the nodes that may have members in other shards."""
    schema = pa.schema([("shard", pa.int64()), *((k, pa.int64()) for k in _KEY), ("n", pa.int64()), ("low", pa.int64()), ("more", pa.bool_())])
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            for c in range(shard.width):
                runs, ends, low, more, _, edge = shard.column(c)
                at = runs[edge]
                yield rows_out(schema, np.full(len(at), row["shard"]), *shard.key(c, at), ends[edge] - at, low[edge], more[edge])


def _figures(shard: Shard, known: dict):
    """By column: first rows, members, smallest member and edge flags of nodes; by cell: what its row bears there."""
    columns, shape = [], (shard.size, shard.width)
    bears, tokens, leaves = np.zeros(shape, bool), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for c in range(shard.width):
        runs, ends, low, more, real, edge = shard.column(c)
        n = ends - runs
        for k, at in zip(np.flatnonzero(edge), zip(*(v.tolist() for v in shard.key(c, runs[edge])))):
            n[k], low[k], more[k] = known[at]
        of = np.cumsum(shard.new[:, c]) - 1
        bears[:, c] = real[of] & (shard.conv == low[of])
        tokens[:, c] = np.where(bears[:, c], (n[of] - 1) * shard.bytes[:, c], 0)
        leaves[:, c] = bears[:, c] & ~more[of]
        columns.append((runs, ends, n, low, real, edge))
    return columns, bears, tokens, leaves


def _known(row: dict) -> dict:
    return {tuple(x[k] for k in _KEY): (x["n"], x["low"], x["more"]) for x in row["known"] or ()}


_BORNE = "shard long, conv_id long, seg long, tokens long, leaves long, first long, last_low long"


def _borne(batches):
    """For each segment of a conversation of several: what it bears in all, at its first place, and its last node's smallest member."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _BORNE.split(", ")])
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            long = np.flatnonzero(shard.turns > SPAN)
            if not len(long):
                continue
            columns, bears, tokens, leaves = _figures(shard, _known(row))
            low = np.zeros((shard.size, shard.width), np.int64)
            for c, (_, _, _, lows, _, _) in enumerate(columns):
                low[:, c] = lows[np.cumsum(shard.new[:, c]) - 1]
            yield rows_out(schema, np.full(len(long), row["shard"]), shard.conv[long], shard.seg[long], tokens[long].sum(1), leaves[long].sum(1),
                           bears[long, 0].astype(np.int64), low[long, shard.lengths[long] - 1])


_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, key_a long, key_b long, ends string, first_end long")


def _nodes(batches):
    """All nodes of each shard. Those with a key are shares of a node: their sums are partial and their ends are spelled out."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _NODE.split(", ")])
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            columns, bears, tokens, leaves = _figures(shard, _known(row))
            below = {(x["conv_id"], x["seg"]): x for x in row["below"] or ()}
            deep = np.zeros((4, shard.size), np.int64)
            for r in np.flatnonzero(shard.turns > SPAN) if below else ():
                x = below[int(shard.conv[r]), int(shard.seg[r])]
                deep[:, r] = x["tokens"], x["leaves"], x["first"], x["parent"]
            tokens = np.cumsum(tokens[:, ::-1], axis=1)[:, ::-1] + deep[0][:, None]
            leaves = np.cumsum(leaves[:, ::-1], axis=1)[:, ::-1] + deep[1][:, None]
            parent, no_parent = deep[3], shard.seg == 0
            for c, (runs, ends, n, low, real, edge) in enumerate(columns):
                if c + 1 < shard.width:
                    child = bears[:, c + 1] + np.where(shard.lengths == c + 1, deep[2], 0)
                else:
                    child = np.where(shard.lengths == c + 1, deep[2], 0)
                sums = [np.add.reduceat(v, runs)[real] for v in (child.astype(np.int64), leaves[:, c], tokens[:, c])]
                depth = shard.depth(c, slice(None))
                ended = shard.turns == depth
                at, to, inner = runs[real], ends[real], ~edge[real]
                any_end = np.logical_or.reduceat(ended, runs)[real]
                texts = [",".join(map(str, shard.conv[a:b][ended[a:b]].tolist())) if e else "" for a, b, e in zip(at, to, any_end)]
                hashes = [hashlib.sha256(t.encode()).hexdigest() if k else None for t, k in zip(texts, inner)]
                key = shard.key(c, at)
                yield rows_out(
                    schema, low[real], key[0], pa.array(parent[at], mask=no_parent[at]), n[real], *sums, hashes,
                    pa.array(key[1], mask=inner), pa.array(key[2], mask=inner), [None if k else t for t, k in zip(texts, inner)],
                    pa.array(shard.conv[at], mask=inner),
                )
                parent, no_parent = low[np.cumsum(shard.new[:, c]) - 1], np.zeros(shard.size, bool)


def _id_texts(batches):
    schema = pa.schema([("ends", pa.string()), ("first_end", pa.int64())])
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        if ids:
            yield rows_out(schema, [",".join(map(str, ids))], ids[:1])


def _hash_in_order(batches):
    """SHA-256 of the pieces of each node, which come in order, joined by commas; one state and one piece are held."""
    schema = pa.schema([*((k, pa.int64()) for k in _KEY), ("ends_sha256", pa.string())])
    key = state = None
    for batch in batches:
        for *at, piece in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ends"))):
            if at != key:
                if state:
                    yield rows_out(schema, *([v] for v in (*key, state.hexdigest())))
                key, state = at, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if state:
        yield rows_out(schema, *([v] for v in (*key, state.hexdigest())))


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, shard_rows: int = SHARD_ROWS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of all conversations, from the textless root on.

    ``turns`` as of ``number_turns``; ``members`` (``conv_id, turns``), which may hold
    conversations without turns, by default those of ``turns``. A node is a different
    sequence of first turns; its columns are ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` (over its subtree: childless nodes, and members but one times bytes of
    the last text) and ``ends_sha256`` (of the ascending ids that end there).

    A first turn or a whole conversation that a third of all share is dealt over shards,
    since rows are ordered by their path and then by ``conv_id``; a conversation of any length
    is dealt over segments. The ids that end at one node are hashed as one text, which SHA-256 can
    only do in order: shards spell out their share, and one task streams these pieces.
    Without members there are no nodes, not even the root.
    """
    turns = lean(turns)
    if members is None:
        members = turns.groupBy("conv_id").agg(F.max("turns").alias("turns"))
    root = members.agg(F.min("conv_id").alias("low"), F.count("*").alias("n")).first()
    order = ["seg", "from_a", "from_b", "path", "conv_id"]
    rows = segments(turns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    shards = stored(rows.mapInArrow(_pack(shard_rows, shard_turns), _PACKED), "shards")

    shares = stored(shards.mapInArrow(_edges, "shard long, depth long, key_a long, key_b long, n long, low long, more boolean"), "shares")
    whole = shares.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("more").alias("more"))
    known = shares.select("shard", *_KEY).join(whole, _KEY).groupBy("shard").agg(F.collect_list(F.struct(*_KEY, "n", "low", "more")).alias("known"))
    shards = shards.join(stored(known, "known"), "shard", "left")  # two paths of at most SPAN nodes a shard

    borne = stored(shards.mapInArrow(_borne, _BORNE), "borne")
    sums = _before(borne.select("conv_id", "seg", "tokens", "leaves"), ["tokens", "leaves"], F.sum, lambda x, y: x + y, reverse=True)
    after = borne.select("conv_id", (F.col("seg") - 1).alias("seg"), "first")
    above = borne.select("conv_id", (F.col("seg") + 1).alias("seg"), F.col("last_low").alias("parent"))
    below = borne.select("shard", "conv_id", "seg").join(sums, ["conv_id", "seg"]).join(after, ["conv_id", "seg"], "left").join(above, ["conv_id", "seg"], "left")
    below = below.na.fill(0, ["first", "parent"]).groupBy("shard").agg(
        F.collect_list(F.struct("conv_id", "seg", "tokens", "leaves", "first", "parent")).alias("below"))  # at most the rows of a shard
    nodes = stored(shards.join(stored(below, "below"), "shard", "left").mapInArrow(_nodes, _NODE), "nodes")

    shared = nodes.where("key_a is not null")
    turnless = members.where("turns = 0").select("conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    pieces = shared.where("ends <> ''").select(*_KEY, "ends", "first_end").unionByName(
        turnless.mapInArrow(_id_texts, "ends string, first_end long").select(*(F.lit(0).cast("long").alias(k) for k in _KEY), "ends", "first_end"))
    hashes = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first_end").mapInArrow(
        _hash_in_order, "depth long, key_a long, key_b long, ends_sha256 string")
    hashes = stored(hashes, "hashes")
    met = shared.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.min("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens"))).join(hashes, _KEY, "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ended = F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    found = nodes.where("key_a is null").select(*out).unionByName(met.select(*out[:-1], ended))
    found = stored(found.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["low"]).cast("long")).otherwise(F.col("parent_conv_id"))), "found")
    top = found.where("depth = 1").agg(F.count("*").alias("n_children"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_leaves", "saved_tokens")))
    top = top.where(F.lit(root["n"] > 0)).join(hashes.where("depth = 0").select("ends_sha256"), how="left").select(
        F.lit(root["low"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(root["n"]).cast("long").alias("n_convs"), "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens", ended)
    return found.unionByName(top)
