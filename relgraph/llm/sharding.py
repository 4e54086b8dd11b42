"""Sharding by balanced label propagation."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relgraph.llm.common import stored


def assign_shards(docs: DataFrame, shards: int = 40, rounds: int = 3, slack: float = 0.1, text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, link, shard, slot`` for every row of ``docs``.

    Documents with the same text are linked. All start in the shard that their id
    hashes to. Groups above ``slack`` of an equal share, ``shards / slack`` at most,
    are given their shards first (``_reserve``). In each round the members of the other
    groups move to the shard that holds most of the group and has room: a shard takes
    what fits into an equal share plus ``slack``, by hashed order of the groups. Groups
    that the rounds leave apart, or in a shard that is too full for them, then go whole
    where there is room (``_settle``), and unlinked documents fill all shards evenly.

    Row counts differ by one at most. Of the smaller groups only those are split that
    fit nowhere, which takes shards full of linked documents, and these at the borders
    of shards. The votes of a group are counts by shard, so a group of a third of all
    rows is some forty numbers. Null texts count as empty, and so as equal; null and
    repeated ids are rows as any other; an empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    cards = stored(
        docs.select(
            "doc_id", (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.xxhash64(whole).alias("link"), start.alias("first"),
        ),
        "cards",
    )
    rows = cards.count()
    cells = cards.groupBy("link", "first").agg(F.count("*").alias("n"))
    sized = stored(cells.withColumn("group_rows", F.sum("n").over(Window.partitionBy("link"))).where("group_rows > 1"), "cells")
    large = rows / shards * slack
    groups = sized.where(F.col("group_rows") > large).groupBy("link").agg(F.sum("n").alias("n")).collect()
    edges = [-(-k * rows // shards) for k in range(shards + 1)]
    free = [b - a for a, b in zip(edges[:-1], edges[1:])]
    pieces = _reserve(sorted((-g.n, g.link) for g in groups), free)
    spark = docs.sparkSession
    caps = spark.createDataFrame([(k, b - a - n, n) for k, (a, b, n) in enumerate(zip(edges[:-1], edges[1:], free))], "shard int, n long, cap long")
    state = stored(sized.where(F.col("group_rows") <= large).withColumn("shard", F.col("first")), "state")
    room = int(rows / shards * (1 + slack))
    for k in range(rounds):
        state = stored(_round(state, caps.select("shard", "n"), room, k), "state")
    homes = _settle(state, caps, free)
    used = {r.home: r.n for r in homes.where("home is not null").groupBy("home").agg(F.sum("n").alias("n")).collect()}
    return _even(cards, sized, homes, pieces, used, edges, large)


def _reserve(groups: list[tuple[int, int]], free: list[int]) -> list[tuple[int, int, int, int]]:
    """``(link, from, rows, shard)`` for the parts of large groups; takes their rows off ``free``.

    Groups above a shard come first, in runs of neighbouring shards: in the shard where
    the last one ended if that costs no shard more, else from the next one on. The others
    go where they leave least room. What fits nowhere whole fills the emptiest shards.
    """
    out, at, size = [], 0, max(free)

    def put(link, done, rows, shard):
        take = min(rows, free[shard])
        if take:
            out.append((link, done, take, shard))
            free[shard] -= take
        return done + take

    for rows, link in groups:
        rows, done = -rows, 0
        if rows > size:
            if at < len(free) and -(-(rows - free[at]) // size) + 1 > -(-rows // size) and free[at] < size - 1:
                at += 1
            while done < rows and at < len(free):
                done = put(link, done, rows - done, at)
                at += not free[at]
        elif fits := [(n, k) for k, n in enumerate(free) if n >= rows]:
            done = put(link, 0, rows, min(fits)[1])
        while done < rows:
            done = put(link, done, rows - done, max(range(len(free)), key=lambda k: (free[k], -k)))
    return out


def _settle(state: DataFrame, caps: DataFrame, free: list[int]) -> DataFrame:
    """``link, n, home`` of each group; the home is null if it fits nowhere.

    Groups in one shard stay by hashed turns while it has room for them. All others are
    dealt by hash into 4096 lots, which the driver puts where they leave least room.
    """
    groups = state.groupBy("link").agg(F.sum("n").alias("n"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    groups = stored(groups.select(
        "link", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("at"), F.pmod(F.xxhash64("link", F.lit(-1)), F.lit(1024)).alias("turn")
    ), "groups")
    queue = Window.partitionBy("at").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = groups.where("at is not null").groupBy("at", "turn").agg(F.sum("n").alias("n")).withColumn("queued", F.sum("n").over(queue))
    fits = turns.join(caps.select(F.col("shard").alias("at"), "cap"), "at").where("queued <= cap").select("at", "turn", F.lit(True).alias("fits"))
    lot = F.pmod(F.xxhash64("link", F.lit(-2)), F.lit(4096)).cast("int").alias("lot")
    kept = stored(groups.join(fits, ["at", "turn"], "left").select("link", "n", F.when(F.col("fits"), F.col("at")).alias("stay"), lot), "kept")
    left = list(free)
    for r in kept.where("stay is not null").groupBy("stay").agg(F.sum("n").alias("n")).collect():
        left[r.stay] -= r.n
    spare = sorted((n, k) for k, n in enumerate(left))
    lots = []
    for rows, name in sorted((-r.n, r.lot) for r in kept.where("stay is null").groupBy("lot").agg(F.sum("n").alias("n")).collect()):
        k = bisect_left(spare, (-rows, -1))
        if k < len(spare):
            room, shard = spare.pop(k)
            insort(spare, (room + rows, shard))
            lots.append((name, shard))
    moved = state.sparkSession.createDataFrame(lots, "lot int, moved int")
    return stored(kept.join(moved, "lot", "left").select("link", "n", F.coalesce("stay", "moved").alias("home")), "homes")


def _round(state: DataFrame, reserved: DataFrame, most: int, k: int) -> DataFrame:
    """One round of moves; the quota tables have a row per shard, or per shard and 256 turns."""
    load = state.select("shard", "n").unionByName(reserved).groupBy("shard").agg(F.sum("n").alias("load"))
    votes = state.groupBy("link", "shard").agg(F.sum("n").alias("votes")).join(load, "shard")
    # a full shard can still be where its own documents stay
    rank = F.struct(F.when(F.col("load") < most, F.col("votes")).otherwise(0).alias("open"), F.xxhash64("link", "shard").alias("tie"), F.col("shard"))
    wish = votes.groupBy("link").agg(F.max(rank).alias("best")).select(
        "link", F.col("best.shard").alias("wish"), F.col("best.open").alias("wish_votes")
    )
    turn = F.pmod(F.xxhash64("link", F.lit(k)), F.lit(256))
    here = votes.select("link", "shard", "votes")
    asked = state.join(wish, "link").join(here, ["link", "shard"]).withColumn("turn", turn).withColumn(
        "moves", (F.col("wish") != F.col("shard")) & (F.col("wish_votes") >= F.col("votes"))
    )
    turns = asked.where("moves").groupBy("wish", "turn").agg(F.sum("n").alias("n"))
    queue = Window.partitionBy("wish").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (
        turns.withColumn("queued", F.sum("n").over(queue)).join(load.withColumnRenamed("shard", "wish"), "wish", "left")
        .where(F.col("queued") + F.coalesce("load", F.lit(0)) <= most).select("wish", "turn", F.lit(True).alias("fits"))
    )
    moved = asked.join(fits, ["wish", "turn"], "left")
    to = F.when(F.col("moves") & F.col("fits"), F.col("wish")).otherwise(F.col("shard"))
    return moved.select("link", "first", "n", "group_rows", to.alias("shard"))


def _even(cards: DataFrame, sized: DataFrame, homes: DataFrame, pieces: list, used: dict, edges: list[int], large: float) -> DataFrame:
    """Number the rows of each large group, of the groups at home in each shard, and of all other rows, and deal ranges of these numbers to shards.

    Numbers come from chunks of about 1/8000 of all rows: one row per chunk is summed
    up in order, then rows are numbered inside their chunk. Groups larger than a
    chunk are dealt over several by document, so no chunk follows one hot text.
    """
    rows, shards = edges[-1], len(edges) - 1
    chunk_rows = max(64, rows // 8000)
    parts = max(1, rows // (shards * chunk_rows))
    # (kind, which): 0 a large group, 1 the groups at home in a shard, 2 the rest; to each the ranges and their places in the order of shards
    ranges, rest = {}, 0
    for k in range(shards):
        at = edges[k]
        mine = [((0, link), done, n) for link, done, n, shard in pieces if shard == k]
        mine.append(((1, k), 0, used.get(k, 0)))
        mine.append(((2, 0), rest, edges[k + 1] - at - sum(n for *_, n in mine)))
        rest += mine[-1][2]
        for section, begin, n in mine:
            if n:
                ranges.setdefault(section, []).append((begin, at))
                at += n
    dealt = [(*section, *map(list, zip(*sorted(both)))) for section, both in ranges.items()]
    dealt = cards.sparkSession.createDataFrame(dealt, "kind int, which long, begins array<long>, places array<long>")

    linked = F.col("group_rows").isNotNull()
    own = F.xxhash64("doc_id", "size")
    deal = F.when(F.col("group_rows") > chunk_rows, F.ceil(F.col("group_rows") / chunk_rows)).otherwise(1)
    kind = F.when(F.col("group_rows") > large, 0).when(F.col("home").isNotNull(), 1).otherwise(2)
    homed = sized.join(homes.select("link", "home"), "link", "left").select("link", "first", "group_rows", "home")
    placed = cards.join(homed, ["link", "first"], "left").select(
        "doc_id", "size", "text_crc32", "link", kind.alias("kind"),
        F.when(kind == 0, F.col("link")).when(kind == 1, F.col("home").cast("long")).otherwise(0).alias("which"),
        F.when(kind == 0, 0).when(kind == 1, F.pmod("link", F.lit(parts))).when(linked, F.pmod("link", F.lit(parts * shards)))
        .otherwise(F.col("first") * parts + F.pmod(F.xxhash64(own), F.lit(parts))).alias("bin"),
        F.when(F.col("group_rows") > chunk_rows, F.col("link")).otherwise(0).alias("hot"),
        F.when(linked, F.pmod(F.xxhash64(own, F.lit(7)), deal)).otherwise(0).alias("deal"),
    )
    placed = stored(placed, "placed")
    key = ["kind", "which", "bin", "hot", "deal"]
    chunks = placed.groupBy(*key).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("kind", "which").orderBy("bin", "hot", "deal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = chunks.withColumn("end", F.sum("n").over(upto)).withColumn("before", F.col("end") - F.col("n")).join(dealt, ["kind", "which"])
    low, high = F.expr("size(filter(begins, x -> x <= before))"), F.expr("size(filter(begins, x -> x < end))")
    offsets = stored(offsets.select(
        *key, "before", F.slice("begins", low, high - low + 1).alias("begins"), F.slice("places", low, high - low + 1).alias("places")
    ), "offsets")
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("link", "doc_id", "size")) - 1
    number = placed.withColumn("inside", inside).join(offsets, key).withColumn("number", F.col("before") + F.col("inside"))
    nth = F.expr("size(filter(begins, x -> x <= number))")
    place = number.withColumn("place", F.col("number") + F.element_at("places", nth) - F.element_at("begins", nth))
    shard = F.expr(f"place * {shards} div {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {shards} - 1) div {shards}")  # the smallest place in the shard
    return place.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "link", "shard", (F.col("place") - first).cast("long").alias("slot")
    )
