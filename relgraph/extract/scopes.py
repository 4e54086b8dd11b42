"""Lines of a table of files, brace depth, and the scopes that enclose a line.

All windows here are keyed by the file or by more, so files move once; a file is
one row of the input and therefore bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relgraph.functions.text import count_of

FILE = ["project", "path"]


# Bytes of text in one task; as lines with their columns and events it takes some tens of times as much.
TEXT_BYTES = 8 << 20


def _text_parts(files: DataFrame) -> int:
    """Tasks for the text of all files: their number grows with it, so that a task's lines fit its memory."""
    spark = files.sparkSession
    total = files.agg(F.sum(F.octet_length("content").cast("long")).alias("bytes")).first()["bytes"] or 0
    return max(spark.sparkContext.defaultParallelism, -(-total // TEXT_BYTES))


def lines(files: DataFrame, *stages, keep=None, ordered: bool = False) -> DataFrame:
    """One row per line: ``(project, path, line, raw, ..)``, 1-based, without terminators.

    Each stage maps a line's struct to further named columns and runs inside the split
    file, so every value is computed once, and ``keep`` (after the first stage) drops lines
    before they become rows. ``ordered`` spreads the files by their key first, so what
    moves is the compact text and every later per-file window finds its rows in place;
    line-local work needs no such move.
    """
    source = files.select(*FILE, "content")
    if ordered:
        source = source.repartition(_text_parts(source), *FILE)
    rows = F.transform(
        F.split("content", "\n", -1),
        lambda raw, at: F.struct((at + 1).cast("long").alias("line"), F.regexp_replace(raw, "\r$", "").alias("raw")),
    )
    names = ["line", "raw"]
    for number, stage in enumerate(stages):
        rows, names = _staged(rows, names, stage)
        if number == 0 and keep is not None:
            rows = F.filter(rows, keep)
    return unnest(source, FILE, rows)


def unnest(df: DataFrame, keep: list[str], rows: Column) -> DataFrame:
    """One row per struct of the array ``rows``, beside the columns to keep.

    A plain ``explode`` makes the optimiser add size and null tests on the array, which
    would evaluate a long expression three times; the outer form does not.
    """
    outer = df.select(*keep, F.explode_outer(rows).alias("_r"))
    return outer.where(F.col("_r").isNotNull()).select(*keep, "_r.*")


def _staged(rows: Column, names: list[str], stage) -> tuple[Column, list[str]]:
    fresh: list[str] = []

    def extend(line: Column) -> Column:
        added = stage(line)
        fresh[:] = list(added)
        return F.struct(*[line[n].alias(n) for n in names], *[c.alias(n) for n, c in added.items()])

    staged = F.transform(rows, extend)
    return staged, [*names, *fresh]


def naive_delta(code: Column) -> Column:
    """Opening minus closing braces, also those inside literals."""
    return count_of(code, "{") - count_of(code, "}")


def in_file(*extra: str):
    return W.partitionBy(*FILE, *extra).orderBy("line")


def upto(window):
    return window.rowsBetween(W.unboundedPreceding, 0)


def ahead(window):
    return window.rowsBetween(W.unboundedPreceding, -1)


def brace_depth(coded: DataFrame, delta: str = "delta") -> DataFrame:
    """Adds the depth before and after each line."""
    return coded.withColumn("depth_after", F.sum(delta).over(upto(in_file())).cast("int")).withColumn(
        "depth_before", (F.col("depth_after") - F.col(delta)).cast("int")
    )


def enclosing(marked: DataFrame, keep: list[str]) -> DataFrame:
    """Names of the open scopes around each declaration line, outermost first.

    ``marked`` has one row per line with ``depth_before``, ``depth_after``, ``is_decl``,
    ``opener`` (name of the scope the line opens at ``depth_before``, else null),
    ``opener_epoch`` and ``decl_epoch``. A scope at depth d ends after the first line
    whose depth is at most d, and is only seen by declarations of its epoch.

    Every line turns into events at the depths it touches. The last event before a
    declaration at one depth tells whether a scope is open there, so the work is linear
    in lines times nesting, without pairing declarations with scopes.
    """
    lowest = F.min("depth_before").over(upto(in_file()))
    staged = marked.withColumn("lowest", F.least(lowest, F.col("depth_before")))
    before, after = F.col("depth_before"), F.col("depth_after")
    none = F.lit(None).cast("struct<open:boolean,name:string,epoch:bigint>")
    state = lambda is_open, name, epoch: F.struct(is_open.alias("open"), name.alias("name"), epoch.cast("bigint").alias("epoch"))

    def event(level: Column, order: int, held: Column) -> Column:
        return F.struct(level.cast("int").alias("level"), F.lit(order).alias("order"), held.alias("held"))

    nothing = F.array().cast("array<struct<level:int,order:int,held:struct<open:boolean,name:string,epoch:bigint>>>")
    closed = state(F.lit(False), F.lit(None).cast("string"), F.lit(None))
    # the declaration itself, at a level no scope has, so that one without scopes still appears
    own = F.when(F.col("is_decl"), F.array(event(F.lit(-(1 << 30)), 0, none))).otherwise(nothing)
    asked = F.when(
        F.col("is_decl") & (F.col("lowest") < before),
        F.transform(F.sequence(F.col("lowest"), before - 1), lambda l: event(l, 0, none)),
    ).otherwise(nothing)
    opened = F.when(
        F.col("opener").isNotNull(),
        F.array(event(before, 1, state(F.lit(True), F.col("opener"), F.col("opener_epoch")))),
    ).otherwise(nothing)
    top = before - F.when(F.col("opener").isNotNull(), 0).otherwise(1)
    ended = F.when(after <= top, F.transform(F.sequence(after, top), lambda l: event(l, 2, closed))).otherwise(nothing)
    events = unnest(staged, [*FILE, "line", "decl_epoch", *keep], F.concat(own, asked, opened, ended))
    at_level = W.partitionBy(*FILE, "level").orderBy("line", "order")
    seen = events.withColumn("seen", F.last("held", ignorenulls=True).over(ahead(at_level))).where(F.col("order") == 0)
    is_open = F.col("seen.open") & (F.col("seen.epoch") == F.col("decl_epoch"))
    scope = F.when(is_open, F.struct("level", "seen.name"))
    return seen.groupBy(*FILE, "line").agg(
        F.transform(F.array_sort(F.collect_list(scope)), lambda s: s["name"]).alias("semantic_path"),
        *[F.first(c).alias(c) for c in keep],
    )
