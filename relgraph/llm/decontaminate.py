"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from relgraph.llm.common import lean

GRAM = 3


def level(text: str) -> str:
    """Lower case, white space as one blank each."""
    return " ".join(text.lower().split())


def grams(text: str) -> set[str]:
    return set(map("".join, zip(text, text[1:], text[2:])))


class Pattern(NamedTuple):
    item: int
    text: str
    budget: int
    masks: dict[str, int]
    grams: set[str]

    def near(self, text: str) -> bool:
        """Whether enough three-character grams are there; each edit can spoil no more than three of them."""
        return len(self.grams & grams(text)) >= len(self.grams) - GRAM * self.budget


def pattern(item: int, text: str, rate: float) -> Pattern:
    """An item with its error budget and the bit masks of its characters."""
    masks: dict[str, int] = {}
    for k, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << k
    return Pattern(item, text, int(len(text) * rate), masks, grams(text))


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """The text in ``budget + 1`` pieces of nearly equal length, each with its place."""
    n = budget + 1
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def distance(p: Pattern, text: str) -> int:
    """Smallest edit distance between the pattern and any part of ``text``: bit-parallel columns after Myers."""
    size = len(p.text)
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best = score
    for c in text:
        equal = p.masks.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return best


class Matcher:
    """Finds items within their error budgets in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.patterns = [pattern(i, t, rate) for i, t in items]
        self.machine = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, p in enumerate(self.patterns):
            for at, piece in pieces(p.text, p.budget):
                places.setdefault(piece, []).append((number, at))
        for piece, owners in places.items():
            self.machine.add_word(piece, (len(piece), owners))
        if places:
            self.machine.make_automaton()
        self.empty = not places

    def find(self, text: str) -> dict[int, int]:
        """Smallest distance of each item that occurs."""
        if self.empty or not text:
            return {}
        text = level(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, owners) in self.machine.iter(text):
            for number, at in owners:
                p = self.patterns[number]
                begin = end + 1 - length - at
                lo, hi = max(0, begin - p.budget), min(len(text), begin + len(p.text) + p.budget)
                own = windows.setdefault(number, [])
                # hits come in the order of their ends, so those of one place follow each other
                if own and lo <= own[-1][1] and lo >= own[-1][0] - p.budget:
                    own[-1] = [min(lo, own[-1][0]), max(hi, own[-1][1])]
                else:
                    own.append([lo, hi])
        found = {}
        for number, spans in windows.items():
            p = self.patterns[number]
            for lo, hi in spans:
                part = text[lo:hi]
                d = 0 if p.text in part else distance(p, part) if p.near(part) else p.budget + 1
                if d <= p.budget:
                    found[p.item] = min(d, found.get(p.item, d))
        return found


_COLUMNS = ("n_items", "best_item", "best_distance")


def _match(items, rate, text, names):
    def run(batches):
        matcher = Matcher(items, rate)
        for batch in batches:
            seen = [[], [], []]
            old = zip(*(batch.column(c).to_pylist() for c in _COLUMNS))
            for t, (n, best, best_d) in zip(batch.column(text).to_pylist(), old):
                found = matcher.find(t or "")
                if found:
                    d, item = min((d, i) for i, d in found.items())
                    n += len(found)
                    if best_d is None or (d, item) < (best_d, best):
                        best, best_d = item, d
                for column, value in zip(seen, (n, best, best_d)):
                    column.append(value)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(s, pa.int64()) for s in seen)], names=[*names, *_COLUMNS])

    return run


def match_items(docs: DataFrame, items: DataFrame, rate: float = 0.08, text: str = "text", keep: list[str] | None = None,
                block_bytes: int = 4 << 20) -> DataFrame:
    """``docs``, or the columns of it named in ``keep``, with ``n_items``, ``best_item`` and ``best_distance``: benchmark items that each whole text holds.

    An item (``item_id, text``) occurs where some part of the text is within ``rate``
    times its length of edits, in lower case and with white space levelled. The item
    is cut into one more piece than that budget; at least one piece then occurs
    unchanged. All pieces are searched in one pass, and the surroundings of each hit
    are measured by Myers' bit-parallel distance.

    Items are sent to the tasks in blocks of about ``block_bytes``; more items mean more
    passes over a document, not more memory. No shuffle of documents: every row of
    ``docs`` gives one row. Null and empty texts and items match nothing; of repeated
    items each counts; of equal distances the smaller id is best. Columns of ``docs``
    with the three result names are replaced.
    """
    keep = [c for c in docs.columns if c not in _COLUMNS and (keep is None or c in keep)]
    carried = list(dict.fromkeys([*keep, text]))
    listed = items.where("item_id is not null and text rlike '[^\\\\s]'").select("item_id", "text").distinct()
    blocks = max(1, -(-(listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    out = lean(docs).select(*carried, F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("best_item"),
                      F.lit(None).cast("long").alias("best_distance"))
    dealt = listed.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        block = [(r.item_id, t) for r in dealt.where(F.col("block") == k).select("item_id", "text").toLocalIterator() if (t := level(r.text))]
        names = keep if k == blocks - 1 else carried
        schema = StructType([*(docs.schema[c] for c in names), *(StructField(c, LongType()) for c in _COLUMNS)])
        out = out.mapInArrow(_match(sorted(block), rate, text, names), schema)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = 0.08, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; all their columns."""
    return match_items(docs, items, rate, text).where("n_items = 0").select(*docs.columns)
