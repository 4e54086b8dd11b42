"""Blocks of sets against each other: all overlaps of two blocks without a row for each pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from relgraph.llm.common import rows_out

_COLUMNS = 4096


def unpack_sets(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Items of all sets, and the set of each."""
    value = np.frombuffer(b"".join(blobs), np.uint64)
    return value, np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])


def common_items(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """How many items each set on the left has in common with each on the right: a product of 0/1 matrices, some columns at a time."""
    (va, ra), (vb, rb) = unpack_sets(left), unpack_sets(right)
    shared = np.intersect1d(va, vb)
    out = np.zeros((len(left), len(right)), np.int64)

    def entries(value, row):
        at = np.searchsorted(shared, value)
        here = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == value) if len(shared) else np.zeros(len(value), bool)
        at, row = at[here], row[here]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    (ca, ra), (cb, rb) = entries(va, ra), entries(vb, rb)
    for lo in range(0, len(shared), _COLUMNS):
        width = min(_COLUMNS, len(shared) - lo)
        grids = []
        for column, row, size in ((ca, ra, len(left)), (cb, rb, len(right))):
            grid = np.zeros((size, width), np.float32)
            a, b = np.searchsorted(column, (lo, lo + width))
            grid[row[a:b], column[a:b] - lo] = 1
            grids.append(grid)
        out += (grids[0] @ grids[1].T).astype(np.int64)  # below 2^24, so exact
    return out


def _stored_items(members: pa.StructArray) -> list[bytes]:
    return members.field("items").to_pylist()


def meet_blocks(share: int, sets=_stored_items):
    """Which components the links between two blocks of sets join, as one link for each component but the smallest of those joined.

    ``x`` and ``y`` are lists of ``rep, comp`` and of what ``sets`` makes the items from, sorted hashes as bytes.
    Two lists with the same representatives hold the same sets.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        reps, held = [None, None], [None, None]  # of the last row; pairs of a block often follow one another
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values for c in "xy"]
                for s, side in enumerate(sides):
                    now = side.field("rep").to_pylist()
                    if now != reps[s]:
                        reps[s], held[s] = now, held[0] if s and now == reps[0] else sets(side)
                x, y = held
                both = common_items(x, y)
                nx, ny = (np.array([len(m) // 8 for m in side]) for side in held)
                cx, cy = (side.field("comp").to_numpy() for side in sides)
                i, j = np.nonzero((100 * both >= share * (nx[:, None] + ny - both)) & (cx[:, None] != cy))
                low, high = spanning(cx[i], cy[j])
                name = {c: r for comps, who in zip((cx, cy), reps) for c, r in zip(comps.tolist(), who)}
                yield rows_out(schema, [name[c] for c in low], [name[c] for c in high])

    return run, "a long, b long"


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """For links between components, each component with the smallest one that they join it to."""
    comps, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left):]
    label = np.arange(len(comps))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(comps)))
    return comps[label[moved]].tolist(), comps[moved].tolist()
