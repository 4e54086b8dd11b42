"""Fill-in-middle transformation by displacement scatter.

The bytes of a batch of texts are one array. Three cuts of each document say where its
parts begin; a difference array holds at these places by how much the way of a byte to
its place in the output changes, and its running sum is the way of every byte. One
scatter writes all bytes, and one gather takes them back out of the outputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from relgraph.llm.common import flat, lean, slices

_STEP = 1 << 20  # bytes worked on at once, so that a very long text takes little more than its own size
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Marks of three bytes before each part.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_KIND = np.zeros(256, bool)
_KIND[[80, 83, 77]] = True


def unit_starts(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a code point starts, and where a unit does: a run of A-Z and a-z, or any other code point."""
    point = (body & 0xC0) != 0x80
    unit = point.copy()
    for lo in range(1, len(body), _STEP):
        hi = min(lo + _STEP, len(body))
        letter = _LETTER[body[lo - 1: hi]]
        unit[lo:hi] &= ~(letter[1:] & letter[:-1])
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    unit[first] = True
    return point, unit


def count_before(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Set flags before each of the ascending ``places``."""
    out, before = np.zeros(len(places), np.int64), 0
    for lo in range(0, len(flags), _STEP):
        hi = min(lo + _STEP, len(flags))
        a, b = np.searchsorted(places, (lo, hi))
        sums = np.concatenate([[0], np.cumsum(flags[lo:hi])])
        out[a:b] = before + sums[places[a:b] - lo]
        before += int(sums[-1])
    out[np.searchsorted(places, len(flags)):] = before
    return out


def place_of(flags: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Places of the set flags with these ascending numbers, counted from 0; one past the last is the end."""
    out, before = np.full(len(numbers), len(flags), np.int64), 0
    for lo in range(0, len(flags), _STEP):
        at = np.flatnonzero(flags[lo: lo + _STEP])
        a, b = np.searchsorted(numbers, (before, before + len(at)))
        out[a:b] = lo + at[numbers[a:b] - before]
        before += len(at)
    return out


def shifts(size: int, places: np.ndarray, change: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(from, to, shift of each)`` over all places below ``size``: running sums of a difference array.

    ``places`` ascend; ``change`` is by how much the shift changes there.
    """
    carried = 0
    for lo in range(0, size, _STEP):
        hi = min(lo + _STEP, size)
        a, b = np.searchsorted(places, (lo, hi))
        jump = np.zeros(hi - lo, np.int64)
        np.add.at(jump, places[a:b] - lo, change[a:b])
        jump[0] += carried
        shift = np.cumsum(jump)
        carried = int(shift[-1])
        yield lo, hi, shift


def _changes(shift: np.ndarray) -> np.ndarray:
    return np.diff(shift.ravel(), prepend=0)


def marks(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all marks, and the text each lies in."""
    found = []
    for lo in range(0, len(body) - 2, _STEP):
        part = body[lo: lo + _STEP + 2]
        found.append(lo + np.flatnonzero((part[:-2] == 60) & (part[2:] == 62) & _KIND[part[1:-1]]))
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    owner = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[owner + 1]
    return at[inside], owner[inside]


def _write_marks(out: np.ndarray, places: np.ndarray, mark: bytes) -> None:
    for k, value in enumerate(mark):
        out[places + k] = value


def cut_and_scatter(body, offsets, draws, plain_from: int, spm_below: int):
    """Forms, units, code points of prefix and middle (masked where plain), and the outputs with their offsets."""
    point, unit = unit_starts(body, offsets)
    begin, end = offsets[:-1], offsets[1:]
    units_before = count_before(unit, offsets)
    n = np.diff(units_before)
    two = np.sort(draws[:2] % (n + 1), axis=0)
    ordinals = (units_before[:-1] + two).T.ravel()
    cut, back = np.minimum(place_of(unit, ordinals), np.repeat(end, 2)).reshape(-1, 2).T
    points = count_before(point, np.stack([begin, cut, back], 1).ravel()).reshape(-1, 3)
    marked = np.zeros(len(n), bool)
    marked[marks(body, offsets)[1]] = True
    plain = marked | (begin == end) | (draws[2] % 100 >= plain_from)
    spm = ~plain & (draws[3] % 100 < spm_below)

    prefix, middle, suffix = cut - begin, back - cut, end - back
    out_offsets = np.concatenate([[0], np.cumsum(end - begin + np.where(plain, 0, 9))])
    at = out_offsets[:-1]
    # where each part goes
    to_prefix = at + np.where(spm, 6 + suffix, 3)
    to_suffix = at + np.where(spm, 3, 6 + prefix)
    to_middle = at + 9 + prefix + suffix
    targets = np.stack([np.where(plain, at, to_prefix), np.where(plain, at + prefix, to_middle), np.where(plain, at + prefix + middle, to_suffix)], 1)
    sources = np.stack([begin, cut, back], 1)
    out = np.empty(int(out_offsets[-1]), np.uint8)
    for lo, hi, shift in shifts(len(body), sources.ravel(), _changes(targets - sources)):
        out[shift + np.arange(lo, hi)] = body[lo:hi]
    made = ~plain
    _write_marks(out, (to_prefix - 3)[made], PREFIX)
    _write_marks(out, (to_suffix - 3)[made], SUFFIX)
    _write_marks(out, (to_middle - 3)[made], MIDDLE)
    form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
    return form, n, plain, np.diff(points, axis=1), out, out_offsets


def gather_back(out, out_offsets, plain, spm):
    """The texts that these outputs were made of, and their offsets."""
    begin, end = out_offsets[:-1], out_offsets[1:]
    at, owner = marks(out, out_offsets)
    made = ~plain[owner]
    at, owner = at[made], owner[made]
    if (np.bincount(owner, minlength=len(plain)) != np.where(plain, 0, 3)).any():
        raise ValueError("an output does not hold its three marks")
    place = np.zeros((3, len(plain)), np.int64)
    place[:, ~plain] = at.reshape(-1, 3).T
    _, second, third = place
    ahead, behind = second - begin - 3, third - second - 3  # lengths of the first and of the second part
    prefix, suffix = np.where(spm, behind, ahead), np.where(spm, ahead, behind)
    middle = end - third - 3
    size = np.where(plain, end - begin, prefix + middle + suffix)
    offsets = np.concatenate([[0], np.cumsum(size)])
    start = offsets[:-1]
    targets = np.stack([start, np.where(plain, start, start + prefix), np.where(plain, start, start + prefix + middle)], 1)
    from_prefix, from_suffix = np.where(spm, second + 3, begin + 3), np.where(spm, begin + 3, second + 3)
    sources = np.stack([np.where(plain, begin, from_prefix), np.where(plain, begin, third + 3), np.where(plain, begin, from_suffix)], 1)
    text = np.empty(int(offsets[-1]), np.uint8)
    for lo, hi, shift in shifts(len(text), targets.ravel(), _changes(sources - targets)):
        text[lo:hi] = out[shift + np.arange(lo, hi)]
    return text, offsets


def _strings(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(body)]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def _transform(plain_from: int, spm_below: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _STEP):
                body, offsets = flat(part.column("text"))
                draws = np.stack([part.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)])
                form, n, plain, chars, out, ends = cut_and_scatter(body, offsets, draws, plain_from, spm_below)
                columns = [part.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()),
                           pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1], mask=plain), _strings(out, ends)]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    A text has ``n`` units: runs of A-Z and a-z, and every other code point. Four draws
    come from the SHA-256 of ``seed:doc_id``; two of them, modulo n + 1, cut the text into
    prefix, middle and suffix. ``psm`` is written as prefix, suffix, middle and ``spm`` as
    suffix, prefix, middle, each part after its mark; the third draw modulo 100 from
    ``plain_from`` on leaves a text ``plain``, the fourth below ``spm_below`` takes ``spm``.
    Empty texts and such as hold a mark themselves are plain: their output is the text,
    their counts of code points are null.

    Rows are independent: nothing is shuffled, and repeated rows come out alike. Null
    texts count as empty, a null id as no digits. Other columns are left out; an empty
    table gives no rows. A very long text is worked on piece by piece.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = lean(docs).select("doc_id", F.col(text).alias("text"), *draws)
    return rows.mapInArrow(_transform(plain_from, spm_below), _OUT)


def _restore(keep: list[str], output: str, form: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, output, _STEP):
                kinds = part.column(form).to_pylist()
                plain = np.array([k is None or k == PLAIN for k in kinds], bool)
                spm = np.array([k == SPM for k in kinds], bool)
                body, offsets = flat(part.column(output))
                text, ends = gather_back(body, offsets, plain, spm)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _strings(text, ends)], names=[*keep, "restored"])

    return run


def restore(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``outputs`` with ``restored``: the texts, from output and form alone.

    Null outputs count as empty, a null form as plain; an output of another form
    without exactly three marks is an error. A column named ``restored`` is replaced.
    """
    rows = lean(outputs).drop("restored")
    schema = StructType([*rows.schema.fields, StructField("restored", StringType())])
    return rows.mapInArrow(_restore(rows.columns, output, form), schema)
