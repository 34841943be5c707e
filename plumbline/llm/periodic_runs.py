"""Periodic runs: maximal stretches of words that repeat with one period, found by Main-Lorentz divide and conquer.

Words are interned, so a text is an array of ids; a slice of a partition is one array of all its texts with marks that
equal nothing between them. Halving it over and over puts every run across one midpoint that lies highest: there the run
is whole, and nowhere below. A run of LEAST_REPEATS periods has two of them on one side of that midpoint, so the
Z-function of the half from the midpoint (the common prefix of the half and itself q words on) gives its period, and for
the other side that of the reversed half; the run is then extended across. Runs that reach over the edge of their piece
are left to the midpoint above. Stretches found with several periods keep the smallest.

Low levels hold many short halves, which numpy works on together; high levels hold few long ones, worked on one by one,
with a Z-box, so that a text of a single word repeated costs n log n as well. One pass, no shuffle: a text is the unit.

Defined results. Null counts as a text without words. Words are what WORD in common matches. A run has a smallest period
q and at least max(least, LEAST_REPEATS * q) words, and no neighbouring word extends it with period q. Runs go by start, then
period. Repeated rows give repeated results; an empty table gives none. Columns that are not asked for may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokens

#: Fixed values of the contract: a run's fewest periods and words.
LEAST_REPEATS = 4
LEAST = 6
#: Halves of up to so many words are worked on together.
TOGETHER = 64
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def agree(s: np.ndarray, x: int, y: int, most: int, step: int = 1) -> int:
    """How many words from x and from y on agree, most at most; step -1 looks back."""
    k, size = 0, 16
    while k < most:
        n = min(size, most - k)
        one, two = x + step * k, y + step * k
        differ = s[one : one + n] != s[two : two + n] if step > 0 else s[one - n + 1 : one + 1][::-1] != s[two - n + 1 : two + 1][::-1]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k, size = k + n, size * 2
    return most


def prefix_squares(s: np.ndarray, m: int, size: int, step: int) -> Iterator[tuple[int, int]]:
    """(q, z) with z >= q of the Z-function of the half that starts at m: z words agree with those q further on.

    step -1 is the half that ends there, read backwards. Multiples of a period whose run covers them are passed over.
    """
    half = s[m : m + size] if step > 0 else s[m - size + 1 : m + 1][::-1]
    at = np.flatnonzero(half[1 : size // 2 + 1] == half[0]) + 1
    for j in range(1, min(4, size)):  # a period of q needs z >= q, so the next words agree too
        at = at[(at <= j) | (half[np.minimum(at + j, size - 1)] == half[j])]
    known: dict[int, int] = {}
    left = right = 0
    while len(at):
        q, at = int(at[0]), at[1:]
        z = min(right - q, known.get(q - left, 0)) if q < right else 0
        if q >= right or q + z >= right or q - left not in known:
            z += agree(s, m + step * z, m + step * (q + z), size - q - z, step)
            left, right = q, q + z
        known[q] = z
        if z >= q:
            yield q, z
            if len(at):
                same = (at % q == 0) & (2 * at <= q + z)
                known.update(zip(at[same].tolist(), (q + z - at[same]).tolist(), strict=True))
                at = at[~same]


def runs_across(s: np.ndarray, m: int, first: int, last: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs across midpoint m that lie whole between first and last."""
    for q, z in prefix_squares(s, m, last - m, 1):
        yield m - agree(s, m - 1, m - 1 + q, m - first, -1), m + q + z, q
    for q, z in prefix_squares(s, m - 1, m - first, -1):
        yield m - q - z, m + agree(s, m, m - q, last - m), q


def runs_across_all(s: np.ndarray, mids: np.ndarray, h: int) -> Iterator[np.ndarray]:
    """The same, [start, end, period], for many midpoints with halves of h words."""
    for step in (1, -1):
        base = mids if step > 0 else mids - 1
        half = s[base[:, None] + step * np.arange(h)]
        i, q = np.nonzero(half[:, 1 : h // 2 + 1] == half[:, :1])
        q = q + 1
        z, open_ = np.ones(len(i), np.int64), np.arange(len(i))
        for k in range(1, h):
            open_ = open_[q[open_] + k < h]
            open_ = open_[half[i[open_], k] == half[i[open_], q[open_] + k]]
            if not len(open_):
                break
            z[open_] += 1
        good = z >= q
        i, q, z = i[good], q[good], z[good]
        far, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
        other = base[i] - step  # the first word beyond the midpoint
        for k in range(h):
            place = other[open_] - step * k
            open_ = open_[s[place] == s[place + step * q[open_]]]
            if not len(open_):
                break
            far[open_] += 1
        m, reach = mids[i], q + z
        yield np.stack([m - far, m + reach, q] if step > 0 else [m - reach, m + far, q], 1)


def find_runs(s: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period), sorted, of all runs in texts that lie from starts to ends in s.

    s has TOGETHER marks on either side and a mark between texts, each of them unlike anything else.
    """
    found, n = [np.zeros((0, 3), np.int64)], len(s) - TOGETHER
    h = 4  # a run of LEAST words lies across a multiple of 4
    while h <= TOGETHER:
        mids = np.arange((TOGETHER + h - 1) // (2 * h) * 2 * h + h, n, 2 * h)
        found += runs_across_all(s, mids, h) if len(mids) else []
        h *= 2
    ones = []
    while h <= len(s):
        for m in range(h, n, 2 * h):
            text = int(np.searchsorted(starts, m, "right")) - 1
            if text >= 0 and starts[text] < m < ends[text]:
                ones += runs_across(s, m, max(m - h, int(starts[text])), min(m + h, int(ends[text])), least)
        h *= 2
    if ones:
        found.append(np.array(ones, np.int64))
    runs = np.concatenate(found)
    a, b, q = runs.T
    # what goes on beyond the edge of its piece is whole elsewhere
    whole = (b - a >= np.maximum(least, LEAST_REPEATS * q)) & (s[a - 1] != s[a - 1 + q]) & (s[b] != s[b - q])
    runs = runs[whole]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))[: len(runs)]
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _texts(texts: pa.Array, least: int) -> tuple[list[int], pa.Array, pa.Array]:
    """(words, runs, text without the repeats) of each text."""
    ids: defaultdict = defaultdict(count().__next__)
    split = [x.split() for x in (texts.cast(pa.binary()).to_pylist())]  # bytes split at the blanks of WORD
    sizes = np.array([len(x) for x in split], np.int64)
    starts = TOGETHER + np.cumsum(sizes + 1) - sizes
    ends = starts + sizes
    total = int(ends[-1]) if len(ends) else TOGETHER
    s = -1 - np.arange(total + TOGETHER + 1, dtype=np.int64)
    for x, a in zip(split, starts.tolist(), strict=True):
        s[a : a + len(x)] = np.fromiter(map(ids.__getitem__, x), np.int64, len(x))
    runs = find_runs(s, starts, ends, least)
    a, b, q = runs.T
    drop = np.zeros(len(s) + 1, np.int64)
    np.add.at(drop, a + q, 1)
    np.add.at(drop, b, -1)
    keep = np.cumsum(drop) == 0
    text = np.searchsorted(starts, a, "right") - 1
    offsets = np.searchsorted(text, np.arange(len(split) + 1)).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(a - starts[text]), pa.array(b - a), pa.array(q)], names=["start", "length", "period"])
    some = set(text.tolist())
    left = [b" ".join(compress(x, keep[p : p + len(x)].tolist()) if i in some else x) for i, (x, p) in enumerate(zip(split, starts.tolist(), strict=True))]
    return sizes.tolist(), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(left, pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs, and its words, joined by a blank, without what runs repeat.

    A run keeps its first period; words in several runs go if any of them drops them.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                words, runs, left = _texts(part.column(1), least)
                yield pa.record_batch([part.column(0), pa.array(words, pa.int64()), runs, left], names=["doc_id", "n_words", "runs", "collapsed"])
            tokens.release()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")
