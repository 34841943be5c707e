"""Numpy kernels over batches of texts: word hashes, shingle sets, MinHash signatures. All arithmetic is modulo 2**64."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are hashed in slices of about this many bytes, so that temporary arrays stay small; one text is never cut.
SLICE_BYTES = 1_000_000


def release() -> None:
    """Gives freed memory back to the system: workers live on between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche permutation of 64-bit values."""
    x = x.astype(U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(factor)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random values."""
    return mix64((np.arange(1, n + 1, dtype=U) + U(seed) * U(1_000_003)) * U(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = stream(1, 256)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
STEP = U(0x9E3779B97F4A7C15 | 1)
PLACE = stream(2, 8) | U(1)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of about `most` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null counts as empty."""
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    arr = pa.concat_arrays([arr])
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def run_ids(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the runs of true values, number of runs before each offset); runs end at offsets, too."""
    before = np.empty(len(keep), bool)
    before[:1] = False
    before[1:] = keep[:-1]
    before[offsets[:-1][offsets[:-1] < len(keep)]] = False
    starts = np.flatnonzero(keep & ~before)
    return starts, np.searchsorted(starts, offsets)


def run_hashes(values: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A polynomial hash of each run; values elsewhere count as nothing."""
    if not len(starts):
        return np.zeros(0, U)
    reach = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, reach)[: len(values) - starts[0]] if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(values)) - np.repeat(starts, reach)])
    powers = np.multiply.accumulate(np.full(int(reach.max()) + 1, STEP, U))
    return mix64(np.add.reduceat(np.where(keep, values * powers[place], U(0)), starts))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word offsets of the texts); words are runs of other bytes than space and 0x09-0x0D, A-Z lower-cased."""
    raw, offsets = utf8(texts)
    keep = ~SPACE[raw]
    starts, words = run_ids(keep, offsets)
    return run_hashes(BYTE[raw], keep, starts), words


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each): k consecutive words each; a text of 1 to k - 1 words is one shingle as a whole."""
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    total = np.zeros(len(words), U)
    for j in range(k):
        part = np.zeros(len(words), U)
        part[: max(0, len(words) - j)] = words[j:] * PLACE[j]
        inside = np.arange(len(words)) + j < offsets[1:][text] if len(words) else np.zeros(0, bool)
        total += np.where(inside, part, U(0))
    index = np.arange(len(words)) - offsets[:-1][text] if len(words) else np.zeros(0, np.int64)
    left = n[text] - index if len(words) else index
    whole = (left >= k) | (index == 0)
    return mix64(total + np.minimum(left, k).astype(U) * PLACE[7])[whole], text[whole]


def distinct_sets(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes text by text, offsets)."""
    order = np.argsort(hashes)
    order = order[np.argsort(text[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], np.searchsorted(t[new], np.arange(n + 1))


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes text by text, offsets)."""
    words, offsets = word_hashes(texts)
    return distinct_sets(*shingles(words, offsets, k), len(texts))


def signatures(sets: np.ndarray, offsets: np.ndarray, n: int, bits: int = 16) -> np.ndarray:
    """[texts, n] MinHash components of `bits` bits (16 at most); rows of empty sets are 0."""
    out = np.zeros((len(offsets) - 1, n), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for i, (a, b) in enumerate(zip(stream(3, n), stream(4, n) | U(1), strict=True)):
            low = np.minimum.reduceat((sets ^ a) * b, starts)
            out[full, i] = (mix64(low) & U((1 << bits) - 1)).astype(np.uint16)
    return out
