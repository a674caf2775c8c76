"""Words, shingles and hashes of whole Arrow batches, computed on their UTF-8 bytes.

All functions work on a run of texts laid end to end: `data` holds the bytes, text `i`
lies between `offsets[i]` and `offsets[i + 1]`. Memory follows the run, about 2 MB of
text unless a single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 21

_LETTERS = np.arange(65, 91)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[_LETTERS] += 32

# Bytes that belong to words: all but ASCII white space.
UNSPACED = np.ones(256, bool)
UNSPACED[[9, 10, 11, 12, 13, 32]] = False

# ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(value: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others (splitmix64)."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def _sequence(start: int, count: int) -> np.ndarray:
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(start))


_VALUES = _sequence(1, 256)
_FACTORS = _sequence(2, 16) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def runs(
    texts: pa.Array, size: int = RUN_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows: first row, end row, data, offsets. Null is empty."""
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, bounds, content = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def words(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = UNSPACED
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each text's words begin among them."""
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[offsets < len(data)]
    first[edges] = inside[edges]
    edges = offsets[offsets > 0] - 1
    last[edges] = inside[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def spread_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of `counts` items laid end to end: the group and the place in it of each."""
    before = np.cumsum(counts) - counts
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - before[group]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span, a polynomial over its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    terms = _VALUES[data[place + np.repeat(starts, lengths)]] * powers[place]
    return mix(np.add.reduceat(terms, before) + lengths.astype(np.uint64))


def sequence_hash(parts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive values."""
    count = max(0, len(parts) - size + 1)
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total += parts[i : i + count] * _FACTORS[i % 16]
    return mix(total + np.uint64(size))


def shingles(
    parts: np.ndarray, bounds: np.ndarray, size: int, short: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's runs of `size` words, and where each text's begin.

    With `short`, a text of fewer words has one: that of all its words.
    """
    many = np.diff(bounds)
    brief = (many > 0) & (many < size) & short
    counts = np.where(many >= size, many - size + 1, brief.astype(np.int64))
    group, place = spread_out(counts)
    at = bounds[:-1][group] + place
    rolled = sequence_hash(parts, size)
    found = rolled[np.minimum(at, len(rolled) - 1)] if len(rolled) else np.zeros(len(at), np.uint64)
    begins = np.concatenate([[0], np.cumsum(counts)])
    for text in np.flatnonzero(brief):
        whole = parts[bounds[text] : bounds[text + 1]]
        found[begins[text]] = sequence_hash(whole, len(whole))[0]
    return found, begins
