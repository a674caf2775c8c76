"""Shingle sets in a global order of tokens, and their adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from scoreframe.llm.text import hashes, lower, mix, runs, shingles, words

COUNTERS = 1 << 22
PART = 1 << 16
SCALE = 4  # classes of frequency per doubling
MOST_MATCHES = 8
VERIFY = 4.0  # cost of verifying a candidate, in list entries read


def text_shingles(
    data: np.ndarray, offsets: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    low = lower(data)
    starts, ends, bounds = words(low, offsets)
    return shingles(hashes(low, starts, ends), bounds, size)


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """A byte per counter: its count on a logarithmic scale; made a part at a time."""
    classes = np.empty(len(counts), np.uint8)
    for begin in range(0, len(counts), PART):
        part = slice(begin, begin + PART)
        classes[part] = np.minimum(np.round(SCALE * np.log2(1.0 + counts[part])), 255)
    return classes


def sorted_sets(
    data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct tokens, rare ones first, end to end, and where each text's begin.

    A token is the frequency class of a shingle's counter in the upper byte and 56 bits of
    its hash, so that numeric order is the global order of tokens.
    """
    found, begins = text_shingles(data, offsets, size)
    common = classes[(found >> np.uint64(42)).astype(np.int64)].astype(np.uint64)
    tokens = common << np.uint64(56) | found & np.uint64((1 << 56) - 1)
    for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        tokens[begin:end].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[begins[:-1][begins[:-1] < len(tokens)]] = True
    return tokens[new], np.concatenate([[0], np.cumsum(new)])[begins]


def signatures(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values that identify each set; 0 for empty ones."""
    first = np.zeros(len(begins) - 1, np.uint64)
    second = np.zeros(len(begins) - 1, np.uint64)
    full = np.diff(begins) > 0
    if full.any():
        spread = mix(tokens + np.uint64(0x9E3779B97F4A7C15))
        first[full] = np.add.reduceat(spread, begins[:-1][full])
        second[full] = np.bitwise_xor.reduceat(mix(spread), begins[:-1][full])
    return first, second


def matches_needed(tokens: np.ndarray, percent: int, noise: float) -> int:
    """How many shared prefix tokens to ask of partners of this set.

    Asking for l of them takes a prefix of n - ceil(percent n / 100) + l tokens. Its lists
    hold so many entries, by the counters beyond what chance fills them with, and at most a
    l-th of the entries can be candidates: the cheapest l is taken.
    """
    size = len(tokens)
    shared = -(-percent * size // 100)
    most = min(MOST_MATCHES, shared)
    longest = tokens[: size - shared + most]
    amount = np.exp2((longest >> np.uint64(56)).astype(np.float64) / SCALE) - 1.0
    entries = np.cumsum(1.0 + np.maximum(0.0, amount - noise))[size - shared :]
    matches = np.arange(1, most + 1)
    return int(np.argmin(entries * (1.0 + VERIFY / matches))) + 1


def prefix_length(size: int, matches: int, percent: int) -> int:
    return size + percent * size // -100 + matches


def linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, are similar enough; an empty set is similar to none."""
    least, most = sorted((len(left), len(right)))
    if not least or 100 * least < percent * most:
        return False
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= percent * (least + most - shared)


def runs_of_sets(
    texts: pa.Array, classes: np.ndarray, size: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in runs(texts):
        yield first, end, *sorted_sets(data, offsets, classes, size)
