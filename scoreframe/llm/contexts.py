"""Context-tree weighting over binary-decomposed bytes, fitted from counts of byte grams.

A byte is coded as eight bits. Each bit, told apart by the bits of its byte before it, has a
context tree of its own, whose contexts are the up to DEPTH bytes before. In every node the
Krichevsky-Trofimov estimate of the bits seen there is mixed, half and half by prior, with
the product of its children. With the counts of the corpus fixed, the weight of stopping in
a node is ½·KT / P_w, and the mixture over all depths is the exact conditional probability
of the next bit.

A gram is a number: the byte before in its highest place, then those before that, and the
coded byte in its lowest. So a tree's nodes are ranges of sorted grams. Subtrees below
contexts of SPLIT bytes are fitted apart, each from at most 256 ** (DEPTH - SPLIT + 1) grams;
what lies above them is one small tree.
"""

from __future__ import annotations

import numpy as np

DEPTH, SPLIT = 5, 3
START, END = 0xFE, 0xFF  # bytes that UTF-8 never holds
HALF = np.log(2)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Γ(x) for x >= ½, by Stirling's series at x + 8."""
    shifted = x + 8
    product = x.copy()
    for i in range(1, 8):
        product *= x + i
    inverse = 1 / shifted
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 / 1260))
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.9189385332046727 + series - np.log(product)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log probability of the Krichevsky-Trofimov estimator; exactly 0 without counts."""
    both = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5)
    found = both - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)
    return np.where(zeros + ones > 0, found, 0.0)


def _one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def _firsts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal ids begins, and the number of the run of each."""
    new = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _weigh(zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log P_w of nodes whose children have log P_w `inner`, and the weight of stopping there."""
    stop = _log_kt(zeros, ones)
    total = np.logaddexp(stop, inner) - HALF
    return total, np.exp(stop - HALF - total)


def _parents(ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, total: np.ndarray):
    """The nodes one byte less deep: ids, counts, log P_w, weights, and each child's parent."""
    first, index = _firsts(ids >> np.uint64(8))
    zeros, ones, inner = (np.add.reduceat(v, first) for v in (zeros, ones, total))
    total, weight = _weigh(zeros, ones, inner)
    return ids[first] >> np.uint64(8), zeros, ones, total, weight, index


def _leaves(keys: np.ndarray, counts: np.ndarray, level: int):
    """Of bit `level` of the coded byte: an order of the grams, the leaf and the bit of each in
    that order, and the leaves' ids and counts. An id is the bits before, after a leading one,
    and then the context.
    """
    symbol = keys & np.uint64(255)
    node = np.uint64(1 << level) | symbol >> np.uint64(8 - level)
    ids = node << np.uint64(8 * DEPTH) | keys >> np.uint64(8)
    order = np.argsort(ids, kind="stable")
    ids, many = ids[order], counts[order].astype(np.float64)
    bit = (symbol[order] >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
    first, leaf = _firsts(ids)
    zeros, ones = (np.add.reduceat(many * side, first) for side in (~bit, bit))
    return order, leaf, bit, ids[first], zeros, ones


def subtrees(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the tree above needs: ids at depth SPLIT - 1, and the sums of the counts and of the
    log P_w of the subtrees below each.

    `keys` are sorted distinct grams and hold all of each subtree they touch.
    """
    parts = []
    for level in range(8 if len(keys) else 0):
        _, _, _, ids, zeros, ones = _leaves(keys, counts, level)
        total = _log_kt(zeros, ones)
        for _ in range(DEPTH - SPLIT):
            ids, zeros, ones, total, _, _ = _parents(ids, zeros, ones, total)
        first, _ = _firsts(ids >> np.uint64(8))
        sums = [np.add.reduceat(v, first) for v in (zeros, ones, total)]
        parts.append((ids[first] >> np.uint64(8), *sums))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0) for _ in range(3))
    return tuple(np.concatenate(column) for column in zip(*parts))


def crown(ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray):
    """The tree above the subtrees, from their sums by sorted id: of each id, what is added to
    the probability found below it, and what that is multiplied by.
    """
    total, weight = _weigh(zeros, ones, inner)
    added, factor = weight * _one(zeros, ones), 1 - weight
    place = np.arange(len(ids))
    for _ in range(SPLIT - 1):
        ids, zeros, ones, total, weight, index = _parents(ids, zeros, ones, total)
        place = index[place]
        own, rest = (weight * _one(zeros, ones))[place], 1 - weight[place]
        added, factor = own + rest * added, rest * factor
    return added, factor


def log_probabilities(keys: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 probability of the byte of each gram after its context, as float64.

    `keys` as in `subtrees`; `top` has the ids of the crown, and both its columns.
    """
    found = np.zeros(len(keys))
    for level in range(8 if len(keys) else 0):
        order, leaf, bit, ids, zeros, ones = _leaves(keys, counts, level)
        one, total, place = _one(zeros, ones), _log_kt(zeros, ones), np.arange(len(ids))
        for _ in range(DEPTH - SPLIT):
            ids, zeros, ones, total, weight, index = _parents(ids, zeros, ones, total)
            place = index[place]
            one = (weight * _one(zeros, ones))[place] + (1 - weight[place]) * one
        at = np.searchsorted(top[0], ids[place] >> np.uint64(8))
        one = (top[1][at] + top[2][at] * one)[leaf]
        found[order] += np.log10(np.where(bit, one, 1 - one))
    return found


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gram of every byte of the texts, followed by those of the texts' ends."""
    key = data.astype(np.uint64)
    last = np.full(len(offsets) - 1, END, np.uint64)
    for distance in range(1, DEPTH + 1):
        shift = np.uint64(8 * (DEPTH + 1 - distance))
        key |= previous(data, offsets, distance, START).astype(np.uint64) << shift
        last |= tails(data, offsets, distance, START).astype(np.uint64) << shift
    return np.concatenate([key, last])


def previous(data: np.ndarray, offsets: np.ndarray, distance: int, blank: int) -> np.ndarray:
    """The value `distance` places before each position of its text; `blank` before its start."""
    earlier = np.full_like(data, blank)
    earlier[distance:] = data[:-distance] if distance else data
    for step in range(distance):
        at = offsets[:-1] + step
        earlier[at[at < offsets[1:]]] = blank
    return earlier


def tails(data: np.ndarray, offsets: np.ndarray, distance: int, blank: int) -> np.ndarray:
    """The value `distance` places before the end of each text (1: its last)."""
    at = offsets[1:] - distance
    values = np.full(len(at), blank, data.dtype)
    inside = at >= offsets[:-1]
    values[inside] = data[at[inside]]
    return values
