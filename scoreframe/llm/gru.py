"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of the word itself, if it is in the vocabulary, next to the
mean embedding of its hashed character trigrams. A window's logit is a linear function of
its hidden states, averaged with weights that an attention layer gives them.

The network is trained on windows. To score a text at every window, it runs once over the
text's segments: a segment's windows share its hidden states, and each pools its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from scoreframe.llm.text import ALNUM, hashes, lower, runs, spread_out, words

TRIGRAM_BITS = 12
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 12, 12, 16, 8


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Word hashes of lower-cased texts with their spans, and where each text's words begin."""
    data = lower(data)
    starts, ends, bounds = words(data, offsets, ALNUM)
    return data, starts, ends, bounds, hashes(data, starts, ends)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray):
    """Codes of equal words, the distinct hashes, and the trigrams of each distinct word."""
    codes, unique = pd.factorize(value)
    where = np.zeros(len(unique), np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    begin, size = starts[where], ends[where] - starts[where]
    group, place = spread_out(size)
    at = begin[group] + place
    middle = data[at].astype(np.uint32)
    left = np.where(place > 0, data[at - 1], 0).astype(np.uint32)
    right = np.where(place < size[group] - 1, data[np.minimum(at + 1, len(data) - 1)], 0)
    code = (left << np.uint32(16) | middle << np.uint32(8) | right.astype(np.uint32)) + np.uint32(1)
    trigrams = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS)
    return codes, unique, trigrams.astype(np.int64), size


def windows(bounds: np.ndarray, width: int, stride: int):
    """Positions of the first word of every window, its length, and its text."""
    many = np.diff(bounds)
    count = np.where(many <= width, np.minimum(many, 1), 1 + -(-(many - width) // stride))
    owner, place = spread_out(count)
    first = bounds[:-1][owner] + np.minimum(place * stride, np.maximum(many[owner] - width, 0))
    return first, np.minimum(many[owner], width), owner


def segments(bounds: np.ndarray, width: int, most: int):
    """Positions of the first word of every segment, its length, and its text.

    Segments have `most` words at most, and every run of `width` words of a text lies in
    exactly one; a shorter text is one segment.
    """
    many = np.diff(bounds)
    reach = np.maximum(many - (width - 1), np.minimum(many, 1))
    count = -(-reach // (most - width + 1))
    each = -(-reach // np.maximum(count, 1))
    owner, place = spread_out(count)
    before = place * each[owner]
    some = before < reach[owner]
    owner, before = owner[some], before[some]
    return bounds[:-1][owner] + before, np.minimum(each[owner] + width - 1, many[owner] - before), owner


def initial(vocabulary: int, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def draw(*shape: int, scale: float | None = None) -> np.ndarray:
        return (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

    size = WORD_SIZE + CHAR_SIZE
    return {
        "word": draw(vocabulary + 1, WORD_SIZE, scale=0.1),
        "char": draw(1 << TRIGRAM_BITS, CHAR_SIZE, scale=0.1),
        "input": draw(2, size, 3 * HIDDEN, scale=size**-0.5),
        "bias": np.zeros((2, 3 * HIDDEN), np.float32),
        "state": draw(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
        "attend": draw(2 * HIDDEN, ATTENTION),
        "weigh": draw(ATTENTION, 1),
        "out": draw(2 * HIDDEN, 1),
        "base": np.zeros(1, np.float32),
    }


def embed(p: dict, word: np.ndarray, trigrams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The input of each distinct word: its embedding and the mean of its trigrams'."""
    begins = np.cumsum(sizes) - sizes
    chars = np.add.reduceat(p["char"][trigrams], begins) / sizes[:, None].astype(np.float32)
    return np.concatenate([p["word"][word], chars], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _direction(gates: np.ndarray, ids: np.ndarray, mask, state: np.ndarray, order, keep: bool):
    """Hidden states [step, window, unit] of one direction; with `keep`, what backward needs."""
    hidden = np.zeros((ids.shape[0], HIDDEN), np.float32)
    found = np.empty((ids.shape[1], ids.shape[0], HIDDEN), np.float32)
    kept: list = [None] * ids.shape[1]
    for t in order:
        given = gates[ids[:, t]]
        own = hidden @ state
        both = _sigmoid(given[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
        update, reset = both[:, :HIDDEN], both[:, HIDDEN:]
        fresh = np.tanh(given[:, 2 * HIDDEN :] + reset * own[:, 2 * HIDDEN :])
        following = fresh + update * (hidden - fresh)
        if mask is not None:
            following = np.where(mask[:, t, None], following, hidden)
        if keep:
            kept[t] = (update, reset, fresh, own[:, 2 * HIDDEN :], hidden)
        hidden = found[t] = following
    return found, kept


def _states(p: dict, inputs: np.ndarray, ids: np.ndarray, sizes: np.ndarray, keep: bool = False):
    """Mask, what backward needs, hidden states, and the attention layer and its exponents."""
    steps = ids.shape[1]
    mask = None
    if len(sizes) and sizes.min() < steps:
        mask = np.arange(steps) < sizes[:, None]
    gates = [inputs @ p["input"][d] + p["bias"][d] for d in (0, 1)]
    ahead, kept0 = _direction(gates[0], ids, mask, p["state"][0], range(steps), keep)
    back, kept1 = _direction(gates[1], ids, mask, p["state"][1], range(steps - 1, -1, -1), keep)
    hidden = np.concatenate([ahead, back], axis=2)
    seen = np.tanh(hidden @ p["attend"])
    weight = (seen @ p["weigh"])[..., 0]
    if mask is not None:
        weight = np.where(mask.T, weight, np.float32(-1e9))
    return mask, (kept0, kept1), hidden, seen, np.exp(weight - weight.max(axis=0))


def forward(p: dict, inputs: np.ndarray, ids: np.ndarray, sizes: np.ndarray, keep: bool = False):
    """The logit of each window; `ids` [window, step] are rows of `inputs`."""
    mask, kept, hidden, seen, weight = _states(p, inputs, ids, sizes, keep)
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", weight, hidden)
    logit = (pooled @ p["out"])[:, 0] + p["base"][0]
    return (logit, mask, kept, hidden, seen, weight, pooled) if keep else logit


def highest(p: dict, inputs: np.ndarray, ids: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The largest logit of all windows of `width` words of each segment, one at every word."""
    _, _, hidden, _, weight = _states(p, inputs, ids, sizes)
    steps, many = weight.shape
    width = min(width, steps)
    mass, total = np.zeros((steps + 1, many)), np.zeros((steps + 1, many))
    np.cumsum(weight, axis=0, dtype=np.float64, out=mass[1:])
    np.cumsum(weight * (hidden @ p["out"][:, 0]), axis=0, dtype=np.float64, out=total[1:])
    whole = np.arange(steps - width + 1)[:, None] <= np.maximum(sizes - width, 0)
    share = np.where(whole, mass[width:] - mass[:-width], 1.0)
    logit = np.where(whole, (total[width:] - total[:-width]) / share, -np.inf)
    return logit.max(axis=0) + p["base"][0]


def gradients(p: dict, word, trigrams, char_sizes, ids, sizes, target):
    """Gradients of the mean logistic loss of these windows."""
    inputs = embed(p, word, trigrams, char_sizes)
    logit, mask, kept, hidden, seen, weight, pooled = forward(p, inputs, ids, sizes, keep=True)
    steps, batch = weight.shape
    loss = (_sigmoid(logit) - target).astype(np.float32)[:, None] / batch
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"], g["base"] = pooled.T @ loss, loss.sum(axis=0)
    inner = loss @ p["out"].T
    share = np.einsum("bh,tbh->tb", inner, hidden)
    share = weight * (share - (weight * share).sum(axis=0))
    g["weigh"] = np.einsum("tba,tb->a", seen, share)[:, None]
    before = share[..., None] * p["weigh"][:, 0] * (1 - seen**2)
    g["attend"] = np.einsum("tbh,tba->ha", hidden, before)
    d_hidden = weight[..., None] * inner + before @ p["attend"].T
    d_inputs = np.zeros_like(inputs)
    by_word = np.argsort(ids.T.reshape(-1), kind="stable")
    where, firsts = np.unique(ids.T.reshape(-1)[by_word], return_index=True)
    for d, order in ((0, range(steps - 1, -1, -1)), (1, range(steps))):
        part = slice(d * HIDDEN, (d + 1) * HIDDEN)
        carried = np.zeros((batch, HIDDEN), np.float32)
        given = np.empty((steps, batch, 3 * HIDDEN), np.float32)
        for t in order:
            update, reset, fresh, own, earlier = kept[d][t]
            total = carried + d_hidden[t][:, part]
            on = total if mask is None else total * mask[:, t, None]
            d_fresh = on * (1 - update) * (1 - fresh**2)
            d_own = d_fresh * reset
            d_update = on * (earlier - fresh) * update * (1 - update)
            d_reset = d_fresh * own * reset * (1 - reset)
            given[t] = np.concatenate([d_update, d_reset, d_fresh], axis=1)
            through = np.concatenate([d_update, d_reset, d_own], axis=1)
            g["state"][d] += earlier.T @ through
            carried = through @ p["state"][d].T + on * update + (total - on)
        d_gates = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
        d_gates[where] = np.add.reduceat(given.reshape(steps * batch, -1)[by_word], firsts)
        g["input"][d] = inputs.T @ d_gates
        g["bias"][d] = d_gates.sum(axis=0)
        d_inputs += d_gates @ p["input"][d].T
    np.add.at(g["word"], word, d_inputs[:, :WORD_SIZE])
    shared = d_inputs[:, WORD_SIZE:] / char_sizes[:, None].astype(np.float32)
    np.add.at(g["char"], trigrams, np.repeat(shared, char_sizes, axis=0))
    return g


class Adam:
    """Adam steps with decoupled weight decay."""

    def __init__(self, p: dict, rate: float, decay: float = 0.1):
        self.p, self.rate, self.decay, self.step = p, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def apply(self, g: dict) -> None:
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, grad in g.items():
            self.m[k] += 0.1 * (grad - self.m[k])
            self.v[k] += 0.001 * (grad**2 - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)
            self.p[k] *= 1 - self.rate * self.decay


def lookup(vocabulary: np.ndarray, unique: np.ndarray) -> np.ndarray:
    """Row of each word hash in the embedding; 0 for words outside the vocabulary."""
    if not len(vocabulary):
        return np.zeros(len(unique), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, unique), len(vocabulary) - 1)
    return np.where(vocabulary[at] == unique, at + 1, 0)


def grid(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The word codes of windows as a table, short windows padded with their last word."""
    steps = np.minimum(np.arange(width), np.maximum(sizes, 1)[:, None] - 1)
    return codes[first[:, None] + steps]


def text_logits(model: dict, texts, width: int, most: int) -> np.ndarray:
    """The largest logit of all windows of each text of an Arrow column; NaN where there are
    no words. Texts of more words than `most` are read in segments.
    """
    p, vocabulary = model["parameters"], model["vocabulary"]
    best = np.full(len(texts), np.nan)
    for begin, end, data, offsets in runs(texts):
        data, starts, ends, bounds, value = tokens(data, offsets)
        if not len(value):
            continue
        codes, unique, trigrams, char_sizes = distinct(data, starts, ends, value)
        inputs = embed(p, lookup(vocabulary, unique), trigrams, char_sizes)
        first, sizes, owner = segments(bounds, width, most)
        logits = np.empty(len(first))
        order = np.argsort(sizes, kind="stable")
        for i in range(0, len(first), 256):
            part = order[i : i + 256]
            ids = grid(codes, first[part], sizes[part], int(sizes[part].max()))
            logits[part] = highest(p, inputs, ids, sizes[part], width)
        found = np.full(end - begin, -np.inf)
        np.maximum.at(found, owner, logits)
        has = np.diff(bounds) > 0
        best[begin:end][has] = found[has]
    return best
