"""Best-fit packing of token sequences by bin completion branch and bound."""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import tidy
from scoreframe.llm.text import hashes, lower, runs, spread_out, words
from scoreframe.session import ship, store

REMEMBERED = 1 << 20
LONGEST_STOP = 3
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
SEPARATOR = 1


def token_spans(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans that the tokenizer treats alone: lower-cased data, starts, ends, texts' limits.

    Beside white space it separates letters from the punctuation after them, so that a word
    is the same at the end of a sentence. It ignores case, but for its special tokens, all
    of which have a `<`: words with one stay as they are.
    """
    starts, ends, bounds = words(data, offsets)
    low = lower(data)
    for at in np.unique(np.searchsorted(starts, np.flatnonzero(data == ord("<")), "right") - 1):
        low[starts[at] : ends[at]] = data[starts[at] : ends[at]]
    stops = ends.copy()
    for _ in range(LONGEST_STOP):
        stops -= _STOP[low[np.maximum(stops - 1, 0)]] & (stops > starts)
    split = (stops < ends) & (stops > starts)
    split &= _LETTER[low[np.maximum(stops - 1, 0)]]
    at = np.flatnonzero(split)
    starts = np.insert(starts, at + 1, stops[at])
    ends = np.insert(ends, at, stops[at])
    before = np.concatenate([[0], np.cumsum(split)])
    return low, starts, ends, bounds + before[bounds]


class WordTokens:
    """Token ids of words, remembered by hash; the memory is emptied when it is full.

    The tokenizer drops white space and never joins what it separates, so the ids of a text
    are those of its words one after the other. New words are encoded together, with a
    control character of known id between them.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        (self.between,) = self.tokenizer.encode(chr(SEPARATOR), add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes in order
        self.begin = self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def _find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.known, values)
        if not len(self.known):
            return place, np.zeros(len(values), bool)
        place = np.minimum(place, len(self.known) - 1)
        return place, self.known[place] == values

    def _learn(
        self, values: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> None:
        sizes = ends - starts
        group, place = spread_out(sizes)
        content = data[starts[group] + place]
        odd = np.zeros(len(sizes), bool)
        odd[group[content == SEPARATOR]] = True
        begins = np.cumsum(sizes + 3) - sizes - 3
        joined = np.full(int((sizes + 3).sum()), 32, np.uint8)
        joined[begins + sizes + 1] = SEPARATOR
        joined[begins[group] + place] = np.where(odd[group], 32, content)
        whole = joined.tobytes().decode(errors="replace")
        ids = np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, "<u4")
        marks = np.flatnonzero(ids == self.between)
        counts = np.diff(np.concatenate([[-1], marks])) - 1
        flat = np.delete(ids, marks)
        starting = len(self.pool) + np.cumsum(counts) - counts
        for i in np.flatnonzero(odd):
            word = data[starts[i] : ends[i]].tobytes().decode(errors="replace")
            own = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4")
            starting[i], counts[i] = len(self.pool) + len(flat), len(own)
            flat = np.concatenate([flat, own])
        self.pool = np.concatenate([self.pool, flat])
        known = np.concatenate([self.known, values])
        order = np.argsort(known)
        self.known = known[order]
        self.begin = np.concatenate([self.begin, starting])[order]
        self.count = np.concatenate([self.count, counts])[order]

    def encode(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each word has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        codes, unique = pd.factorize(hashes(data, starts, ends))
        where = np.zeros(len(unique), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        new = ~self._find(unique)[1]
        if new.any():
            at = where[new]
            self._learn(unique[new], data, starts[at], ends[at])
        place = self._find(unique)[0][codes]
        counts = self.count[place]
        before = np.cumsum(counts) - counts
        shift = np.repeat(self.begin[place] - before, counts)
        return self.pool[np.arange(len(shift)) + shift], counts


@functools.cache
def word_tokens(tokenizer_file: str) -> WordTokens:
    """The tokens of one worker process, kept from task to task."""
    return WordTokens(tokenizer_file)


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest bin that takes it.

    That bin stays the fullest for further copies of the length, which go in together.
    """
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    for length, count in zip(sizes[::-1].tolist(), counts[::-1].tolist()):
        while count:
            at = bisect.bisect_left(rooms, (length, -1))
            if at < len(rooms):
                room, number = rooms.pop(at)
            else:
                room, number = capacity, len(bins)
                bins.append([])
            copies = min(count, room // length)
            bins[number].extend([length] * copies)
            count -= copies
            if room > length * copies:
                bisect.insort(rooms, (room - length * copies, number))
    return bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without: for each t, lengths over capacity - t stand alone
    as far as those of at least t are concerned (Martello and Toth's L2)."""
    sizes = np.arange(len(counts))
    number = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(counts * sizes)])
    t = np.arange(capacity // 2 + 1)
    alone = number[-1] - number[capacity - t + 1]
    half = number[-1] - number[capacity // 2 + 1]
    room = half * capacity - (total[-1] - total[capacity // 2 + 1])
    room = room - (alone * capacity - (total[-1] - total[capacity - t + 1]))
    small = total[capacity // 2 + 1] - total[t]
    return int((half + np.maximum(0, -(-(small - room) // capacity))).max())


def sums(
    sizes: list[int],
    copies: list[int],
    reach: list[int],
    tries: list[int],
    i: int,
    left: int,
    many: int,
) -> Iterator[tuple[int, ...]]:
    """All ways to make `left` of `many` lengths of sizes[i:], the most even ones first.

    `sizes` descend; the bits of reach[i] are the sums that sizes[i:] can make in any number.
    Every step takes one of `tries`, and there are no more ways once these are used up.
    """
    tries[0] -= 1
    if not many:
        yield ()
        return
    low = bisect.bisect_left(sizes, -left, i, key=lambda x: -x)
    high = bisect.bisect_right(sizes, left // -many, i, key=lambda x: -x)
    for j in range(high - 1, low - 1, -1):
        for taken in range(1, min(copies[j], many, left // sizes[j]) + 1):
            rest, more = left - taken * sizes[j], many - taken
            if tries[0] <= 0:
                return
            if more * sizes[-1] > rest or (rest > 0) != (more > 0):
                continue
            if reach[j + 1] >> rest & 1:
                for ending in sums(sizes, copies, reach, tries, j + 1, rest, more):
                    yield (sizes[j],) * taken + ending


def dominated(chosen: tuple[int, ...], unused: int, waste: int) -> bool:
    """Whether an unused length fits beside the chosen ones, or in place of one smaller or two.

    `unused` has a bit for every length of which a copy is left. What the longer length
    replaces fits where that would have gone, so that other filling is never worse.
    """
    if unused & ((2 << waste) - 2):
        return True
    larger, same = (1 << waste) - 1, (2 << waste) - 1
    if waste and any(unused >> (x + 1) & larger for x in set(chosen)):
        return True
    pairs = {x + y for i, x in enumerate(chosen) for y in chosen[i + 1 :]}
    return any(unused >> pair & same for pair in pairs)


def fillings(
    counts: np.ndarray,
    room: int,
    width: int,
    most: int | None = None,
    tries: list[int] | None = None,
) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, lengths): the `width` least wasteful undominated ways to fill `room`.

    All ways are gone through in order of their waste, up to `most`, and of their number of
    lengths. Those `dominated` are left out, and no others unless `tries` are used up.
    """
    tries = [1 << 62] if tries is None else tries
    most = room if most is None else min(most, room)
    sizes = np.flatnonzero(counts[: room + 1])
    sizes = sizes[sizes > 0][::-1]
    number = counts[sizes].tolist()
    small = np.cumsum((counts * np.arange(len(counts)))[: room + 1])
    sizes = sizes.tolist()
    copies = [min(n, room // size) for n, size in zip(number, sizes)]
    reach, whole = [1], (2 << room) - 1
    for size, count in zip(reversed(sizes), reversed(copies)):
        bits, step = reach[-1], 1
        while count:
            step = min(step, count)
            bits |= bits << size * step
            count -= step
            step *= 2
        reach.append(bits & whole)
    reach.reverse()
    present = sum(1 << size for size in sizes)
    found = []
    for waste in range(most + 1):
        if small[waste] > room - waste:  # what fits beside a filling must be in it
            break
        if not reach[0] >> (room - waste) & 1:
            continue
        for chosen in _by_number(sizes, copies, reach, tries, room - waste):
            unused = present
            for size in set(chosen):
                if chosen.count(size) == counts[size]:
                    unused ^= 1 << size
            if not dominated(chosen, unused, waste):
                found.append((waste, chosen))
            if len(found) == width:
                return found
        if tries[0] <= 0:
            break
    return found


def _by_number(
    sizes: list[int], copies: list[int], reach: list[int], tries: list[int], total: int
) -> Iterator[tuple[int, ...]]:
    """All ways to make `total`, those of few lengths first."""
    if not total:
        yield ()
        return
    for many in range(-(-total // sizes[0]), min(sum(copies), total // sizes[-1]) + 1):
        yield from sums(sizes, copies, reach, tries, 0, total, many)


def bin_completion(
    lengths: Sequence[int],
    capacity: int,
    width: int = 1,
    effort: int = 32,
    least: int = 10_000,
) -> list[list[int]]:
    """Pack lengths into few bins by branch and bound, starting from best-fit decreasing.

    Bins are completed around the largest remaining length, least wasteful filling first;
    fillings are listed `width` at a time, then twice as many, until all have been tried. A
    branch ends when its waste exceeds what one bin less than the best packing so far
    allows. The search ends when the lower bound is met, when nothing is left to try (the
    packing is then optimal), or after `effort` steps per bin of the incumbent, `least` at
    least.
    """
    best = best_fit(lengths, capacity)
    counts = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)
    bound, total = lower_bound(counts, capacity), int(sum(lengths))
    tries = [max(least, effort * len(best))]
    path: list[list] = []  # largest, fillings, how many tried, asked for, in use, waste before
    waste, remaining = 0, len(lengths)
    while len(best) > bound and tries[0] > 0:
        allowed = (len(best) - 1) * capacity - total
        if remaining:
            largest = int(np.flatnonzero(counts)[-1])
            counts[largest] -= 1
            tries[0] -= 1
            options = fillings(counts, capacity - largest, width, allowed - waste, tries)
            path.append([largest, options, 0, width, None, waste])
        else:
            best = [[step[0], *step[4]] for step in path]
            allowed = (len(best) - 1) * capacity - total
        while path:
            step = path[-1]
            largest, options, tried, asked, used, before = step
            if used is not None:
                for size in used:
                    counts[size] += 1
                remaining += 1 + len(used)
                waste, step[4] = before, None
            if tried == asked and before + options[-1][0] <= allowed and tries[0] > 0:
                step[3] = asked = 2 * asked
                room = capacity - largest
                step[1] = options = fillings(counts, room, asked, allowed - before, tries)
            if (
                tried < len(options)
                and before + options[tried][0] <= allowed
                and len(path) < len(best)
            ):
                lost, step[4] = options[tried]
                step[2] += 1
                for size in step[4]:
                    counts[size] -= 1
                remaining -= 1 + len(step[4])
                waste = before + lost
                break
            counts[largest] += 1
            path.pop()
        if not path:
            break
    return best


def cut_pieces(
    docs: DataFrame, tokenizer_file: str, doc_id: str, text: str, capacity: int, end: int
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids and the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_file)
        for batch in batches:
            for first, last, data, offsets in runs(batch.column("text")):
                low, starts, ends, bounds = token_spans(data, offsets)
                ids, counts = tokens.encode(low, starts, ends)
                limits = np.concatenate([[0], np.cumsum(counts)])[bounds].tolist()
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(last - first):
                    whole = np.append(ids[limits[i] : limits[i + 1]], np.uint32(end))
                    for number, at in enumerate(range(0, len(whole), capacity)):
                        part = whole[at : at + capacity]
                        row.append(i)
                        piece.append(number)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                ids_here = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids_here.take(pa.array(row, pa.int64())),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(tidy(cut), schema)


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end: int = 1,
    group: int = 1024,
) -> DataFrame:
    """Pack every row's tokens and an end id into few sequences of at most `capacity` tokens.

    A document longer than `capacity` is cut into pieces of that length and a rest. Returns
    per piece: doc_id, piece, start (ids of its document before it), length, ids_crc32,
    sequence_id, offset (its place in the sequence). A null or empty text is one piece of
    the end id alone. Repeated rows and null ids are packed like others. An empty table
    gives an empty result; other columns are not looked at.

    Pieces are dealt evenly into groups of about `group` sequences, by their tokens alone,
    each packed in one task by `bin_completion`; a group wastes at most part of its last
    sequences.
    """
    ship(docs.sparkSession)
    pieces = store(cut_pieces(docs, tokenizer_file, doc_id, text, capacity, end), "pieces")
    tokens = pieces.agg(F.sum("length").alias("tokens")).first().tokens or 0
    groups = 1 + tokens // (capacity * group)
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("number")

    def packed(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.argsort(lengths, kind="stable")
        begins = np.searchsorted(lengths[order], np.arange(capacity + 2))
        used = begins.copy()
        sequence = np.zeros(len(lengths), np.int64)
        offset = np.zeros(len(lengths), np.int64)
        full = np.flatnonzero(lengths == capacity)
        sequence[full] = np.arange(len(full))
        bins = bin_completion(lengths[lengths < capacity].tolist(), capacity)
        for number, chosen in enumerate(bins, start=len(full)):
            at = 0
            for size in chosen:
                place = order[used[size]]
                used[size] += 1
                sequence[place], offset[place] = number, at
                at += size
        base = table["number"].to_numpy() << 32
        return (
            table.drop_columns("number")
            .append_column("sequence_id", pa.array(base + sequence))
            .append_column("offset", pa.array(offset))
        )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    return pieces.select("*", dealt).groupBy("number").applyInArrow(packed, schema)
