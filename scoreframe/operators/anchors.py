"""Rules too many to send: prompts and rules meet in a join on the keys that stand in prompts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.session import store

RUN_BYTES = 1 << 20
# The filter: 16 bits for each of a key's three entries, in chunks of 128 KiB, 128 MiB at most.
CHUNK_BITS = 20
ENTRY_BITS = 16
MOST_CHUNKS = 1024
PROBES = 3
FLUSH = 1 << 19
# Bytes at a key's ends that are looked up by themselves.
END = 8

_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(value: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others (splitmix64)."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _FIRST)


def _windows(data: np.ndarray, largest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For 1, 2, 4 ... bytes up to `largest`: hashes of the windows that begin at each place."""
    size, hashed = 1, _BYTES[data]
    while size <= largest and len(hashed):
        yield size, hashed
        hashed = _mix(hashed[:-size] * _FIRST + hashed[size:] * _SECOND)
        size *= 2


def _first(window: np.ndarray, size: int) -> np.ndarray:
    return _mix(window ^ np.uint64(size))


def _last(window: np.ndarray, size: int) -> np.ndarray:
    return _mix(window ^ np.uint64(size << 32))


def _whole(prefix: np.ndarray, suffix: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Of a key: its first and last window, which overlap and cover it, and its length."""
    return _mix(prefix * _SECOND + suffix + np.asarray(length).astype(np.uint64) * _FIRST)


def _size(length: int) -> int:
    """The largest power of two up to `length`."""
    return 1 << (length.bit_length() - 1)


def _chunk(entries: np.ndarray, chunks: int) -> np.ndarray:
    return (entries >> np.uint64(40)).astype(np.int64) % chunks


def _bits(entries: np.ndarray) -> Iterator[np.ndarray]:
    """The places of `PROBES` bits for each entry in its chunk."""
    spread = _mix(entries + _FIRST)
    for probe in range(PROBES):
        place = spread >> np.uint64(CHUNK_BITS * probe)
        yield (place & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)


def _laid_out(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of about `RUN_BYTES` of a column without nulls: first row, bytes, offsets."""
    texts = texts.cast(pa.large_binary())
    _, bounds, content = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _entries(keys: pa.Array) -> Iterator[np.ndarray]:
    """Three entries of the filter for each key, none of which is empty."""
    for _, data, offsets in _laid_out(keys):
        lengths = np.diff(offsets)
        sizes = np.array([_size(n) for n in lengths.tolist()])
        for size, hashed in _windows(data, int(sizes.max())):
            if size <= END:
                short = hashed
            own = np.flatnonzero(sizes == size)
            begin, end = offsets[own], offsets[own + 1]
            yield _first(short[begin], size)
            yield _last(short[end - min(size, END)], size)
            yield _whole(hashed[begin], hashed[end - size], lengths[own])


class KeyFilter:
    """A Bloom filter of rule keys, and the lengths they have.

    It has an entry for the first bytes of each key, one for the last, `END` or the 1, 2 or 4
    that a shorter key has, and one for the key as a whole. Where the first bytes of some key
    stand in a text, and the last bytes of some key at the end of a span of a length that keys
    have, the span is looked up as a whole, without touching the bytes between: two windows
    cover it, of the largest power of two that it holds. However many keys there are, those
    built alike share most of their ends, which so keep spans apart from keys also where the
    filter is full of wholes.
    """

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits = bits
        self.lengths: dict[int, list[int]] = defaultdict(list)
        for length in sorted(lengths):
            self.lengths[_size(length)].append(length)

    def holds(self, entries: np.ndarray) -> np.ndarray:
        """The places of the entries that may be in the filter."""
        chunk, found = _chunk(entries, len(self.bits)), np.ones(len(entries), bool)
        for bit in _bits(entries):
            found &= (self.bits[chunk, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return np.flatnonzero(found)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, start and length of the spans that may be keys, one for each span of a text."""
        found = []
        for size, hashed in _windows(data, max(self.lengths, default=0)):
            if size <= END:
                short = hashed
            if size not in self.lengths:
                continue
            starts = self.holds(_first(short[: len(hashed)], size))
            texts = np.searchsorted(offsets, starts, "right") - 1
            ends = offsets[texts + 1]
            for length in self.lengths[size]:
                inside = starts + length <= ends
                at, text = starts[inside], texts[inside]
                closed = self.holds(_last(short[at + length - min(size, END)], size))
                at, text = at[closed], text[closed]
                whole = _whole(hashed[at], hashed[at + length - size], length)
                kept = self.holds(whole)
                pairs = np.stack([text[kept].astype(np.uint64), whole[kept]])
                kept = kept[np.unique(pairs, axis=1, return_index=True)[1]]
                found.append((text[kept], at[kept], np.full(len(kept), length)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(parts) for parts in zip(*found))


def key_filter(keys: DataFrame) -> KeyFilter:
    """The filter of all `keys` (one column, no nulls or empty texts, each once).

    Tasks send the distinct entries of their keys, 8 bytes each, dealt by chunk; the bits of a
    chunk are set in one task, one chunk at a time, and at most 128 MiB of them come to the
    driver, however many the keys are.
    """
    length = F.octet_length("key")
    count, lengths = keys.agg(F.count(F.lit(1)), F.collect_set(length)).first()
    chunks = min(MOST_CHUNKS, 1 + (3 * ENTRY_BITS * count >> CHUNK_BITS))

    def dealt(parts: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.unique(np.concatenate(parts))
        chunk = _chunk(entries, chunks)
        order = np.argsort(chunk, kind="stable")
        numbers, begins = np.unique(chunk[order], return_index=True)
        groups = [part.tobytes() for part in np.split(entries[order], begins[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(groups, pa.binary())], ["chunk", "entries"]
        )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for entries in _entries(batch.column(0)):
                parts.append(entries)
                size += len(entries)
                if size >= FLUSH:
                    yield dealt(parts)
                    parts, size = [], 0
        if size:
            yield dealt(parts)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bits = None, np.zeros(1 << CHUNK_BITS, bool)

        def done() -> pa.RecordBatch:
            packed = np.packbits(bits, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "bits"]
            )

        for batch in batches:
            for chunk, entries in zip(batch.column(0).to_pylist(), batch.column(1)):
                if chunk != current:
                    if current is not None:
                        yield done()
                        bits[:] = False
                    current = chunk
                for places in _bits(np.frombuffer(entries.as_buffer(), np.uint64)):
                    bits[places] = True
        if current is not None:
            yield done()

    sent = keys.select("key").mapInArrow(gathered, "chunk int, entries binary")
    sent = sent.repartition("chunk").sortWithinPartitions("chunk")
    table = sent.mapInArrow(filled, "chunk int, bits binary").toArrow()
    bits = np.zeros((chunks, 1 << (CHUNK_BITS - 3)), np.uint8)
    for chunk, own in zip(table["chunk"].to_pylist(), table["bits"]):
        bits[chunk] = np.frombuffer(own.as_buffer(), np.uint8)
    return KeyFilter(bits, lengths)


def joined_rules(prompts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """`rule_predictions` for any number of rules, `rules` (rule_order, key, response).

    Rules are stored once, the first of each key. The tasks that hold prompts get a Bloom
    filter of the keys and emit, for each prompt, the spans that may be keys, each span
    once. These are joined with the rules on the text itself, so what the filter lets pass
    by mistake finds no partner, and the smallest order of each prompt is taken by
    aggregation. Equal prompts are known by half of their SHA-256 and answered once. Then prompts,
    which meet their answers in a join, are shuffled once; columns nobody reads are not.
    """
    spark = prompts.sparkSession
    first = F.struct("rule_order", "response")
    response = F.coalesce("response", F.lit(default)).alias("response")
    known = rules.filter(F.col("key").isNotNull()).select("rule_order", "key", response)
    known = known.groupBy("key").agg(F.min(first).alias("rule"))
    known = store(known.select("key", "rule.*"), "rules")
    # An empty key stands in every prompt, so no later rule ever applies.
    always = known.filter("key = ''").first()
    known = known.filter("key <> ''")
    if always is not None:
        known = known.filter(F.col("rule_order") < F.lit(always["rule_order"]))
    sent = spark.sparkContext.broadcast(key_filter(known))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        for batch in batches:
            for row, data, offsets in _laid_out(batch.column("prompt")):
                texts, starts, lengths = search.spans(data, offsets)
                content = data.tobytes()
                keys = [content[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]
                asked = batch.column("asked").take(pa.array(texts + row))
                yield pa.RecordBatch.from_arrays([asked, pa.array(keys, pa.binary())], ["asked", "key"])

    asked = prompts.select(_asked().alias("asked"), "prompt").filter(F.col("prompt").isNotNull())
    met = asked.mapInArrow(spans, "asked binary, key binary")
    # Spark cannot foresee how many spans tasks emit, and would send them all to each other.
    rule = known.withColumn("key", F.col("key").cast("binary")).hint("merge")
    met = met.join(rule, "key")
    answers = met.groupBy("asked").agg(F.min(first)["response"].alias("__found"))
    otherwise = F.lit(default)
    if always is not None:
        otherwise = F.when(F.col("prompt").isNotNull(), F.lit(always["response"])).otherwise(otherwise)
    answered = prompts.withColumn("__asked", _asked())
    answers = answers.withColumnRenamed("asked", "__asked").hint("merge")
    answered = answered.join(answers, "__asked", "left")
    return answered.select(*prompts.columns, F.coalesce("__found", otherwise).alias("prediction"))


def _asked() -> Column:
    return F.unhex(F.left(F.sha2("prompt", 256), F.lit(32)))
