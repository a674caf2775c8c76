"""Once-seen and twice-seen Bloom filters over hashes, built in chunks of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scoreframe.llm.text import mix

CHUNK_BITS = 20
PROBES = 4
FLUSH = 1 << 19


def chunks_for(items: int, bits_per_item: int, most: int) -> int:
    """How many chunks of 128 KiB so many items take, `most` at most."""
    return min(most, 1 + items * bits_per_item // (1 << CHUNK_BITS))


def _probes(values: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of each hash inside its chunk, one array per probe."""
    spread = mix(values)
    mask = np.uint64((1 << CHUNK_BITS) - 1)
    halves = [spread, mix(spread + np.uint64(1))]
    for i in range(PROBES):
        yield ((halves[i // 3] >> np.uint64(20 * (i % 3))) & mask).astype(np.int64)


def _chunk(values: np.ndarray, chunks: int) -> np.ndarray:
    return (values >> np.uint64(40)).astype(np.int64) % chunks


def _packed(parts: list[np.ndarray], chunks: int) -> Iterator[pa.RecordBatch]:
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    chunk = _chunk(values, chunks)
    order = np.argsort(chunk, kind="stable")
    values, again, chunk = values[order], counts[order] > 1, chunk[order]
    numbers, begins = np.unique(chunk, return_index=True)
    spans = list(zip(begins, [*begins[1:], len(chunk)]))
    yield pa.RecordBatch.from_pydict(
        {
            "chunk": pa.array(numbers, pa.int32()),
            "hashes": pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()),
            "again": pa.array([again[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def repeat_filter(
    frame: DataFrame, values: Callable[[pa.RecordBatch], Iterable[np.ndarray]], chunks: int
) -> np.ndarray:
    """The bits of the twice-seen filter over the hashes `values` takes from each batch.

    Each task sends its distinct hashes, so one that is everywhere counts once per task.
    A chunk's once-seen and twice-seen bits are filled in one pass over what the tasks
    sent, one chunk at a time. The result is a row of bytes per chunk.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in values(batch):
                parts.append(part)
                size += len(part)
                if size >= FLUSH:
                    yield from _packed(parts, chunks)
                    parts, size = [], 0
        if size:
            yield from _packed(parts, chunks)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            bits = np.packbits(twice).tobytes()
            return pa.RecordBatch.from_pydict(
                {"chunk": pa.array([current], pa.int32()), "bits": [bits]}
            )

        for batch in batches:
            for chunk, hashes, again in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != current:
                    if current is not None:
                        yield done()
                    current = chunk
                    once = np.zeros(1 << CHUNK_BITS, bool)
                    twice = np.zeros(1 << CHUNK_BITS, bool)
                probes = np.stack(list(_probes(np.frombuffer(hashes, np.uint64))))
                before = once[probes].all(axis=0) | np.frombuffer(again, bool)
                twice[probes[:, before]] = True
                once[probes] = True
        if current is not None:
            yield done()

    sent = frame.mapInArrow(gathered, "chunk int, hashes binary, again binary")
    dealt = sent.repartition(chunks, "chunk").sortWithinPartitions("chunk")
    bits = np.zeros((chunks, 1 << (CHUNK_BITS - 3)), np.uint8)
    for row in dealt.mapInArrow(merged, "chunk int, bits binary").collect():
        bits[row.chunk] = np.frombuffer(row.bits, np.uint8)
    return bits


def seen(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the filter holds each hash; never false for one that was added."""
    chunk, found = _chunk(values, len(bits)), np.ones(len(values), bool)
    for probe in _probes(values):
        found &= (bits[chunk, probe >> 3] >> (7 - (probe & 7)).astype(np.uint8)) & 1 == 1
    return found


def membership(keys: list[int] | np.ndarray, most: int = 256) -> np.ndarray:
    """A filter over known hashes, with `seen` as its test."""
    values = np.asarray(keys, np.int64).view(np.uint64)
    bits = np.zeros((chunks_for(len(values), 16, most), 1 << CHUNK_BITS), bool)
    chunk = _chunk(values, len(bits))
    for probe in _probes(values):
        bits[chunk, probe] = True
    return np.packbits(bits, axis=1)
