"""Spark helpers the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1


def fold(doc_id: str, parts: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo `parts`."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(parts)


def held(doc_id: str, parts: int, number: int) -> Column:
    """Whether a document is held out; without an id it is not."""
    return F.coalesce(fold(doc_id, parts) == F.lit(number), F.lit(False))


def known(doc_id: str) -> Column:
    """The id, with the largest long in place of null, so that ids can be compared."""
    return F.coalesce(F.col(doc_id), F.lit(LAST))


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def packed(values: np.ndarray) -> bytes:
    """An array byte by byte, the first bytes of all values first: small numbers compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    """The array of `packed`, as a copy."""
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def sum_blocks(frame: DataFrame, dtype: str, partitions: int) -> DataFrame:
    """Add up packed arrays: `frame` has key string, block int, data binary of numpy `dtype`.

    Rows of a block meet in one task, which holds one block at a time.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([place[0]], pa.string()),
                    "block": pa.array([place[1]], pa.int32()),
                    "data": [packed(total)],
                }
            )

        for batch in batches:
            for key, block, data in zip(*(column.to_pylist() for column in batch.columns)):
                values = unpacked(data, dtype)
                if (key, block) != place:
                    if place is not None:
                        yield done()
                    place, total = (key, block), values
                else:
                    total += values
        if place is not None:
            yield done()

    dealt = frame.repartition(partitions, "key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(add, "key string, block int, data binary")


def blocks(key: str, values: np.ndarray, size: int) -> pa.RecordBatch:
    """One array as rows for `sum_blocks`, `size` values each."""
    parts = range(0, len(values), size)
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array([key] * len(parts), pa.string()),
            "block": pa.array(range(len(parts)), pa.int32()),
            "data": pa.array([packed(values[i : i + size]) for i in parts], pa.binary()),
        }
    )


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a partition, which then gives the memory it has freed back to the system.

    Idle Python workers are kept for later tasks, and with them what their allocators hold.
    """

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Give memory this process has freed back to the system, which its allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
