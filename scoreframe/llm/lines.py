"""Line dedup: two Bloom filters find suspected repeats; only those are shuffled and confirmed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.bloom import chunks_for, repeat_filter, seen
from scoreframe.llm.common import known
from scoreframe.session import ship, store

SPACES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends and with A-Z in lower case."""
    return line.strip(SPACES).lower()


def _long_enough(key: bytes, least: int) -> bool:
    """Whether a key has at least `least` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    texts = batch.column("text").cast(pa.large_binary())
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
        yield doc_id, text.as_py() or b""


def _keys(text: bytes, least: int) -> dict[bytes, None]:
    """The distinct keys of a text that are long enough to be compared."""
    return {k: None for k in map(line_key, text.split(b"\n")) if _long_enough(k, least)}


def _hashes(texts: list[dict[bytes, None]]) -> np.ndarray:
    values = [xxhash.xxh3_64_intdigest(key) for keys in texts for key in keys]
    return np.array(values, np.uint64)


def suspected(
    docs: DataFrame, least: int, bits_per_line: int, most_chunks: int
) -> DataFrame:
    """(doc_id, key) of the lines whose hash the twice-seen filter holds; no repeat is missing."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    lines = docs.agg(F.sum(count.cast("long"))).first()[0] or 0
    chunks = chunks_for(lines, bits_per_line, most_chunks)

    def hashed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, text in _texts(batch):
            yield _hashes([_keys(text, least)])

    filled = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, hashed, chunks))

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in _texts(batch):
                found.append(_keys(text, least))
                ids.extend([doc_id] * len(found[-1]))
            keys = [key for keys in found for key in keys]
            places = np.flatnonzero(seen(filled.value, _hashes(found)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[i] for i in places], pa.int64()),
                    "key": pa.array([keys[i] for i in places], pa.binary()),
                }
            )

    return docs.mapInArrow(tested, "doc_id long, key binary")


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = 10,
    bits_per_line: int = 16,
    most_chunks: int = 1024,
) -> DataFrame:
    """Drop lines that an earlier document holds too; the text that stays, per row of `docs`.

    A line is compared by `line_key`. Keys of at least `least` code points found in two
    documents or more lose all their lines except in the document of the smallest id; other
    lines, and repeats inside one document, stay. Returns doc_id, n_lines, n_dropped,
    kept_text. A null or empty text is one empty line, as is a text that loses all lines.
    Rows of equal id count as one document; a null id counts as the largest long. An empty
    table gives an empty result; other columns are not looked at.

    The filters take `bits_per_line` bits a line in chunks of 128 KiB, `most_chunks` at
    most (128 MiB), which bounds the broadcast. A fuller filter only lets more unique lines
    through to the confirmation, which compares whole keys: the result is the same.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        known(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    suspects = store(suspected(rows, least, bits_per_line, most_chunks), "suspects")
    repeats = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("l"))
    repeats = store(repeats.filter(F.col("first") < F.col("l")).select("key", "first"), "repeats")
    dropped = suspects.join(repeats, "key").filter(F.col("doc_id") > F.col("first"))
    dropped = dropped.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    joined = rows.join(dropped, "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lost, kept = [], [], []
            for (_, whole), keys in zip(_texts(batch), batch.column("keys")):
                gone = set(keys.as_py() or ()) if keys.is_valid else ()
                lines = whole.split(b"\n") if gone else None
                left = [x for x in lines if line_key(x) not in gone] if gone else None
                counts.append(len(lines) if gone else whole.count(b"\n") + 1)
                lost.append(len(lines) - len(left) if gone else 0)
                kept.append(b"\n".join(left) if gone else whole)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_lines": pa.array(counts, pa.int64()),
                    "n_dropped": pa.array(lost, pa.int64()),
                    "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )

    schema = "doc_id long, n_lines long, n_dropped long, kept_text string"
    return joined.mapInArrow(cut, schema)
