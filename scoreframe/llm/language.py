"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import blocks, sum_blocks, unpacked
from scoreframe.llm.text import runs
from scoreframe.session import ship

BITS = 16
BUCKETS = 1 << BITS
BLOCK = 1 << 12
UNKNOWN = "und"
_SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool)


def _prepared(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as lower-case code points, with a space for all that is no letter."""
    folded = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for first, end, data, offsets in runs(folded):
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        points = np.where(_letters()[points], points, np.uint32(_SPACE))
        yield first, end, points, leads[offsets]


def _buckets(points: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of the 1-, 2- and 3-gram that begins at each position; texts end in spaces."""
    following = [points]
    for distance in (1, 2):
        later = np.full_like(points, _SPACE)
        later[:-distance] = points[distance:]
        for step in range(1, distance + 1):
            at = offsets[1:] - step
            later[at[at >= offsets[:-1]]] = _SPACE
        following.append(later)
    total = np.zeros_like(points)
    for size, (codes, factor) in enumerate(
        zip(following, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)), start=1
    ):
        total = (total + codes * np.uint32(factor)) * np.uint32(0x27D4EB2F)
        mixed = total ^ (total >> np.uint32(15))
        yield (mixed * np.uint32(0x165667B1 + 2 * size)) >> np.uint32(32 - BITS)


def ngram_counts(docs: DataFrame) -> dict[str, np.ndarray]:
    """Counts of the buckets per language over all rows of `docs` (text, lang)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").cast(pa.string()).dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for first, end, points, offsets in _prepared(batch.column("text")):
                here, places = np.unique(codes[first:end], return_inverse=True)
                owner = np.repeat(places * BUCKETS, np.diff(offsets))
                table = np.zeros(len(here) * BUCKETS, np.int64)
                for bucket in _buckets(points, offsets):
                    table += np.bincount(owner + bucket, minlength=len(table))
                for code, counts in zip(here, table.reshape(-1, BUCKETS)):
                    name = names[code]
                    totals[name] = totals[name] + counts if name in totals else counts.copy()
        for name, counts in totals.items():
            yield blocks(name, counts, BLOCK)

    sent = docs.mapInArrow(counted, "key string, block int, data binary")
    found: dict[str, np.ndarray] = {}
    for row in sum_blocks(sent, "int64", 64).collect():
        counts = found.setdefault(row.key, np.zeros(BUCKETS, np.int64))
        counts[row.block * BLOCK : (row.block + 1) * BLOCK] = unpacked(row.data, "int64")
    return found


def log_probabilities(counts: dict[str, np.ndarray], smoothing: float) -> np.ndarray:
    """A row per bucket, a column per language in order of name."""
    table = np.stack([counts[name] for name in sorted(counts)], axis=1) + smoothing
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def _sums(matrix: np.ndarray, bucket: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the matrix rows of each text's buckets, in pieces of bounded memory."""
    sums = np.zeros((len(offsets) - 1, matrix.shape[1]))
    piece = max(1 << 12, (1 << 21) // matrix.shape[1])
    for start in range(0, len(bucket), piece):
        stop = min(start + piece, len(bucket))
        low = np.searchsorted(offsets, start, "right") - 1
        high = np.searchsorted(offsets, stop, "left")
        begins = np.maximum(offsets[low:high], start)
        full = np.minimum(offsets[low + 1 : high + 1], stop) > begins
        rows = matrix[bucket[start:stop]]
        sums[low:high][full] += np.add.reduceat(rows, (begins - start)[full], dtype=np.float64)
    return sums


def identify_language(
    docs: DataFrame,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    smoothing: float = 0.5,
    most_languages: int = 512,
) -> DataFrame:
    """The language of every row's whole text, learned from the rows where `train` holds.

    Returns doc_id, lang_pred and score, the model's probability of that language. A text
    without a letter, null and empty ones included, is `und` with score 0, as is every text
    if there is nothing to learn from. Rows with a null lang teach nothing; a null id never
    matters, and repeated rows are rows like others. Of equally likely languages the first
    by name wins. Other columns are not looked at.

    Counts cover all training rows. The matrix sent to the tasks has 65,536 float32 values
    per language; more than `most_languages` distinct values of `lang` are an error.
    """
    ship(docs.sparkSession)
    rows = docs.filter(train).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = ngram_counts(rows.filter(F.col("lang").isNotNull()))
    if len(counts) > most_languages:
        raise ValueError(f"{len(counts)} languages, more than {most_languages}")
    names = sorted(counts)
    matrix = log_probabilities(counts, smoothing) if names else np.zeros((BUCKETS, 0), np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((names, matrix))
    id_type = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        for batch in batches:
            found, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for first, end, points, offsets in _prepared(batch.column("text")) if names else ():
                sums = np.zeros((end - first, len(names)))
                for bucket in _buckets(points, offsets):
                    sums += _sums(matrix, bucket, offsets)
                lettered = np.concatenate([[0], np.cumsum(points != _SPACE)])
                best = sums.argmax(axis=1)
                odds = np.exp(sums - sums.max(axis=1, keepdims=True))
                chance = odds[np.arange(len(best)), best] / odds.sum(axis=1)
                for i in np.flatnonzero(np.diff(lettered[offsets])):
                    found[first + i], scores[first + i] = names[best[i]], chance[i]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": pa.array(found, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                }
            )

    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return whole.mapInArrow(scored, f"doc_id {id_type}, lang_pred string, score double")
