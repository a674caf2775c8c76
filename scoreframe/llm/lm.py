"""Language-model scoring: context-tree weighting over bytes, beside a smoothed word unigram.

Grams of six bytes are counted as rows, over the whole corpus. The context trees are fitted
from these rows, a subtree at a time, and every gram gets the log probability of its last
byte; a text's score is the sum over its grams. Grams of texts that are only scored are
counted too, with no weight, so that each has its place in the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import contexts as C
from scoreframe.llm.text import hashes, lower, runs, words
from scoreframe.session import ship, store

WORD, GRAM = 0, 1
END_WORD = 0x656E64  # the key of the end token
FLUSH = 1 << 20
ADD = 0.1
CHUNK = 1 << 20


class _Counter:
    """Counts of 64-bit keys, in training texts and in all; handed out when they grow too many."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, taught: bool) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, counts * taught, counts))
        self.size += len(keys)
        if self.size > 2 * FLUSH:
            self._combine()
            if self.size > FLUSH:
                yield from self.flush()

    def _combine(self) -> None:
        keys, *counts = (np.concatenate(column) for column in zip(*self.parts))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[first], *(np.add.reduceat(c[order], first) for c in counts))]
        self.size = len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        self._combine()
        ((keys, taught, counts),) = self.parts
        for i in range(0, len(keys), 1 << 16):
            part = slice(i, i + (1 << 16))
            many = len(keys[part])
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array(np.full(many, self.kind, np.int32)),
                    "key": pa.array(keys[part].astype(np.uint64).view(np.int64)),
                    "n": pa.array(taught[part].astype(np.int64)),
                    "m": pa.array(counts[part].astype(np.int64)),
                }
            )
        self.parts, self.size = [], 0


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(values)
    return distinct, np.bincount(codes, minlength=len(distinct))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n, m): how often words, by hash, and byte grams are in the rows of `docs`
    with `train` (n) and in all rows (m). `docs` has text and train.

    Words are lower-cased, and only those of training rows are counted; byte grams are of the
    text as it is. Each task sums up its own.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, gram = _Counter(WORD), _Counter(GRAM)
        for batch in batches:
            for taught in (True, False):
                texts = batch.column("text").filter(pc.equal(batch.column("train"), taught))
                for first, end, data, offsets in runs(texts):
                    yield from gram.add(*_counted(C.grams(data, offsets)), taught)
                    if not taught:
                        continue
                    low = lower(data)
                    starts, ends, _ = words(low, offsets)
                    yield from word.add(*_counted(hashes(low, starts, ends)), True)
                    yield from word.add(np.array([END_WORD], np.uint64), np.array([end - first]), True)
        yield from gram.flush()
        yield from word.flush()

    sent = docs.mapInArrow(counted, "kind int, key long, n long, m long")
    return sent.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, n, m) of batches sorted by key, cut where a subtree ends, about CHUNK rows each."""
    shift = np.uint64(8 * (C.DEPTH - C.SPLIT + 1))
    kept: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        columns = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "n", "m"))
        key, *counts = columns
        kept.append((key.view(np.uint64), *counts))
        size += len(key)
        if size < CHUNK:
            continue
        whole = tuple(np.concatenate(column) for column in zip(*kept))
        place = whole[0] >> shift
        end = int(np.searchsorted(place, place[-1]))
        if end:
            yield tuple(column[:end] for column in whole)
        kept = [tuple(column[end:] for column in whole)]
        size = len(kept[0][0])
    if size:
        yield tuple(np.concatenate(column) for column in zip(*kept))


def gram_scores(grams: DataFrame) -> DataFrame:
    """(key, m, value): the log10 probability of the last byte of every gram after the others.

    Subtrees meet whole in a task, sorted, which holds one or about a million grams at a time
    (a subtree has 2^24 grams at most). The sums of subtrees below the same two bytes of
    context, again 2^24 at most, come to the driver, which fits the tree above them.
    """
    context = grams.sparkSession.sparkContext
    subtree = F.shiftright("key", 8 * (C.DEPTH - C.SPLIT + 1))
    dealt = grams.select("key", "n", "m").repartition(subtree).sortWithinPartitions("key")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, _ in _subtrees(batches):
            ids, zeros, ones, inner = C.subtrees(key, n)
            yield pa.RecordBatch.from_pydict(
                {"id": ids.view(np.int64), "zeros": zeros, "ones": ones, "inner": inner}
            )

    found = dealt.mapInArrow(sums, "id long, zeros double, ones double, inner double")
    found = found.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "inner")]).toArrow()
    ids = found["id"].to_numpy().view(np.uint64)
    order = np.argsort(ids)
    columns = [ids[order], *(found[c].to_numpy()[order] for c in ("zeros", "ones", "inner"))]
    sent = context.broadcast((columns[0], *(C.crown(*columns) if len(ids) else columns[1:3])))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, m in _subtrees(batches):
            value = C.log_probabilities(key, n, sent.value)
            yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "m": m, "value": value})

    return dealt.mapInArrow(valued, "key long, m long, value double")


def frequent(counts: DataFrame, value: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the highest counts `m`, `most` at most, in order, and their `value`.

    The bound lies at a power of two of the count; keys below it are joined instead.
    """
    level = F.floor(F.log2("m")).cast("int").alias("level")
    levels = {r.level: r.keys for r in counts.groupBy(level).agg(F.count("*").alias("keys")).collect()}
    least, total = 64, 0
    for step in range(max(levels, default=0), -1, -1):
        total += levels.get(step, 0)
        if total > most:
            break
        least = step
    found = counts.filter(F.col("m") >= F.lit(1 << min(least, 62))).select("key", value).toArrow()
    keys, values = found["key"].to_numpy().view(np.uint64), found[value].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray):
    """The value of each of `asked`, 0 where it is not in `keys`, and whether it is."""
    codes, distinct = pd.factorize(asked)
    if not len(keys) or not len(distinct):
        return np.zeros(len(asked)), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    hit = keys[at] == distinct
    return np.where(hit, values[at], 0.0)[codes], hit[codes]


def _lists(keys: np.ndarray, owner: np.ndarray, many: int) -> pa.Array:
    """The keys of each of `many` owners as a list."""
    order = np.argsort(owner, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=many))]).astype(np.int32)
    return pa.ListArray.from_arrays(begins, keys[order].astype(np.uint64).view(np.int64))


def score_texts(
    docs: DataFrame,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    most_sent: int = 1 << 18,
    most_grams: int = 1 << 21,
) -> DataFrame:
    """Score every row's whole text by a byte model and a word model of the rows in `train`.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score.

    `score` is the log10 probability of the text's UTF-8 bytes and its end under context-tree
    weighting over contexts of all depths up to five bytes (`contexts`); divided by the bytes
    it is a code length. `base_score` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the
    lower-cased words and the end token. Null and empty texts consist of the end alone.
    Without training rows all bytes are equally unlikely and N and V are 0. Repeated rows and
    rows with equal or null ids are scored one by one. An empty table gives an empty result.

    Words and byte grams of the highest counts, `most_sent` and `most_grams` at most, are sent
    to the tasks; the others of a text meet their values in a join. Both together cover all.
    """
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    body = F.col(text).cast("string").alias("text")
    taught = F.coalesce(train, F.lit(False)).alias("train")
    counts = store(corpus_counts(docs.select(body, taught)), "lm-counts")
    vocabulary = counts.filter(F.col("kind") == WORD).drop("kind")
    size = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total = size.n or 0
    norm = float(np.log10(total + ADD * (size.v + 1)))
    grams = store(gram_scores(counts.filter(F.col("kind") == GRAM)), "lm-grams")
    ends = vocabulary.filter(F.col("key") == F.lit(END_WORD)).first()
    ends = ends.n if ends else 0
    sent = context.broadcast((frequent(vocabulary, "n", most_sent), frequent(grams, "value", most_grams)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, amounts), known = sent.value
        values = np.log10(amounts + ADD) - norm
        for batch in batches:
            for first, end, data, offsets in runs(batch.column("text")):
                many = end - first
                asked = C.grams(data, offsets)
                gain, hit = _looked_up(*known, asked)
                score, full = gain[len(data) :].copy(), np.diff(offsets) > 0
                score[full] += np.add.reduceat(gain[: len(data)], offsets[:-1][full])
                place = np.flatnonzero(~hit)
                text_of = np.searchsorted(offsets, place, "right") - 1
                text_of = np.where(place < len(data), text_of, place - len(data))
                rare_grams = _lists(asked[place], text_of, many)
                low = lower(data)
                starts, stops, bounds = words(low, offsets)
                word = hashes(low, starts, stops)
                gain, hit = _looked_up(keys, values, word)
                owner = np.repeat(np.arange(many), np.diff(bounds))
                base = np.bincount(owner, gain, many)
                found = np.bincount(owner[hit], minlength=many)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": batch.column("row").slice(first, many),
                        "doc_id": batch.column("doc_id").slice(first, many),
                        "n_tokens": pa.array(np.diff(bounds) + 1, pa.int64()),
                        "n_known": pa.array(found + int(ends > 0), pa.int64()),
                        "base": pa.array(base + np.log10(ends + ADD) - norm, pa.float64()),
                        "score": pa.array(score, pa.float64()),
                        "rare_words": _lists(word[~hit], owner[~hit], many),
                        "rare_grams": rare_grams,
                    }
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), body
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, "
        "rare_words array<long>, rare_grams array<long>"
    )
    partial = store(rows.mapInArrow(scored, schema), "lm-scores")
    gain = (F.log10(F.col("n") + ADD) - F.lit(norm)).alias("value")
    known = vocabulary.select(F.lit(WORD).alias("kind"), "key", gain).unionByName(
        grams.select(F.lit(GRAM).alias("kind"), "key", "value")
    )
    rare = partial.select("row", F.lit(WORD).alias("kind"), F.explode("rare_words").alias("key"))
    rare = rare.unionByName(
        partial.select("row", F.lit(GRAM).alias("kind"), F.explode("rare_grams").alias("key"))
    )
    word = F.col("kind") == WORD
    value = F.coalesce("value", F.lit(float(np.log10(ADD) - norm)))
    rare = rare.join(known, ["kind", "key"], "left").groupBy("row").agg(
        F.sum(F.when(word, value)).alias("gain"),
        F.count(F.when(word, F.col("value"))).alias("found"),
        F.sum(F.when(~word, F.col("value"))).alias("spelled"),
    )
    return partial.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("spelled", F.lit(0.0))).alias("score"),
    )
