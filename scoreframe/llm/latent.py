"""Benchmark decontamination by latent semantic retrieval and longest common subsequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import blocks, sum_blocks, unpacked
from scoreframe.llm.text import ALNUM, hashes, runs, sequence_hash, spread_out, words
from scoreframe.session import ship, store

PIECE = 128  # rows of a matrix that are multiplied at a time
HALF = 32  # words from one passage to the next; a passage has twice as many
BLOCK = 1 << 15
OVERSAMPLE = 32
GRAM = 5  # words of the runs by which verbatim items are found
IDS = pa.list_(pa.int64())
FOUND = pa.list_(pa.struct({"item_id": pa.int64(), "share": pa.float64()}))


def text_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as hashes of their lower-cased words of letters and digits."""
    folded = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for first, end, data, offsets in runs(folded):
        starts, ends, bounds = words(data, offsets, ALNUM)
        yield first, end, hashes(data, starts, ends), bounds


def coded(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, words): every text as packed numbers, 1 + place in the vocabulary or 0."""
    kind = code_type(vocabulary)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, value, bounds in text_hashes(batch.column("text")):
                at = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)
                code = np.where(vocabulary[at] == value, at + 1, 0).astype(kind)
                parts = [code[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, end - first),
                        "words": pa.array(parts, pa.binary()),
                    }
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(packed, f"doc_id {id_type}, words binary")


def code_type(vocabulary: np.ndarray) -> str:
    return "<u2" if len(vocabulary) < 1 << 16 else "<u4"


def chunks(
    column: pa.Array, kind: str, size: int = 1 << 14
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of packed texts: first row, end row, codes, and where each text's begin."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    _, bounds, content = column.buffers()
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(bounds, np.int64, len(column) + 1, 8 * column.offset) // width
    codes = np.frombuffer(content, kind) if content else np.zeros(0, kind)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, codes[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def entries(codes: np.ndarray, bounds: np.ndarray, vocabulary: int, size: int):
    """(passage, word, count) of the vocabulary words of disjoint passages of `size` words."""
    many = -(-np.diff(bounds) // size)
    owner, place = spread_out(np.diff(bounds))
    passage = (np.cumsum(many) - many)[owner] + place // size
    inside = np.flatnonzero(codes)
    key, count = np.unique(
        passage[inside] * vocabulary + codes[inside].astype(np.int64) - 1, return_counts=True
    )
    return key // vocabulary, key % vocabulary, count, int(many.sum())


def document_frequencies(table: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many passages of the corpus each word is, and how many passages there are."""
    size, kind = len(vocabulary), code_type(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, _, codes, bounds in chunks(batch.column("words"), kind, 1 << 19):
                _, word, _, many = entries(codes, bounds, size, 2 * HALF)
                total[:size] += np.bincount(word, minlength=size)
                total[size] += many
        yield blocks("", total, BLOCK)

    sent = table.mapInArrow(counted, "key string, block int, data binary")
    total = _gathered(sent, size + 1, "int64")
    return total[:size], int(total[size])


def _gathered(sent: DataFrame, size: int, kind: str) -> np.ndarray:
    total = np.zeros(size, kind)
    for row in sum_blocks(sent, kind, 1 + size // BLOCK).collect():
        part = unpacked(row.data, kind)
        total[row.block * BLOCK : row.block * BLOCK + len(part)] = part
    return total


def weighted(
    word: np.ndarray, count: np.ndarray, passage: np.ndarray, idf: np.ndarray
) -> np.ndarray:
    """TF-IDF weights of the entries, each passage of length one."""
    weight = count * idf[word]
    if not len(word):
        return np.zeros(0, np.float32)
    norm = np.bincount(passage, weight**2)
    return (weight / np.sqrt(np.maximum(norm, 1e-12))[passage]).astype(np.float32)


def pieces(
    row: np.ndarray, word: np.ndarray, value: np.ndarray, rows: int, vocabulary: int
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A sparse matrix, given by entries in order of row, as small dense ones.

    Each has `PIECE` rows and a column per word that occurs in them, so that products with
    it stay in the processor's caches and in bounded memory.
    """
    place = np.zeros(vocabulary, np.int64)
    for start in range(0, rows, PIECE):
        end = min(start + PIECE, rows)
        here = slice(*np.searchsorted(row, [start, end]))
        used = np.zeros(vocabulary, bool)
        used[word[here]] = True
        columns = np.flatnonzero(used)
        place[columns] = np.arange(len(columns))
        dense = np.zeros((end - start) * len(columns), np.float32)
        np.add.at(dense, (row[here] - start) * len(columns) + place[word[here]], value[here])
        yield slice(start, end), dense.reshape(end - start, -1), columns


def add_product(
    total: np.ndarray,
    basis: np.ndarray,
    passage: np.ndarray,
    word: np.ndarray,
    weight: np.ndarray,
    factor: float = 1.0,
) -> None:
    """Add factor·AᵀA·basis of these entries to `total`."""
    rows = int(passage[-1]) + 1 if len(passage) else 0
    for _, dense, columns in pieces(passage, word, weight, rows, len(basis)):
        total[columns] += factor * (dense.T @ (dense @ basis[columns]))


def narrowed(codes: np.ndarray, own: np.ndarray | None, vocabulary: int) -> np.ndarray:
    """Codes counted within the words `own` alone, with 0 for others; as they are without."""
    if own is None:
        return codes
    place = np.zeros(vocabulary + 1, np.int64)
    place[own + 1] = np.arange(1, len(own) + 1)
    return place[codes]


def gram_product(
    table: DataFrame,
    vocabulary: np.ndarray,
    idf: np.ndarray,
    basis: np.ndarray,
    own: np.ndarray | None = None,
) -> np.ndarray:
    """AᵀA·basis over the TF-IDF matrix A of all passages of the corpus.

    With `own`, places in the vocabulary, A has only the columns of these words; `idf` and
    `basis` have only theirs.
    """
    size, whole, kind = len(basis), len(vocabulary), code_type(vocabulary)
    sent = table.sparkSession.sparkContext.broadcast(basis.astype(np.float32))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for _, _, codes, bounds in chunks(batch.column("words"), kind):
                codes = narrowed(codes, own, whole)
                passage, word, count, _ = entries(codes, bounds, size, 2 * HALF)
                weight = weighted(word, count, passage, idf)
                add_product(total, sent.value, passage, word, weight)
        yield blocks("", total.reshape(-1).astype(np.float32), BLOCK)

    products = table.mapInArrow(summed, "key string, block int, data binary")
    found = _gathered(products, basis.size, "float32")
    return found.reshape(basis.shape).astype(np.float64)


def singular_basis(
    product: np.ndarray, basis: np.ndarray, rank: int
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and values of A from one product AᵀA·basis (Nyström's form).

    With Y = AᵀA·Ω, AᵀA is close to Y (Ωᵀ Y)⁻¹ Yᵀ; a small shift keeps the core positive.
    """
    shift = 1e-7 * np.linalg.norm(product)
    shifted = product + shift * basis
    core = basis.T @ shifted
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > 1e-10 * value[-1]
    half = shifted @ (vector[:, keep] / np.sqrt(value[keep]))
    left, singular, _ = np.linalg.svd(half, full_matrices=False)
    singular = np.sqrt(np.maximum(singular**2 - shift, 0))
    rank = min(rank, int((singular > 1e-4 * singular[0]).sum()))
    return left[:, :rank], singular[:rank]


def common_subsequence(left: Sequence[int], masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of an item."""
    row = (1 << size) - 1
    full = row
    for word in left:
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def rarest_grams(items: list[np.ndarray]) -> list[np.ndarray]:
    """Of each item, the hashes of those of its runs of `GRAM` words that fewest items have.

    An item of fewer words has one run, that of all its words. Who holds an item word for
    word holds all these runs.
    """
    grams = [np.unique(sequence_hash(c.astype(np.uint64), min(GRAM, len(c)))) for c in items]
    known, place, count = np.unique(
        np.concatenate(grams), return_inverse=True, return_counts=True
    )
    shared = np.split(count[place], np.cumsum([len(g) for g in grams])[:-1])
    return [g[n == n.min()] for g, n in zip(grams, shared)]


class Items:
    """Benchmark items as word codes, with what the checks of a candidate need.

    `grams` are hashes of runs of words by which items are found beside their similarity.
    """

    def __init__(
        self, ids: list[int], codes: list[np.ndarray], tail: float, grams: list[np.ndarray]
    ):
        self.ids, self.codes = ids, [c.tolist() for c in codes]
        self.grams = {}
        for size in {min(GRAM, len(c)) for c in codes}:
            own = [i for i, c in enumerate(codes) if min(GRAM, len(c)) == size]
            value = np.concatenate([grams[i] for i in own])
            owner = np.repeat(own, [len(grams[i]) for i in own])
            order = np.argsort(value, kind="stable")
            self.grams[size] = value[order], owner[order]
        self.masks = [self._mask(c) for c in self.codes]
        self.answers = [c[len(c) - max(1, round(tail * len(c))) :] for c in self.codes]
        self.answer_masks = [self._mask(c) for c in self.answers]
        self.counts = np.array([len(c) for c in self.codes])

    @staticmethod
    def _mask(codes: list[int]) -> dict[int, int]:
        masks: dict[int, int] = {}
        for place, code in enumerate(codes):
            masks[code] = masks.get(code, 0) | 1 << place
        return masks

    def verbatim(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item): where in the texts' codes a run of words of an item begins."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for size, (value, owner) in self.grams.items():
            seen = sequence_hash(codes.astype(np.uint64), size)
            low = np.searchsorted(value, seen, "left")
            at = np.flatnonzero(value[np.minimum(low, len(value) - 1)] == seen)
            at = at[text[at] == text[at + size - 1]]
            many = np.searchsorted(value, seen[at], "right") - low[at]
            group, step = spread_out(many)
            places.append(at[group])
            found.append(owner[low[at][group] + step])
        return np.concatenate(places), np.concatenate(found)

    def share(self, item: int, region: list[int], least: float, answer: float) -> float:
        """The share of the item's words the region has in order; 0 if a check fails."""
        size = len(self.codes[item])
        masks = self.masks[item]
        if len(masks) and sum(c in masks for c in region) < least * size:
            return 0.0
        share = common_subsequence(region, masks, size) / size
        if share < least:
            return 0.0
        end = self.answers[item]
        got = common_subsequence(region, self.answer_masks[item], len(end))
        return share if got >= answer * len(end) else 0.0


def contaminated(
    codes: np.ndarray,
    bounds: np.ndarray,
    projection: np.ndarray,
    queries: np.ndarray,
    items: Items,
    cosine: float,
    least: float,
    answer: float,
    counter: list[int] | None = None,
    own: np.ndarray | None = None,
    vocabulary: int = 0,
) -> list[dict[int, float]]:
    """Per text, the items it holds and the best share of each.

    Codes count in a vocabulary of that size, rows of `projection` in its words `own`.
    """
    many = -(-np.diff(bounds) // HALF)
    owner, place = spread_out(np.diff(bounds))
    begins = np.concatenate([[0], np.cumsum(many)])
    half = begins[owner] + place // HALF
    local = narrowed(codes, own, vocabulary)
    inside = np.flatnonzero(local)
    word, size = local[inside].astype(np.int64) - 1, int(begins[-1])
    sums = np.zeros((size, projection.shape[1]), np.float32)
    ones = np.ones(len(inside), np.float32)
    for part, dense, columns in pieces(half[inside], word, ones, size, len(projection)):
        sums[part] = dense @ projection[columns]
    text = np.repeat(np.arange(len(many)), many)
    joined = sums.copy()
    same = np.flatnonzero(text[1:] == text[:-1])
    joined[same] += sums[same + 1]
    joined /= np.maximum(np.linalg.norm(joined, axis=1, keepdims=True), 1e-12)
    rows, hits = np.nonzero(joined @ queries.T >= cosine)
    exact, whose = items.verbatim(codes, bounds)
    key = np.concatenate([rows * len(items.codes) + hits, half[exact] * len(items.codes) + whose])
    rows, hits = np.divmod(np.unique(key), len(items.codes))
    if counter is not None:
        counter[0] += len(rows)
    found: list[dict[int, float]] = [{} for _ in range(len(many))]
    for row, item in zip(rows.tolist(), hits.tolist()):
        doc = text[row]
        size = len(items.codes[item])
        start = bounds[doc] + (row - begins[doc]) * HALF
        low, high = max(bounds[doc], start - size), min(bounds[doc + 1], start + 2 * HALF + size)
        share = items.share(item, codes[low:high].tolist(), least, answer)
        if share > found[doc].get(item, 0.0):
            found[doc][item] = share
    return found


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rank: int = 256,
    cosine: float = 0.25,
    least: float = 0.6,
    answer: float = 0.4,
    tail: float = 0.25,
    most_items: int = 256,
    largest: int = 100_000,
) -> DataFrame:
    """The benchmark items whose passages a document holds, word for word or paraphrased.

    Returns one row per row of `docs`: doc_id, contaminated, item_ids (ascending), score (the
    best share of an item's words found, 0 without) and matches (item_id, share). Null and
    empty texts are clean. Items without words match nothing; of repeated items each is
    found under its own id; a null item id is left out. Repeated rows and null ids are
    searched like others. Without items or documents nothing is found; other columns are
    not looked at.

    Texts become numbers of the benchmark's words, all that matter for similarity to an
    item. Passages of 64 words, of the corpus and the benchmark, are the rows of a TF-IDF
    matrix, items as heavy together as the corpus; `rank` singular vectors of it come from
    a randomised product made by all tasks. Every passage, one beginning each 32 words, is
    compared to all items by the cosine of their folded-in coordinates, in which all
    directions weigh the same. For those over `cosine` the longest common subsequence of
    words in the passage's surroundings must hold `least` of the item, and `answer` of its
    last `tail`, where the answer stands. The same is checked around every run of five
    words that is among an item's rarest, whatever the cosine, so that an item held word
    for word is always found. Items are taken `most_items` at a time, so that their
    directions fit the rank; each such block has a space of its own items' words and goes
    over the numbers of all texts. The benchmark is held by every task: more than `largest`
    items are an error.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = benchmark.select(
        F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")
    )
    asked = asked.filter(F.col("item_id").isNotNull())
    if (size := asked.count()) > largest:
        raise ValueError(f"{size} benchmark items, more than {largest}")
    asked = asked.orderBy("item_id", "text").toArrow()
    ids, parts = asked["item_id"].to_pylist(), []
    for _, _, value, bounds in text_hashes(asked["text"].combine_chunks()):
        parts.extend(value[a:b] for a, b in zip(bounds[:-1], bounds[1:]))
    worded = [i for i, part in enumerate(parts) if len(part)]
    vocabulary = np.unique(np.concatenate([parts[i] for i in worded] or [np.zeros(1, np.uint64)]))
    table = store(coded(rows, vocabulary), "coded-texts")
    models = []
    if worded:
        frequency, passages = document_frequencies(table, vocabulary)
        idf = np.log((passages + 1) / (frequency + 1)) + 1e-3
        places = [np.searchsorted(vocabulary, parts[j]) + 1 for j in worded]
        grams = rarest_grams(places)
        for i in range(0, len(worded), most_items):
            block = slice(i, i + most_items)
            codes = places[block]
            own = np.unique(np.concatenate(codes)) - 1
            models.append(
                (
                    *latent_model(table, vocabulary, idf, passages, codes, rank, own),
                    Items([ids[j] for j in worded[block]], codes, tail, grams[block]),
                    own,
                )
            )
    whole, kind = len(vocabulary), code_type(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, codes, bounds in chunks(batch.column("words"), kind):
                best: list[dict[int, float]] = [{} for _ in range(end - first)]
                for projection, queries, items, own in sent.value:
                    found = contaminated(
                        codes, bounds, projection, queries, items, cosine, least, answer,
                        own=own, vocabulary=whole,
                    )
                    for own, new in zip(best, found):
                        for item, share in new.items():
                            number = items.ids[item]
                            own[number] = max(share, own.get(number, 0.0))
                lists = [sorted(b.items()) for b in best]
                matches = [[{"item_id": k, "share": v} for k, v in x] for x in lists]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, end - first),
                        "contaminated": pa.array([bool(x) for x in lists], pa.bool_()),
                        "item_ids": pa.array([[k for k, _ in x] for x in lists], IDS),
                        "score": pa.array([max([0.0, *b.values()]) for b in best]),
                        "matches": pa.array(matches, FOUND),
                    }
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, contaminated boolean, item_ids array<long>, score double, "
        "matches array<struct<item_id: long, share: double>>"
    )
    return table.mapInArrow(searched, schema)


def latent_model(
    table: DataFrame,
    vocabulary: np.ndarray,
    idf: np.ndarray,
    passages: int,
    items: list[np.ndarray],
    rank: int,
    own: np.ndarray,
    seed: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """Projection of words into the latent space, and the items' unit coordinates in it.

    The space is that of the words `own` of the items, as places in the vocabulary.
    """
    size, idf = len(own), idf[own]
    width = min(size, rank + OVERSAMPLE)
    basis = np.random.default_rng(seed).standard_normal((size, width))
    product = gram_product(table, vocabulary, idf, basis, own)
    codes = narrowed(np.concatenate(items), own, len(vocabulary))
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in items])])
    owner = np.repeat(np.arange(len(items)), np.diff(bounds))
    key, count = np.unique(owner * size + codes - 1, return_counts=True)
    passage, word = key // size, key % size
    weight = weighted(word, count, passage, idf)
    add_product(product, basis, passage, word, weight, max(1.0, passages / len(items)))
    vectors, values = singular_basis(product, basis, rank)
    projection = (idf[:, None] * vectors / values).astype(np.float32)
    queries = np.zeros((len(items), projection.shape[1]), np.float32)
    np.add.at(queries, owner, projection[codes - 1])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    return projection, queries
