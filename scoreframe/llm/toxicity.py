"""Toxicity: windows of every text scored by a recurrent network trained on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import gru
from scoreframe.llm.common import give_back
from scoreframe.llm.text import runs
from scoreframe.session import ship

WIDTH, STRIDE = 32, 24  # of a window; the latter between those to train on
SEGMENT = 128
LEAST_ROUNDS, LEAST_STEPS = 6, 400
TEXTS = 256  # whose words are counted at a time
PRIOR = 5  # texts of either class that a word is taken to be in beforehand


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> list[tuple[int, str]]:
    """(label, text) of at most `rows_per_class` documents of each class, texts whole.

    `docs` has doc_id and text, `labels` doc_id and toxic. Documents are chosen by a hash of
    their id among all labelled ones; of several rows of an id, the smallest text counts.
    """
    marked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [
        marked.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        for value in (0, 1)
    ]
    chosen = chosen[0].unionByName(chosen[1]).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in chosen], "doc_id long, toxic int")
    found = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return [(r.toxic, r.text) for r in sorted(found.collect(), key=lambda r: r.doc_id)]


def train(
    sample: list[tuple[int, str | None]],
    vocabulary_size: int = 1 << 14,
    batch: int = 64,
    rate: float = 0.01,
    seed: int = 1,
) -> dict:
    """Fit the network to labelled texts.

    A label holds for a text, not for its windows: of those that begin at every 24th word of
    the whole text, it is represented by the one the network finds most toxic, looked for again six times, and clean texts by another at
    random as well. There are six rounds, or as many as make 400 steps.
    In the second half of the rounds toxic texts in which nothing looks toxic are taken for
    mislabelled and left out. The word embedding starts from how much more often a word is
    in toxic texts; words are hidden at random, so that their characters count too. At the
    end the largest logit of a text, over windows at every word, is mapped to a probability
    by logistic regression.
    """
    rng = np.random.default_rng(seed)
    marks = np.array([label for label, _ in sample], np.float32)
    column = pa.array([text for _, text in sample], pa.string())
    numbered = _numbered(column)
    if not numbered:
        nothing = np.zeros(0, np.uint64)
        return {"parameters": gru.initial(0), "vocabulary": nothing, "scale": (0.0, 0.0)}
    ids, sizes, owner, unique, trigrams, char_sizes = numbered
    has_words, owner = np.unique(owner, return_inverse=True)
    target = marks[has_words]
    # In how many toxic and clean texts each word is.
    cuts = np.searchsorted(owner, np.arange(0, len(has_words) + TEXTS, TEXTS))
    pairs = np.concatenate(
        [
            np.unique(np.repeat(owner[a:b], WIDTH) * len(unique) + ids[a:b].reshape(-1))
            for a, b in zip(cuts[:-1], cuts[1:])
        ]
    )
    pairs = pairs // len(unique), pairs % len(unique)
    with_word = np.bincount(pairs[1], minlength=len(unique))
    toxic = np.bincount(pairs[1], target[pairs[0]], len(unique))
    odds = np.log((toxic + PRIOR) / (target.sum() + 2 * PRIOR)) - np.log(
        (with_word - toxic + PRIOR) / (len(target) - target.sum() + 2 * PRIOR)
    )
    frequent = np.lexsort((unique, -with_word))[:vocabulary_size]
    frequent = frequent[with_word[frequent] >= 5]
    vocabulary = np.sort(unique[frequent])
    p = gru.initial(len(vocabulary), seed)
    place = gru.lookup(vocabulary, unique)
    p["word"][place[frequent], 0] = np.clip(odds[frequent], -3, 3)
    begins = np.cumsum(char_sizes) - char_sizes
    adam = gru.Adam(p, rate)

    def logits() -> np.ndarray:
        inputs = gru.embed(p, place, trigrams, char_sizes)
        parts = [slice(i, i + 1024) for i in range(0, len(ids), 1024)]
        return np.concatenate([gru.forward(p, inputs, ids[s], sizes[s]) for s in parts])

    def leading(logit: np.ndarray) -> np.ndarray:
        order = np.lexsort((-logit, owner))
        return order[np.searchsorted(owner[order], np.arange(len(target)))]

    clean = np.flatnonzero(target[owner] == 0)
    rounds = max(LEAST_ROUNDS, -(-LEAST_STEPS * batch // len(target)))
    logit = p["word"][place, 0][ids].max(axis=1)
    for turn in range(rounds):
        if turn and turn % (rounds // LEAST_ROUNDS) == 0:
            logit = logits()
        picked = leading(logit)
        if 2 * turn >= rounds:
            picked = picked[_believed(logit[picked], target)]
        if len(clean):
            picked = np.concatenate([picked, rng.choice(clean, min(len(clean), len(target)) // 2)])
        picked = rng.permutation(picked)
        for start in range(0, len(picked), batch):
            part = picked[start : start + batch]
            used, inverse = np.unique(ids[part], return_inverse=True)
            group, at = gru.spread_out(char_sizes[used])
            hidden = np.where(rng.random(len(used)) < 0.15, 0, place[used])
            adam.apply(
                gru.gradients(
                    p,
                    hidden,
                    trigrams[begins[used][group] + at],
                    char_sizes[used],
                    inverse.reshape(ids[part].shape),
                    sizes[part],
                    target[owner[part]],
                )
            )
        adam.rate *= 0.12 ** (1 / rounds)
    model = {"parameters": p, "vocabulary": vocabulary}
    best = gru.text_logits(model, column, WIDTH, SEGMENT)[has_words]
    used = _believed(best, target)
    return model | {"scale": _scale(best[used], target[used])}


def _believed(best: np.ndarray, target: np.ndarray) -> np.ndarray:
    """All texts but toxic ones that look no more toxic than most clean ones, a fifth at most."""
    toxic = np.flatnonzero(target == 1)
    believed = np.ones(len(target), bool)
    if len(toxic) and len(toxic) < len(target):
        weakest = toxic[np.argsort(best[toxic])][: len(toxic) // 5]
        believed[weakest] = best[weakest] > np.quantile(best[target == 0], 0.9)
    return believed


def _numbered(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """The windows of all texts: words by number, length, text; and of each distinct word its
    hash and trigrams. Nothing if there are no words.
    """
    known: dict[int, int] = {}
    ids, sizes, owners, trigrams = [], [], [], []
    for begin, _, data, offsets in runs(texts):
        data, starts, ends, bounds, value = gru.tokens(data, offsets)
        if not len(value):
            continue
        codes, unique, grams, grams_each = gru.distinct(data, starts, ends, value)
        numbers = np.empty(len(unique), np.int32)
        parts = np.split(grams, np.cumsum(grams_each)[:-1])
        for place, (word, part) in enumerate(zip(unique.tolist(), parts)):
            if word not in known:
                known[word] = len(known)
                trigrams.append(part)
            numbers[place] = known[word]
        first, size, owner = gru.windows(bounds, WIDTH, STRIDE)
        sizes.append(size)
        owners.append(begin + owner)
        ids.append(numbers[gru.grid(codes, first, size, WIDTH)])
    if not known:
        return ()
    return (
        np.concatenate(ids),
        np.concatenate(sizes),
        np.concatenate(owners),
        np.fromiter(known, np.uint64, len(known)),
        np.concatenate(trigrams),
        np.array([len(part) for part in trigrams]),
    )


def _scale(logit: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression with a weak pull to slope 1, by Newton steps."""
    x = np.stack([logit.astype(np.float64), np.ones(len(logit))], axis=1)
    prior, pull = np.array([1.0, 0.0]), np.diag([1.0, 0.01])
    w = prior.copy()
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (chance - target) + pull @ (w - prior)
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + pull
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(w[0]), float(w[1])


def toxicity_model(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2000) -> dict:
    return train(labelled_sample(docs, labels, rows_per_class))


def scores(model: dict, texts: pa.Array) -> np.ndarray:
    """The probability that each text is toxic; 0 for texts without words."""
    slope, offset = model["scale"]
    logit = gru.text_logits(model, texts, WIDTH, SEGMENT)
    chance = 1 / (1 + np.exp(-np.clip(slope * logit + offset, -700, 700)))
    return np.where(np.isnan(logit), 0.0, chance)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train_on: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    rows_per_class: int = 2000,
) -> DataFrame:
    """All columns of `docs` and toxicity, the probability that its whole text is toxic.

    The network learns from documents with a row in `labels` (doc_id, toxic) where
    `train_on` holds for the label's id, at most `rows_per_class` of each class. A text is
    scored whole, by every window of 32 words, one at each word, and the highest score counts.
    The recurrent states of a window are those of a segment of up to 128 words around it. A null text,
    an empty one or one without words scores 0. Repeated rows and rows of null id are scored
    like others. A null label teaches nothing, of several labels of a document the highest
    holds; without labels every text with words scores 0.5. A column named toxicity is
    replaced.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    marks = labels.filter(train_on & F.col("toxic").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "toxic"
    )
    model = toxicity_model(rows, marks, rows_per_class)
    give_back()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(scores(sent.value, column))

    return docs.withColumn("toxicity", toxicity(F.col(text).cast("string")))
