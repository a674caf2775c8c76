"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.dom import Block, blocks
from scoreframe.llm.pages import bare_page, labelled_page
from scoreframe.session import ship

PAGES = 400
REMEMBERED = 10_000


def ancestor_features(block: Block) -> list[str]:
    return [*sorted(block.above), f"parent={block.parent}"]


def text_features(block: Block, place: int, count: int) -> list[str]:
    text, size = block.text, len(block.text)
    density = 3 * min(1.0, block.linked / size)
    return [
        "any",
        f"size={min(size, 4000).bit_length()}",
        f"linked={math.ceil(density)}",
        f"sentence={text[-1] in '.!?…:;\"”»'}",
        f"comma={',' in text}",
        f"space={' ' in text}",
        f"sign={'©' in text}",
        f"bar={'|' in text}",
        f"place={5 * place // count}",
        f"first={place == 0}",
        f"last={place == count - 1}",
    ]


class ChainField:
    """Weights per feature and label, and per pair of neighbouring labels, of which there are two."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.pairs = np.zeros((3, 2))  # row 2: the start of a page
        self.paths: dict[tuple[frozenset[str], str], np.ndarray] = {}

    def _sum(self, features: Sequence[str]) -> np.ndarray:
        total = np.zeros(2)
        for feature in features:
            weight = self.weights.get(feature)
            if weight is not None:
                total += weight
        return total

    def unary(self, page: Sequence[Block]) -> np.ndarray:
        """The score of both labels of each block; sums over ancestors are remembered."""
        rows = np.empty((len(page), 2))
        for place, block in enumerate(page):
            key = (block.above, block.parent)
            above = self.paths.get(key)
            if above is None:
                if len(self.paths) >= REMEMBERED:
                    self.paths.clear()
                above = self.paths[key] = self._sum(ancestor_features(block))
            rows[place] = above + self._sum(text_features(block, place, len(page)))
        return rows

    def decode(self, page: Sequence[Block]) -> list[int]:
        """The most probable labels of a page, by Viterbi."""
        if not page:
            return []
        pairs = self.pairs.tolist()
        scores = self.unary(page).tolist()
        zero, one = scores[0][0] + pairs[2][0], scores[0][1] + pairs[2][1]
        came = []
        for a, b in scores[1:]:
            to_zero = (zero + pairs[0][0], one + pairs[1][0])
            to_one = (zero + pairs[0][1], one + pairs[1][1])
            came.append((to_zero[1] > to_zero[0], to_one[1] > to_one[0]))
            zero, one = max(to_zero) + a, max(to_one) + b
        label = int(one > zero)
        labels = [label]
        for step in reversed(came):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]

    def marginals(self, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the labels, and of each pair of neighbouring labels summed up."""
        size, pairs = len(unary), self.pairs[:2]
        ahead, back = np.empty((size, 2)), np.zeros((size, 2))
        ahead[0] = unary[0] + self.pairs[2]
        for t in range(1, size):
            ahead[t] = unary[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + pairs, axis=0)
        for t in range(size - 2, -1, -1):
            back[t] = np.logaddexp.reduce(pairs + unary[t + 1] + back[t + 1], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        joint = ahead[:-1, :, None] + pairs + (unary[1:] + back[1:])[:, None, :]
        return np.exp(ahead + back - total), np.exp(joint - total).sum(axis=0)

    def fit(
        self,
        pages: Sequence[tuple[list[Block], list[int]]],
        rounds: int = 6,
        rate: float = 0.3,
        decay: float = 1e-4,
        seed: int = 1,
    ) -> ChainField:
        """Maximise the conditional likelihood by adaptive stochastic gradient steps."""
        rng = np.random.default_rng(seed)
        named = [
            [
                [*ancestor_features(b), *text_features(b, i, len(page))]
                for i, b in enumerate(page)
            ]
            for page, _ in pages
        ]
        for features in {f for page in named for block in page for f in block}:
            self.weights[features] = np.zeros(2)
        seen = {f: np.full(2, 1e-6) for f in self.weights}
        pair_seen = np.full((3, 2), 1e-6)
        for _ in range(rounds):
            for number in rng.permutation(len(pages)):
                features, labels = named[number], pages[number][1]
                if not labels:
                    continue
                unary = np.stack([self._sum(f) for f in features])
                chance, joint = self.marginals(unary)
                slope = np.eye(2)[labels] - chance
                pull = np.zeros((3, 2))
                pull[:2] = -joint
                np.add.at(pull, (labels[:-1], labels[1:]), 1)
                pull[2] = slope[0]
                pair_seen += pull**2
                self.pairs += rate * (pull / np.sqrt(pair_seen) - decay * self.pairs)
                total: dict[str, np.ndarray] = {}
                for block, gradient in zip(features, slope):
                    for f in block:
                        total[f] = total[f] + gradient if f in total else gradient
                for f, gradient in total.items():
                    gradient = gradient - decay * self.weights[f]
                    seen[f] += gradient**2
                    self.weights[f] = self.weights[f] + rate * gradient / np.sqrt(seen[f])
        return self


def main_text_model(pages: int = PAGES) -> ChainField:
    """The field trained on labelled pages of random layouts, one in ten an article alone."""
    examples = []
    made = [labelled_page(seed) for seed in range(pages)]
    made += [bare_page(seed) for seed in range(pages // 10)]
    for page, labels in made:
        examples.append((list(blocks(page)), labels))
    return ChainField().fit(examples)


def main_text(field: ChainField, page: str) -> str:
    found = list(blocks(page))
    return "\n".join(b.text for b, label in zip(found, field.decode(found)) if label)


def extract_main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    A page is cut into leaf blocks, texts without a block tag inside; the blocks the field
    labels as main text are joined by line feeds. Character references are decoded and white
    space inside a block is one space. A null or empty page, and one without main text, has
    an empty text. Repeated rows and null ids are extracted one by one; an empty table gives
    an empty result; other columns are not looked at.
    """
    ship(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(main_text_model())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            texts = [main_text(field, page.as_py() or "") for page in batch.column("html")]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.col(html).cast("string").alias("html"),
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")
