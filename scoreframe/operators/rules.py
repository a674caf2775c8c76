"""Rule predictions: the first rule whose key occurs in a prompt answers it."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.operators.anchors import joined_rules
from scoreframe.session import ship

# Fixed value: the answer where no rule applies.
DEFAULT_RESPONSE = "モックレスポンス"

# Rules of at most this many bytes of text are sent to the tasks; a rule counts as some more
# for what the search keeps beside its texts.
SMALL_BYTES = 16 * 1024 * 1024
OVERHEAD = 64
RUN_BYTES = 1 << 20
STEMS = (8, 4, 2, 1)


class RuleSearch:
    """Rules, searched for together in the bytes of many texts.

    The stem of a key is its first 8, 4, 2 or 1 bytes, the most it has. Every window of
    these sizes is compared to the stems as a number; where one is met, the text from
    there is looked up among the keys of that stem, once for each length they have.
    """

    def __init__(self, keys: list[bytes]):
        none = len(keys)
        self.always = keys.index(b"") if b"" in keys else none
        self.longer: dict[int, dict[int, dict[int, dict[bytes, int]]]] = {}
        whole: dict[int, dict[int, int]] = defaultdict(dict)
        for order, key in enumerate(keys[: self.always]):
            size = next(s for s in STEMS if s <= len(key))
            stem = int.from_bytes(key[:size], "big")
            if len(key) == size:
                whole[size].setdefault(stem, order)
            else:
                lengths = self.longer.setdefault(size, {}).setdefault(stem, defaultdict(dict))
                lengths[len(key)].setdefault(key, order)
        # Per size: the stems in order, the rule whose whole key a stem is, and the first of
        # the rules with longer keys.
        self.stems: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {*whole, *self.longer}:
            longer = self.longer.get(size, {})
            stems = sorted({*whole[size], *longer})
            firsts = (
                min((o for keys in longer[s].values() for o in keys.values()), default=none)
                if s in longer
                else none
                for s in stems
            )
            self.stems[size] = (
                np.array(stems, np.uint64),
                np.array([whole[size].get(s, none) for s in stems]),
                np.array(list(firsts)),
            )

    def first(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The first rule met in each text laid end to end in `data`, or the number of rules."""
        best = np.full(len(offsets) - 1, self.always)
        content, windows, size = data.tobytes(), data.astype(np.uint64), 1
        while size <= max(self.stems, default=0) and len(windows):
            if size in self.stems:
                stems, whole, firsts = self.stems[size]
                place = np.minimum(np.searchsorted(stems, windows), len(stems) - 1)
                spots = np.flatnonzero(stems[place] == windows)
                texts = np.searchsorted(offsets, spots, "right") - 1
                inside = spots + size <= offsets[texts + 1]
                spots, texts = spots[inside], texts[inside]
                np.minimum.at(best, texts, whole[place[spots]])
                open_ = firsts[place[spots]] < best[texts]
                for spot, text in zip(spots[open_].tolist(), texts[open_].tolist()):
                    for length, keys in self.longer[size][int(windows[spot])].items():
                        if spot + length <= offsets[text + 1]:
                            order = keys.get(content[spot : spot + length])
                            if order is not None and order < best[text]:
                                best[text] = order
            windows = (windows[:-size] << np.uint64(8 * size)) | windows[size:]
            size *= 2
        return best

    def answers(self, texts: pa.Array) -> np.ndarray:
        """The first rule of each text of a column without nulls."""
        texts = texts.cast(pa.large_string())
        found = np.full(len(texts), self.always)
        if not len(texts):
            return found
        _, bounds, content = texts.buffers()
        offsets = np.frombuffer(bounds, np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            end = int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, "right")) - 1
            end = min(max(end, row + 1), len(texts))
            part = data[offsets[row] : offsets[end]]
            found[row:end] = self.first(part, offsets[row : end + 1] - offsets[row])
            row = end
        return found


def rule_predictions(
    prompts: DataFrame,
    rules: Mapping[str, str] | DataFrame,
    default: str = DEFAULT_RESPONSE,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Add `prediction` from the first rule, in rule order, whose key the prompt contains.

    `rules` is a mapping in rule order or a table `(rule_order, key, response)`; of rules of
    equal order any may come first, a null key or prompt meets nothing. Rules of at most
    `small_bytes` of text go to the tasks, which search each prompt on its own row: prompts
    are not shuffled. Any more stay a table that prompts are joined with, see
    `joined_rules`. Both give the same rows, also of prompts with equal sample keys.
    """
    spark = prompts.sparkSession
    ship(spark)
    if isinstance(rules, DataFrame):
        texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("key", "response")]
        rules = rules.select("rule_order", "key", "response")
        size = rules.agg(F.sum(texts[0] + texts[1] + OVERHEAD)).first()[0] or 0
        if size > small_bytes:
            return joined_rules(prompts, rules, default)
        ordered = rules.filter(F.col("key").isNotNull()).orderBy("rule_order").collect()
        pairs = [(row["key"], row["response"]) for row in ordered]
    else:
        pairs = list(rules.items())
        texts = [t for pair in pairs for t in pair if t is not None]
        if sum(len(t.encode()) for t in texts) + OVERHEAD * len(pairs) > small_bytes:
            numbered = [(n, *pair) for n, pair in enumerate(pairs)]
            kind = "rule_order long, key string, response string"
            return joined_rules(prompts, spark.createDataFrame(numbered, kind), default)
    pairs = [(key, default if response is None else response) for key, response in pairs]
    return _answered(prompts, pairs, default)


def _answered(prompts: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    sent = prompts.sparkSession.sparkContext.broadcast(rules)

    @F.arrow_udf("string")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys = [key.encode() for key, _ in sent.value]
        responses = pa.array([response for _, response in sent.value] + [None], pa.string())
        search = RuleSearch(keys)
        for batch in batches:
            found = search.answers(pc.fill_null(batch, ""))
            found = np.where(batch.is_null().to_numpy(zero_copy_only=False), len(keys), found)
            yield responses.take(pa.array(found))

    return prompts.withColumn("prediction", F.coalesce(answer("prompt"), F.lit(default)))
