"""Metrics that need Python, as Arrow UDFs over whole column batches.

Every UDF takes only the raw prediction and reference, so any number of them
share one `ArrowEvalPython` node. A NULL input gives NULL without any work, which
is how a metric is switched off for the rows of a dataset that does not ask for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreframe.functions import kernels

CHECKED = pa.struct({"score": pa.float64(), "error": pa.string(), "seconds": pa.float64()})


def pair_udf(
    score: Callable[[str, str], float], null_on_error: bool = False
) -> Callable[[Column, Column], Column]:
    """Wrap `score(prediction, reference) -> float` as an Arrow UDF.

    An exception fails the job, or with `null_on_error` leaves the score NULL.
    """

    def one(prediction: str | None, reference: str | None) -> float | None:
        if prediction is None or reference is None:
            return None
        try:
            return float(score(prediction, reference))
        except Exception:
            if null_on_error:
                return None
            raise

    @F.arrow_udf("double")
    def scored(prediction: pa.Array, reference: pa.Array) -> pa.Array:
        return pa.array(map(one, prediction.to_pylist(), reference.to_pylist()), pa.float64())

    return scored


def checked_udf(score: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """`pair_udf` with errors as values: struct(score, error, seconds), one of the first two
    NULL; `seconds` is the time of this pair.
    """

    def one(prediction: str | None, reference: str | None) -> dict[str, float | str] | None:
        if prediction is None or reference is None:
            return None
        started = time.perf_counter()
        try:
            found = {"score": float(score(prediction, reference))}
        except Exception as problem:
            found = {"error": f"{type(problem).__name__}: {problem}"}
        return {**found, "seconds": time.perf_counter() - started}

    @F.arrow_udf("struct<score: double, error: string, seconds: double>")
    def scored(prediction: pa.Array, reference: pa.Array) -> pa.Array:
        return pa.array(map(one, prediction.to_pylist(), reference.to_pylist()), CHECKED)

    return scored


def time_spent(weight: Column, known: Column, after: Column) -> Column:
    """Seconds the task took to produce each row, as far as `after` needs them computed.

    The wait for a batch is what its rows cost. Of it, `known` seconds were measured row by
    row; the rest is shared out by `weight`, which must be positive.
    """

    @F.arrow_udf("double")
    def seconds(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        started = time.perf_counter()
        for weights, own, _ in batches:
            waited = time.perf_counter() - started
            share, own = weights.to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False)
            rest = max(0.0, waited - own.sum())
            yield pa.array(own + rest * share / np.sum(share, dtype=np.float64), pa.float64())
            started = time.perf_counter()

    return seconds(weight.cast("double"), known.cast("double"), after)


def char_f1(prediction: Column, reference: Column) -> Column:
    """Similarity of the alphabetically sorted words, in whole percent.

    The cost of a long pair grows with the number of its differences, at most with the
    product of both lengths, bit-parallel. Outer white space never survives the word split, so no trimming is needed;
    two texts without any word count as equal.
    """

    def score(p: str, r: str) -> float:
        if p == r:
            return 1.0
        return kernels.fuzzy_ratio(kernels.token_sorted(p), kernels.token_sorted(r)) / 100.0

    return pair_udf(score)(prediction, reference)


def fuzzy_match(prediction: Column, reference: Column, match_threshold: float = 0.8) -> Column:
    """Similarity of the trimmed texts; 1 from `match_threshold` upwards."""

    def score(p: str, r: str) -> float:
        return kernels.fuzzy_ratio(p.strip(), r.strip()) / 100.0

    ratio = pair_udf(score)(prediction, reference)
    return F.when(ratio >= F.lit(float(match_threshold)), F.lit(1.0)).otherwise(ratio)


def bleu(prediction: Column, reference: Column) -> Column:
    return pair_udf(kernels.bleu)(prediction, reference)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F measure of the longest common subsequence of words.

    The cost of a long pair grows with the number of its differences, at most with the
    product of both word counts, bit-parallel.
    """
    return pair_udf(kernels.rouge_l)(prediction, reference)


def json_validity(prediction: Column, reference: Column) -> Column:
    return pair_udf(kernels.json_key_overlap)(prediction, reference)


def json_fields(text: Column, fields: Iterable[str]) -> Column:
    """Which of `fields` the JSON object in `text` has; NULL where it is no object."""
    wanted = tuple(fields)

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        documents = (None if t is None else kernels.json_keys(t) for t in texts.to_pylist())
        return pa.array(
            (None if keys is None else [f for f in wanted if f in keys] for keys in documents),
            pa.list_(pa.string()),
        )

    return found(text)


def text_outputs(text: Column) -> Column:
    """Whether the outputs of a dataset document are texts; other JSON types cannot be scored."""

    @F.arrow_udf("boolean")
    def plain(texts: pa.Array) -> pa.Array:
        return pa.array((t is None or kernels.text_outputs(t) for t in texts.to_pylist()))

    return plain(text)


def has_json_keys(text: Column, fields: Iterable[str]) -> Column:
    """True where `text` is a JSON object with all `fields`, NULL where it is no object."""
    wanted = tuple(fields)
    return F.array_size(json_fields(text, wanted)) == len(wanted)
