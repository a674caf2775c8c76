"""Named metrics: look-up, parameters and registration.

A metric is a function of two columns. Three kinds can be registered:

* a column builder `(prediction, reference, **params) -> Column`;
* a plain Python function `(str, str) -> float`, run as an Arrow UDF;
* a weighted sum over other registered metrics (`composite`).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import add
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.functions import arrow, native
from scoreframe.functions.native import Text

Builder = Callable[..., Column]

# The default parts of the composite metric.
COMPOSITE_WEIGHTS = {"exact_match": 0.3, "char_f1": 0.4, "set_f1": 0.3}


@dataclass(frozen=True)
class Metric:
    """A named metric with bound parameters; call it on two columns to score them.

    `function` is that of a Python metric whose exceptions `score` can keep as values.
    """

    name: str
    builder: Builder | None
    params: Mapping[str, Any] = field(default_factory=dict)
    takes_text: bool = False
    parts: tuple[tuple[Metric, float], ...] = ()
    function: Callable[[str, str], float] | None = None

    def build(self, prediction: Text, reference: Text) -> Column:
        """Score expression over two text views; not for composites."""
        if self.takes_text:
            return self.builder(prediction, reference, **self.params)
        return self.builder(prediction.raw, reference.raw, **self.params)

    def combine(self, part: Callable[[Metric], Column]) -> Column:
        """Weighted sum of the parts, each given as a column by `part`."""
        return reduce(add, [part(metric) * F.lit(weight) for metric, weight in self.parts])

    def __call__(self, prediction: Column, reference: Column) -> Column:
        views = Text(prediction), Text(reference)
        if self.parts:
            return self.combine(lambda metric: metric(prediction, reference))
        return self.build(*views)


@dataclass(frozen=True)
class _Entry:
    builder: Builder
    takes_text: bool
    function: Callable[[str, str], float] | None = None


def _composite(weights: Mapping[str, float] | None = None) -> Metric:
    """Weighted sum of other metrics; weights are used as given, not normalised."""
    weights = weights or COMPOSITE_WEIGHTS
    parts = tuple((metric(name), float(weight)) for name, weight in weights.items())
    return Metric("composite", None, {"weights": dict(weights)}, parts=parts)


_ENTRIES: dict[str, _Entry] = {
    **{
        builder.__name__: _Entry(builder, takes_text=True)
        for builder in (
            native.exact_match,
            native.exact_match_figure,
            native.contains_answer,
            native.set_f1,
            native.jaccard_similarity,
            native.word_count_similarity,
            native.length_ratio,
            native.weighted_match,
        )
    },
    **{
        builder.__name__: _Entry(builder, takes_text=False)
        for builder in (
            arrow.char_f1,
            arrow.bleu,
            arrow.rouge_l,
            arrow.fuzzy_match,
            arrow.json_validity,
        )
    },
}


def list_metrics() -> list[str]:
    """Names that `metric` resolves."""
    return sorted([*_ENTRIES, *([] if "composite" in _ENTRIES else ["composite"])])


def metric(name: str, **params: Any) -> Metric:
    """The registered metric `name` with its parameters bound.

    Raises ValueError for an unknown name and TypeError for a parameter the metric
    does not take, both before any job runs.
    """
    if name == "composite" and name not in _ENTRIES:
        return _composite(**params)
    if name not in _ENTRIES:
        raise ValueError(f"Unsupported metric: {name}")
    entry = _ENTRIES[name]
    inspect.signature(entry.builder).bind(None, None, **params)
    return Metric(name, entry.builder, params, entry.takes_text, function=entry.function)


def metrics(names: Iterable[str | Metric], **params: Any) -> list[Metric]:
    """Several metrics at once; `params` go to every name in the list."""
    return [m if isinstance(m, Metric) else metric(m, **params) for m in names]


def register_metric(
    name: str,
    function: Callable,
    *,
    spark: SparkSession | None = None,
    python: bool = False,
    null_on_error: bool = False,
) -> Metric:
    """Register `function` under `name`, replacing an earlier metric of that name.

    A column builder is checked by analysing it over an empty frame, which runs no
    job. With `python=True` the function works on two strings and returns a number; an
    exception in it fails the job unless `score` is told to keep `errors` (as `evaluate`
    does), or with `null_on_error` just leaves that score NULL. With `spark` given, a Python metric is also callable by its name from SQL.
    """
    if not callable(function):
        raise TypeError(f"metric {name} must be a function")
    if not python:
        _check_builder(spark or SparkSession.active(), name, function)
        _ENTRIES[name] = _Entry(function, takes_text=False)
        return metric(name)
    builder = arrow.pair_udf(function, null_on_error)
    kept = None if null_on_error else function
    _ENTRIES[name] = _Entry(builder, takes_text=False, function=kept)
    if spark is not None:
        spark.udf.register(name, builder)
    return metric(name)


def _check_builder(spark: SparkSession, name: str, builder: Builder) -> None:
    column = builder(F.col("prediction"), F.col("reference"))
    if not isinstance(column, Column):
        raise TypeError(f"metric {name} must return a Column, not {type(column).__name__}")
    empty = spark.createDataFrame([], "prediction string, reference string")
    kind = empty.select(column.alias("score")).schema["score"].dataType
    if not isinstance(kind, (T.NumericType, T.BooleanType)):
        raise TypeError(f"metric {name} must return a number, not {kind.simpleString()}")
