"""Predictions: parsing responses, joining them to samples, and generating them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.operators.endpoint import response_text
from scoreframe.session import ship
from scoreframe.sources.datasets import source_keys

PARSED = pa.struct({"prediction": pa.string(), "error": pa.string()})

ANSWER = T.StructType(
    [
        T.StructField("prediction", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)

# Fixed value: the text a failed call yields when mocking is asked for.
MOCK_ON_ERROR = "APIエラーによるモックレスポンス"


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `prediction` and `error` from a chat-completion response document.

    Text that is not one JSON document with a first choice, see `response_text`, is an
    error and predicts the empty string; a choice without content predicts the empty
    string but is no error.
    """
    ship(responses.sparkSession)

    @F.arrow_udf("struct<prediction: string, error: string>")
    def parsed(texts: pa.Array) -> pa.Array:
        return pa.array(map(_parsed, texts.to_pylist()), PARSED)

    return (
        responses.withColumn("__answer", parsed(F.col(raw)))
        .withColumn("prediction", F.col("__answer.prediction"))
        .withColumn("error", F.col("__answer.error"))
        .drop("__answer")
    )


def _parsed(raw: str | None) -> dict[str, str | None]:
    try:
        return {"prediction": response_text(raw or ""), "error": None}
    except ValueError as problem:
        return {"prediction": "", "error": str(problem)}


def sample_keys(frame: DataFrame) -> list[str]:
    """Columns that identify one sample in this frame."""
    return [*source_keys(frame), "sample_idx"]


def attach_predictions(
    samples: DataFrame, predictions: DataFrame, models: str | Sequence[str]
) -> DataFrame:
    """Give every sample its prediction per model; without one it is the empty string.

    An equi-join on the full sample key, so rows spread evenly whatever the size of a
    single dataset. Of several predictions for a model and sample the smallest text counts,
    so no sample is multiplied. Predictions without `file_path` are refused where samples
    of several files share a dataset name, since they could belong to any of them.
    """
    names = [models] if isinstance(models, str) else list(models)
    keys = ["model", *(k for k in sample_keys(samples) if k in predictions.columns)]
    if "file_path" in samples.columns and "file_path" not in keys:
        _check_names(samples)
    wanted = predictions.filter(F.col("model").isin(names)).groupBy(*keys)
    wanted = wanted.agg(F.min("prediction").alias("prediction"))
    asked = samples.withColumn("model", F.explode(F.array(*[F.lit(n) for n in names])))
    if len(names) == 1:
        asked = samples.withColumn("model", F.lit(names[0]))
    return asked.join(wanted, keys, "left").withColumn(
        "prediction", F.coalesce("prediction", F.lit(""))
    )


def _check_names(samples: DataFrame) -> None:
    """Raise if a dataset name stands for several files; one small job."""
    files = samples.groupBy("dataset").agg(
        F.min("file_path").alias("first"), F.max("file_path").alias("last")
    )
    clash = files.filter("first <> last").first()
    if clash:
        raise ValueError(
            f"predictions need file_path: {clash['dataset']} is in {clash['first']} and {clash['last']}"
        )


def _call(
    prompt: str, fn: Callable[[str], str], retries: int, delay: float, fallback: str | None
) -> tuple[str, str | None, int, float]:
    """One prompt with linear back-off: prediction, last error, attempts, seconds."""
    started = time.monotonic()
    for attempt in range(1, retries + 2):
        try:
            return fn(prompt) or "", None, attempt, time.monotonic() - started
        except Exception as problem:  # a failed call must not fail the job
            error = f"{type(problem).__name__}: {problem}"
            if attempt <= retries:
                time.sleep(delay * attempt)
    return fallback or "", error, retries + 1, time.monotonic() - started


def generate(
    prompts: DataFrame,
    fn: Callable[[str], str],
    model: str,
    concurrency: int = 5,
    retries: int = 3,
    delay: float = 1.0,
    mock_on_error: bool = False,
) -> DataFrame:
    """Call `fn(prompt)` for every row; columns model, key, prediction, error, attempts, seconds.

    At most `concurrency` calls run at once in each task, so the total is that times
    the running tasks. A call that fails after all retries predicts the empty string.
    Reading the result twice would call the model twice: use `generate_to`, or write
    it to a table, before scoring.
    """
    keys = sample_keys(prompts)
    called = _called(prompts, keys, fn, concurrency, retries, delay, mock_on_error)
    return called.select(F.lit(model).alias("model"), "*")


def _called(
    prompts: DataFrame,
    keys: Sequence[str],
    fn: Callable[[str], str],
    concurrency: int = 5,
    retries: int = 3,
    delay: float = 1.0,
    mock_on_error: bool = False,
) -> DataFrame:
    """`keys`, and what calling `fn(prompt)` gave."""
    ship(prompts.sparkSession)
    keys = list(keys)
    source = prompts.select(*keys, "prompt")
    schema = T.StructType([*[source.schema[k] for k in keys], *ANSWER.fields])
    fallback = MOCK_ON_ERROR if mock_on_error else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                calls = pool.map(lambda p: _call(p, fn, retries, delay, fallback), batch["prompt"])
                answers = pd.DataFrame(calls, columns=ANSWER.names, index=batch.index)
                yield pd.concat([batch[keys], answers], axis=1)

    return source.mapInPandas(run, schema)
