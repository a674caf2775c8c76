"""A whole run: dataset files in, predictions, scores and summaries out."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions.registry import Metric, metrics as resolve
from scoreframe.operators import prompts as P
from scoreframe.operators import summary as S
from scoreframe.operators.fingerprint import (
    function_fingerprint,
    mapping_fingerprint,
    table_fingerprint,
)
from scoreframe.operators.ledger import generate_to
from scoreframe.operators.predictions import attach_predictions, sample_keys
from scoreframe.operators.rules import rule_predictions
from scoreframe.operators.score import declared_metrics, score
from scoreframe.session import remove, ship, spread
from scoreframe.sources import datasets as D
from scoreframe.sources import sinks

ERRORS = "metric_errors"
SECONDS = "__seconds"
PACE = ("concurrency", "retries", "delay", "rounds", "small_bytes")


@dataclass(frozen=True)
class Run:
    """Tables of a finished run, read back from where they were written."""

    scores: DataFrame
    summary: DataFrame
    report: DataFrame
    failures: DataFrame
    metrics: tuple[str, ...]
    elapsed_time: float
    output: str


def evaluate(
    spark: SparkSession,
    path: str | Sequence[str],
    model: str,
    answer: Callable[[str], str] | Mapping[str, str] | DataFrame,
    output: str,
    metrics: Sequence[str | Metric] | None = None,
    few_shot_count: int = 0,
    partitions: int | None = None,
    run_id: str | None = None,
    fingerprint: str | None = None,
    **how,
) -> Run:
    """Evaluate one dataset file, or every file below a directory, as one set of jobs.

    `answer` is a function called per prompt (`how` goes to `generate`), a rule mapping
    or table, or a predictions table. Without `metrics` each dataset is scored by its
    own list. Files are exploded into sample rows as they are read, and the samples are
    spread by key over `partitions` tasks before the model is called and scores are made,
    by default four per core, so that one large file uses all cores.

    `run_id` names the run's folder below `output`. By default it follows from the model,
    the answer, the settings and the samples themselves. Answers of a function are kept in
    a ledger in `output`, see `generate_to`: the same call made again, after an abort or an
    outage, asks only for those it has no answer to, while another function, or the same
    with other settings, starts anew. `fingerprint` tells functions apart where their code
    cannot, and names those that cannot be compared.

    Datasets that cannot be evaluated, or that a metric leaves without a score, are
    reported in `failures` and left out of all summaries. A Python metric that raises costs
    only the datasets it raises on, which are reported with its message; an error in a
    column of a metric counts as no score. Samples, predictions, scores and the summary are each written once
    below `output` and read back, so that nothing is parsed, generated or scored twice and
    a lost executor costs its own tasks. The time of a dataset is that of its calls and that
    of scoring its samples, both measured in the tasks and added up.
    """
    started = time.monotonic()
    ship(spark)
    staged = f"{output.rstrip('/')}/inputs-{uuid.uuid4().hex}"
    rows = _sample_rows(spark, path, few_shot_count, metrics)
    rows.write.parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    fingerprint = fingerprint or _answer_fingerprint(answer)
    run_id = run_id or _run_id(rows, model, fingerprint, few_shot_count, metrics, how)
    place = f"{output.rstrip('/')}/run_id={run_id}"

    datasets = rows.filter(F.coalesce("sample_idx", F.lit(0)) == 0)
    valid = datasets.filter(F.col("error").isNull())
    chosen = resolve(declared_metrics(valid) if metrics is None else metrics)
    names = tuple(m.name for m in chosen)

    asked = rows.filter(F.col("error").isNull() & F.col("sample_idx").isNotNull()).select(
        *D.source_keys(rows),
        "sample_idx",
        "input",
        "reference",
        "metrics",
        F.concat("prefix", F.lit("\n\n"), "input").alias("prompt"),
    )
    asked = spread(asked, *sample_keys(asked), partitions=partitions)
    calls = None
    if callable(answer):
        ledger = f"{output.rstrip('/')}/ledger"
        calls = generate_to(spark, asked, answer, model, ledger, fingerprint=fingerprint, **how)
        pairs = attach_predictions(asked, calls, model)
    elif isinstance(answer, DataFrame) and "prediction" in answer.columns:
        pairs = attach_predictions(asked, answer, model)
    else:
        pairs = rule_predictions(asked, answer, **how).withColumn("model", F.lit(model))

    with _errors_as_null(spark):
        scored = score(
            pairs, chosen, only_declared=metrics is None, errors=ERRORS, seconds=SECONDS
        ).drop("prompt")
    if metrics is not None:
        scored = scored.drop("metrics")
    scored.write.mode("overwrite").parquet(f"{place}/scores")
    scores = spark.read.schema(scored.schema).parquet(f"{place}/scores")
    spent = [scores.select(*S.group_keys(scores), F.col(SECONDS).alias("seconds"))]
    scores = scores.drop(SECONDS)

    failures = D.error_rows(datasets, model)
    listed = valid.select(*D.source_keys(valid), F.lit(model).alias("model"))
    if names:
        failures = failures.unionByName(S.unscored_datasets(scores, names, ERRORS))
    failures.write.mode("overwrite").json(f"{place}/failures")
    failures = spark.read.schema(failures.schema).json(f"{place}/failures")
    listed = listed.join(failures, S.group_keys(listed), "left_anti")

    summary = S.summarize(scores, names, few_shot_count, listed)
    if calls is not None:
        spent.append(calls.select(*S.group_keys(calls), "seconds"))
    summary = _timed(summary, spent)
    summary.write.mode("overwrite").parquet(f"{place}/summary")
    summary = spark.read.schema(summary.schema).parquet(f"{place}/summary")
    report = S.wide_summary(summary, names)
    sinks.write_results_csv(report, f"{place}/report")
    if names:
        sinks.write_results_json(S.result_rows(summary, names), f"{output}/results", run_id)
        sinks.write_results_json(S.sample_scores(scores, names), f"{output}/samples", run_id)
        detailed = S.detailed_metrics(scores, names)
        sinks.write_results_json(detailed, f"{output}/detailed", run_id)
        sinks.write_summary(S.summary_document(summary, names), f"{place}/document")
    remove(spark, staged)
    elapsed = time.monotonic() - started
    return Run(scores, summary, report, failures, names, elapsed, place)


def _sample_rows(
    spark: SparkSession,
    path: str | Sequence[str],
    few_shot_count: int,
    metrics: Sequence[str | Metric] | None,
) -> DataFrame:
    """One row per sample, and one without `sample_idx` for a dataset that has none to ask."""
    checked = D.check_datasets(D.read_datasets(spark, path), few_shot_count, metrics)
    usable = F.when(F.col("error").isNull(), F.col("samples"))
    return checked.select(
        *D.source_keys(checked),
        "metrics",
        "error",
        F.when(F.col("error").isNull(), P.prompt_prefix(few_shot_count)).alias("prefix"),
        F.posexplode_outer(usable).alias("place", "sample"),
    ).select(
        *D.source_keys(checked),
        "metrics",
        "error",
        "prefix",
        F.col("place").cast("long").alias("sample_idx"),
        F.col("sample.input").alias("input"),
        F.col("sample.output").alias("reference"),
    )


def _answer_fingerprint(answer: Callable[[str], str] | Mapping[str, str] | DataFrame) -> str:
    if isinstance(answer, DataFrame):
        return table_fingerprint(answer)
    return function_fingerprint(answer) if callable(answer) else mapping_fingerprint(answer)


def _run_id(
    rows: DataFrame,
    model: str,
    fingerprint: str,
    few_shot_count: int,
    metrics: Sequence[str | Metric] | None,
    how: Mapping[str, object],
) -> str:
    """A name that follows from the settings, the answer and the content of all samples."""
    content = F.xxhash64(*[c for c in rows.columns if c != "error"]).cast("decimal(38,0)")
    total = rows.agg(F.sum(content), F.count(F.lit(1))).first()
    asked = None if metrics is None else [_metric_name(m) for m in resolve(metrics)]
    # How fast it runs is no part of what it is.
    result = sorted((k, v) for k, v in how.items() if k not in PACE)
    settings = repr((model, fingerprint, few_shot_count, asked, result, str(total[0]), total[1]))
    return hashlib.sha256(settings.encode()).hexdigest()[:32]


def _metric_name(m: Metric) -> str:
    try:
        built = function_fingerprint(m.function or m.builder) if m.builder else ""
    except ValueError:  # what it holds cannot be compared; scores are made anew in any case
        built = ""
    parts = [(_metric_name(part), weight) for part, weight in m.parts]
    return repr((m.name, built, sorted(m.params.items()), parts))


@contextmanager
def _errors_as_null(spark: SparkSession) -> Iterator[None]:
    """Columns built meanwhile give NULL instead of failing the job, as without ANSI mode."""
    setting = "spark.sql.ansi.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _timed(summary: DataFrame, spent: Sequence[DataFrame]) -> DataFrame:
    """Add `elapsed_time` per dataset: the sum of all `seconds` spent on its rows."""
    for rows in spent:
        keys = [k for k in S.group_keys(summary) if k in rows.columns]
        total = rows.groupBy(*keys).agg(F.sum("seconds").alias("__seconds"))
        summary = summary.join(total, keys, "left")
        so_far = F.col("elapsed_time") if "elapsed_time" in summary.columns else F.lit(0.0)
        summary = summary.withColumn("elapsed_time", so_far + F.coalesce("__seconds", F.lit(0.0)))
        summary = summary.drop("__seconds")
    return summary
