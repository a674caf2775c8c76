"""Summaries: means and deviations per model and dataset, and their documents.

Aggregates combine on the map side, so a dataset that holds most of the rows costs
one partial row per task. Nothing here gathers all scores of a dataset, or all
datasets of a model, in a single row: arrays and documents come in bounded parts.

An empty dataset has NULL means, where a plain average of nothing is not a number.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.operators.ranks import running_totals
from scoreframe.operators.score import long_scores, quoted
from scoreframe.sources.datasets import source_keys

PART = 10_000


def group_keys(frame: DataFrame) -> list[str]:
    """Columns that identify one run over one dataset in this frame."""
    return [*(["model"] if "model" in frame.columns else []), *source_keys(frame)]


def summarize(
    scored: DataFrame,
    metrics: Sequence[str],
    few_shot_count: int = 0,
    datasets: DataFrame | None = None,
) -> DataFrame:
    """Per model and dataset: number of samples, mean and population deviation per metric.

    Give `datasets` to report those without any sample, too; they must then be of one
    model, which the rows of `datasets` name in a column `model`.
    """
    keys = group_keys(scored)
    statistics = [
        statistic
        for name in metrics
        for statistic in (
            F.avg(quoted(name)).alias(name),
            F.stddev_pop(quoted(name)).alias(f"{name}_std"),
        )
    ]
    summary = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_samples"), *statistics)
    if datasets is not None:
        summary = datasets.select(*keys).join(summary, keys, "left")
    return summary.select(
        *keys,
        F.coalesce("num_samples", F.lit(0)).alias("num_samples"),
        F.lit(few_shot_count).alias("few_shot_count"),
        *[quoted(c) for name in metrics for c in (name, f"{name}_std")],
    )


def wide_summary(
    summary: DataFrame, metrics: Sequence[str], elapsed_time: float | None = None
) -> DataFrame:
    """The flat report: one row per dataset with a column per metric mean."""
    columns = [
        *source_keys(summary),
        "model",
        "num_samples",
        "few_shot_count",
        *[quoted(name) for name in metrics],
        *(["elapsed_time"] if "elapsed_time" in summary.columns else []),
    ]
    report = summary.select(*columns)
    if elapsed_time is not None:
        return report.withColumn("elapsed_time", F.lit(float(elapsed_time)))
    return report


def pivot_scores(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean per metric column from the long score table, in one aggregation."""
    return long.groupBy(*group_keys(long)).pivot("metric", list(metrics)).agg(F.avg("score"))


def metric_map(metrics: Iterable[str]) -> Column:
    """Map of metric name to value, without the metrics a row has no value for."""
    names = list(metrics)
    filled = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(quoted(n)) for n in names])
    )
    return F.map_filter(filled, lambda _, value: value.isNotNull())


def sample_scores(scored: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per sample: texts and a map of its scores."""
    return scored.select(
        *group_keys(scored),
        "sample_idx",
        "input",
        "reference",
        "prediction",
        metric_map(metrics).alias("scores"),
    )


def result_rows(
    summary: DataFrame, metrics: Sequence[str], elapsed_time: float | None = None
) -> DataFrame:
    """Result document head: one row per run and dataset with maps of means and deviations."""
    deviations = F.map_from_arrays(
        F.array(*[F.lit(n) for n in metrics]), F.array(*[F.col(quoted(f"{n}_std")) for n in metrics])
    )
    known = elapsed_time is None and "elapsed_time" in summary.columns
    time = F.col("elapsed_time") if known else F.lit(elapsed_time)
    return summary.select(
        *group_keys(summary),
        "num_samples",
        "few_shot_count",
        metric_map(metrics).alias("metrics"),
        F.map_filter(deviations, lambda _, value: value.isNotNull()).alias("deviations"),
        time.cast("double").alias("elapsed_time"),
    )


def unscored_datasets(
    scored: DataFrame, metrics: Sequence[str], errors: str | None = None
) -> DataFrame:
    """Error rows for datasets where a metric gave no score for some sample.

    Needs the array column `metrics` where a dataset is only scored by its own list. With
    `errors`, the column of that name `score` made, the report on a metric that raised has
    the smallest of its messages.
    """
    missing = {name: F.col(quoted(name)).isNull() for name in metrics}
    if "metrics" in scored.columns:
        missing = {n: gap & F.array_contains("metrics", n) for n, gap in missing.items()}
    raised = {n: F.col(errors)[n] if errors else F.lit(None).cast("string") for n in metrics}
    failed = F.coalesce(
        *[
            F.when(
                F.col(quoted(f"__{name}")),
                F.coalesce(
                    F.concat(F.lit(f"metric {name}: "), F.col(quoted(f"__raised_{name}"))),
                    F.lit(f"no score by metric: {name}"),
                ),
            )
            for name in metrics
        ]
    )
    counted = scored.groupBy(*group_keys(scored)).agg(
        *[F.bool_or(gap).alias(f"__{name}") for name, gap in missing.items()],
        *[F.min(message).alias(f"__raised_{name}") for name, message in raised.items()],
    )
    return counted.select(*group_keys(scored), failed.alias("error")).filter("error IS NOT NULL")


def detailed_metrics(
    scored: DataFrame, metrics: Sequence[str], part_size: int = PART
) -> DataFrame:
    """Score arrays in sample order with mean and deviation, per dataset and metric.

    An array covers the next `part_size` samples that have a score, whatever their numbers
    are, so all parts but the last are full and no row or task holds more; a dataset of that
    size or less is one row. Samples are placed by `running_totals`, by ranges of all keys:
    a dataset that holds most of the scores is ranked by many tasks.
    """
    keys = [*group_keys(scored), "metric"]
    order = [F.col(c) for c in (*keys, "sample_idx")]
    placed = running_totals(long_scores(scored, metrics), order, {"__place": F.lit(1)})
    totals = placed.groupBy(*keys).agg(
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.min("__place").alias("__first"),
    )
    part = F.floor((F.col("__place") - F.col("__first")) / part_size).cast("long")
    entries = F.array_sort(F.collect_list(F.struct("__place", "score")))
    return (
        placed.join(totals, keys)
        .groupBy(*keys, part.alias("part"))
        .agg(
            F.transform(entries, lambda entry: entry["score"]).alias("scores"),
            F.first("mean").alias("mean"),
            F.first("std").alias("std"),
        )
    )


def summary_document(
    summary: DataFrame,
    metrics: Sequence[str],
    timestamp: str | None = None,
    parts: int = 1,
) -> DataFrame:
    """Nested `{dataset: {metric: mean}}` per model with the number of datasets.

    One row per model, or one for each of `parts` parts that datasets are hashed into: a
    row holds the means of all its datasets, so give more parts where there are very many.
    The layout follows from this number alone. Datasets of equal name are told apart by
    their file path. `summary` is read more than once: give a stored table, not a plan
    that scores again.
    """
    per_dataset = summary.withColumn("means", metric_map(metrics))
    label = F.col("dataset")
    if "file_path" in summary.columns:
        names = summary.groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("same_name"))
        per_dataset = per_dataset.join(names, ["model", "dataset"])
        label = F.when(F.col("same_name") > 1, F.col("file_path")).otherwise(label)
    counts = summary.groupBy("model").agg(F.count(F.lit(1)).alias("num_datasets"))
    return (
        per_dataset.select("model", label.alias("label"), "means")
        .join(counts, "model")
        .withColumn("part", F.pmod(F.xxhash64("label"), F.lit(parts).cast("long")))
        .groupBy("model", "num_datasets", "part")
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "means"))).alias("metrics"))
        .withColumn("timestamp", F.lit(timestamp) if timestamp else F.current_timestamp().cast("string"))
        .select("model", "timestamp", "num_datasets", "part", "metrics")
    )
