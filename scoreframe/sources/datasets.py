"""Dataset documents: reading, discovery, checks and samples.

A dataset is one JSON object per file. Reading it whole makes one task per file, so
samples are spread again after they are exploded. Once samples are stored as a table
nothing here is needed any more: every later step works on sample rows.

Two points differ from a plain directory walk: Spark skips names that begin with
`_` or `.`, and a missing path raises Spark's `PATH_NOT_FOUND`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions import arrow
from scoreframe.functions.registry import list_metrics
from scoreframe.session import ship

PAIR = "struct<input:string,output:string>"
DOCUMENT = (
    "instruction string, output_length int, metrics array<string>, "
    f"few_shots array<{PAIR}>, samples array<{PAIR}>"
)
FIELDS = ("instruction", "output_length", "metrics", "few_shots", "samples")
REQUIRED = ("instruction", "samples", "metrics")


def _files(spark: SparkSession, path: str | Sequence[str], pattern: str) -> DataFrame:
    """One row per file: location, name without suffix, and text (NULL if not UTF-8)."""
    ship(spark)
    files = spark.read.text(
        path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern
    )
    return files.select(*file_columns(), F.try_validate_utf8("value").alias("raw"))


def file_columns() -> list[Column]:
    """Location and name without suffix of the file a row was read from."""
    name = F.regexp_replace(_decoded("_metadata.file_name"), r"(?<=.)\.[^.]*\z", "")
    return [_decoded("_metadata.file_path").alias("file_path"), name.alias("dataset")]


def _decoded(location: str) -> Column:
    """Spark escapes special characters in file locations, a plus sign is none of them."""
    return F.url_decode(F.replace(F.col(location), F.lit("+"), F.lit("%2B")))


def read_datasets(
    spark: SparkSession, path: str | Sequence[str], pattern: str = "*.json"
) -> DataFrame:
    """Dataset documents of a file, or of all files below a directory.

    Missing fields get their defaults. `present` lists the fields a document has and
    is NULL where the text is no JSON object; `dataset_error` builds on it. Files of
    the same name stay apart because `file_path` is part of every later key.
    """
    document = F.from_json("raw", DOCUMENT, {"allowSingleQuotes": "false"})
    return (
        _files(spark, path, pattern)
        .withColumn("present", arrow.json_fields(F.col("raw"), FIELDS))
        .withColumn("text_outputs", arrow.text_outputs(F.col("raw")))
        .withColumn("document", F.when(F.col("present").isNotNull(), document))
        .select(
            "dataset",
            "file_path",
            F.when(_absent("instruction"), "")
            .otherwise(F.col("document.instruction"))
            .alias("instruction"),
            F.col("document.output_length").alias("output_length"),
            *[
                F.when(_absent(name), F.from_json(F.lit("[]"), f"array<{kind}>"))
                .otherwise(F.col(f"document.{name}"))
                .alias(name)
                for name, kind in (("metrics", "string"), ("few_shots", PAIR), ("samples", PAIR))
            ],
            "present",
            "text_outputs",
        )
    )


def _absent(name: str) -> Column:
    return ~F.array_contains("present", name)


def discover_datasets(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Files below `path` that hold a JSON object with all required fields.

    Presence counts, also of a null value; anything else is skipped silently.
    """
    complete = arrow.has_json_keys(F.col("raw"), REQUIRED)
    return _files(spark, path, pattern).filter(complete).select("dataset", "file_path")


def dataset_info(datasets: DataFrame) -> DataFrame:
    """One row per dataset: settings and sizes, without the samples themselves."""
    return datasets.select(
        *source_keys(datasets),
        "instruction",
        "output_length",
        "metrics",
        F.array_size("few_shots").alias("few_shot_total"),
        F.array_size("samples").alias("sample_total"),
    )


def source_keys(frame: DataFrame) -> list[str]:
    """Columns that tell datasets apart in this frame."""
    return [name for name in ("dataset", "file_path") if name in frame.columns]


def explode_samples(
    datasets: DataFrame,
    carry: Iterable[str] = ("instruction", "few_shots", "metrics"),
    partitions: int | None = None,
) -> DataFrame:
    """One row per sample in document order, numbered from 0.

    `partitions` spreads the rows by sample key: the samples of one large file leave
    its single task, however many of them one dataset holds, and the rows are already
    placed for the join with predictions.
    """
    keys = source_keys(datasets)
    rows = datasets.select(*keys, *carry, F.posexplode("samples").alias("sample_idx", "sample"))
    samples = rows.select(
        *keys,
        F.col("sample_idx").cast("long").alias("sample_idx"),
        F.col("sample.input").alias("input"),
        F.col("sample.output").alias("reference"),
        *carry,
    )
    return samples.repartition(partitions, *keys, "sample_idx") if partitions else samples


def dataset_error(few_shot_count: int = 0, metrics: Iterable[str] | None = None) -> Column:
    """Why a dataset cannot be evaluated, NULL if it can.

    With `metrics` given the dataset's own list is not used and so not checked.
    """
    incomplete = lambda pair: pair.isNull() | pair["input"].isNull() | pair["output"].isNull()
    prompted = F.array_size("samples") > 0  # prompts are built per sample
    checks = [
        (F.col("samples").isNull(), F.lit("samples is not a list of pairs")),
        (F.col("instruction").isNull() & prompted, F.lit("instruction is null")),
        (F.exists("samples", incomplete), F.lit("a sample lacks input or output")),
    ]
    if few_shot_count > 0:
        used = F.slice("few_shots", 1, few_shot_count)
        enough = F.array_size("few_shots") >= few_shot_count
        checks += [
            (F.col("few_shots").isNull() & prompted, F.lit("few_shots is not a list of pairs")),
            (
                enough & prompted & F.exists(used, incomplete),
                F.lit("a few-shot example lacks a side"),
            ),
        ]
    if metrics is None:
        known = F.array(*[F.lit(name) for name in list_metrics()])
        unknown = F.array_except("metrics", known)
        checks += [
            (F.col("metrics").isNull(), F.lit("metrics is not a list")),
            (
                F.array_size(unknown) > 0,
                F.concat(
                    F.lit("Unsupported metric: "),
                    F.coalesce(F.try_element_at(unknown, F.lit(1)), F.lit("null")),
                ),
            ),
        ]
    return F.coalesce(*[F.when(failed, message) for failed, message in checks])


def check_datasets(
    datasets: DataFrame, few_shot_count: int = 0, metrics: Iterable[str] | None = None
) -> DataFrame:
    """Add `error`: why a dataset cannot be evaluated, NULL if it can."""
    reason = dataset_error(few_shot_count, metrics)
    if "present" in datasets.columns:
        reason = F.coalesce(F.when(F.col("present").isNull(), "not a JSON object"), reason)
    if "text_outputs" in datasets.columns:
        reason = F.coalesce(reason, F.when(~F.col("text_outputs"), "an output is not text"))
    return datasets.withColumn("error", reason)


def error_rows(checked: DataFrame, model: str) -> DataFrame:
    """The report on the checked datasets that have an error."""
    failed = checked.filter(F.col("error").isNotNull())
    return failed.select(*source_keys(checked), F.lit(model).alias("model"), "error")


def failed_datasets(
    datasets: DataFrame,
    model: str,
    few_shot_count: int = 0,
    metrics: Iterable[str] | None = None,
) -> DataFrame:
    """An error row for every dataset that cannot be evaluated."""
    return error_rows(check_datasets(datasets, few_shot_count, metrics), model)


def valid_datasets(
    datasets: DataFrame, few_shot_count: int = 0, metrics: Iterable[str] | None = None
) -> DataFrame:
    """The datasets `failed_datasets` does not report."""
    checked = check_datasets(datasets, few_shot_count, metrics)
    return checked.filter(F.col("error").isNull()).drop("error")
