"""Prompts and request bodies."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.sources.datasets import source_keys


def prompt_prefix(few_shot_count: int = 0) -> Column:
    """Instruction followed by the first `few_shot_count` examples of a dataset.

    A dataset with fewer examples than asked for gets none at all.
    """
    if few_shot_count <= 0:
        return F.col("instruction")
    shots = F.transform(
        F.slice("few_shots", 1, few_shot_count),
        lambda shot: F.concat(F.lit("\n\n"), shot["input"], F.lit("\n"), shot["output"]),
    )
    enough = F.array_size("few_shots") >= few_shot_count
    return F.concat("instruction", F.when(enough, F.array_join(shots, "")).otherwise(""))


def build_prompts(
    samples: DataFrame, few_shot_count: int = 0, datasets: DataFrame | None = None
) -> DataFrame:
    """Add `prompt`: prefix, blank line, sample input.

    Samples may carry their dataset's `instruction` and `few_shots`. Otherwise give
    `datasets`: the prefix is then built once per dataset and joined on the dataset
    key. Neither side is hinted, so Spark broadcasts the dataset side only where its
    measured size allows, and splits a skewed dataset where it does not.
    """
    prompt = F.concat(F.col("prefix"), F.lit("\n\n"), F.col("input"))
    if datasets is None:
        return samples.withColumn("prefix", prompt_prefix(few_shot_count)).withColumn(
            "prompt", prompt
        ).drop("prefix")
    keys = source_keys(samples)
    prefixes = datasets.select(*keys, prompt_prefix(few_shot_count).alias("prefix"))
    return samples.join(prefixes, keys).withColumn("prompt", prompt).drop("prefix")


def request_table(
    prompts: DataFrame,
    model: str,
    temperature: float = 0.7,
    max_tokens: int = 500,
    **extra: Any,
) -> DataFrame:
    """Add `request`: the chat-completion body of each prompt as JSON text.

    `extra` settings are appended unless the body already has a field of that name. They
    may be anything JSON can state, `None` included, or a column.
    """
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    body = {
        "model": F.lit(model),
        "messages": F.array(message),
        "temperature": F.lit(float(temperature)),
        "max_tokens": F.lit(int(max_tokens)),
    }
    columns = {n: v for n, v in extra.items() if isinstance(v, Column) and n not in body}
    body |= columns
    plain = {n: v for n, v in extra.items() if n not in body}
    request = F.to_json(F.struct(*[value.alias(name) for name, value in body.items()]))
    if plain:
        # The object goes on where it ended.
        more = json.dumps(plain, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        request = F.concat(F.left(request, F.char_length(request) - 1), F.lit("," + more[1:]))
    return prompts.withColumn("request", request)
