"""A ledger of attempts: what was asked, by which answer function, and what came of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.operators.fingerprint import function_fingerprint
from scoreframe.operators.predictions import ANSWER, _called, sample_keys


def request_key(keys: Sequence[str]) -> Column:
    """A digest of the sample key and the prompt: what one request is known by."""
    return F.sha2(F.to_json(F.struct(*keys, "prompt")), 256)


def generate_to(
    spark: SparkSession,
    prompts: DataFrame,
    fn: Callable[[str], str],
    model: str,
    path: str,
    rounds: int = 1,
    fingerprint: str | None = None,
    **how,
) -> DataFrame:
    """Ask for what the ledger at `path` does not hold yet, and return the current answers.

    The ledger is a Parquet table that only grows: a row for every attempt at a request,
    under the model and the fingerprint of the answer function, with a number that rises
    from call to call. A request is a sample and its prompt. Those with an attempt that
    succeeded are not asked again; failed ones are, as are all whose prompt has changed. A
    function with other code or settings has another `fingerprint` (by default that of
    `function_fingerprint`) and never sees these rows.

    A job commits its rows as a whole, so `rounds` splits a long run into that many commits
    by request: after an abort only the rows of the unfinished round are asked for again.
    `how` goes to `generate`. The answers are those of `current_answers` to these prompts.
    """
    fingerprint = fingerprint or function_fingerprint(fn)
    keys = sample_keys(prompts)
    asked = prompts.select(*keys, "prompt", request_key(keys).alias("request"))
    held = attempts(spark, path, asked, model, fingerprint)
    number = 1
    todo = asked
    if held is not None:
        number += held.agg(F.coalesce(F.max("attempt"), F.lit(0))).first()[0]
        done = held.filter(F.col("error").isNull()).select("request").distinct()
        todo = asked.join(done, "request", "left_anti")
    for turn in range(rounds):
        share = todo
        if rounds > 1:
            share = todo.filter(F.pmod(F.xxhash64("request"), F.lit(rounds)) == turn)
        made = _called(share, [*keys, "request"], fn, **how).select(
            F.lit(model).alias("model"),
            F.lit(fingerprint).alias("fingerprint"),
            "*",
            F.lit(number).cast("long").alias("attempt"),
        )
        made.write.mode("append").partitionBy("model", "fingerprint").parquet(path)
    return current_answers(attempts(spark, path, asked, model, fingerprint), asked)


def attempts(
    spark: SparkSession, path: str, prompts: DataFrame, model: str, fingerprint: str
) -> DataFrame | None:
    """All rows of one answer function for one model, or None where there is no ledger yet.

    Both are partitions of the table, so other functions' files are not read.
    """
    fields = [prompts.schema[k] for k in sample_keys(prompts)]
    text = [T.StructField(n, T.StringType()) for n in ("request", "model", "fingerprint")]
    number = T.StructField("attempt", T.LongType())
    schema = T.StructType([*fields, *ANSWER.fields, number, *text])
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return table.filter((F.col("model") == model) & (F.col("fingerprint") == fingerprint))


def current_answers(held: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One row per request: its last successful attempt, or its last if all have failed.

    `attempts` and `seconds` add up all calls that were made for it. With `asked` (a column
    `request`) only those requests count. Attempts are combined on the map side.
    """
    keys = sample_keys(held)
    if asked is not None:
        held = held.join(asked.select("request"), "request", "left_semi")
    latest = F.struct(F.col("error").isNull(), "attempt", "prediction")
    best = F.max_by(F.struct("prediction", "error"), latest).alias("best")
    found = held.groupBy("model", "fingerprint", *keys, "request").agg(
        best, F.sum("attempts").cast("int").alias("attempts"), F.sum("seconds").alias("seconds")
    )
    return found.select(
        "model", "fingerprint", *keys, "best.prediction", "best.error", "attempts", "seconds"
    )
