"""Samples of dataset files of any size, read by many tasks.

A JSON document has no line breaks to split at, but every pair ends with a brace. Spark's
text source splits a file at any byte, so it is read as pieces that end with `}`, by ranges.
What a piece is depends on all before it: whether it begins inside a string, and how deep
in brackets. Both are running totals of numbers each piece gives by itself, taken within
ranges and, one row per range, over a file's ranges. A pair ends where a brace outside
strings leads back to the depth of a list in the document; pieces between two such ends
are one pair's text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreframe.session import ship, store
from scoreframe.sources.datasets import file_columns

LISTED = 2  # how deep the elements of a list in the document lie
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]:]', re.DOTALL)
RANGE = ("file_path", "block")


def read_sample_ranges(
    spark: SparkSession, path: str | Sequence[str], pattern: str = "*.json"
) -> DataFrame:
    """dataset, file_path, sample_idx, input, reference: the samples of a file, or of all files
    below a directory, as `explode_samples(read_datasets(...))` has them.

    A file is read by one task for each `spark.sql.files.maxPartitionBytes`. A task holds a
    pair at a time, with the document's text since the pair before. Files whose brackets do
    not balance give no rows, nor do those without samples. Otherwise the text is taken for
    JSON with pairs in `samples`: what `failed_datasets` finds wrong with a document is not
    looked for here.
    """
    ship(spark)
    source = spark.read.text(path, lineSep="}", recursiveFileLookup=True, pathGlobFilter=pattern)
    pieces = source.select(
        *file_columns(),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("piece"),
    )
    structure = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)
    pieces = pieces.withColumn("structure", structure).select(
        "*",
        (F.array_size("structure") - 1).cast("long").alias("quotes"),
        _brackets(0).alias("from_outside"),
        _brackets(1).alias("from_inside"),
    )
    pieces = store(pieces.drop("structure"), "pieces")

    opened = _before(pieces, "quotes", "opened")
    inside = F.col("opened") % 2 == 1
    change = F.when(inside, F.col("from_inside")).otherwise(F.col("from_outside"))
    leveled = _before(opened.withColumn("change", change), "change", "depth")
    closed = ((F.col("opened") + F.col("quotes")) % 2 == 0) & (F.col("depth") + F.col("change") == LISTED)
    leveled = leveled.withColumn("ends", closed.cast("long"))
    numbered = _before(leveled, "ends", "element").join(_balanced(leveled), "file_path", "left_semi")

    parts = F.sort_array(F.collect_list(F.struct("block", "place", "piece")))
    elements = numbered.groupBy("dataset", "file_path", "element").agg(
        F.concat(F.array_join(F.transform(parts, lambda p: p["piece"]), "}"), F.lit("}")).alias("text"),
        F.max("ends").alias("ends"),
    )
    elements = elements.filter("ends = 1").select(
        "dataset", "file_path", "element", _pair(F.col("text"), F.col("element") == 0).alias("found")
    )
    elements = store(elements.select("dataset", "file_path", "element", "found.*"), "pairs")

    # Where each list begins, and the next one: a row per list, not per pair.
    lists = elements.filter(F.col("field").isNotNull()).select("file_path", "element", "field")
    following = F.lead("element").over(Window.partitionBy("file_path").orderBy("element"))
    lists = lists.withColumn("until", following).filter(F.col("field") == "samples")
    lists = lists.groupBy("file_path").agg(
        F.max("element").alias("since"), F.max_by("until", "element").alias("until")
    )
    own = (F.col("element") >= F.col("since")) & (
        F.col("until").isNull() | (F.col("element") < F.col("until"))
    )
    pair = F.from_json("pair", "input string, output string", {"allowSingleQuotes": "false"})
    return (
        elements.join(lists, "file_path")
        .filter(own)
        .withColumn("pair", pair)
        .select(
            "dataset",
            "file_path",
            (F.col("element") - F.col("since")).alias("sample_idx"),
            F.col("pair.input").alias("input"),
            F.col("pair.output").alias("reference"),
        )
    )


def _brackets(start: int) -> Column:
    """By how much a piece and the brace after it go deeper, if it begins outside (0) or
    inside (1) a string. `structure` holds the piece cut at its quotes.
    """
    outside = F.array_join(F.filter("structure", lambda _, i: i % 2 == start), "")
    deeper = F.regexp_count(outside, F.lit(r"[{\[]")) - F.regexp_count(outside, F.lit(r"\]"))
    ends_outside = (F.array_size("structure") - 1) % 2 == start
    return (deeper - ends_outside.cast("int")).cast("long")


def _before(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """Add the sum of `value` over all earlier pieces of the file."""
    earlier = (Window.unboundedPreceding, -1)
    per_range = pieces.groupBy(*RANGE).agg(F.sum(value).alias("__total"))
    over_ranges = Window.partitionBy("file_path").orderBy("block").rowsBetween(*earlier)
    total = F.coalesce(F.sum("__total").over(over_ranges), F.lit(0)).alias("__earlier")
    within = Window.partitionBy(*RANGE).orderBy("place").rowsBetween(*earlier)
    rows = pieces.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    rows = rows.join(per_range.select(*RANGE, total), [*RANGE])
    return rows.withColumn(name, F.col(name) + F.col("__earlier")).drop("__earlier")


def _balanced(pieces: DataFrame) -> DataFrame:
    """The files whose brackets balance, with nothing but white space after the last brace."""
    last = F.struct("block", "place")
    files = pieces.groupBy("file_path").agg(
        (F.sum(F.octet_length("piece") + 1) - F.first("file_size")).alias("missing"),
        F.sum("change").alias("depth"),
        F.max_by(F.col("piece").rlike(r"\A\s*\z"), last).alias("blank"),
    )
    # A last piece without a brace was counted as if it had one.
    whole = (F.col("missing") == 0) & (F.col("depth") == 0)
    return files.filter(whole | ((F.col("missing") == 1) & (F.col("depth") == -1) & F.col("blank")))


def _pair(text: Column, first: Column) -> Column:
    """struct(field, pair): the object a text ends with, and the field that began before it.

    The text begins outside the document if it is the `first`, else between two pairs.
    """

    def found(text: str, first: bool) -> dict[str, str | None]:
        depth, start, name, field = 0 if first else LISTED, 0, '""', None
        for token in TOKEN.finditer(text):
            sign = token[0][0]
            if sign == '"':
                name = token[0]
            elif sign == ":":
                field = json.loads(name, strict=False) if depth == 1 else field
            elif sign in "{[":
                start = token.start() if depth == LISTED else start
                depth += 1
            else:
                depth -= 1
        return {"field": field, "pair": text[start:]}

    @F.arrow_udf("struct<field: string, pair: string>")
    def pairs(texts: pa.Array, firsts: pa.Array) -> pa.Array:
        kind = pa.struct({"field": pa.string(), "pair": pa.string()})
        return pa.array(map(found, texts.to_pylist(), firsts.to_pylist()), kind)

    return pairs(text, first)
