"""Input tables derived from the given ones, always over whole tables and whole texts.

There is no table of predictions or of dataset documents among the given data, so both
are derived. `workloads.sql` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions import text as X
from scoreframe.operators.merge import merge_scores, retract
from scoreframe.session import spread

MODEL = "echo"
TURNS_PER_CONVERSATION = 1_000_000_000  # keeps sample numbers apart and in order
CONVERSATIONS_PER_DOCUMENT = 16
TURNS_PER_DOCUMENT = 8
LOG_CUT = "timestamp_ntz'2024-01-16 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn and the assistant turn right after it, joined on the full turn key."""
    turns = table(spark, folder, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("input")
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat(F.lit("d"), F.col("conv_id") % 4).alias("dataset"),
        (F.col("conv_id") * TURNS_PER_CONVERSATION + F.col("turn")).alias("sample_idx"),
        "input",
        "reference",
        "conv_id",
        "turn",
    )


def _variant() -> Column:
    return (F.col("conv_id") + F.col("turn")) % 6


def _prediction() -> Column:
    words = X.words(F.col("reference"))
    half = F.array_join(F.slice(words, 1, F.floor(F.size(words) / 2).cast("int")), " ")
    return (
        F.when(_variant() == 0, F.col("reference"))
        .when(_variant() == 1, F.concat(F.lit("　"), "reference", F.lit("\t")))
        .when(_variant() == 2, half)
        .when(_variant() == 3, F.replace("reference", F.lit("e"), F.lit("E")))
        .when(_variant() == 4, F.concat("input", F.lit(" "), "reference"))
        .otherwise(F.lit(""))
    )


def conversation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Samples with a prediction derived from the reference in six ways."""
    return samples(spark, folder).select(
        F.lit(MODEL).alias("model"),
        "dataset",
        "sample_idx",
        "input",
        "reference",
        _prediction().alias("prediction"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of two models; one call in six failed and has no row."""
    made = samples(spark, folder).filter(_variant() != 2)
    answers = F.array(
        F.struct(F.lit(MODEL).alias("model"), _prediction().alias("prediction")),
        F.struct(F.lit("copy").alias("model"), F.col("reference").alias("prediction")),
    )
    return made.select("dataset", "sample_idx", F.inline(answers))


def numeric_pairs(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.col("value").cast("string")
    kind = F.col("event_id") % 11
    loops = F.concat(F.lit("1"), F.repeat(F.lit("_1"), 2500))
    prediction = (
        F.when(kind == 6, F.translate(shown, "0123456789", "٠١٢٣٤٥٦٧٨٩"))
        .when(kind == 7, F.concat(F.repeat(F.lit("7"), 20_000), F.lit("x")))
        .when(kind == 8, F.concat(loops, F.lit("_")))
        .when(kind == 9, F.concat(F.lit("0."), loops))
        .when(kind == 1, F.concat(shown, F.lit("0")))
        .when(kind == 2, F.concat(F.lit("　 "), shown, F.lit("\n")))
        .when(kind == 3, F.concat(F.lit("1_0"), shown))
        .when(kind == 4, F.concat(shown, F.lit("d")))
        .when(kind == 5, F.lit("nan"))
        .otherwise(shown)
    )
    reference = (
        F.when(kind == 3, F.concat(F.lit("10"), shown, F.lit("e0")))
        .when(kind == 5, F.lit("NaN"))
        .when(kind == 8, F.replace(loops, F.lit("_"), F.lit("")))
        .when(kind == 9, F.concat(F.lit("."), F.repeat(F.lit("1"), 2501)))
        .otherwise(shown)
    )
    # Spread while rows are narrow: the texts are made, and read, by all cores.
    events = spread(table(spark, folder, "events").select("event_id", "value"), "event_id")
    return events.select(
        F.col("event_id").alias("sample_idx"),
        prediction.alias("prediction"),
        reference.alias("reference"),
    )


def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents against their text without every third line."""
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, place: place % 3 != 2)
    return table(spark, folder, "documents").select(
        F.col("lang").alias("dataset"),
        F.col("doc_id").alias("sample_idx"),
        F.col("text").alias("reference"),
        F.array_join(kept, "\n").alias("prediction"),
    )


def passage_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents, each asked for one of its lines or for a benchmark passage."""
    passages = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("passage"))
    lines = F.split("text", "\n")
    documents = table(spark, folder, "documents").withColumn(
        "item_id", F.col("doc_id") % passages.count()
    )
    return documents.join(passages, "item_id").select(
        F.col("doc_id").alias("sample_idx"),
        F.col("text").alias("prediction"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.element_at(lines, -1)))
        .otherwise(F.col("passage"))
        .alias("reference"),
    )


def part_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Short texts with their words moved, for character-level metrics."""
    kind = F.col("p_partkey") % 4
    prediction = (
        F.when(kind == 0, F.concat_ws(" ", F.lower("p_type"), "p_name"))
        .when(kind == 1, F.concat_ws(", ", "p_brand", "p_name"))
        .when(kind == 2, F.concat(F.lit("　"), "p_name", F.lit(" "), "p_type"))
        .otherwise(F.col("p_brand"))
    )
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("sample_idx"),
        prediction.alias("prediction"),
        F.concat_ws(" ", "p_name", "p_type").alias("reference"),
    )


def listed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a few short lines, some of them in another order, missing or repeated."""
    kind = F.col("p_partkey") % 4
    reference = F.concat_ws("\n", "p_name", "p_brand", "p_type")
    prediction = (
        F.when(kind == 0, F.concat_ws("\n", "p_type", "p_name", "p_brand"))
        .when(kind == 1, F.concat_ws("\n ", "p_name", "p_brand", "p_brand"))
        .when(kind == 2, F.concat(F.lit(" "), reference, F.lit("\n")))
        .otherwise(F.concat_ws("\n\n", F.lower("p_name"), "p_type"))
    )
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("sample_idx"),
        prediction.alias("prediction"),
        reference.alias("reference"),
    )


def json_pairs(spark: SparkSession, folder: str) -> DataFrame:
    props = F.col("props")
    kind = F.col("event_id") % 8
    prediction = (
        F.when(kind == 1, F.replace(props, F.lit("}"), F.lit(', "extra": [1, 2]}')))
        .when(kind == 2, F.replace(props, F.lit('"k"'), F.lit('"other"')))
        .when(kind == 3, F.replace(props, F.lit("}"), F.lit("")))
        .when(kind == 4, F.concat(F.lit("["), props, F.lit("]")))
        .when(kind == 5, F.replace(props, F.lit('"'), F.lit("'")))
        .when(kind == 6, F.lit("{}"))
        .when(kind == 7, F.concat(props, F.lit(" trailing")))
        .otherwise(props)
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("sample_idx"),
        prediction.alias("prediction"),
        props.alias("reference"),
    )


def raw_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Response documents around the event type, some without an answer."""
    kind = F.col("event_id") % 9
    content = F.concat("event_type", F.lit(" "), F.col("value").cast("string"))
    raw = (
        F.when(kind == 1, F.lit('{"choices":[{}]}'))
        .when(kind == 2, F.lit('{"choices":[]}'))
        .when(kind == 3, F.concat(F.lit('{"error":"'), content, F.lit('"}')))
        .when(kind == 4, F.concat(F.lit('{"choices":[{"message":{"content":"'), content))
        .when(kind == 5, F.lit('{"choices":[{"message":null}]}'))
        .when(kind == 6, F.lit('{"choices":[null]}'))
        .when(kind == 7, F.concat(F.lit('{"choices":[{"message":{}}]} '), content))
        .when(kind == 8, F.lit('{"choices":[{"message":{"content":null}}]}'))
        .otherwise(
            F.concat(F.lit('{"choices":[{"message":{"content":"'), content, F.lit('"}}]}'))
        )
    )
    return table(spark, folder, "events").select("event_id", raw.alias("raw"))


def dataset_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Dataset documents of at most 128 samples, built from neighbouring conversations.

    The group key holds a range of conversations and of turns, so the number of samples
    in a document is bounded even if one conversation holds most of the turns.
    """
    number = F.floor(F.col("conv_id") / CONVERSATIONS_PER_DOCUMENT)
    stretch = F.floor(F.col("turn") / TURNS_PER_DOCUMENT)
    ordered = F.array_sort(
        F.collect_list(F.struct("sample_idx", "input", F.col("reference").alias("output")))
    )
    return (
        samples(spark, folder)
        .groupBy(number.alias("number"), stretch.alias("stretch"))
        .agg(
            F.transform(
                ordered, lambda s: F.struct(s["input"].alias("input"), s["output"].alias("output"))
            ).alias("samples")
        )
        .select(
            F.concat_ws("_", F.lit("set"), "number", "stretch").alias("dataset"),
            F.concat(F.lit("Answer set "), "number", F.lit("。")).alias("instruction"),
            (F.col("number") % 5).cast("int").alias("output_length"),
            F.when(F.col("number") % 2 == 0, F.array(F.lit("exact_match"), F.lit("rouge_l")))
            .otherwise(F.array(F.lit("word_count_similarity"), F.lit("contains_answer")))
            .alias("metrics"),
            F.slice("samples", 1, (F.col("number") % 4).cast("int")).alias("few_shots"),
            "samples",
            "number",
        )
    )


def faulty_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The dataset documents, some with a fault that keeps them from being evaluated."""
    kind = F.col("number") % 5
    no_output = F.transform(
        "samples",
        lambda s: F.struct(s["input"].alias("input"), F.lit(None).cast("string").alias("output")),
    )
    return (
        dataset_documents(spark, folder)
        .withColumn("instruction", F.when(kind != 1, F.col("instruction")))
        .withColumn("samples", F.when(kind == 2, no_output).otherwise(F.col("samples")))
        .withColumn(
            "metrics",
            F.when(kind == 3, F.array_append("metrics", F.lit("unheard_of"))).otherwise(
                F.col("metrics")
            ),
        )
    )


def benchmark_rules(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("rule_order"),
        F.col("text").alias("key"),
        F.concat(F.lit("item "), "item_id").alias("response"),
    )


def order_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rule for every order line: a table of many megabytes."""
    key = F.concat(
        F.lit("[order "), "l_orderkey", F.lit(" line "), "l_linenumber", F.lit(" of the open list]")
    )
    response = F.concat(F.lit("line "), "l_linenumber", F.lit(" of order "), "l_orderkey")
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("rule_order"),
        key.alias("key"),
        response.alias("response"),
    )


def order_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Two models asked about an order under the same sample key, in different words."""

    def line(order: Column, number: int) -> Column:
        return F.concat(F.lit("[order "), order, F.lit(f" line {number} of the open list]"))

    order = F.col("o_orderkey")
    asked = F.array(
        F.struct(
            F.lit("m1").alias("model"),
            F.concat(F.lit("Where is "), line(order, 1), F.lit("?")).alias("prompt"),
        ),
        F.struct(
            F.lit("m2").alias("model"),
            F.concat(line(order + 1, 1), F.lit(", then "), line(order, 2)).alias("prompt"),
        ),
    )
    return table(spark, folder, "orders").select(
        F.lit("orders").alias("dataset"), order.alias("sample_idx"), F.inline(asked)
    )


def document_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("lang").alias("dataset"),
        F.col("doc_id").alias("sample_idx"),
        F.col("text").alias("prompt"),
    )


def _score_log(events: DataFrame) -> DataFrame:
    """Events as score changes; a key recurs the more often the longer the log is."""
    return events.select(
        F.concat(F.lit("m"), F.col("user_id") % 2).alias("model"),
        F.concat(F.lit("u"), F.col("user_id") % 10).alias("dataset"),
        F.get_json_object("props", "$.k").cast("long").alias("sample_idx"),
        F.col("event_type").alias("metric"),
        F.col("value").alias("score"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"),
        F.col("event_id").alias("seq"),
        (F.col("value") > 60).alias("is_builtin"),
    )


def score_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _score_log(table(spark, folder, "events").filter(f"ts >= {LOG_CUT}"))


def current_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score table after the first part of the log, some keys retracted."""
    log = _score_log(table(spark, folder, "events").filter(f"ts < {LOG_CUT}"))
    empty = spark.createDataFrame(
        [],
        "model string, dataset string, sample_idx long, metric string, score double, "
        "created_at string, updated_at string, is_builtin boolean, is_active boolean",
    )
    return retract(merge_scores(empty, log), log.filter(F.col("score") < 3))
