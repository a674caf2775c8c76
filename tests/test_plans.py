"""Physical plans: what is shuffled, pushed down and sent to Python."""

import re

import pytest
from pyspark.sql import functions as F

from scoreframe import active, long_scores, lookup, score, spread, summarize
from workloads.catalog import BUILT_IN, CATALOG
from workloads.tables import document_pairs

NAMES = sorted(BUILT_IN)


@pytest.fixture
def plan(capsys):
    def text(frame, mode=None):
        capsys.readouterr()
        frame.explain(mode) if mode else frame.explain()
        return capsys.readouterr().out

    return text


@pytest.fixture
def pairs(spark, folder):
    return document_pairs(spark, folder)


def test_scoring_needs_no_shuffle_and_one_python_node(plan, pairs):
    text = plan(score(pairs, NAMES))
    assert "Exchange" not in text
    assert text.count("ArrowEvalPython") == 1


def test_native_metrics_need_no_python(plan, pairs):
    names = ["exact_match", "set_f1", "jaccard_similarity", "length_ratio"]
    assert "Python" not in plan(score(pairs, names))


def test_shared_forms_are_computed_once(plan, pairs):
    text = plan(score(pairs, ["exact_match", "contains_answer", "weighted_match"]))
    assert len(re.findall(r" AS __prediction_stripped", text)) == 1


def test_summary_has_one_shuffle(plan, pairs):
    scored = score(pairs, NAMES).withColumn("model", F.lit("m"))
    text = plan(summarize(scored, NAMES))
    assert text.count("Exchange") == 1 and "partial_avg" in text


def test_only_needed_columns_are_read(plan, spark, folder):
    text = plan(CATALOG["rule_predictions_mapping"].run(spark, folder), "formatted")
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "text" in schema and "source" not in schema and "n_chars" not in schema


def test_state_filters_reach_the_files(plan, spark, tmp_path):
    path = str(tmp_path / "state")
    spark.createDataFrame(
        [("m", "d", 1, "x", 0.5, True, True)],
        "model string, dataset string, sample_idx long, metric string, score double, "
        "is_builtin boolean, is_active boolean",
    ).write.parquet(path)
    state = spark.read.parquet(path)
    text = plan(active(state, custom_only=True), "formatted")
    assert "EqualTo(is_active,true)" in text and "Not(EqualTo(is_builtin,true))" in text
    key = {"model": "m", "dataset": "d", "sample_idx": 1, "metric": "x"}
    assert "EqualTo(sample_idx,1)" in plan(lookup(state, key), "formatted")


def test_merge_shuffles_each_side_once(plan, spark, tmp_path):
    from scoreframe import merge_scores

    state = spark.range(10).selectExpr(
        "'m' || id AS model", "'d' || id AS dataset", "id AS sample_idx", "'x' || id AS metric",
        "1.0D AS score", "id AS created_at", "id AS updated_at", "id AS seq",
        "true AS is_builtin", "true AS is_active",
    )
    for name, frame in (("state", state.drop("seq")), ("log", state.drop("created_at", "is_active"))):
        frame.write.parquet(str(tmp_path / name))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(merge_scores(read("state"), read("log"), small_bytes=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 2
    text = plan(merge_scores(read("state"), read("log")))
    # The collapsed log is stored, so the log itself is no part of the plan any more.
    assert "/log" not in text and "Aggregate" not in text
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") == 3
    assert "FullOuter" not in text


def test_undeclared_forms_are_not_built(plan, pairs):
    names = ["exact_match", "jaccard_similarity"]
    early = F.col("sample_idx") < 5
    one = F.when(early, F.array(F.lit(names[0]))).otherwise(F.array(F.lit(names[1])))
    text = plan(score(pairs.withColumn("metrics", one), names, only_declared=True))
    for form in ("stripped", "word_set"):
        made = text.split(f" AS __prediction_{form}")[0].rsplit("CASE WHEN arrays_overlap", 1)
        assert len(made) == 2 and " AS __" not in made[1], form


def test_long_form_carries_no_texts(plan, pairs):
    text = plan(long_scores(score(pairs, ["exact_match", "set_f1"]), ["exact_match", "set_f1"]))
    expand = re.search(r"Expand (.*)", text).group(1)
    assert "prediction" not in expand and "reference" not in expand


def test_spread_shuffles_once(plan, pairs):
    assert plan(spread(pairs, "sample_idx", partitions=7)).count("Exchange") == 1
    assert spread(pairs, "sample_idx", partitions=7).rdd.getNumPartitions() == 7


def test_scoring_works_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "pairs")
    pair = "prediction string, reference string"
    spark.createDataFrame([("a", "a"), ("b", "a")], pair).write.parquet(source)
    scored = score(spark.readStream.schema(pair).parquet(source), ["exact_match", "char_f1"])
    writer = scored.writeStream.format("memory").queryName("streamed").trigger(availableNow=True)
    writer.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    rows = spark.sql("SELECT exact_match FROM streamed").collect()
    assert sorted(r.exact_match for r in rows) == [0.0, 1.0]
