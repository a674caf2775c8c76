"""Named metrics."""

import pytest
from pyspark.sql import functions as F

from scoreframe import list_metrics, metric, metrics, register_metric, score

BUILT_IN = {
    "bleu",
    "char_f1",
    "composite",
    "contains_answer",
    "exact_match",
    "exact_match_figure",
    "fuzzy_match",
    "jaccard_similarity",
    "json_validity",
    "length_ratio",
    "rouge_l",
    "set_f1",
    "weighted_match",
    "word_count_similarity",
}


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([("ab", "ab"), ("a", "ab")], "prediction string, reference string")


def test_names():
    assert BUILT_IN <= set(list_metrics())
    assert metric("exact_match").name == "exact_match"
    assert [m.name for m in metrics(["bleu", "set_f1"])] == ["bleu", "set_f1"]


def test_unknown_name_and_parameter():
    with pytest.raises(ValueError, match="Unsupported metric: magic"):
        metric("magic")
    with pytest.raises(TypeError):
        metric("set_f1", colour="red")
    with pytest.raises(TypeError):
        metrics(["exact_match", "set_f1"], delimiter=",")


def test_column_builder(spark, pairs):
    def longer_by(prediction, reference, least=1):
        return F.char_length(reference) - F.char_length(prediction) >= least

    register_metric("longer_by", longer_by)
    rows = score(pairs, [metric("longer_by", least=1)]).collect()
    assert [r.longer_by for r in rows] == [0.0, 1.0]


def test_python_function_and_sql(spark, pairs):
    def same_length(prediction, reference):
        return len(prediction) == len(reference)

    register_metric("same_length", same_length, spark=spark, python=True)
    assert [r.same_length for r in score(pairs, ["same_length"]).collect()] == [1.0, 0.0]
    pairs.createOrReplaceTempView("pairs_for_sql")
    rows = spark.sql("SELECT same_length(prediction, reference) AS s FROM pairs_for_sql").collect()
    assert [r.s for r in rows] == [1.0, 0.0]


def test_later_registration_wins(spark, pairs):
    register_metric("constant", lambda p, r: F.lit(1.0))
    register_metric("constant", lambda p, r: F.lit(2.0))
    assert list_metrics().count("constant") == 1
    assert {r.constant for r in score(pairs, ["constant"]).collect()} == {2.0}


def test_builders_are_checked(spark):
    with pytest.raises(TypeError, match="must return a number"):
        register_metric("texty", lambda p, r: F.concat(p, r))
    with pytest.raises(TypeError, match="must return a Column"):
        register_metric("plain", lambda p, r: 1.0)
    with pytest.raises(TypeError, match="must be a function"):
        register_metric("nothing", None)
    assert not {"texty", "plain", "nothing"} & set(list_metrics())


def test_exceptions_in_python_metrics(spark, pairs):
    def strict(prediction, reference):
        if prediction != reference:
            raise ValueError("different")
        return 1.0

    register_metric("lenient", strict, python=True, null_on_error=True)
    assert [r.lenient for r in score(pairs, ["lenient"]).collect()] == [1.0, None]
    register_metric("strict", strict, python=True)
    with pytest.raises(Exception, match="different"):
        score(pairs, ["strict"]).collect()
