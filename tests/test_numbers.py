"""Numbers in text: what float() takes, in linear time whatever the text."""

import time

import pytest
from pyspark.sql import functions as F

from scoreframe.functions.text import strip, to_number

CASES = [
    "1", "+1.", "-.5", "1e5", "1E-05", ".5e+1", "1_000", "1_0.0_1", "1e1_0", "inf", "-Infinity",
    "٣", "１２.５", "१२३", "٣_٠", "", ".", "1_", "_1", "1__0", "1._5", "1_.5", "1e", "e5", "1d", "0x1",
    "1 2", "+-1", "infin", "²", "½", "1e5_", "--1",
]


def expected(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_numbers_are_those_of_float(spark):
    frame = spark.createDataFrame([(c,) for c in CASES], "text string")
    rows = frame.select("text", to_number(strip(F.col("text"))).alias("number")).collect()
    assert {r.text: r.number for r in rows} == {c: expected(c) for c in CASES}


@pytest.mark.parametrize(
    "unit, end", [("7", "x"), ("_1", ""), ("_1", "x"), ("1_", ""), ("1e", ""), ("1.", "")]
)
def test_long_texts_take_linear_time(spark, unit, end):
    text = "1" + unit * (1_000_000 // len(unit)) + end
    started = time.monotonic()
    frame = spark.createDataFrame([(text,)], "text string")
    (row,) = frame.select(to_number(F.col("text")).alias("number")).collect()
    assert row.number == expected(text)
    assert time.monotonic() - started < 20
