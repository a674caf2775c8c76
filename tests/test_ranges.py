"""Samples of dataset files read by ranges, against the files read whole."""

import json
import random

import pytest

from scoreframe import explode_samples, read_datasets, read_sample_ranges

ODD = ['}', '{', '"', '\\', '\\"', '}"{', ']}', '"samples": [{', '\n', '漢', '🇮🇸', "a b", "'", ":", ",", "\t", "\\u007d"]


def texts(r):
    return "".join(r.choices(ODD, k=r.randint(0, 12)))


def document(seed):
    r = random.Random(seed)
    pairs = lambda n: [
        {"input": texts(r), **({"more": {"a": [{"b": texts(r)}]}} if r.random() < 0.2 else {}), "output": texts(r)}
        for _ in range(n)
    ]
    fields = [
        ("instruction", texts(r)), ("output_length", 3), ("metrics", ["exact_match", "}"]),
        ("few_shots", pairs(r.choice([0, 2]))), ("samples", pairs(r.choice([0, 1, 40]))),
        ("extra", {"x": {"y": [texts(r), {}]}, "z": [{"input": "no"}, [{}]]}),
    ]
    r.shuffle(fields)
    return json.dumps(dict(fields), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2]))


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_are_those_of_whole_files(spark, tmp_path, small_ranges):
    for n in range(30):
        place = tmp_path / ("more" if n % 2 else "") / f"d ü {n // 2}.json"
        place.parent.mkdir(exist_ok=True)
        place.write_text(document(n) + ("\n \n" if n % 3 else ""), encoding="utf-8")
    whole = explode_samples(read_datasets(spark, str(tmp_path)), [])
    found = read_sample_ranges(spark, str(tmp_path))
    assert found.columns == whole.columns
    expected = sorted(map(tuple, whole.collect()))
    assert len(expected) > 200 and sorted(map(tuple, found.collect())) == expected


def test_files_that_are_no_documents_give_no_rows(spark, tmp_path, small_ranges):
    good = document(3)
    assert '"samples"' in good
    broken = {
        "cut": good[:-1], "half": good[: len(good) // 2], "open": "{" + good, "empty": "", "blank": " \n",
        "list": "[1]", "after": good + " x", "none": "{}", "no_samples": '{"few_shots": [{"input": "a", "output": "b"}]}',
    }
    for name, text in broken.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    assert read_sample_ranges(spark, str(tmp_path)).count() == 0


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    samples = [{"input": f"question {n} {{}}", "output": "x" * (n % 50)} for n in range(30000)]
    (tmp_path / "large.json").write_text(json.dumps({"samples": samples}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        source = spark.read.text(str(tmp_path), lineSep="}")
        assert source.rdd.getNumPartitions() >= 8
        rows = read_sample_ranges(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {r.sample_idx: (r.input, r.reference) for r in rows}
    assert len(rows) == len(found) == 30000
    assert all(found[n] == (s["input"], s["output"]) for n, s in enumerate(samples))
