"""Scoring options, summaries and result files."""

import csv
import json
import statistics
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe import (
    declared_metrics,
    detailed_metrics,
    long_scores,
    metric,
    pivot_scores,
    sample_scores,
    score,
    summarize,
    summary_document,
    wide_summary,
    write_results_csv,
    write_results_json,
    write_summary,
)

METRICS = ["exact_match", "word_count_similarity", "rouge_l"]
PAIRS = [
    ("m", "a", 0, "q0", "the cat", "the cat"),
    ("m", "a", 1, "q1", "the", "the cat"),
    ("m", "a", 2, "q2", "", "日本"),
    ("m", "b", 0, "q0", "x y", "x y"),
    ("n", "a", 0, "q0", "dog", "the cat"),
]
SCHEMA = (
    "model string, dataset string, sample_idx long, input string, prediction string, "
    "reference string"
)


@pytest.fixture(scope="module")
def scored(spark):
    return score(spark.createDataFrame(PAIRS, SCHEMA), METRICS).cache()


def test_mean_and_population_deviation(scored):
    rows = {(r.model, r.dataset): r for r in summarize(scored, METRICS, 2).collect()}
    assert set(rows) == {("m", "a"), ("m", "b"), ("n", "a")}
    values = [1.0, 0.5, 0.0]
    row = rows["m", "a"]
    assert (row.num_samples, row.few_shot_count) == (3, 2)
    assert row.word_count_similarity == pytest.approx(np.mean(values))
    assert row.word_count_similarity_std == pytest.approx(np.std(values))
    assert row.word_count_similarity_std == pytest.approx(statistics.pstdev(values))
    assert rows["m", "b"].exact_match_std == 0.0


def test_empty_datasets_are_reported(spark, scored):
    listed = spark.createDataFrame([("m", "a"), ("m", "void")], "model string, dataset string")
    rows = {r.dataset: r for r in summarize(scored, METRICS, 0, listed).collect()}
    assert set(rows) == {"a", "void"}
    assert (rows["void"].num_samples, rows["void"].exact_match) == (0, None)


def test_pivot_equals_wide(scored):
    names = sorted(METRICS)
    wide = wide_summary(summarize(scored, names), names).select("model", "dataset", *names)
    pivoted = pivot_scores(long_scores(scored, names), names).select("model", "dataset", *names)
    assert sorted(wide.collect()) == sorted(pivoted.collect())


@pytest.mark.parametrize("part_size", [2, 10])
def test_score_arrays_are_ordered_and_bounded(scored, part_size):
    rows = detailed_metrics(scored, METRICS, part_size).orderBy("part").collect()
    mine = [r for r in rows if (r.model, r.dataset, r.metric) == ("m", "a", "exact_match")]
    assert [s for r in mine for s in r.scores] == [1.0, 0.0, 0.0]
    assert all(len(r.scores) <= part_size for r in rows)
    assert mine[0].mean == pytest.approx(1 / 3)
    assert mine[0].std == pytest.approx(np.std([1, 0, 0]))


def test_parts_of_sparse_numbers_are_full(spark):
    rows = [("m", "a", n * n * 1000, float(n % 7)) for n in range(250)] + [("m", "b", 5, 1.0), ("m", "b", 9, None)]
    scored = spark.createDataFrame(rows, "model string, dataset string, sample_idx long, bleu double")
    found = sorted(detailed_metrics(scored.repartition(6), ["bleu"], 100).collect(), key=lambda r: (r.dataset, r.part))
    assert [(r.dataset, r.part, len(r.scores)) for r in found] == [("a", 0, 100), ("a", 1, 100), ("a", 2, 50), ("b", 0, 1)]
    assert [s for r in found[:3] for s in r.scores] == [float(n % 7) for n in range(250)]
    assert found[0]["mean"] == found[2]["mean"] == pytest.approx(np.mean([n % 7 for n in range(250)]))
    assert detailed_metrics(scored.limit(0), ["bleu"]).count() == 0


def test_only_declared_metrics(spark):
    rows = [
        ("a", ["exact_match"], "x", "x"),
        ("b", ["rouge_l", "composite", "magic"], "x", "x"),
        ("c", [], "x", "x"),
    ]
    pairs = spark.createDataFrame(
        rows, "dataset string, metrics array<string>, prediction string, reference string"
    )
    names = declared_metrics(pairs)
    assert names == ["composite", "exact_match", "rouge_l"]
    result = {r.dataset: r for r in score(pairs, names, only_declared=True).collect()}
    assert [[result[d][n] for n in names] for d in "abc"] == [
        [None, 1.0, None],
        [pytest.approx(1.0), None, 1.0],
        [None, None, None],
    ]
    seen = long_scores(score(pairs.withColumn("sample_idx", F.lit(0)), names, True), names)
    assert sorted((r.dataset, r.metric) for r in seen.collect()) == [
        ("a", "exact_match"),
        ("b", "composite"),
        ("b", "rouge_l"),
    ]


def test_metrics_not_declared_are_not_run(spark):
    from scoreframe import register_metric

    def picky(prediction: str, reference: str) -> float:
        if prediction == "poison":
            raise ValueError("must not run here")
        return 1.0

    register_metric("picky", picky, python=True)
    pairs = spark.createDataFrame(
        [(["picky"], "fine", ""), (["exact_match"], "poison", "")],
        "metrics array<string>, prediction string, reference string",
    )
    rows = score(pairs, ["picky", "exact_match"], only_declared=True).collect()
    assert [r.picky for r in rows] == [1.0, None]


def test_a_metric_only_once(spark):
    pairs = spark.createDataFrame([("a", "a")], "prediction string, reference string")
    with pytest.raises(ValueError, match="only once"):
        score(pairs, ["set_f1", metric("set_f1", delimiter=",")])


def test_summary_document(scored):
    summary = summarize(scored, METRICS)
    rows = {r.model: r for r in summary_document(summary, METRICS, "now").collect()}
    assert rows["m"].num_datasets == 2 and rows["n"].num_datasets == 1
    assert set(rows["m"].metrics) == {"a", "b"}
    assert rows["m"].metrics["b"] == {
        "exact_match": 1.0,
        "word_count_similarity": 1.0,
        "rouge_l": 1.0,
    }
    split = summary_document(summary, METRICS, "now", parts=50).collect()
    merged = {name for r in split if r.model == "m" for name in r.metrics}
    assert merged == {"a", "b"} and all(r.num_datasets in (1, 2) for r in split)


def test_datasets_of_one_name_stay_apart(spark):
    rows = [("m", "a", f"/{p}/a.json", 0, "x", r) for p, r in (("p", "x"), ("q", "y"))]
    pairs = spark.createDataFrame(
        rows,
        "model string, dataset string, file_path string, sample_idx long, prediction string, "
        "reference string",
    )
    summary = summarize(score(pairs, ["exact_match"]), ["exact_match"])
    assert sorted((r.file_path, r.exact_match) for r in summary.collect()) == [
        ("/p/a.json", 1.0),
        ("/q/a.json", 0.0),
    ]
    document = summary_document(summary, ["exact_match"], "now").first()
    assert set(document.metrics) == {"/p/a.json", "/q/a.json"}


def test_result_files(spark, scored, tmp_path):
    write_results_json(sample_scores(scored, METRICS), str(tmp_path / "json"), "r1")
    files = list((tmp_path / "json/run_id=r1/model=m/dataset=a").glob("*.json"))
    lines = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert {line["sample_idx"] for line in lines} == {0, 1, 2}
    assert any("日本" in f.read_text(encoding="utf-8") for f in files)
    assert lines[0]["scores"].keys() == set(METRICS)

    summary = summarize(scored, METRICS)
    report = wide_summary(summary, METRICS, 1.5).withColumn("model", F.lit('say "x", ok'))
    write_results_csv(report, str(tmp_path / "csv"))
    rows = [
        row
        for f in Path(tmp_path / "csv").glob("*.csv")
        for row in csv.DictReader(f.open(encoding="utf-8"))
    ]
    assert len(rows) == 3
    expected = ["dataset", "model", "num_samples", "few_shot_count", *METRICS, "elapsed_time"]
    assert list(rows[0]) == expected
    assert rows[0]["model"] == 'say "x", ok' and rows[0]["elapsed_time"] == "1.5"

    document = summary_document(summary, METRICS)
    assert write_summary(document, str(tmp_path / "doc"))
    assert not write_summary(document.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
