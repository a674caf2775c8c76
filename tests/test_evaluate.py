"""Whole runs over dataset files."""

import json

import pytest
from pyspark.sql import functions as F

from scoreframe import evaluate, register_metric, score


def document(metrics, samples, shots=(), instruction="Answer."):
    pair = lambda p: {"input": p[0], "output": p[1]}
    return json.dumps(
        {
            "instruction": instruction,
            "output_length": 5,
            "metrics": metrics,
            "few_shots": [pair(s) for s in shots],
            "samples": [pair(s) for s in samples],
        }
    )


@pytest.fixture
def place(tmp_path):
    files = {
        "sums.json": document(["exact_match_figure"], [("1+1", "2"), ("2+2", "4")], [("0+0", "0")]),
        "words.json": document(["exact_match", "char_f1"], [("say hi", "hi")]),
        "more/words.json": document(["exact_match"], [("say no", "hi"), ("say hi", "hi")]),
        "none.json": document(["exact_match"], []),
        "odd.json": document(["magic"], [("a", "b")]),
        "bad.json": "{",
    }
    for name, content in files.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8")
    return tmp_path


def test_directory_run(spark, place):
    def answer(prompt):  # inner, so that it travels to the workers by value
        question = prompt.rsplit("\n\n", 1)[1]
        if question == "2+2":
            raise TimeoutError("slow")
        return {"1+1": "2.0", "say hi": "hi "}.get(question, "?")

    out = str(place / "out")
    how = {"retries": 1, "delay": 0.0, "concurrency": 2}
    run = evaluate(spark, str(place / "in"), "m", answer, out, few_shot_count=1, **how)
    assert run.metrics == ("char_f1", "exact_match", "exact_match_figure")
    rows = sorted(
        (r.dataset, r.num_samples, r.few_shot_count, r.exact_match, r.char_f1, r.exact_match_figure)
        for r in run.report.collect()
    )
    assert rows == [
        ("none", 0, 1, None, None, None),
        ("sums", 2, 1, None, None, 0.5),
        ("words", 1, 1, 1.0, 1.0, None),
        ("words", 2, 1, 0.5, None, None),
    ]
    assert {(r.dataset, r.model, r.error) for r in run.failures.collect()} == {
        ("odd", "m", "Unsupported metric: magic"),
        ("bad", "m", "not a JSON object"),
    }
    scores = {(r.dataset, r.input): r for r in run.scores.collect() if r.dataset == "sums"}
    assert scores["sums", "2+2"].prediction == ""
    assert run.elapsed_time > 0
    documents = [
        json.loads(line)
        for f in (place / "out").glob("run_id=*/document/*.json")
        for line in f.read_text().splitlines()
    ]
    assert len(documents) == 1 and documents[0]["num_datasets"] == 4
    assert documents[0]["metrics"]["sums"] == {"exact_match_figure": 0.5}
    assert list((place / "out").glob("samples/run_id=*/model=m/dataset=words/*.json"))
    results = [
        json.loads(line)
        for f in (place / "out").glob("results/run_id=*/model=m/dataset=words/*.json")
        for line in f.read_text().splitlines()
    ]
    assert sorted(r["num_samples"] for r in results) == [1, 2]
    spent = {(r.file_path, r.elapsed_time) for r in run.report.collect() if r.dataset == "words"}
    assert len(spent) == 2 and all(0 < t < run.elapsed_time for _, t in spent)
    detailed = [
        json.loads(line)
        for f in (place / "out").glob("detailed/run_id=*/model=m/dataset=sums/*.json")
        for line in f.read_text().splitlines()
    ]
    assert [(d["metric"], d["scores"], d["mean"]) for d in detailed] == [
        ("exact_match_figure", [1.0, 0.0], 0.5)
    ]
    assert not list((place / "out").glob("inputs-*"))


def test_one_file_uses_all_cores_and_a_second_call_resumes(spark, tmp_path):
    samples = [(f"q{n}", f"a{n}") for n in range(400)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.json").write_text(document(["exact_match"], samples))
    seen = tmp_path / "seen"
    seen.mkdir()

    def answer(prompt):
        from pathlib import Path

        from pyspark import TaskContext

        place = Path(seen) / f"{TaskContext.get().partitionId()}"
        with place.open("a") as log:
            log.write(prompt[-4:] + "\n")
        if prompt.endswith("q7") and not (Path(seen) / "again").exists():
            raise ConnectionError("down")
        return "a" + prompt.rsplit("q", 1)[1]

    how = {"retries": 0, "delay": 0.0}
    run = evaluate(spark, str(tmp_path / "in"), "m", answer, str(tmp_path / "out"), **how)
    assert len(list(seen.iterdir())) >= 8
    assert run.report.first().exact_match == pytest.approx(399 / 400)
    asked = sum(len(p.read_text().split()) for p in seen.iterdir())
    (seen / "again").write_text("")
    again = evaluate(spark, str(tmp_path / "in"), "m", answer, str(tmp_path / "out"), **how)
    assert again.output == run.output
    assert sum(len(p.read_text().split()) for p in seen.iterdir()) == asked + 1
    assert again.report.first().exact_match == 1.0
    other = evaluate(
        spark, str(tmp_path / "in"), "m", answer, str(tmp_path / "out"), metrics=["bleu"], **how
    )
    assert other.output != run.output


def test_errors_in_column_metrics_cost_only_their_dataset(spark, tmp_path):
    from pyspark.sql import functions as F

    register_metric("inverse.size", lambda p, r: F.lit(1.0) / F.length(p), spark=spark)
    (tmp_path / "in").mkdir()
    for name, text in (("full", "x"), ("empty", "")):
        body = document(["inverse.size"], [("q", "r"), (text or "none", "r")])
        (tmp_path / "in" / f"{name}.json").write_text(body)
    rules = {"none": "", "x": "four", "q": "yes"}
    run = evaluate(spark, str(tmp_path / "in"), "m", rules, str(tmp_path / "out"))
    assert {r.dataset: r.error for r in run.failures.collect()} == {
        "empty": "no score by metric: inverse.size"
    }
    assert [(r.dataset, r["inverse.size"]) for r in run.report.collect()] == [
        ("full", pytest.approx((1 / 3 + 1 / 4) / 2))
    ]


def test_outputs_that_are_no_text_and_null_metrics(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bodies = {
        "number": '{"instruction":"","metrics":["exact_match"],"samples":[{"input":"a","output":5}]}',
        "object": '{"instruction":"","metrics":["exact_match"],"samples":[{"input":"a","output":{"x":1}}]}',
        "null": '{"instruction":"","metrics":[null],"samples":[{"input":"a","output":"b"}]}',
        "fine": '{"instruction":"","metrics":["exact_match"],"samples":[{"input":5,"output":"b"}]}',
    }
    for name, body in bodies.items():
        (tmp_path / "in" / f"{name}.json").write_text(body)
    run = evaluate(spark, str(tmp_path / "in"), "m", {"5": "b"}, str(tmp_path / "out"))
    assert {r.dataset: r.error for r in run.failures.collect()} == {
        "number": "an output is not text",
        "object": "an output is not text",
        "null": "Unsupported metric: null",
    }
    assert [(r.dataset, r.exact_match) for r in run.report.collect()] == [("fine", 1.0)]


def test_chosen_metrics_and_one_file(spark, place):
    path = str(place / "in" / "odd.json")
    run = evaluate(spark, path, "m", {"a": "b"}, str(place / "out"), metrics=["bleu", "exact_match"])
    assert [(r.dataset, r.exact_match) for r in run.report.collect()] == [("odd", 1.0)]
    assert run.failures.isEmpty()


def test_stored_predictions(spark, place):
    known = spark.createDataFrame(
        [("m", "sums", 1, "4"), ("n", "sums", 0, "2")],
        "model string, dataset string, sample_idx long, prediction string",
    )
    path = str(place / "in" / "sums.json")
    run = evaluate(spark, path, "m", known, str(place / "out"))
    rows = run.scores.orderBy("sample_idx").collect()
    assert [(r.prediction, r.exact_match_figure) for r in rows] == [("", 0.0), ("4", 1.0)]


def test_run_without_a_valid_dataset(spark, place):
    path = str(place / "in" / "bad.json")
    run = evaluate(spark, path, "m", {}, str(place / "out"))
    assert run.report.isEmpty() and run.failures.count() == 1
    assert not list((place / "out").glob("run_id=*/document"))


def test_a_failing_metric_costs_only_its_dataset(spark, place):
    def picky(prediction, reference):
        return 1 / len(prediction)

    register_metric("picky", picky, python=True, null_on_error=True)
    for name, text in (("one", "x"), ("two", "")):
        (place / "in" / f"{name}.json").write_text(document(["picky"], [("q", "r"), (text, "r")]))
    rules = {"q": "yes", "x": "four"}
    run = evaluate(spark, str(place / "in"), "m", rules, str(place / "out"), default="")
    errors = {r.dataset: r.error for r in run.failures.collect()}
    assert errors["two"] == "no score by metric: picky"
    rows = {r.dataset: r.picky for r in run.report.collect()}
    assert rows["one"] == pytest.approx((1 / 3 + 1 / 4) / 2)
    assert "two" not in rows and {"sums", "words", "none"} <= rows.keys()


def test_another_answer_function_never_sees_the_answers_of_the_first(spark, place):
    def make(text):
        return lambda prompt: text

    path, out = str(place / "in" / "sums.json"), str(place / "out")
    first = evaluate(spark, path, "m", make("2"), out)
    second = evaluate(spark, path, "m", make("4"), out)
    assert first.output != second.output
    for run, texts in ((first, ["2", "2"]), (second, ["4", "4"])):
        assert [r.prediction for r in run.scores.orderBy("sample_idx").collect()] == texts
    rules = [evaluate(spark, path, "m", {"+": text}, out) for text in ("2", "4")]
    assert [sorted({r.prediction for r in run.scores.collect()}) for run in rules] == [["2"], ["4"]]
    assert len({run.output for run in (first, second, *rules)}) == 4


def test_an_exception_in_a_metric_costs_only_its_dataset(spark, place):
    from scoreframe import metric

    def fussy(prediction, reference):
        if prediction == "four":
            raise LookupError(f"no {prediction}")
        return len(prediction)

    register_metric("fussy", fussy, python=True)
    for name, text in (("one", "y"), ("two", "x")):
        (place / "in" / f"{name}.json").write_text(document(["fussy", "bleu"], [("q", "r"), (text, "r")]))
    rules = {"q": "yes", "x": "four", "y": ""}
    run = evaluate(spark, str(place / "in"), "m", rules, str(place / "out"), default="")
    errors = {r.dataset: r.error for r in run.failures.collect()}
    assert errors["two"] == "metric fussy: LookupError: no four"
    rows = {r.dataset: r.fussy for r in run.report.collect()}
    assert rows["one"] == 1.5 and "two" not in rows and {"sums", "words", "none"} <= rows.keys()
    chosen = evaluate(
        spark, str(place / "in"), "m", rules, str(place / "chosen"), metrics=["fussy", "exact_match"], default=""
    )
    assert {r.dataset for r in chosen.failures.collect()} == {"two", "bad"}

    pairs = spark.createDataFrame([("four", "r"), ("ab", "ab"), (None, "r")], "prediction string, reference string")
    both = ["fussy", metric("composite", weights={"fussy": 0.5, "exact_match": 1.0}), "char_f1"]
    found = score(pairs, both, errors="problems").collect()
    assert [(r.fussy, r.composite, r.problems) for r in found] == [
        (None, None, {"fussy": "LookupError: no four"}),
        (2.0, 2.0, {}),
        (None, None, {}),
    ]
    found = score(pairs, ["exact_match", both[1]], errors="problems").collect()
    assert [(r.composite, r.problems) for r in found][:2] == [(None, {"fussy": "LookupError: no four"}), (2.0, {})]
    with pytest.raises(Exception, match="no four"):
        score(pairs, ["fussy"]).collect()


def test_time_is_that_of_the_dataset(spark, tmp_path):
    def slow(prediction, reference):
        import time

        time.sleep(0.05 if reference.startswith("late") else 0.001)
        return 1.0

    register_metric("slow_or_not", slow, python=True, spark=spark)
    (tmp_path / "in").mkdir()
    for name, start in (("late", "late"), ("soon", "soon")):
        samples = [(f"q{n}", f"{start} {n}") for n in range(80)]
        (tmp_path / "in" / f"{name}.json").write_text(document(["slow_or_not"], samples))
    run = evaluate(spark, str(tmp_path / "in"), "m", {"q": "late"}, str(tmp_path / "out"), partitions=4)
    spent = {r.dataset: r.elapsed_time for r in run.report.collect()}
    assert spent["late"] >= 80 * 0.05 and 80 * 0.001 <= spent["soon"] < 0.5 * spent["late"]
    assert "__seconds" not in run.scores.columns


def test_times_add_up_to_those_of_the_tasks(spark):
    def task_of(prediction, reference):
        import time

        time.sleep(0.004)
        return 1.0

    register_metric("sleeper", task_of, python=True, spark=spark)
    rows = [(n, "a" * (n % 7), "b") for n in range(600)]
    pairs = spark.createDataFrame(rows, "sample_idx long, prediction string, reference string")
    names = ["sleeper", "exact_match", "bleu"]
    pairs = pairs.repartition(3).withColumn("task", F.spark_partition_id())
    found = score(pairs, names, errors="failed", seconds="spent")
    assert found.columns == [*pairs.columns, *names, "failed", "spent"]
    spent = [r.spent for r in found.groupBy("task").agg(F.sum("spent").alias("spent")).collect()]
    # 200 pairs of 4 ms are in a task, which does little else.
    assert len(spent) == 3 and all(0.8 <= s < 1.6 for s in spent)
    with pytest.raises(ValueError):
        score(pairs, names, seconds="spent")
    empty = score(pairs.filter("false"), ["exact_match"], errors="failed", seconds="spent")
    assert empty.count() == 0
