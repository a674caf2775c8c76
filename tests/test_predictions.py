"""Prompts, requests, responses, generation and rules."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from scoreframe import (
    attach_predictions,
    build_prompts,
    generate,
    parse_responses,
    request_table,
    rule_predictions,
)
from scoreframe.operators.predictions import MOCK_ON_ERROR
from scoreframe.operators.rules import DEFAULT_RESPONSE

SHOTS = [("eins", "1"), ("zwölf", "12")]


def dataset(spark):
    return spark.createDataFrame(
        [("d", "Schreibe als Zahl.", SHOTS)],
        "dataset string, instruction string, few_shots array<struct<input:string,output:string>>",
    )


PROMPTS = {
    0: "Schreibe als Zahl.\n\nsieben",
    1: "Schreibe als Zahl.\n\neins\n1\n\nsieben",
    2: "Schreibe als Zahl.\n\neins\n1\n\nzwölf\n12\n\nsieben",
    3: "Schreibe als Zahl.\n\nsieben",
    -1: "Schreibe als Zahl.\n\nsieben",
}


@pytest.mark.parametrize("shots", PROMPTS)
def test_prompts(spark, shots):
    settings = dataset(spark)
    carried = settings.withColumn("input", F.lit("sieben"))
    apart = carried.select("dataset", "input")
    assert build_prompts(carried, shots).first().prompt == PROMPTS[shots]
    assert build_prompts(apart, shots, settings).first().prompt == PROMPTS[shots]


def test_requests(spark):
    prompts = spark.createDataFrame([('say "ü"\n日本',)], "prompt string")
    row = request_table(prompts, "m", seed=7, stop=["a", "b"], messages="ignored").first()
    assert json.loads(row.request) == {
        "model": "m",
        "messages": [{"role": "user", "content": 'say "ü"\n日本'}],
        "temperature": 0.7,
        "max_tokens": 500,
        "seed": 7,
        "stop": ["a", "b"],
    }


@pytest.mark.parametrize(
    ("raw", "prediction", "failed"),
    [
        ('{"choices":[{"message":{"content":"Antwort ✓ 七"}}]}', "Antwort ✓ 七", False),
        ('{"choices":[{"message":{"content":"a"}},{"message":{"content":"b"}}]}', "a", False),
        ('{"choices":[{}]}', "", False),
        ('{"choices":[{"message":{}}]}', "", False),
        ('{"choices":[]}', "", True),
        ('{"error":"busy"}', "", True),
        ('{"choices":[{"message":{"content":"a"}}]} junk', "", True),
        ('{"choices":[{"message":null}]}', "", True),
        ('{"choices":[null]}', "", True),
        ('{"choices":[{"message":{"content":null}}]}', "", False),
        ('{"choices":[{"message":{"content":5}}]}', "", True),
        ("[1]", "", True),
        ("busy", "", True),
        (None, "", True),
    ],
)
def test_responses(spark, raw, prediction, failed):
    row = parse_responses(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row.prediction, row.error is not None) == (prediction, failed)


def test_predictions_are_joined_per_model(spark):
    samples = spark.createDataFrame(
        [("d", n, f"r{n}") for n in range(3)], "dataset string, sample_idx long, reference string"
    )
    predictions = spark.createDataFrame(
        [("m", "d", 0, "x"), ("m", "d", 1, None), ("n", "d", 2, "y"), ("m", "e", 2, "z")],
        "model string, dataset string, sample_idx long, prediction string",
    )
    one = attach_predictions(samples, predictions, "m").orderBy("sample_idx").collect()
    assert [(r.model, r.sample_idx, r.prediction) for r in one] == [
        ("m", 0, "x"),
        ("m", 1, ""),
        ("m", 2, ""),
    ]
    both = attach_predictions(samples, predictions, ["m", "n"]).collect()
    assert sorted((r.model, r.sample_idx, r.prediction) for r in both) == [
        ("m", 0, "x"),
        ("m", 1, ""),
        ("m", 2, ""),
        ("n", 0, ""),
        ("n", 1, ""),
        ("n", 2, "y"),
    ]


def test_repeated_and_ambiguous_predictions(spark):
    samples = spark.createDataFrame(
        [("d", "x/d.json", 0), ("d", "y/d.json", 0)], "dataset string, file_path string, sample_idx long"
    )
    rows = [("m", "d", 0, "b"), ("m", "d", 0, "a"), ("m", "d", 0, None)]
    known = spark.createDataFrame(rows, "model string, dataset string, sample_idx long, prediction string")
    with pytest.raises(ValueError, match="file_path"):
        attach_predictions(samples, known, "m")
    one = attach_predictions(samples.limit(1), known, "m").collect()
    assert [r.prediction for r in one] == ["a"]


def test_settings_of_any_kind(spark):
    import json

    from pyspark.sql import functions as F

    frame = spark.createDataFrame([('a "}', 7)], "prompt string, n int")
    extra = {"response_format": {"type": "json_object"}, "stop": None, "bias": {"é": [1, 2.5, True]}}
    asked = request_table(frame, "m", messages="x", seed=F.col("n"), **extra).first().request
    assert json.loads(asked) == {
        "model": "m",
        "messages": [{"role": "user", "content": 'a "}'}],
        "temperature": 0.7,
        "max_tokens": 500,
        "seed": 7,
        **extra,
    }


def prompts_of(spark, texts):
    rows = [("d", n, text) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "dataset string, sample_idx long, prompt string")


def test_generation_retries_and_gives_up(spark):
    def flaky():
        seen = {}

        def answer(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "never" or (prompt == "third" and seen[prompt] < 3):
                raise ConnectionError("down")
            return None if prompt == "nothing" else prompt.upper()

        return answer

    prompts = prompts_of(spark, ["first", "third", "never", "nothing"]).coalesce(1)
    rows = generate(prompts, flaky(), "m", retries=3, delay=0.0).orderBy("sample_idx").collect()
    assert [(r.prediction, r.error, r.attempts) for r in rows] == [
        ("FIRST", None, 1),
        ("THIRD", None, 3),
        ("", "ConnectionError: down", 4),
        ("", None, 1),
    ]
    mocked = generate(prompts, flaky(), "m", retries=0, delay=0.0, mock_on_error=True)
    assert [r.prediction for r in mocked.orderBy("sample_idx").collect()] == [
        "FIRST",
        MOCK_ON_ERROR,
        MOCK_ON_ERROR,
        "",
    ]


def test_generation_bounds_concurrency_and_keeps_rows_apart(spark):
    def watched():
        state = {"now": 0, "most": 0}

        def answer(prompt):
            lock = state.setdefault("lock", threading.Lock())  # made in the worker
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.005 * (int(prompt) % 3))
            with lock:
                state["now"] -= 1
            return f"{prompt}:{state['most']}"

        return answer

    prompts = prompts_of(spark, [str(n) for n in range(60)]).coalesce(1)
    rows = generate(prompts, watched(), "m", concurrency=4).collect()
    assert [r.prediction.split(":")[0] for r in rows] == [str(n) for n in range(60)]
    assert 1 < max(int(r.prediction.split(":")[1]) for r in rows) <= 4


def first_rule(prompt, rules, default):
    return next((response for key, response in rules if key in prompt), default)


@pytest.mark.parametrize("count", [3, 40, 200])
def test_rules_agree_whichever_way_they_are_matched(spark, count):
    rng = random.Random(count)
    alphabet = "abé日😀 "
    word = lambda most: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most)))
    rules = [(word(6), f"r{n}") for n in range(count)]
    prompts = ["", *(word(30) for _ in range(200))]
    expected = [first_rule(p, rules, DEFAULT_RESPONSE) for p in prompts]
    frame = prompts_of(spark, prompts)
    table = spark.createDataFrame(
        [(n, key, response) for n, (key, response) in enumerate(rules)],
        "rule_order long, key string, response string",
    )

    def answers(**how):
        rows = rule_predictions(frame, table, **how).orderBy("sample_idx").collect()
        return [r.prediction for r in rows]

    assert answers() == expected
    assert answers(small_bytes=0) == expected
    as_mapping = dict(reversed(rules))  # for a repeated key the first response counts
    ordered = {key: as_mapping[key] for key, _ in rules}
    rows = rule_predictions(frame, ordered).orderBy("sample_idx").collect()
    assert [r.prediction for r in rows] == expected


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("filler", [0, 30])
def test_empty_rule_key_matches_everything(spark, limit, filler):
    rules = [("zz", "first"), *[(f"q{n}", "no") for n in range(filler)], ("", "any"), ("a", "late")]
    table = spark.createDataFrame(
        [(n, k, r) for n, (k, r) in enumerate(rules)], "rule_order long, key string, response string"
    )
    frame = prompts_of(spark, ["a", "zz", ""])
    rows = rule_predictions(frame, table, small_bytes=limit).orderBy("sample_idx").collect()
    assert [r.prediction for r in rows] == ["any", "first", "any"]


def test_rules_answer_each_row_of_equal_sample_keys(spark):
    schema = "model string, dataset string, sample_idx long, prompt string"
    rows = [("m1", "d", 0, "an apple"), ("m2", "d", 0, "a pear"), ("m2", "d", 0, None)]
    frame = spark.createDataFrame(rows, schema)
    for limit in (0, 1 << 20):
        answered = rule_predictions(frame, {"apple": "A", "pear": "B", "a": None}, "none", limit)
        assert sorted(r.prediction for r in answered.collect()) == ["A", "B", "none"]


def test_rules_of_all_key_lengths(spark):
    text = "0123456789abcdefghijklmnopqrstuvwxyz" * 40
    rng = random.Random(7)
    spans = [(rng.randrange(len(text)), size) for size in (1, 2, 3, 4, 7, 8, 9, 15, 16, 33, 900)]
    for start, size in spans:
        key = text[start : start + size]
        rules = {key + "!": "no", key: "yes"}
        frame = prompts_of(spark, [text[:start], text[start : start + size], "x" + text, key[:-1]])
        for limit in (0, 1 << 20):
            rows = rule_predictions(frame, rules, "none", limit).orderBy("sample_idx").collect()
            expected = [first_rule(r.prompt, rules.items(), "none") for r in rows]
            assert [r.prediction for r in rows] == expected


def test_no_rules(spark):
    assert rule_predictions(prompts_of(spark, ["a"]), {}, "none").first().prediction == "none"
    none = spark.createDataFrame([], "rule_order long, key string, response string")
    assert rule_predictions(prompts_of(spark, ["a"]), none, "none", -1).first().prediction == "none"


def test_many_rules_and_prompts_of_equal_text(spark):
    rng = random.Random(5)
    keys = [f"[{n % 500} {'é' * (n % 3)} of {n}]" for n in range(3000)] + ["e", "of 1", None]
    rules = list(enumerate(rng.sample(keys, len(keys))))
    table = spark.createDataFrame([(n, k, f"r{n}") for n, k in rules], "rule_order long, key string, response string")
    texts = [" ".join(str(rng.choice(keys)) for _ in range(rng.randrange(4))) + "x" for _ in range(300)]
    texts += ["the same for all"] * 200 + [None, "", "e"]
    frame = prompts_of(spark, texts).selectExpr("*", "1 AS key", "2 AS rule_order", "3 AS response", "4 AS asked")
    known = [(k, f"r{n}") for n, k in rules if k is not None]
    expected = [first_rule(t or "", known, "none") if t is not None else "none" for t in texts]
    for limit in (0, 1 << 20):
        rows = rule_predictions(frame, table, "none", limit).orderBy("sample_idx").collect()
        assert [r.prediction for r in rows] == expected


class Answer:
    def __init__(self, body, status=200):
        self.body, self.status = body, status

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return json.dumps(self.body).encode()


def test_endpoint_without_a_network(monkeypatch):
    from scoreframe import chat_completion

    sent = []

    def opened(body, status=200):
        def urlopen(request, timeout):
            sent.append((request.full_url, json.loads(request.data), timeout))
            return Answer(body, status)

        monkeypatch.setattr("urllib.request.urlopen", urlopen)

    ask = chat_completion("http://x/chat", "m", temperature=0.1, timeout=5, seed=1)
    opened({"choices": [{"message": {"content": "はい"}}]})
    assert ask("元気?") == "はい"
    url, body, timeout = sent[0]
    assert (url, timeout) == ("http://x/chat", 5)
    assert body["messages"] == [{"role": "user", "content": "元気?"}]
    assert (body["temperature"], body["max_tokens"], body["seed"]) == (0.1, 500, 1)
    opened({"choices": [{}]})
    assert ask("p") == ""
    for wrong, status in (({"choices": []}, 200), ({}, 200), ({"choices": [{}]}, 503)):
        opened(wrong, status)
        with pytest.raises((ValueError, ConnectionError)):
            ask("p")
