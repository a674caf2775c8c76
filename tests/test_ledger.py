"""The ledger of attempts: resumed, retried, and apart for every answer function."""

import functools
import threading
from pathlib import Path

import pytest

from scoreframe import attempts, function_fingerprint, generate_to
from scoreframe.operators.fingerprint import mapping_fingerprint, table_fingerprint

HOW = {"retries": 1, "delay": 0.0}


def prompts_of(spark, texts):
    rows = [("d", n, text) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "dataset string, sample_idx long, prompt string")


def make(tag, down=None):
    """An answer function that fails for all of `down` while that file lists them."""

    def answer(prompt):
        if down is not None and prompt in Path(down).read_text().split():
            raise ConnectionError("down")
        return f"{tag} {prompt}"

    return answer


def answers(frame):
    return sorted((r.sample_idx, r.prediction, r.error, r.attempts) for r in frame.collect())


@pytest.mark.parametrize("rounds", [1, 3])
def test_finished_requests_are_not_asked_again(spark, tmp_path, rounds):
    path, asked = str(tmp_path / "ledger"), str(tmp_path / "asked")

    def answer(prompt):
        with open(asked, "a") as log:
            log.write(f"{prompt}\n")
        return prompt.upper()

    generate_to(spark, prompts_of(spark, ["a", "b"]), answer, "m", path, **HOW)
    found = generate_to(spark, prompts_of(spark, list("abcde")), answer, "m", path, rounds=rounds, **HOW)
    assert answers(found) == [(n, t, None, 1) for n, t in enumerate("ABCDE")]
    assert sorted(Path(asked).read_text().split()) == list("abcde")
    # Another prompt for a sample is another request, and the old one no answer to it.
    found = generate_to(spark, prompts_of(spark, ["a", "x"]), answer, "m", path, **HOW)
    assert answers(found) == [(0, "A", None, 1), (1, "X", None, 1)]
    assert sorted(Path(asked).read_text().split()) == list("abcdex")
    other = generate_to(spark, prompts_of(spark, ["a"]), answer, "n", path, **HOW)
    assert answers(other) == [(0, "A", None, 1)] and other.first().model == "n"


def test_failed_requests_are_asked_again(spark, tmp_path):
    path, down = str(tmp_path / "ledger"), tmp_path / "down"
    down.write_text("b c")
    prompts, answer = prompts_of(spark, ["a", "b", "c", None]), make("yes", str(down))
    first = [(0, "yes a", None, 1), (1, "", "ConnectionError: down", 2), (2, "", "ConnectionError: down", 2)]
    none = (3, "yes None", None, 1)
    assert answers(generate_to(spark, prompts, answer, "m", path, **HOW)) == [*first, none]
    down.write_text("c")
    second = [first[0], (1, "yes b", None, 3), (2, "", "ConnectionError: down", 4), none]
    assert answers(generate_to(spark, prompts, answer, "m", path, **HOW)) == second
    down.write_text("")
    third = [*second[:2], (2, "yes c", None, 5), none]
    assert answers(generate_to(spark, prompts, answer, "m", path, **HOW)) == third
    down.write_text("a b c")  # nothing is left to ask
    assert answers(generate_to(spark, prompts, answer, "m", path, **HOW)) == third
    held = attempts(spark, path, prompts, "m", function_fingerprint(answer))
    assert sorted((r.sample_idx, r.attempt, r.error is None) for r in held.collect()) == [
        (0, 1, True), (1, 1, False), (1, 2, True), (2, 1, False), (2, 2, False), (2, 3, True), (3, 1, True),
    ]


def test_other_functions_and_settings_start_anew(spark, tmp_path):
    path, prompts = str(tmp_path / "ledger"), prompts_of(spark, ["a"])
    for tag in ("one", "two", "one"):
        assert answers(generate_to(spark, prompts, make(tag), "m", path, **HOW)) == [(0, f"{tag} a", None, 1)]
    assert len(list((tmp_path / "ledger").glob("model=m/fingerprint=*"))) == 2
    named = generate_to(spark, prompts, make("three"), "m", path, fingerprint="own", **HOW)
    assert answers(named) == [(0, "three a", None, 1)]
    named = generate_to(spark, prompts, make("four"), "m", path, fingerprint="own", **HOW)
    assert answers(named) == [(0, "three a", None, 1)]
    empty = generate_to(spark, prompts.limit(0), make("one"), "m", str(tmp_path / "new"), **HOW)
    assert answers(empty) == []


def helper(prompt):
    return prompt


class Asker:
    def __init__(self, tag):
        self.tag = tag

    def __call__(self, prompt):
        return f"{self.tag} {prompt}"


def test_fingerprints_follow_code_and_settings(monkeypatch):
    assert function_fingerprint(make("a")) == function_fingerprint(make("a"))
    made = [
        make("a"), make("b"), make("a", "x"), make(("a",)), make(["a"]), make({"a": 1}), make({"a"}),
        lambda p: p, lambda p: p + "x", lambda p, q=1: p, lambda p, q=2: p, lambda p: helper(p),
        Asker("a"), Asker("b"), Asker("a").__call__, functools.partial(make, "a"), str.upper, make(Path("a")),
        make(Asker), make(None), make(1), make(1.0), make(True), make(helper),
    ]
    found = [function_fingerprint(f) for f in made]
    assert len(set(found)) == len(made)
    assert function_fingerprint(Asker("a")) == found[12]
    calls = lambda p: helper(p)
    before = function_fingerprint(calls)
    monkeypatch.setitem(globals(), "helper", lambda p: p + "!")
    assert function_fingerprint(calls) != before
    loop = []
    loop.append(loop)
    assert function_fingerprint(make(loop))
    with pytest.raises(ValueError, match="needs a name"):
        function_fingerprint(make(threading.Lock()))


def test_fingerprints_of_rules(spark):
    assert mapping_fingerprint({"a": "1", "b": "2"}) != mapping_fingerprint({"b": "2", "a": "1"})
    kind = "rule_order long, key string"
    one = spark.createDataFrame([(1, "a"), (2, None)], kind)
    turned = spark.createDataFrame([(2, None), (1, "a")], kind).select("key", "rule_order")
    assert table_fingerprint(one) == table_fingerprint(turned)
    for rows in ([(1, "a"), (2, "")], [(1, "a")], [(1, "a"), (2, None), (2, None)], []):
        assert table_fingerprint(spark.createDataFrame(rows, kind)) != table_fingerprint(one)
