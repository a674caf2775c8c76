"""Rules too many to send: what leaves the tasks that hold the prompts."""

import numpy as np
import pyarrow as pa

from scoreframe.operators import anchors


def test_spans_stay_few_where_keys_are_too_many_for_the_filter(spark, monkeypatch):
    monkeypatch.setattr(anchors, "MOST_BITS", 1 << 20, raising=False)
    monkeypatch.setattr(anchors, "MOST_CHUNKS", 1, raising=False)
    keys = spark.range(200_000).selectExpr("concat('[order ', id + 1000000, ' of the open list]') AS key")
    search = anchors.key_filter(keys)
    numbers = np.random.default_rng(1).integers(1_000_000, 1_400_000, 2000)
    texts = pa.array([f"Where is [order {n} of the open list], the green one?" for n in numbers])
    found = set()
    for row, data, offsets in anchors._laid_out(texts):
        texts_of, starts, lengths = search.spans(data, offsets)
        content = data.tobytes()
        for text, start, length in zip(texts_of, starts, lengths):
            place = start - offsets[text]
            found.add((row + int(text), content[offsets[text] :][place : place + length].decode()))
    held = {(i, f"[order {n} of the open list]") for i, n in enumerate(numbers) if n < 1_200_000}
    assert held <= found
    assert len(found) < 1.2 * len(held)


def test_spans_are_not_sent_whole_to_every_task(spark):
    """Spark takes what tasks emit for no more than what they read."""
    prompts = spark.sql("SELECT id AS sample_idx, repeat('ab ', 40) || id AS prompt FROM range(50)")
    rules = spark.sql("SELECT id AS rule_order, 'b ' || id AS key, 'r' || id AS response FROM range(30)")
    answered = anchors.joined_rules(prompts, rules, "none")
    rows = answered.orderBy("sample_idx").collect()
    expected = [next((f"r{k}" for k in range(30) if f"b {k}" in f"ab {n}"), "none") for n in range(50)]
    assert [r.prediction for r in rows] == expected
    plan = answered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
