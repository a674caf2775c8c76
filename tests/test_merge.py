"""Score tables against a log replayed one write at a time."""

import random

import pytest

from scoreframe import active, lookup, merge_scores, retract

STATE = (
    "model string, dataset string, sample_idx long, metric string, score double, "
    "created_at long, updated_at long, is_builtin boolean, is_active boolean"
)
CHANGE = (
    "model string, dataset string, sample_idx long, metric string, score double, "
    "updated_at long, seq long, is_builtin boolean"
)


def replay(state, changes):
    state = {key: dict(row) for key, row in state.items()}
    for change in sorted(changes, key=lambda c: (c[5], c[6])):
        key, (score, when, _, builtin) = tuple(change[:4]), change[4:]
        row = state.setdefault(
            key, {"created": when, "builtin": False, "active": True}
        )
        row.update(score=score, updated=when)
        row["builtin"] = row["builtin"] or builtin
    return state


def rows_of(frame):
    return {
        (r.model, r.dataset, r.sample_idx, r.metric): {
            "score": r.score,
            "created": r.created_at,
            "updated": r.updated_at,
            "builtin": r.is_builtin,
            "active": r.is_active,
        }
        for r in frame.collect()
    }


def log(rng, count, start):
    keys = [("m", "d", n, metric) for n in range(10) for metric in ("x", "y")]
    return [
        (*rng.choice(keys), float(rng.randrange(100)), start + rng.randrange(20), n, rng.random() < 0.2)
        for n in range(count)
    ]


def frame_of(spark, state):
    rows = [
        (*key, r["score"], r["created"], r["updated"], r["builtin"], r["active"])
        for key, r in state.items()
    ]
    return spark.createDataFrame(rows, STATE)


@pytest.mark.parametrize("few", [0, 1000])
def test_replayed_log(spark, few):
    rng = random.Random(5)
    state, table = {}, spark.createDataFrame([], STATE)
    for step in range(3):
        changes = log(rng, 25, 100 * step)
        state = replay(state, changes)
        table = merge_scores(table, spark.createDataFrame(changes, CHANGE), few)
        assert rows_of(table) == state
        gone = [key for key in state if rng.random() < 0.3] + [("m", "d", 999, "x")]
        keys = spark.createDataFrame(
            [*gone, *gone], "model string, dataset string, sample_idx long, metric string"
        )
        for key in gone[:-1]:
            state[key]["active"] = False
        table = frame_of(spark, rows_of(retract(table, keys)))
        assert rows_of(table) == state

    def chosen(**how):
        return set(rows_of(active(table, **how)))

    assert chosen() == {k for k, r in state.items() if r["active"]}
    assert chosen(include_inactive=True) == set(state)
    builtin = {k for k, r in state.items() if r["active"] and r["builtin"]}
    assert chosen(builtin_only=True) == builtin
    assert chosen(builtin_only=True, custom_only=True) == builtin
    assert chosen(custom_only=True) == chosen() - builtin
    names = ("model", "dataset", "sample_idx", "metric")
    for key, row in list(state.items())[:4]:
        found = rows_of(lookup(table, dict(zip(names, key))))
        assert found == ({key: row} if row["active"] else {})


def test_a_write_does_not_revive(spark):
    state = {("m", "d", 1, "x"): dict(score=1.0, created=1, updated=1, builtin=True, active=False)}
    change = [("m", "d", 1, "x", 2.0, 5, 1, False)]
    merged = rows_of(merge_scores(frame_of(spark, state), spark.createDataFrame(change, CHANGE)))
    assert merged == {
        ("m", "d", 1, "x"): dict(score=2.0, created=1, updated=5, builtin=True, active=False)
    }
