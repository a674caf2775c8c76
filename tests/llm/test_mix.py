"""Mixing against targets reshared round by round, naive quotients and blocks one by one."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scoreframe.llm.mix import apportioned, mix_sources

BLOCK = 16


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(3, 1, 2), share=1.5):
    """Shares by weight; what is over twice a source's size is shared anew until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = share * sum(sizes.values()) - sum(fixed.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def by_force(rows, rows_per_shard):
    """(id, size, source size, target, taken) of all rows, block by block."""
    sizes, lots = defaultdict(int), defaultdict(list)
    for i, text, source in rows:
        sizes[source] += count(text)
        name = f"mix:{'' if i is None else i}:{text or ''}"
        lots[source].append((number(name), i is not None, i or 0, count(text)))
    goals = targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    seats = int(1.5 * sum(sizes.values()) / BLOCK + 0.5)
    quotas = dict(zip(order, sainte_lague([goals[s] for s in order], seats)))
    found = []
    for source in order:
        shards = -(-len(lots[source]) // rows_per_shard)
        dealt = defaultdict(list)
        for row in sorted(lots[source]):
            dealt[row[0] % shards].append(row)
        numbers = sorted(dealt)
        won = sainte_lague([sum(r[3] for r in dealt[n]) for n in numbers], quotas[source])
        key = "1" if source is None else "0" + source
        for shard, quota in zip(numbers, won):
            words = [row for row in dealt[shard] for _ in range(row[3])]
            blocks = max(1, -(-len(words) // BLOCK))
            quota = min(quota, 2 * -(-len(words) // BLOCK))
            start = number(f"mix:{key}:{shard}") % blocks
            more = quota % blocks
            times = [
                quota // blocks + ((b + 1) * more + start) // blocks - (b * more + start) // blocks
                for b in range(blocks)
            ]
            assert sum(times) == quota and max(times) <= 2
            at = 0
            for _, has_id, i, size in dealt[shard]:
                taken = sum(times[place // BLOCK] for place in range(at, at + size))
                found.append((i if has_id else None, size, sizes[source], goals[source], taken))
                at += size
    return found


def check(found, expected):
    assert len(found) == len(expected)

    def order(row):
        return repr((row[0], row[1], row[2], row[4]))

    for got, wanted in zip(sorted(found, key=order), sorted(expected, key=order)):
        assert got[:3] == wanted[:3] and got[4] == wanted[4]
        assert got[3] == pytest.approx(wanted[3], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("rows_per_shard", [8_192, 3])
def test_test_data(spark, folder, rows_per_shard):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    found = [tuple(r) for r in mix_sources(documents, rows_per_shard=rows_per_shard).collect()]
    check(found, by_force(rows, rows_per_shard))
    # Taken words come near the targets; the last block of each shard may be short.
    source = {i: s for i, _, s in rows}
    taken, goal = defaultdict(int), {}
    for i, size, _, target, took in found:
        assert took <= 2 * size
        taken[source[i]] += took
        goal[source[i]] = target
    for s, words in taken.items():
        shards = -(-sum(x == s for x in source.values()) // rows_per_shard)
        assert abs(words - goal[s]) <= BLOCK * (1 + 2 * shards)


def test_skewed_and_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    rows += [(100 + i, f"word {i} " * (i % 7), "hot") for i in range(400)]
    rows += [(1000 + i, "tiny", f"small {i}") for i in range(30)] + [(2000, "", "empty"), (2001, None, "none")]
    rows += [(3000, "x " * 50, ""), (3001, "é" * 10, "Z"), (3002, "é " * 10, "a"), (3003, "😀 " * 9, "é")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    documents = documents.selectExpr("*", "1 AS key", "2 AS size", "3 AS shard", "4 AS quota", "5 AS n")
    for rows_per_shard in (8_192, 20):
        found = [tuple(r) for r in mix_sources(documents, rows_per_shard=rows_per_shard).collect()]
        check(found, by_force(rows, rows_per_shard))
    assert mix_sources(nothing).count() == 0
    empty = mix_sources(documents.filter("doc_id = 2000 or doc_id = 2001")).collect()
    assert sorted(tuple(r)[1:] for r in empty) == [(0, 0, 0.0, 0)] * 2


def test_seats_go_to_the_highest_quotients(spark):
    votes = [1000.0, 0.0, 330.0, 330.0, 5.0, 1.0, 1.0, 70.0]
    frame = spark.createDataFrame(list(enumerate(votes)), "place long, votes double")
    for seats in (0, 1, 3, 8, 100, 1737):
        rows = apportioned(frame, "votes", seats, sum(votes), len(votes)).collect()
        assert [r.quota for r in sorted(rows)] == sainte_lague(votes, seats)


def test_no_python_on_the_main_path(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    plan = mix_sources(documents)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert mix_sources(documents).agg(F.sum("taken")).first() == mix_sources(documents).agg(F.sum("taken")).first()
