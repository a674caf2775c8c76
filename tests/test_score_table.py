"""The stored score table against the same operations on a plain one."""

import pytest
from pyspark.sql import functions as F

from scoreframe import ScoreTable, lookup, merge_scores, retract
from test_merge import CHANGE, STATE


def keyed(rows, kind, spark):
    return spark.createDataFrame(rows, kind)


def state_rows(count):
    return [("m", f"d{n % 3}", n, "x", float(n), 1, 1, False, n % 10 != 9) for n in range(count)]


def collected(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def table(spark, tmp_path):
    made = ScoreTable(spark, str(tmp_path / "scores"), STATE, buckets=8)
    made.write(keyed(state_rows(400), STATE, spark))
    return made


def files(tmp_path):
    return {p.parent.name: p.name for p in (tmp_path / "scores").glob("buckets=8/bucket=*/*.parquet")}


def test_a_merge_rewrites_only_the_partitions_it_touches(spark, tmp_path, table):
    state = keyed(state_rows(400), STATE, spark)
    assert collected(table.rows()) == collected(state)
    before = files(tmp_path)
    assert len(before) == 8
    log = [("m", "d0", 3, "x", 7.0, 5, 1, True), ("m", "d0", 3, "x", 8.0, 5, 2, False), ("new", "d", 1, "y", 1.0, 6, 3, False)]
    changes = keyed(log, CHANGE, spark)
    touched = table.merge(changes)
    assert 1 <= len(touched) <= 2
    after = files(tmp_path)
    assert {name for name in before if before[name] != after[name]} == {f"bucket={b}" for b in touched}
    expected = merge_scores(state, changes)
    assert collected(table.rows()) == collected(expected)
    table.merge(changes)  # once more changes nothing
    assert collected(table.rows()) == collected(expected)
    keys = changes.filter("model = 'm'")
    assert len(table.retract(keys)) == 1
    assert collected(table.rows()) == collected(retract(expected, keys))
    before = files(tmp_path)
    assert table.merge(changes.limit(0)) == [] and files(tmp_path) == before


def test_an_empty_table_and_odd_keys(spark, tmp_path):
    table = ScoreTable(spark, str(tmp_path / "scores"), STATE, buckets=8)
    table.write(keyed([], STATE, spark))
    assert collected(table.rows()) == []
    assert table.lookup({"model": "m", "dataset": "d", "sample_idx": 1, "metric": "x"}).isEmpty()
    changes = keyed([("", "日本", -1, "x'y", 1.0, 1, 1, False)], CHANGE, spark)
    assert len(table.merge(changes, small_bytes=0)) == 1
    assert table.lookup({"model": "", "dataset": "日本", "sample_idx": -1, "metric": "x'y"}).first().score == 1.0


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    # Many row groups in one file: the filter on the hash excludes all but one of them.
    spark.conf.set("parquet.block.size", "20000")
    try:
        table = ScoreTable(spark, str(tmp_path / "scores"), STATE, buckets=1)
        table.write(keyed(state_rows(30_000), STATE, spark).repartition(1))
    finally:
        spark.conf.unset("parquet.block.size")
    for number in (17, 29_999, 77):
        key = {"model": "m", "dataset": f"d{number % 3}", "sample_idx": number, "metric": "x"}
        found = table.lookup(key)
        assert collected(found) == collected(lookup(table.rows(), key))
        plan = found._jdf.queryExecution().executedPlan()
        assert "PartitionFilters: [isnotnull(buckets" in plan.toString()
        leaf = plan.collectLeaves().head()
        assert "key_hash" in leaf.dataFilters().mkString() and "xxhash64" not in leaf.dataFilters().mkString()
        assert leaf.metrics().get("numOutputRows").get().value() < 30_000 / 4
    missing = {"model": "m", "dataset": "d0", "sample_idx": 10**9, "metric": "x"}
    found = table.lookup(missing)
    assert found.collect() == []
    assert table.rows().agg(F.count("*")).first()[0] == 30_000
