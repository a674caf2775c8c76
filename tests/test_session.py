"""Shared storage and shipping."""

from types import SimpleNamespace

import pytest

from scoreframe import session as session_module
from scoreframe import shared_path, store


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used_everywhere():
    for master in ("local[2]", "spark://host:7077"):
        path = shared_path(session(master, "hdfs://shared/"), "t")
        assert path.startswith("hdfs://shared/scoreframe/t-")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(session("spark://host:7077"), "t")
    assert shared_path(session("local[2]"), "t") != shared_path(session("local[2]"), "t")


def test_stored_tables_can_be_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session_module, "shared_path", lambda *_: f"{tmp_path}/scoreframe/t")
    stored, path = session_module.store_sized(spark.range(100).toDF("id"), "t")
    assert stored.count() == 100 and session_module.stored_bytes(spark, path) > 100
    fake = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: str(tmp_path)), _jvm=spark._jvm, _jsc=spark._jsc
    )
    session_module.remove_stored(fake)
    assert not (tmp_path / "scoreframe").exists()


def test_stored_tables_end_their_lineage(spark, capsys):
    frame = store(spark.range(10).selectExpr("id", "id % 3 AS k").groupBy("k").count(), "counts")
    assert {(r.k, r["count"]) for r in frame.collect()} == {(0, 4), (1, 3), (2, 3)}
    frame.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_a_bucketed_table_is_not_shuffled_again(spark):
    from scoreframe.session import store_bucketed

    frame = spark.range(2000).selectExpr("id % 1000 AS key", "id AS value")
    stored = store_bucketed(frame, "key", "bucketed")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.join(spark.range(500).withColumnRenamed("id", "key"), "key")
        assert joined.count() == 1000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key") <= 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(stored.collect()) == sorted(frame.collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stored_")]
