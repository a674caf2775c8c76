"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
import brute

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def ordered(columns, rows):
    places = [columns.index(c) for c in sorted(columns)]
    picked = (tuple(row[p] for p in places) for row in rows)
    return sorted(picked, key=lambda row: [(value is None, str(value)) for value in row])


def same(left, right):
    if isinstance(left, float) and isinstance(right, float):
        return math.isclose(left, right, abs_tol=1e-6)
    return left == right


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_query_equals_sql(spark, folder, database, name):
    frame = entry.queries()[name](spark, folder)
    got = ordered(frame.columns, frame.collect())
    relation = database.sql(entry.oracle_sql()[name])
    want = ordered(relation.columns, relation.fetchall())
    assert sorted(frame.columns) == sorted(relation.columns)
    assert len(got) == len(want)
    assert got or name.startswith("lookup")
    assert all(same(a, b) for g, w in zip(got, want) for a, b in zip(g, w))


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_give_rows(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0


def test_long_texts_against_the_formulas(spark, folder):
    from workloads.tables import conversation_pairs

    texts = {r.sample_idx: r for r in conversation_pairs(spark, folder).collect()}
    scored = entry.queries()["character_metrics"](spark, folder).collect()
    assert len(scored) == len(texts)
    for row in scored:
        pair = texts[row.sample_idx]
        for name in ("char_f1", "fuzzy_match"):
            expected = getattr(brute, name)(pair.prediction, pair.reference)
            assert row[name] == pytest.approx(expected, abs=1e-6), (name, row.sample_idx)


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "exact_match_std" in frame.columns
