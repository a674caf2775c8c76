import random

from pyspark.sql import functions as F

from scoreframe.operators.ranks import running_totals


def test_running_totals(spark):
    chance = random.Random(1)
    rows = [(i, chance.randrange(100)) for i in range(5000)]
    frame = spark.createDataFrame(chance.sample(rows, len(rows)), "id long, value long").repartition(7)
    found = running_totals(
        frame, [F.col("value").desc(), F.col("id")], {"place": F.lit(1), "total": F.col("value")}
    )
    assert found.columns == ["id", "value", "place", "total"]
    total = 0
    ordered = sorted(found.collect(), key=lambda r: (-r.value, r.id))
    for place, row in enumerate(ordered, 1):
        total += row.value
        assert (row.place, row.total) == (place, total)


def test_running_totals_of_nothing_and_of_equal_rows(spark):
    frame = spark.createDataFrame([(None,)] * 10, "value long")
    found = running_totals(frame, [F.col("value").asc_nulls_last()], {"place": F.lit(1)})
    assert sorted(r.place for r in found.collect()) == list(range(1, 11))
    assert running_totals(frame.limit(0), [F.col("value")], {"place": F.lit(1)}).count() == 0
