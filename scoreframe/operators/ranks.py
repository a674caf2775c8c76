"""Ranks and running totals over a whole table, without a task that sees all of its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.session import store


def running_totals(
    frame: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """Add a column for each of `totals`: its sum over all rows up to this one, in `order`.

    With `F.lit(1)` it is the place of the row, from 1. Rows are dealt out by ranges of
    `order` and stored with the number of their range. Sums within a range are a window of
    that range; what lies before it is a running sum over one row per range, which is sent
    to all tasks. Rows that `order` does not tell apart share a range, in any order.
    """
    own = {name: f"__own_{name}" for name in totals}
    valued = frame.withColumns({own[name]: column for name, column in totals.items()})
    dealt = valued.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    dealt = store(dealt, "ranges")

    ranges = dealt.groupBy("__range").agg(*[F.sum(c).alias(c) for c in own.values()])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"__before_{n}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in own.items()}
    ranges = ranges.select("__range", *[column.alias(n) for n, column in before.items()])

    here = Window.partitionBy("__range").orderBy(*order)
    here = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.select(
        *frame.columns, "__range", *[F.sum(c).over(here).alias(c) for c in own.values()]
    ).join(F.broadcast(ranges), "__range")
    return summed.select(
        *frame.columns, *[(F.col(c) + F.col(f"__before_{n}")).alias(n) for n, c in own.items()]
    )
