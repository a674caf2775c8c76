"""How filters interact: what each removes in every order they can be applied in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm.common import SPACE, known
from scoreframe.session import store

SALTS = 32


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of one text, as columns without nulls.

    A: under 200 words; B: under half of the words are distinct; C: over two in a hundred
    code points are A-Z; D: any of `#$%&*|`. An empty text fails A alone.
    """
    found = F.filter(F.split(text, SPACE), lambda word: word != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def removal_intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first, end): from rank `first` up to `end`, `step` removes what fails `mask`.

    Ranks are those of the orders of the filters, lexicographic (Lehmer codes): orders that
    begin alike are neighbours. A mask goes at the first filter it fails, so each beginning
    of filters it passes, and one it fails, is an interval of ranks; intervals that touch
    are one.
    """
    found: list[tuple[int, int, int, int]] = []
    for mask in range(1, 1 << filters):
        passed = [f for f in range(filters) if not mask >> f & 1]
        for step in range(1, len(passed) + 2):
            width = factorial(filters - step)
            spans: list[list[int]] = []
            for start in permutations(passed, step - 1):
                for last in (f for f in range(filters) if mask >> f & 1):
                    first = _rank((*start, last), filters)
                    if spans and spans[-1][1] == first:
                        spans[-1][1] += width
                    else:
                        spans.append([first, first + width])
            found += [(mask, step, first, end) for first, end in spans]
    return found


def _rank(start: Sequence[int], filters: int) -> int:
    """The first rank of the orders that begin with `start`."""
    left, rank = list(range(filters)), 0
    for item in start:
        place = left.index(item)
        rank += place * factorial(len(left) - 1)
        left.pop(place)
    return rank


def failure_masks(documents: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """(doc_id, part, mask) of every row: bit i for the i-th filter, the last for a copy.

    A text is a copy if a smaller doc_id holds the very same one; a null id is larger than
    all others. Texts are compared by their SHA-256, of which only those that occur more
    than once are joined, dealt out by id too, so that many copies of one text spread.
    """
    bits = [F.when(failed, F.lit(1 << i)).otherwise(0) for i, failed in enumerate(filters.values())]
    text = F.coalesce("text", F.lit(""))
    facts = documents.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        sum(bits, F.lit(0)).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    facts = store(facts, "filter-facts")
    copies = facts.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(known("doc_id")).alias("first")
    )
    copies = copies.filter("copies > 1").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    facts = facts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = facts.join(copies.drop("copies"), ["digest", "salt"], "left")
    copy = F.when(known("doc_id") > F.col("first"), F.lit(1 << len(bits))).otherwise(0)
    return joined.select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def audit_filters(
    documents: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column] | None = None,
    copies: str = "E",
) -> DataFrame:
    """What every filter removes in every order, one row per part, order and step.

    `filters` maps letters to failure conditions over `documents`, by default those of
    `text_filters`; `copies` names the filter of equal texts, which comes last in the
    alphabet. A part is a value of `source`. Columns: part, filter_order, step (1 on), and
    the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Documents meet in counts of part and failure mask at once, combined on the map side.
    Each mask's counts are added where its intervals of ranks begin and taken off where
    they end; running sums over the ranks then give every order. So nothing but counts is
    multiplied by the orders: 32 masks become at most a few hundred differences a part.

    Null texts are empty, null sources the empty string. Rows count as often as they
    occur. A document has quality or toxic 1 if any of its label rows says so; labels of a
    null id, or of no document, count nowhere. Without documents there are no rows.
    """
    if filters is None:
        filters = text_filters(F.coalesce("text", F.lit("")))
    letters = [*filters, copies]
    if letters != sorted(set(letters)):
        raise ValueError(f"filters must be in order and differ: {letters}")
    masks = store(failure_masks(documents, filters), "filter-masks")
    cells = store(_cells(masks, labels), "filter-cells")
    orders = ["".join(order) for order in permutations(letters)]
    steps = _removals(cells, len(letters), len(orders))

    names = F.array(*[F.lit(order) for order in orders])
    steps = steps.withColumn("filter_order", F.element_at(names, F.col("rank") + 1))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    place = Window.partitionBy("part", "rank").orderBy("step")
    place = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = steps.select(
        "*",
        F.sum("removed").over(place).alias("gone"),
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
    bit = {letter: F.col("mask").bitwiseAND(1 << i) for i, letter in enumerate(letters)}
    totals = cells.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(b != 0, F.col("n")).otherwise(0)).alias(f"fails_{x}") for x, b in bit.items()],
        *[
            F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only_{x}")
            for i, x in enumerate(letters)
        ],
    )

    def own(kind: str) -> Column:
        return F.coalesce(*[F.when(F.col("filter") == x, F.col(f"{kind}_{x}")) for x in letters])

    return summed.join(totals, "part").select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("gone")).alias("kept"),
        "removed",
        (own("fails") - F.col("removed")).alias("redundant"),
        own("only").alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        "shapley",
    )


def _cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those among them with either label."""
    counted = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
    marked = marked.agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    held = masks.join(marked, "doc_id").groupBy("part", "mask")
    held = held.agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    none = F.lit(0).cast("long")
    both = counted.select("*", none.alias("good"), none.alias("toxic")).unionByName(
        held.select("part", "mask", none.alias("n"), "good", "toxic")
    )
    return both.groupBy("part", "mask").agg(
        *[F.coalesce(F.sum(c), none).alias(c) for c in ("n", "good", "toxic")]
    )


def _removals(cells: DataFrame, filters: int, orders: int) -> DataFrame:
    """(part, rank, step, removed, good_lost, toxic_lost) for every rank and step."""
    spark = cells.sparkSession
    intervals = spark.createDataFrame(
        removal_intervals(filters), "mask int, step int, first int, end int"
    )
    counts = {"n": "removed", "good": "good_lost", "toxic": "toxic_lost"}
    met = cells.join(F.broadcast(intervals), "mask")
    begins = met.select("part", "step", F.col("first").alias("rank"), *counts)
    ends = met.select("part", "step", F.col("end").alias("rank"), *[(-F.col(c)).alias(c) for c in counts])
    # Zeros for every rank and step, so that running sums have a row each.
    ranks = F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank")
    steps = F.explode(F.sequence(F.lit(1), F.lit(filters))).alias("step")
    zeros = cells.select("part").distinct().select("part", ranks).select("part", "rank", steps)
    zeros = zeros.select("part", "step", "rank", *[F.lit(0).cast("long").alias(c) for c in counts])
    differences = begins.unionByName(ends).unionByName(zeros).groupBy("part", "step", "rank")
    differences = differences.agg(*[F.sum(c).alias(c) for c in counts]).filter(F.col("rank") < orders)
    along = Window.partitionBy("part", "step").orderBy("rank")
    along = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return differences.select(
        "part", "rank", "step", *[F.sum(c).over(along).alias(name) for c, name in counts.items()]
    )
