"""Mixing sources to target weights: how many words of each document a mix takes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.operators.ranks import running_totals
from scoreframe.session import store

WORD = r"[^\x20\x09-\x0D]+"


def mix_sources(
    documents: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
    block: int = 16,
    rows_per_shard: int = 8_192,
    seed: str = "mix",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: words, and words the mix takes.

    Sources, by code point and null last, have the `weights` in turn and share `percent` of
    all words; no source gets more than `most` times its own words, and what it cannot take
    goes to the others by their weights (`source_targets`).

    A source's rows are dealt into shards of about `rows_per_shard` by a seeded digest of id
    and text and lie there end to end in the order of that digest, cut into blocks of
    `block` words; a shard's last block may be shorter. The blocks of the whole mix are
    apportioned to sources by their targets, and a source's blocks to its shards by their
    words, both by highest quotients (`apportioned`). A shard of n blocks with a quota of q
    takes every block q // n times, and q % n of them once more: those which the n-th parts
    of that number, from a seeded start, fall into. As this is a formula of a block's
    place, no block becomes a row, and a document's `taken` is the difference between what
    is taken up to its end and up to its beginning: never over `most` times its size, and
    the same in every run.

    Null and empty texts have size 0 and take nothing; a null source is a source of its
    own, apart from the empty one. Rows of equal id and text lie side by side. No documents,
    no rows. Everything is DataFrame work; a single task sees a shard's rows, or the rows of
    a source's shards, never those of a source.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    rows = documents.select(
        "doc_id",
        _source_key(F.col("source")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        _number(F.md5(name)).alias("order"),
    )
    rows = store(rows, "mix-rows")
    sources = rows.groupBy("key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sources = source_targets(store(sources, "mix-sources"), weights, percent, most)

    words, count = sources.agg(F.sum("words"), F.count(F.lit(1))).first()
    total = min(percent, 100 * most) * (words or 0) / 100
    blocks = math.floor(total / block + 0.5)
    sources = apportioned(sources, "target", blocks, total, count)
    shards = F.ceil(F.col("n") / rows_per_shard).alias("shards")
    sources = store(
        sources.select("key", F.col("words").alias("source_size"), "target", "quota", shards), "mix-quotas"
    )

    # Sources are few rows beside their documents; a hot one is split by the join if it is large.
    rows = rows.join(sources.drop("quota"), "key")
    rows = rows.withColumn("shard", F.pmod("order", "shards"))
    cells = rows.groupBy("key", "shard").agg(F.sum("size").alias("words"))
    cells = shard_quotas(cells, sources.select("key", "source_size", "quota"))
    cells = cells.withColumn("blocks", _whole(F.col("words") + (block - 1), F.lit(block)))
    start = _number(F.md5(F.concat_ws(":", F.lit(seed), "key", F.col("shard").cast("string"))))
    cells = cells.select(
        "key",
        "shard",
        F.greatest("blocks", F.lit(1)).alias("blocks"),
        F.least("quota", most * F.col("blocks")).alias("quota"),
        F.pmod(start, F.greatest("blocks", F.lit(1))).alias("start"),
    )
    met = rows.join(cells, ["key", "shard"])
    along = Window.partitionBy("key", "shard").orderBy("order", "doc_id", "size")
    along = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("end", F.sum("size").over(along))
    upto = _taken_up_to(F.col("end"), block) - _taken_up_to(F.col("end") - F.col("size"), block)
    taken = F.when(F.col("size") > 0, upto).otherwise(0).cast("long").alias("taken")
    return met.select("doc_id", "size", "source_size", "target", taken)


def source_targets(
    sources: DataFrame, weights: Sequence[float], percent: int, most: int
) -> DataFrame:
    """Add `place` (by key) and `target` to `sources` (key, words, and others).

    Targets are `most * words` or, below that, the weight times one level for all. Sources
    reach their bound in the order of bound per weight, so with running totals of bounds and
    weights in that order each row knows the level if it were the first without a bound; the
    first that stays below its own is right.
    """
    placed = running_totals(sources, [F.col("key")], {"place": F.lit(1)})
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = placed.withColumn(
        "weight", F.element_at(turn, ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("bound", most * F.col("words"))
    whole = placed.agg(F.sum("words"), F.sum("weight")).first()
    wanted, weight = percent * (whole[0] or 0) / 100, whole[1] or 0.0
    order = [F.col("bound") / F.col("weight"), F.col("place")]
    summed = running_totals(placed, order, {"bounds": F.col("bound"), "passed": F.col("weight")})
    # The same sums without the row itself.
    before, passed = F.col("bounds") - F.col("bound"), F.col("passed") - F.col("weight")
    summed = summed.withColumn("level", (F.lit(wanted) - before) / (F.lit(weight) - passed))
    summed = store(summed, "mix-levels")
    free = F.col("bound") > F.col("weight") * F.col("level")
    level = summed.filter(free).agg(F.min_by("level", F.struct(*order))).first()[0]
    bound = F.col("bound").cast("double")
    target = bound if level is None else F.least(bound, F.col("weight") * F.lit(level))
    return summed.select(*sources.columns, "place", target.alias("target"))


def apportioned(
    parties: DataFrame, votes: str, seats: int, total: float, count: int
) -> DataFrame:
    """Add `quota`: `seats` apportioned to all rows of `parties` by Sainte-Laguë.

    `total` is the sum of the column `votes`, `count` the number of rows; ties go to the
    smaller `place`. The highest of all quotients votes / (2 k + 1) win a seat. Those that
    win anyway, whatever the rest, are counted by rounding, and only the few of every row
    that may or may not win are ranked.
    """
    spared = _rounded(F.col(votes), seats - count / 2, total, -1)
    limit = _rounded(F.col(votes), seats + count / 2, total, 1)
    sure = store(parties.withColumn("__sure", spared).withColumn("__most", limit), "seats")
    left = seats - (sure.agg(F.sum("__sure")).first()[0] or 0)
    open_ = sure.filter("__most > __sure").select(
        "place", votes, F.explode(F.sequence(F.col("__sure"), F.col("__most") - 1)).alias("k")
    )
    open_ = open_.withColumn("quotient", F.col(votes) / (2 * F.col("k") + 1))
    order = [F.col("quotient").desc(), F.col("place"), F.col("k")]
    ranked = running_totals(open_, order, {"rank": F.lit(1)}).filter(F.col("rank") <= left)
    won = ranked.groupBy("place").agg(F.count(F.lit(1)).alias("__won"))
    found = sure.join(won, "place", "left")
    quota = F.col("__sure") + F.coalesce("__won", F.lit(0))
    return found.select(*parties.columns, quota.alias("quota"))


def shard_quotas(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, shard, words, quota): each source's blocks apportioned to its shards by their words.

    `cells` has key, shard, words, `sources` has key, source_size, quota. The same as
    `apportioned` within every source, whose shards' open quotients meet in one task.
    """
    own = Window.partitionBy("key")
    met = cells.join(sources, "key").withColumn("count", F.count(F.lit(1)).over(own))
    seats, total, half = F.col("quota"), F.col("source_size"), F.col("count") / 2
    met = met.withColumn("sure", _rounded(F.col("words"), seats - half, total, -1))
    met = met.withColumn("most", _rounded(F.col("words"), seats + half, total, 1))
    met = met.withColumn("left", F.col("quota") - F.sum("sure").over(own))
    # One more entry stands for the sure seats, and comes before all quotients.
    entries = F.sequence(F.col("sure") - 1, F.greatest(F.col("most"), F.col("sure")) - 1)
    open_ = met.select("key", "shard", "words", "sure", "left", F.explode(entries).alias("k"))
    open_ = open_.withColumn("is_open", (F.col("k") >= F.col("sure")).cast("int"))
    quotient = F.col("words") / (2 * F.col("k") + 1)
    best = Window.partitionBy("key").orderBy("is_open", quotient.desc(), "shard", "k")
    best = best.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = open_.withColumn("rank", F.sum("is_open").over(best))
    wins = ((F.col("is_open") == 1) & (F.col("rank") <= F.col("left"))).cast("int")
    return open_.groupBy("key", "shard").agg(
        F.first("words").alias("words"), (F.first("sure") + F.sum(wins)).alias("quota")
    )


def _rounded(votes: Column, seats, total, spare: int) -> Column:
    """The seats for `votes` by rounding at `seats` for the `total`; `spare` is for the rounding."""
    seats = seats if isinstance(seats, Column) else F.lit(float(seats))
    total = total if isinstance(total, Column) else F.lit(total)
    share = F.floor(F.try_divide(votes * seats, total) + 0.5) + spare
    return F.when((seats > 0) & (total > 0), F.greatest(share, F.lit(0))).otherwise(0).cast("long")


def _whole(value: Column, by: Column) -> Column:
    return F.call_function("div", value, by)


def _taken_up_to(place: Column, block: int) -> Column:
    """Words taken of a shard's first `place` words, from its blocks, quota and start."""
    blocks, quota = F.col("blocks"), F.col("quota")
    more = quota % blocks

    def chosen(count: Column) -> Column:
        """How many of the first `count` blocks are among those taken once more."""
        return _whole(count * more + F.col("start"), blocks)

    whole, rest = _whole(place, F.lit(block)), place % block
    last = chosen(whole + 1) - chosen(whole)
    return _whole(quota, blocks) * place + chosen(whole) * block + rest * last


def _source_key(source: Column) -> Column:
    """The source as text that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _number(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
