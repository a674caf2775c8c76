"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import prefixes as P
from scoreframe.llm.bloom import chunks_for, repeat_filter, seen
from scoreframe.llm.common import blocks, give_back, packed, sum_blocks, tidy, unpacked
from scoreframe.llm.components import components
from scoreframe.llm.text import runs
from scoreframe.session import discard, ship, shuffles_removed, store, store_bucketed

BLOCK = 1 << 16
SMALL = 16  # rows in a list whose pairs are formed one by one in any case
PAIRS = 32  # pairs formed for each row of the input, which longer lists may use up
LEAST_PAIRS = 1 << 22  # formed at once, however few rows there are
HELD = 1 << 26  # tokens of whole sets held at once, or a third of all tokens if that is more
ROWS = 2048  # rows of a block where longer lists are compared block by block
TOKENS = 1 << 20  # tokens of their whole sets, which bound a block as well
PARTNERS = 64  # rows compared to the same row in one group
MOST_CHUNKS = 1024
SET = "s1 long, s2 long, n int"


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """Counts of all shingles of all texts, by the counter their hash falls into."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(P.COUNTERS, np.uint32)
        for batch in batches:
            for _, _, data, offsets in runs(batch.column("text")):
                found, _ = P.text_shingles(data, offsets, size)
                np.add.at(counts, (found >> np.uint64(42)).astype(np.int64), np.uint32(1))
        if counts.any():
            yield blocks("", counts, BLOCK)

    sent = texts.mapInArrow(tidy(counted), "key string, block int, data binary")
    counts = np.zeros(P.COUNTERS, np.uint32)
    for row in sum_blocks(sent, "uint32", P.COUNTERS // BLOCK).collect():
        counts[row.block * BLOCK : (row.block + 1) * BLOCK] = unpacked(row.data, "uint32")
    return counts


def prefix_table(rows: DataFrame, order, noise: float, percent: int, words: int) -> DataFrame:
    """(row, doc_id, s1, s2, n, need, prefix): every text's set by signature, and its prefix."""

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, tokens, begins in P.runs_of_sets(batch.column("text"), order.value, words):
                one, two = P.signatures(tokens, begins)
                need, parts = [], []
                for i in range(end - first):
                    own = tokens[begins[i] : begins[i + 1]]
                    need.append(P.matches_needed(own, percent, noise) if len(own) else 0)
                    size = P.prefix_length(len(own), need[-1], percent) if len(own) else 0
                    parts.append(own[:size])
                limits = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                flat = np.concatenate(parts).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": batch.column("row").slice(first, end - first),
                        "doc_id": batch.column("doc_id").slice(first, end - first),
                        "s1": pa.array(one.view(np.int64)),
                        "s2": pa.array(two.view(np.int64)),
                        "n": pa.array(np.diff(begins).astype(np.int32)),
                        "need": pa.array(need, pa.int32()),
                        "prefix": pa.ListArray.from_arrays(limits.astype(np.int32), flat),
                    }
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, {SET}, need int, prefix array<long>"
    return rows.mapInArrow(tidy(prepared), schema)


def shared_entries(table: DataFrame, single: DataFrame) -> DataFrame:
    """(token, row, n, need) of the prefixes of the rows in `single` whose token others have too.

    `rows` is how many have it and `leader` the first of them. A Bloom filter of tokens seen
    twice keeps most others out of the shuffle.
    """

    def tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column("prefix").flatten().to_numpy().view(np.uint64)

    size = table.agg(F.sum(F.size("prefix").cast("long"))).first()[0] or 0
    chunks = chunks_for(size, 16, MOST_CHUNKS)
    bits = repeat_filter(table.select("prefix"), tokens, chunks)
    sent = table.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def repeated(column: pa.Array) -> pa.Array:
        return pa.array(seen(sent.value, column.to_numpy().view(np.uint64)))

    entries = table.select("row", "n", "need", F.explode("prefix").alias("token"))
    likely = entries.filter(repeated("token")).join(single, "row", "left_semi")
    likely = store(likely, "likely-entries")
    lists = likely.groupBy("token").agg(F.count("*").alias("rows"), F.min("row").alias("leader"))
    lists = store(lists.filter("rows > 1"), "lists")
    shared = store(likely.join(lists, "token"), "shared-entries")
    discard(likely, lists)
    return shared


def fetch_sets(texts: DataFrame, wanted: DataFrame, order, words: int) -> DataFrame:
    """(row, n, tokens): the whole sets of the rows in `wanted` (row, s1, s2, n), see `_packed`.

    They are stored in buckets by row, so that they stay where they are in later joins.

    Sets are made anew from the texts. A Bloom filter of the wanted signatures spares the
    shuffle most of the others, and of equal sets each task sends one. No two rows in `wanted`
    have equal sets.
    """
    size = wanted.count()
    chunks = chunks_for(size, 16, MOST_CHUNKS)

    def twice(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        values = batch.column("s1").to_numpy().view(np.uint64)
        yield values
        yield values

    sent = texts.sparkSession.sparkContext.broadcast(
        repeat_filter(wanted.select("s1"), twice, chunks)
    )

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for _, _, tokens, begins in P.runs_of_sets(batch.column("text"), order.value, words):
                one, two = P.signatures(tokens, begins)
                hits = np.flatnonzero(seen(sent.value, one) & (np.diff(begins) > 0)).tolist()
                hits = [i for i in hits if one[i] not in done and not done.add(one[i])]
                if hits:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "s1": pa.array(one[hits].view(np.int64)),
                            "s2": pa.array(two[hits].view(np.int64)),
                            "n": pa.array(np.diff(begins)[hits].astype(np.int32)),
                            "tokens": [_packed(tokens[begins[i] : begins[i + 1]]) for i in hits],
                        }
                    )

    sets = texts.mapInArrow(tidy(found), f"{SET}, tokens binary")
    keys = ["s1", "s2", "n"]
    joined = wanted.join(sets, keys).dropDuplicates(keys)
    return store_bucketed(joined.select("row", "n", "tokens"), "row", "sets")


def _packed(tokens: np.ndarray) -> bytes:
    """48 bits of the hashes in order, as differences: the upper of their bytes are mostly 0."""
    hashed = np.sort(tokens & np.uint64((1 << 48) - 1))
    return packed(np.diff(hashed, prepend=np.uint64(0)))


def _values(tokens: bytes) -> np.ndarray:
    return np.cumsum(unpacked(tokens, "uint64"), dtype=np.uint64)


def verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), stored, those whose sets are similar enough, stored as well.

    Of each pair, the row with more pairs is the centre, and its set is sent once for up to
    `PARTNERS` of them; a task holds the sets of one centre and of one partner at a time.
    """
    ends = pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b"))
    degrees = store(ends.groupBy("row").agg(F.count(F.lit(1)).alias("links")), "degrees")
    one = degrees.select(F.col("row").alias("a"), F.col("links").alias("links_a"))
    two = degrees.select(F.col("row").alias("b"), F.col("links").alias("links_b"))
    known = pairs.join(one, "a").join(two, "b")
    first = F.col("links_a") >= F.col("links_b")
    centre = F.when(first, F.col("a")).otherwise(F.col("b"))
    other = F.when(first, F.col("b")).otherwise(F.col("a"))
    part = F.pmod(F.xxhash64(other), F.ceil(F.greatest("links_a", "links_b") / PARTNERS))
    known = store(known.select(centre.alias("centre"), part.alias("part"), other.alias("row")), "groups")
    centres = known.select("centre", "part", F.col("centre").alias("row")).distinct()
    asked = known.select("*", F.lit(1).alias("side")).unionByName(
        centres.select("*", F.lit(0).alias("side"))
    )
    sent = asked.join(sets.select("row", "tokens"), "row")
    sent = sent.repartition("centre", "part").sortWithinPartitions("centre", "part", "side")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("centre", "part", "side")))
            for key, tokens in zip(keys, batch.column("tokens")):
                values = _values(tokens.as_buffer())
                if key[2] == 0:
                    own, centre = key[:2], values
                    good.append(False)
                else:
                    good.append(own == key[:2] and P.linked(centre, values, percent))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield kept.select(["centre", "row"]).rename_columns(["a", "b"])

    sent = sent.select("centre", "part", "side", "row", "tokens")
    links = store(sent.mapInArrow(tidy(compared), "a long, b long"), "links")
    discard(degrees, known)
    return links


def _in_round(key, rounds: int, number: int):
    return F.pmod(F.xxhash64(key, F.lit(rounds)), F.lit(rounds)) == number


def linked_pairs(
    texts: DataFrame,
    pairs: DataFrame,
    groups: DataFrame,
    order,
    percent: int,
    words: int,
    total: int,
) -> DataFrame:
    """`verified_pairs` of `pairs`, for which the whole sets of their rows are fetched.

    Where these are a large share of the `total` tokens of all sets, the pairs are done in
    rounds by their row `a`, and no more than one round's sets are on disk.
    """

    def ends(of: DataFrame) -> DataFrame:
        rows = of.select(F.col("a").alias("row")).unionAll(of.select("b")).distinct()
        return rows.join(groups, "row")

    wanted = store(ends(pairs), "wanted")
    amount = wanted.agg(F.sum("n")).first()[0] or 0
    rounds = -(-amount // max(HELD, total // 3))
    found = []
    for number in range(rounds):
        own = pairs
        if rounds > 1:
            own = store(pairs.filter(_in_round("a", rounds, number)), "round-pairs")
            discard(wanted)
            wanted = store(ends(own), "wanted")
        sets = fetch_sets(texts, wanted, order, words)
        found.append(verified_pairs(own, sets, percent))
        discard(sets)
        if rounds > 1:
            discard(own)
    discard(wanted)
    return reduce(DataFrame.unionByName, found) if found else pairs


def _similar_size(a: str, b: str, percent: int):
    least, most = F.least(a, b), F.greatest(a, b)
    return 100 * least.cast("long") >= percent * most.cast("long")


def star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): every row with the smallest row of its lists, if they share enough tokens there.

    One row per entry, however long the list: this joins large groups of similar texts
    without forming their pairs.
    """
    leaders = shared.filter("row = leader").select(
        "token", F.col("n").alias("leader_n"), F.col("need").alias("leader_need")
    )
    pairs = shared.filter("row <> leader").join(leaders, "token")
    pairs = pairs.filter(_similar_size("n", "leader_n", percent))
    pairs = pairs.groupBy(F.col("leader").alias("a"), F.col("row").alias("b")).agg(
        F.count("*").alias("found"), F.min(F.least("need", "leader_need")).alias("asked")
    )
    return pairs.filter("found >= asked").select("a", "b")


def mixed_entries(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(token, row, n, need, part, rows): the entries that can still tell of a link between
    rows of different parts; `rows` is how many of a list are left. `shared` is discarded.

    Lists within one part go. So do rows with fewer entries than they, or all they meet, ask
    of a pair: tokens that a few texts have by chance then connect nothing.
    """
    known = shared.select("token", "row", "n", "need").join(parts, "row", "left")
    parted = store(known.withColumn("part", F.coalesce("part", "row")), "parted")
    discard(shared)
    spans = parted.groupBy("token").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.min("need").alias("least")
    )
    spans = spans.filter("low <> high").select("token", "least")
    mixed = store(parted.join(spans, "token"), "mixed")
    discard(parted)
    counts = mixed.groupBy("row").agg(
        F.count(F.lit(1)).alias("held"), F.min(F.least("need", "least")).alias("asked")
    )
    strong = counts.filter("held >= asked").select("row")
    kept = store(mixed.drop("least").join(strong, "row", "left_semi"), "kept")
    discard(mixed)
    lists = kept.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    left = store(kept.join(lists.filter("rows > 1"), "token"), "left-entries")
    discard(kept)
    return left


def pair_plan(left: DataFrame, rows: int) -> tuple[int, int]:
    """Up to which length the pairs of a list are formed, and in how many rounds.

    At least up to `SMALL`; beyond that as long as the pairs grow with the `rows` of the input.
    """
    size = F.col("rows").cast("double")
    power = F.ceil(F.log2("rows")).cast("int").alias("power")
    made = left.groupBy(power).agg(F.sum((size - 1) / 2).alias("pairs"))
    most = max(LEAST_PAIRS, PAIRS * rows)
    longest, total = SMALL, 0.0
    for row in sorted(made.collect()):
        if 1 << row.power > SMALL:
            if total + row.pairs > PAIRS * rows:
                break
            longest = 1 << row.power
        total += row.pairs
    return longest, max(1, math.ceil(total / most))


def single_pairs(left: DataFrame, percent: int, longest: int, rounds: int) -> DataFrame:
    """(a, b) of different parts, stored, with enough matches in lists of at most `longest` rows."""
    small = left.filter(F.col("rows") <= longest)
    fields = ("row", "n", "need", "part")
    one = small.select("token", *[F.col(c).alias(f"{c}_a") for c in fields])
    two = small.select("token", *[F.col(c).alias(f"{c}_b") for c in fields])
    found = []
    for number in range(rounds):
        own = one if rounds == 1 else one.filter(_in_round("row_a", rounds, number))
        pairs = own.join(two, "token").filter(
            (F.col("row_a") < F.col("row_b"))
            & (F.col("part_a") != F.col("part_b"))
            & _similar_size("n_a", "n_b", percent)
        )
        pairs = pairs.groupBy(F.col("row_a").alias("a"), F.col("row_b").alias("b")).agg(
            F.count("*").alias("found"), F.min(F.least("need_a", "need_b")).alias("asked")
        )
        found.append(store(pairs.filter("found >= asked").select("a", "b"), "single-pairs"))
    return reduce(DataFrame.unionByName, found)


def block_links(
    texts: DataFrame,
    left: DataFrame,
    longest: int,
    groups: DataFrame,
    order,
    percent: int,
    words: int,
    total: int,
) -> DataFrame | None:
    """(a, b): links between rows of different parts that meet in lists of over `longest` rows.

    Rows that meet in such lists, over any number of steps, are a cloud, and a cloud of up
    to `ROWS` rows and `TOKENS` tokens of their sets is a block, whose sets are sent once.
    Larger clouds are dealt into several blocks, and all pairs of blocks that a list
    touches are compared. Each is one task's work, which counts the shared tokens of all
    its rows, compares whole sets where they suffice, and returns only links that join what
    it had not joined before: rows in its result, not pairs. Where blocks are sent very often,
    the pairs of blocks are done in rounds. None if there are no such lists.
    """
    mixed = left.filter(F.col("rows") > longest)
    if mixed.isEmpty():
        return None
    first = mixed.groupBy("token").agg(F.min("row").alias("a"))
    clouds = components(mixed.join(first, "token").select("a", F.col("row").alias("b")))
    homes = mixed.groupBy("row").agg(
        F.first("part").alias("part"), F.first("need").alias("need"), F.first("n").alias("n")
    )
    homes = homes.join(clouds.select(F.col("node").alias("row"), F.col("label").alias("cloud")), "row")
    placed = homes = store(homes, "clouds")
    loads = homes.groupBy("cloud").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("load"))
    slots = F.ceil(F.greatest(F.col("held") / ROWS, F.col("load") / TOKENS))
    homes = homes.join(loads.select("cloud", slots.alias("slots")), "cloud")
    slot = F.pmod(F.xxhash64("row"), F.col("slots"))
    homes = homes.withColumn("block", F.xxhash64("cloud", slot)).drop("cloud", "slots")
    # All tokens a row shares with rows of other parts count, also those of small lists.
    lists = left.join(homes.select("row"), "row", "left_semi")
    homes = homes.join(lists.groupBy("row").agg(F.collect_list("token").alias("list")), "row")
    homes = store(homes, "homes")
    discard(placed, clouds)
    touched = mixed.select("row", "token").join(homes.select("row", "block"), "row")
    touched = store(touched.select("token", "block").distinct(), "touched")
    other = touched.select("token", F.col("block").alias("second"))
    met = touched.select("token", F.col("block").alias("first")).join(other, "token")
    met = store(met.filter("first <= second").select("first", "second").distinct(), "met")
    wanted = store(homes.select("row").join(groups, "row"), "wanted")
    sets = fetch_sets(texts, wanted, order, words)
    rows = store(homes.join(sets.select("row", "tokens"), "row"), "block-rows")
    discard(wanted, sets)
    loads = store(rows.groupBy("block").agg(F.sum("n").alias("load")), "loads")
    sides = met.select(F.col("first").alias("block")).unionAll(
        met.filter("first <> second").select("second")
    )
    amount = sides.join(loads, "block").agg(F.sum("load")).first()[0] or 0
    rounds = max(1, -(-amount // max(HELD, total // 3)))
    pair = F.xxhash64("first", "second")
    side = ["row", "part", "need", "list", "tokens"]

    def sent(number: int) -> DataFrame:
        own = met.filter(_in_round(pair, rounds, number))
        one = own.join(rows, F.col("first") == F.col("block"))
        two = own.filter("first <> second").join(rows, F.col("second") == F.col("block"))
        return one.select(pair.alias("pair"), F.lit(0).alias("side"), *side).unionByName(
            two.select(pair.alias("pair"), F.lit(1).alias("side"), *side)
        )

    def compared(table: pa.Table) -> pa.Table:
        sides = table["side"].to_numpy()
        table = table.take(pa.array(np.argsort(sides, kind="stable")))
        rows, need = table["row"].to_numpy(), table["need"].to_numpy()
        sets = [_values(x.as_buffer()) for x in table["tokens"]]
        sizes = np.array([len(x) for x in sets])
        root = np.unique(table["part"].to_numpy(), return_inverse=True)[1]
        lists = table["list"].combine_chunks()
        owner = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
        # The rows that hold each token, one token after the other.
        place = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        holders = owner[np.argsort(place, kind="stable")]
        ends = np.cumsum(np.bincount(place))
        mine = np.split(place, np.cumsum(np.bincount(owner, minlength=len(rows)))[:-1])
        split = int((sides == 0).sum())
        found: list[tuple[int, int]] = []
        for i in range(split if split < len(rows) else len(rows) - 1):
            rest = np.arange(split if split < len(rows) else i + 1, len(rows))
            met = [holders[ends[t - 1] if t else 0 : ends[t]] for t in mine[i].tolist()]
            shared = np.bincount(np.concatenate(met), minlength=len(rows))[rest]
            near = shared >= np.minimum(need[i], need[rest])
            least, most = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
            near &= 100 * least >= percent * most
            for j in rest[near & (root[rest] != root[i])]:
                if root[j] != root[i] and P.linked(sets[i], sets[j], percent):
                    root[root == root[j]] = root[i]
                    found.append((rows[i], rows[j]))
        return pa.table(
            {
                "a": pa.array([a for a, _ in found], pa.int64()),
                "b": pa.array([b for _, b in found], pa.int64()),
            }
        )

    found = [
        store(sent(n).groupBy("pair").applyInArrow(compared, "a long, b long"), "block-links")
        for n in range(rounds)
    ]
    discard(homes, touched, met, rows, loads)
    return reduce(DataFrame.unionByName, found)


def jaccard_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 85,
    words: int = 4,
) -> DataFrame:
    """The connected component of every row of `docs` under Jaccard links of its shingles.

    A text's set holds its distinct runs of `words` lower-cased words, or all its words as one
    if they are fewer; two rows link when 100 |intersection| >= `percent` |union|. Returns
    doc_id, n_shingles, component_id (the smallest id reachable). A text without words, null
    or empty, has an empty set and links with nothing. Rows with equal sets link, also if
    their ids are equal or null; null ids are no component's smallest unless it has no
    other. An empty table gives an empty result; other columns are not looked at.

    Sets are kept as 56-bit hashes in an order of estimated frequency from counters of all
    shingles, 2^22 whatever the input. Every set asks its partners for as many shared prefix
    tokens as its estimated candidates make worthwhile and has a prefix so much longer; a
    pair must share the smaller number. Equal sets are one row from there on. Stars around
    the first row of each list join groups of similar texts; only rows still in different
    components are then compared pair by pair, in short lists as rows, in long ones block by
    block. Stored tables and shuffle files are deleted as soon as nothing needs them.
    """
    ship(docs.sparkSession)
    with shuffles_removed(docs.sparkSession):
        return _components(docs, doc_id, text, percent, words)


def _components(docs: DataFrame, doc_id: str, text: str, percent: int, words: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )
    counts = shingle_counts(rows.select("text"), words)
    chance = float(counts.mean())
    order = context.broadcast(P.frequency_classes(counts))
    noise = chance + 3 * chance**0.5
    del counts
    give_back()
    table = store(prefix_table(rows, order, noise, percent, words), "prefixes")

    filled = table.filter("n > 0")
    sets_of = ["s1", "s2", "n"]
    groups = store(filled.groupBy(sets_of).agg(F.min("row").alias("row")), "set-groups")
    shared = shared_entries(filled, groups.select("row"))
    prefixed, table = table, store(table.select("row", "doc_id", "n", "s1", "s2"), "signed-rows")
    discard(prefixed)
    size, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    bodies = rows.select("text")
    near = store(star_pairs(shared, percent), "star-pairs")
    stars = linked_pairs(bodies, near, groups, order, percent, words, total)
    labels = components(stars)
    parts = labels.select(F.col("node").alias("row"), F.col("label").alias("part"))
    left = mixed_entries(shared, parts)
    longest, rounds = pair_plan(left, size)
    single = single_pairs(left, percent, longest, rounds)
    links = stars.unionByName(
        linked_pairs(bodies, single, groups, order, percent, words, total)
    )
    met = block_links(bodies, left, longest, groups, order, percent, words, total)
    links = links if met is None else links.unionByName(met)
    discard(left, labels)
    found = components(links).select(F.col("node").alias("rep"), "label")

    members = table.select("row", "doc_id", "n", "s1", "s2").join(
        groups.withColumnRenamed("row", "rep"), sets_of, "left"
    )
    members = store(members.join(found, "rep", "left"), "members")
    discard(table, groups)
    members = members.withColumn("label", F.coalesce("label", "rep", "row"))
    smallest = members.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    smallest = store(smallest, "smallest")
    joined = members.join(smallest, "label")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
