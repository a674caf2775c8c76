"""A trie of conversations by their turns: which beginnings they share, and what that saves."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import radix
from scoreframe.session import ship, store

# Bytes of a turn id, the first half of a SHA-256: big-endian and of fixed width.
WIDTH = 16
NOTHING = hashlib.sha256(b"").hexdigest()
# Conversation ids in a row of those that end at a node of a task's border.
CHUNK = 8192
SALTS = 32
BATCH = 8192

# What a task knows of a node: all, all but its parent's smallest member, or its own share.
DONE, BELOW_BORDER, BORDER, ENDS = range(4)
ROWS = """kind int, node binary, parent binary, depth long, conv_id long, parent_conv_id long,
    n_convs long, n_children long, n_leaves long, saved_tokens long, code_points long,
    ends_sha256 string, first long, ids binary"""
ARROW = pa.schema(
    [("kind", pa.int32()), ("node", pa.binary()), ("parent", pa.binary())]
    + [
        (name, pa.int64())
        for name in (
            "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", "code_points",
        )
    ]
    + [("ends_sha256", pa.string()), ("first", pa.int64()), ("ids", pa.binary())]
)


def rebuilt_conversations(conversations: DataFrame, heads: Column, group: int = 100) -> DataFrame:
    """(conv_id, key, code_points): every conversation with a beginning from its group's first.

    `heads` says over conv_id how many turns to take, 5 at most: those of conversation
    `conv_id - conv_id % group` (all if it has fewer, none if it is absent) replace as many
    of its own. `key` joins the ids of the turns, `code_points` has the length of each
    turn's text. Turns are ordered by `turn`, null first, and equal ones by their id. Rows
    without conv_id belong to no conversation. The ids of one conversation are one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(
        F.col("turn"),
        F.substring(digest, 1, 2 * WIDTH).alias("id"),
        F.length(text).cast("long").alias("code_points"),
    )
    own = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")
    )
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    own = store(own, "conversations")
    first = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head")
    )
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    met = met.withColumn("taken", heads.cast("int"))
    rest = F.slice(F.col("turns"), F.col("taken") + 1, F.size("turns"))
    head = F.when(F.col("head").isNotNull(), F.slice(F.col("head"), F.lit(1), F.col("taken")))
    met = met.withColumn("turns", F.when(head.isNull(), rest).otherwise(F.concat(head, rest)))
    return met.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"),
        F.transform("turns", lambda t: t["code_points"]).alias("code_points"),
    )


def prefix_trie(
    rebuilt: DataFrame, rows_per_task: int = 20_000, bytes_per_task: int = 16 << 20
) -> DataFrame:
    """A row for every beginning of a conversation in `rebuilt`, see `rebuilt_conversations`.

    A node is a distinct sequence of the first `depth` turns; its members are the
    conversations that begin so. Columns: conv_id (the smallest member), depth,
    parent_conv_id (of the parent, null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its
    subtree, members but one times the code points of a node's last text) and ends_sha256
    (of the ids of the members that have no further turn, ascending, joined by commas).

    Conversations are sorted by key and id over ranges of both, so that a task holds a run
    of keys, and copies of one conversation may be in several tasks. Every task puts its run
    into an adaptive radix tree. Only nodes on the way to its first and its last key can have
    members elsewhere: at most two paths a task. Those shares are added up by node, and the
    few border nodes are folded from the deepest up; all others are whole as they are.
    SHA-256 takes its input in order, so the ids that end at one border node pass through one
    task, as a stream of chunks.

    Without conversations there are no nodes, with turnless ones alone only the root.
    """
    ship(rebuilt.sparkSession)
    rebuilt = store(rebuilt, "rebuilt")
    size = rebuilt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    tasks = max(1, math.ceil(size[0] / rows_per_task), math.ceil(size[1] / bytes_per_task))
    planned = int(rebuilt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rebuilt.repartitionByRange(max(tasks, planned), "key", "conv_id")
    runs = runs.sortWithinPartitions("key", "conv_id").select("conv_id", "key", "code_points")
    nodes = store(runs.mapInArrow(_tree_rows, ROWS), "trie-nodes")
    borders = store(_border_nodes(nodes), "trie-borders")

    shown = (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256",
    )
    # The root may have very many children, so its row meets them in many places.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    parents = borders.select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), salts
    )
    salt = F.pmod("conv_id", F.lit(SALTS)).cast("int").alias("salt")
    below = nodes.filter(F.col("kind") == BELOW_BORDER).drop("parent_conv_id").select("*", salt)
    below = below.join(parents, ["parent", "salt"])
    upper = borders.select("*", salt).join(parents, ["parent", "salt"], "left")
    done = nodes.filter(F.col("kind") == DONE)
    return done.select(*shown).unionByName(below.select(*shown)).unionByName(upper.select(*shown))


def _digests(key: bytes) -> list[bytes]:
    """A digest of each whole number of turns from the beginning of `key`."""
    state, found = hashlib.sha256(), []
    found.append(state.digest()[:WIDTH])
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        found.append(state.digest()[:WIDTH])
    return found


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one run of sorted keys."""
    root, lengths = radix.Node(), {}
    first = last = None
    for batch in batches:
        for conv_id, key, points in zip(*(column.to_pylist() for column in batch.columns)):
            first = key if first is None else first
            last = key
            radix.insert(root, key, conv_id)
            for place, count in enumerate(points):
                lengths[key[place * WIDTH : (place + 1) * WIDTH]] = count
    if first is None:
        return
    rows: list[dict] = []
    for row in _nodes(root, first, last, lengths):
        rows.append(row)
        if len(rows) == BATCH:
            yield pa.RecordBatch.from_pylist(rows, ARROW)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, ARROW)


class _Below:
    """What a node of the tree hands to the node above it."""

    __slots__ = ("members", "smallest", "tops", "children", "leaves", "saved")

    def __init__(self):
        self.members, self.smallest = 0, None
        # Rows of nodes whose parent is still to come; those of them that are no border nodes.
        self.tops: list[dict] = []
        self.children = self.leaves = self.saved = 0

    def add(self, other: _Below) -> None:
        self.members += other.members
        self.smallest = _smaller(self.smallest, other.smallest)
        self.tops += other.tops
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _nodes(root: radix.Node, first: bytes, last: bytes, lengths: dict[bytes, int]) -> Iterator[dict]:
    """Rows of all nodes that stand at whole turns, from the leaves up.

    A compressed path may pass several whole turns: each is a node with one child.
    """
    names = {key: _digests(key) for key in {first, last}}
    # Depth first; a node is finished when it is met the second time.
    stack = [(root, 0, False)]
    finished: dict[int, _Below] = {}
    way: list[bytes] = []
    while stack:
        node, top, again = stack.pop()
        if not again:
            way.append(node.path)
            stack.append((node, top, True))
            stack += [(child, top + len(node.path), False) for child in node.nodes()]
            continue
        below = _Below()
        for child in node.nodes():
            below.add(finished.pop(id(child)))
        bottom = top + len(node.path)
        before = b"".join(way)  # the whole way down to this node
        way.pop()
        ends = node.values
        if ends:
            below.members += len(ends)
            below.smallest = _smaller(below.smallest, min(ends))
        lowest = bottom // WIDTH * WIDTH
        shared = {radix.common(before, key, 0): key for key in names}
        way_shared = max(shared)
        for at in range(lowest, -1 if node is root else top, -WIDTH):
            depth = at // WIDTH
            own = ends if at == bottom else []
            border = shared[way_shared] if at <= way_shared else None
            points = lengths[before[at - WIDTH : at]] if at else 0
            row = {"depth": depth, "conv_id": below.smallest, "n_convs": below.members,
                   "code_points": points, "n_children": below.children}
            if border is None:
                below.leaves = below.leaves or 1
                below.saved += (below.members - 1) * points
                row |= {"kind": DONE, "ends_sha256": _ends(own)}
            else:
                row |= {"kind": BORDER, "node": names[border][depth]}
                row |= {"parent": names[border][depth - 1] if depth else None}
                for start in range(0, len(own), CHUNK):
                    part = own[start : start + CHUNK]
                    yield {"kind": ENDS, "node": row["node"], "first": part[0],
                           "ids": np.array(part, "<i8").tobytes()}
            row |= {"n_leaves": below.leaves, "saved_tokens": below.saved}
            for child in below.tops:
                if border is None:
                    child["parent_conv_id"] = below.smallest
                else:
                    child |= {"kind": BELOW_BORDER, "parent": row["node"]}
                yield child
            below.tops = []
            if border is None:
                below.tops, below.children = [row], 1
            else:
                yield row
                below.children = below.leaves = below.saved = 0
        finished[id(node)] = below


def _ends(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else NOTHING


def _border_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes that several tasks may have a share of, all but their parent's member."""
    shares = nodes.filter(F.col("kind") == BORDER).groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("code_points").alias("code_points"),
    )
    columns = shares.columns
    schema = pa.schema([ARROW.field(c) for c in columns])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Children come before their parents; those of one depth wait for them.
        waiting: dict[bytes, list[int]] = defaultdict(lambda: [0, 0, 0])
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                children, leaves, saved = waiting.pop(row["node"], (0, 0, 0))
                row["n_children"] += children
                row["n_leaves"] += leaves
                row["saved_tokens"] += saved + (row["n_convs"] - 1) * row["code_points"]
                row["n_leaves"] = row["n_leaves"] or 1
                above = waiting[row["parent"]]
                above[0] += 1
                above[1] += row["n_leaves"]
                above[2] += row["saved_tokens"]
            yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = ", ".join(f"{name} {kind}" for name, kind in shares.dtypes)
    folded = shares.repartition(1).sortWithinPartitions(F.col("depth").desc()).mapInArrow(fold, ddl)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"node": pa.array([node], pa.binary()), "ends_sha256": [state.hexdigest()]}
            )

        for batch in batches:
            for name, ids in zip(*(column.to_pylist() for column in batch.columns)):
                text = ",".join(map(str, np.frombuffer(ids, "<i8").tolist())).encode()
                if name == node:
                    state.update(b"," + text)
                else:
                    if node is not None:
                        yield done()
                    node, state = name, hashlib.sha256(text)
        if node is not None:
            yield done()

    chunks = nodes.filter(F.col("kind") == ENDS).repartition("node").sortWithinPartitions("node", "first")
    ends = chunks.select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")
    joined = folded.join(ends, "node", "left")
    return joined.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
