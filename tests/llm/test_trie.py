"""The radix tree and the trie of conversations against plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from scoreframe.llm import radix
from scoreframe.llm.trie import WIDTH, prefix_trie, rebuilt_conversations

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def heads():
    return F.crc32(F.col("conv_id").cast("string")) % 6


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_force(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = sha(f"{len(role)}:{role}{text}")[: 2 * WIDTH]
            turns[conv].append((turn is not None, turn or 0, order, role, text))
    own = {conv: [t[3:] for t in sorted(found)] for conv, found in turns.items()}
    members = defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(abs(conv) % 100) * (1 if conv >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + own[conv][h:])
        for depth in range(len(whole) + 1):
            members[whole[:depth]].append((conv, depth == len(whole)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    found, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        ids = sorted(conv for conv, _ in members[node])
        leaves = sum(below[c][0] for c in children[node]) or 1
        saved = sum(below[c][1] for c in children[node]) + (len(node[-1][1]) * (len(ids) - 1) if node else 0)
        below[node] = leaves, saved
        parent = min(conv for conv, _ in members[node[:-1]]) if node else None
        ends = ",".join(map(str, sorted(conv for conv, end in members[node] if end)))
        found.append((ids[0], len(node), parent, len(ids), len(children[node]), leaves, saved, sha(ends)))
    return sorted(found, key=repr)


def trie(frame, **how):
    found = prefix_trie(rebuilt_conversations(frame, heads()), **how)
    assert found.columns == list(COLUMNS)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_radix_tree_grows_and_splits():
    chance = random.Random(3)
    keys = [bytes(chance.choices(range(256), k=chance.randrange(4))) for _ in range(3000)]
    keys += [b"x" * n for n in (1, 500, 5000, 5001)] + [b"x" * 5000 + b"y", b"", b""]
    root = radix.Node()
    for number, key in enumerate(keys):
        radix.insert(root, key, number)
    kinds, found, stack = set(), defaultdict(list), [(root, b"")]
    while stack:
        node, way = stack.pop()
        assert node is root or node.values or len(node.nodes()) > 1
        found[way + node.path] += node.values
        kinds.add(type(node.children).__name__ + str(getattr(node.children, "room", "")))
        for byte, child in node.children.items() if node.children else ():
            assert child.path[0] == byte and node.child(byte) is child
            stack.append((child, way + node.path))
    expected = defaultdict(list)
    for number, key in enumerate(keys):
        expected[key].append(number)
    assert {k: v for k, v in found.items() if v} == expected
    assert {"Sorted4", "Sorted16", "Direct", "NoneType"} <= kinds

    root = radix.Node()
    for byte in range(40):
        radix.insert(root, bytes([byte, 1]), byte)
    assert isinstance(root.children, radix.Indexed)
    assert [n.values for n in root.nodes()] == [[b] for b in range(40)] and root.child(41) is None


def test_test_data(spark, folder):
    frame = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]
    assert trie(frame) == by_force(rows)
    assert trie(frame, rows_per_task=3) == by_force(rows)


def test_many_copies_long_and_odd_conversations(spark):
    rows = [(c, t, "user", f"hot {t}") for c in range(100, 700, 1) for t in range(4)]
    rows += [(c, t, "user", f"hot {t}" if t < 3 else f"own {c}") for c in range(700, 900) for t in range(4)]
    rows += [(5000 + c, t, "a", f"turn {t}") for c in (0, 1, 2) for t in range(2000 + c)]
    rows += [
        (None, 1, "user", "lost"), (31, None, None, None), (31, None, None, None), (31, 2, "", ""),
        (31, 1, "b", "tie"), (31, 1, "a", "tie"), (1, 1, "ab", "c"), (2, 1, "a", "bc"), (-205, 1, "a", "bc"),
        (-200, 3, "a", "x" * 100000), (3, 7, "été", "où ça 😀"), (4, 7, "été", "où ça 😀"), (2**62, 1, "z", "z"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    frame = frame.selectExpr("*", "1 AS key", "2 AS node", "3 AS depth", "4 AS head")
    expected = by_force(rows)
    assert trie(frame) == expected
    assert trie(frame, rows_per_task=40) == expected
    assert trie(frame.limit(0)) == []
    # A conversation whose only turn is replaced by none of an absent one has no turns at all.
    alone = [(c, 1, "user", "x") for c in (12345, 12346, 12347, 12348)]
    found = trie(spark.createDataFrame(alone, frame.select("conv_id", "turn", "role", "text").schema))
    assert found == by_force(alone)
