"""Line dedup, exact dedup and the Jaccard join against plain Python."""

import hashlib
import pathlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from odd_texts import TEXTS
from scoreframe.llm import jaccard, prefixes
from scoreframe.llm.components import components
from scoreframe.llm.exact import exact_duplicates, without_copies
from scoreframe.llm.jaccard import jaccard_components
from scoreframe.llm.lines import dedup_lines, line_key


def kept_lines(texts):
    """(n_lines, n_dropped, kept) per id, the rule written out."""
    holders = defaultdict(set)
    keys = {}
    for i, text in texts:
        keys[i] = [line_key(x.encode()).decode() for x in (text or "").split("\n")]
        for key in keys[i]:
            if len(key) >= 10:
                holders[key].add(i)
    for i, text in texts:
        lines = (text or "").split("\n")
        stay = [
            x
            for x, key in zip(lines, keys[i])
            if len(key) < 10 or len(holders[key]) < 2 or min(holders[key]) == i
        ]
        yield i, (len(lines), len(lines) - len(stay), "\n".join(stay))


@pytest.mark.parametrize("chunks", [1, 1024])
def test_line_dedup(spark, texts, chunks):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    # A filter that is far too small lets more lines through and changes nothing.
    rows = dedup_lines(frame, bits_per_line=16 if chunks > 1 else 1, most_chunks=chunks).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in rows} == dict(
        kept_lines(list(texts.items()))
    )


def test_line_dedup_of_odd_rows(odd, nothing):
    rows = dedup_lines(odd).collect()
    assert len(rows) == len(TEXTS)
    got = {r.doc_id: r for r in rows if r.doc_id and r.doc_id != 9}
    assert (got[1].n_lines, got[1].n_dropped) == (4, 0)
    assert got[2].kept_text == "own line of the second" and got[2].n_dropped == 2
    assert (got[3].n_lines, got[3].n_dropped, got[3].kept_text) == (1, 0, "")
    assert got[6].kept_text == "" and got[5].n_dropped == 0
    last = [r for r in rows if r.doc_id == (1 << 63) - 1]
    assert sorted(r.kept_text for r in last) == ["", "1234 5678 !!!"]
    assert dedup_lines(nothing).count() == 0


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup_of_odd_rows(odd, nothing):
    rows = exact_duplicates(odd).collect()
    groups = defaultdict(list)
    for i, text, _ in TEXTS:
        groups[normal(text)].append(i)
    expected = []
    for i, text, _ in TEXTS:
        group = groups[normal(text)]
        keep = min((x for x in group if x is not None), default=None)
        digest = hashlib.sha256(normal(text).encode()).hexdigest()
        expected.append((i, keep, len(group), i == keep, digest))
    order = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, rows), key=order) == sorted(expected, key=order)
    assert exact_duplicates(nothing).count() == 0


def test_texts_of_equal_hash_stay_apart(odd):
    weak = lambda body: F.unhex(F.hex(F.substring(body, 1, 1)))
    order = lambda row: tuple(map(str, row))
    strong = sorted(map(tuple, exact_duplicates(odd).collect()), key=order)
    assert sorted(map(tuple, exact_duplicates(odd, content_hash=weak).collect()), key=order) == strong


def test_without_copies_keeps_whole_rows(odd):
    left = without_copies(odd)
    assert left.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect())
    assert [i for null, i in ids if not null] == [1, 2, 3, 5, 7, 8, 9, 10, 11, 12]
    assert sum(null for null, _ in ids) == 2


def sets_of(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def by_force(rows, percent, size):
    """(set size, smallest reachable id) per id, over all pairs."""
    sets = {i: sets_of(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(frame, **kwargs):
    rows = jaccard_components(frame, **kwargs).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("percent, words", [(85, 4), (80, 5)])
def test_jaccard_components(spark, texts, percent, words):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert got(frame, percent=percent, words=words) == by_force(texts.items(), percent, words)


def variants():
    """Chains and clouds of similar texts: long lists in which many pairs are no links."""
    import random

    r = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for cloud, edits in ((0, 2), (1, 4), (2, 8), (3, 14)):
        base = r.sample(words, 120)
        for _ in range(45):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows), " ".join(own)))
    chain = r.sample(words, 100)
    for step in range(25):
        chain[step * 4 % 100] = r.choice(words)
        rows.append((len(rows), " ".join(chain)))
    return rows


@pytest.mark.parametrize("small", [2, 9, 16, 30])
def test_jaccard_components_of_dense_groups(spark, monkeypatch, small):
    """Links must be found whichever of their tokens are in short and in long lists."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = variants()
    rows = [(i * 7919 % 10007, text) for i, text in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = by_force(rows, 85, 4)
    assert 10 < len({c for _, c in expected.values()}) < 190
    monkeypatch.setattr(jaccard, "ROWS", 16)  # several blocks per list
    assert got(frame) == expected


def test_jaccard_components_of_odd_rows(odd, nothing):
    rows = jaccard_components(odd).collect()
    assert len(rows) == len(TEXTS)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id}
    assert found[3] == (0, 3) and found[4] == (0, 4) and found[7] == (0, 7)
    assert found[5] == found[6] and found[6][1] == 5
    assert found[10] == (1, 10) and found[11] == (1, 10)
    assert found[9] == (2, 9)
    assert sorted(r.component_id or 0 for r in rows if r.doc_id is None) == [0, 0]
    assert jaccard_components(nothing).count() == 0


def test_prefix_lengths_never_lose_a_link():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(300):
        base = np.unique(r.integers(0, 1 << 62, 80).astype(np.uint64))
        left = base[r.random(len(base)) < 0.97]
        right = base[r.random(len(base)) < 0.97]
        if not prefixes.linked(left, right, 85):
            continue
        for a in (1, 3, 8):
            for b in (1, 5, 8):
                one = left[: prefixes.prefix_length(len(left), a, 85)]
                two = right[: prefixes.prefix_length(len(right), b, 85)]
                assert len(np.intersect1d(one, two)) >= min(a, b)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.label for r in components(frame).collect()}
    assert found == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)}
    assert components(frame.filter("false")).count() == 0


def near_copies():
    """Groups of 12 texts that differ in a word or two, and lone texts."""
    import random

    r = random.Random(8)
    words = [f"v{i}" for i in range(30000)]
    rows = []
    for _ in range(6):
        base = r.sample(words, 150)
        for _ in range(12):
            own = list(base)
            own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows), " ".join(own)))
        rows.append((len(rows), " ".join(r.sample(words, 150))))
    return rows


def test_jaccard_tables_go_and_joined_rows_form_no_pairs(spark, monkeypatch):
    """Once a star has joined a group, its rows are not compared, and no step's table stays."""
    made = {}

    def counted(frame, name):
        stored = store(frame, name)
        made.setdefault(name, []).append(stored.count())
        return stored

    store = jaccard.store
    monkeypatch.setattr(jaccard, "store", counted)
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"), "scoreframe")
    before = set(root.glob("*"))
    assert got(frame) == by_force(rows, 85, 4)
    assert sum(made["star-pairs"]) >= 60 and sum(made["single-pairs"]) == 0
    left = {re.sub("-[0-9a-f]{32}$", "", path.name) for path in set(root.glob("*")) - before}
    large = {"prefixes", "likely-entries", "shared-entries", "parted", "mixed", "kept", "sets"}
    assert "members" in left and not left & (large | {"left-entries", "groups", "edges"})


@pytest.mark.parametrize("held, pairs", [(3000, 0), (20000, 2)])
def test_jaccard_components_in_rounds(spark, monkeypatch, held, pairs):
    """Few sets, pairs and blocks at a time give what all at once give."""
    monkeypatch.setattr(jaccard, "HELD", held)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    monkeypatch.setattr(jaccard, "LEAST_PAIRS", 2000)
    monkeypatch.setattr(jaccard, "SMALL", 9)
    monkeypatch.setattr(jaccard, "ROWS", 16)
    rows = variants()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(frame) == by_force(rows, 85, 4)


def test_tokens_shared_by_chance_connect_nothing(spark):
    """Rows with fewer entries than a pair of theirs needs are not compared."""
    chance = [(7, row, 100, 4) for row in range(40)]
    near = [(token, row, 100, 4) for token in range(20, 24) for row in (50, 51)]
    short = [(30, 60, 2, 1), (30, 61, 100, 4)]
    frame = spark.createDataFrame(chance + near + short, "token long, row long, n int, need int")
    parts = spark.createDataFrame([], "row long, part long")
    left = jaccard.mixed_entries(frame, parts)
    assert {r.row for r in left.collect()} == {50, 51, 60, 61}
    joined = spark.createDataFrame([(50, 50), (51, 50)], "row long, part long")
    left = jaccard.mixed_entries(frame, joined)
    assert {r.row for r in left.collect()} == {60, 61}
