"""The audit of filters against each order applied one filter after the other."""

import re
from itertools import permutations

from scoreframe.llm.audit import audit_filters, removal_intervals
from scoreframe.llm.common import LAST

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(rows):
    """Per row the letters it fails."""
    first = {}
    for i, text, _ in rows:
        first[text or ""] = min(first.get(text or "", LAST), LAST if i is None else i)
    found = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": (LAST if i is None else i) > first[text],
        }
        found.append({letter for letter, bad in failed.items() if bad})
    return found


def by_force(rows, labels):
    """(part, order, step) -> counts, by filtering in every order."""
    found, fails = {}, failures(rows)
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    for part in {source or "" for _, _, source in rows}:
        own = [(i, f) for (i, _, source), f in zip(rows, fails) if (source or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                found[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in own) - len(gone),
                    sum(f == {letter} for _, f in own),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                    letter,
                ]
        for key in found:
            if key[0] == part:
                found[key][-1] = shapley[found[key][-1]]
    return {key: tuple(row) for key, row in found.items()}


def audited(frame):
    rows = frame.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_intervals_cover_what_each_order_removes():
    orders = list(permutations(range(4)))
    found = {}
    for mask, step, first, end in removal_intervals(4):
        for rank in range(first, end):
            assert (mask, rank) not in found
            found[mask, rank] = step
    for mask in range(1, 16):
        for rank, order in enumerate(orders):
            assert found[mask, rank] == 1 + min(order.index(f) for f in range(4) if mask >> f & 1)


def test_test_data(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    assert audited(audit_filters(documents, labels)) == by_force(rows, marks)


def test_odd_rows(spark, odd, nothing):
    copies = [(100 + i, "the very same text", "a") for i in range(50)] + [(7, "the very same text", "b")]
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()] + copies + [
        (1, "ONCE more $", "a"), (1, "ONCE more $", "a"), (None, "the very same text", ""),
        (2, "word " * 300, None), (3, " ".join(map(str, range(300))), "a"),
    ]
    marks = [(1, 1, 1), (1, 0, 0), (2, None, 1), (None, 1, 1), (110, 1, None), (999, 1, 1), (9, 1, 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = documents.selectExpr("*", "1 AS part", "2 AS mask", "3 AS step", "4 AS n", "5 AS digest")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    labels = labels.selectExpr("*", "1 AS part", "2 AS mask", "3 AS good")
    assert audited(audit_filters(documents, labels)) == by_force(rows, marks)
    assert audited(audit_filters(documents, labels.limit(0))) == by_force(rows, [])
    assert audit_filters(nothing, labels).count() == 0
    alone = audited(audit_filters(spark.createDataFrame([(None, None, None)], documents.select("doc_id", "text", "source").schema), labels))
    assert len(alone) == 600 and alone["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
