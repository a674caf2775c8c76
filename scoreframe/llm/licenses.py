"""License scans by diagonal voting: word k-grams joined to the places they have in templates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm.text import ALNUM, hashes, lower, runs, sequence_hash, words
from scoreframe.session import ship, store

GRAM = 2
SPAN = pa.list_(
    pa.struct(
        {"label": pa.string(), "start": pa.int32(), "end": pa.int32(), "share": pa.float64()}
    )
)

# Fixed phrases and their labels: every place where the words stand consecutively counts.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Further wordings by which licenses are recognised: short ones as they are, those of ten
# words or more also with small changes.
LONG = 10
TEMPLATES = (
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "released into the public domain under cc0 1 0 universal"),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
    ),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "licensed under the isc license"),
    ("proprietary", "all rights reserved no part of this work may be reproduced"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CAPITALS = {c: c + 32 for c in range(65, 91)}


def text_words(text: str) -> list[str]:
    """The words of a text: A-Z in lower case, runs of letters, digits and non-ASCII."""
    return _WORD.findall(text.translate(_CAPITALS))


def _hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    return hashes(data, starts, ends)


def _grams(docs: DataFrame) -> DataFrame:
    """(key, place, gram): every run of `GRAM` words of every text, hashed."""

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("key").to_numpy()
            for first, end, data, offsets in runs(batch.column("text")):
                starts, ends, bounds = words(lower(data), offsets, ALNUM)
                gram = sequence_hash(hashes(lower(data), starts, ends), GRAM).view(np.int64)
                owner = np.repeat(np.arange(end - first), np.diff(bounds))
                place = np.arange(len(owner)) - bounds[owner]
                inside = np.flatnonzero(owner[: len(gram)] == owner[GRAM - 1 :][: len(gram)])
                for i in range(0, len(inside), 1 << 16):
                    at = inside[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": pa.array(ids[first:end][owner[at]]),
                            "place": pa.array(place[at].astype(np.int32)),
                            "gram": pa.array(gram[at]),
                        }
                    )

    return docs.mapInArrow(rolled, "key long, place int, gram long")


def _positions(spark, wordings: tuple[str, ...]) -> DataFrame:
    """(gram, template, at): where each word pair stands in the templates."""
    rows = [
        (int(gram), number, at)
        for number, wording in enumerate(wordings)
        for at, gram in enumerate(sequence_hash(_hashed(wording), GRAM).view(np.int64))
    ]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def common_words(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence of two short word lists."""
    best = [0] * (len(right) + 1)
    for word in left:
        diagonal = 0
        for i, other in enumerate(right, start=1):
            diagonal, best[i] = best[i], diagonal + 1 if word == other else max(best[i], best[i - 1])
    return best[-1]


def _verified(
    text: list[str],
    candidates: list[dict],
    lists: tuple[list[str], ...],
    gap: int,
    share: float,
) -> Iterator[tuple[int, int, int, float]]:
    """(template, start, end, share) of the candidate diagonals whose words agree."""
    fuzzy: dict[int, dict[int, int]] = {}
    for found in candidates:
        template, start, words_ = found["template"], found["start"], lists[found["template"]]
        if len(words_) >= LONG:
            fuzzy.setdefault(template, {})[start] = found["votes"]
        elif start >= 0 and text[start : start + len(words_)] == words_:
            yield template, start, start + len(words_), 1.0
    for template, votes in sorted(fuzzy.items()):
        left = sorted(votes, key=lambda start: (-votes[start], start))
        done: set[int] = set()
        for start in left:
            merged = {s for s in range(start - gap, start + gap + 1) if s in votes} - done
            if start not in merged:
                continue
            done |= merged
            low, high = max(0, min(merged)), max(merged) + len(lists[template])
            part = common_words(lists[template], text[low:high]) / len(lists[template])
            if part >= share:
                yield template, low, min(high, len(text)), part


def scan_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    gap: int = 3,
    share: float = 0.8,
) -> DataFrame:
    """License phrases and wordings in every row's whole text.

    Returns doc_id, n_words, n_base (places of the fixed phrases), first_word and last_word
    (the smallest and largest start of one), base_labels, labels (those of wordings too),
    score (the best share of a wording found; 1 with a phrase; 0 with neither) and spans
    (label, start, end, share). A null or empty text has no words and no labels; repeated
    rows and null ids are scanned one by one. An empty table gives an empty result; other
    columns are not looked at.

    All word pairs of the texts are joined to their positions in the templates, which are
    part of the code and so of fixed size. Pairs as far from the start of the text as from
    that of their template lie on one diagonal; votes are added up by diagonal, those of
    diagonals at most `gap` words apart together, and where they suffice the words
    themselves are compared: in full for a phrase or a short wording, `share` of them in
    order for one of ten words or more.
    Votes are kept by hash of the text, so copies of a text share theirs.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    wordings = tuple(p for p, _ in PHRASES) + tuple(w for _, w in templates)
    names = tuple(x for _, x in PHRASES) + tuple(x for x, _ in templates)
    lists = tuple(text_words(w) for w in wordings)
    need = [
        len(x) - GRAM + 1
        if len(x) < LONG
        else max(1, len(x) - GRAM + 1 - GRAM * (len(x) - math.ceil(share * len(x))))
        for i, x in enumerate(lists)
    ]
    positions = F.broadcast(_positions(docs.sparkSession, wordings))
    votes = _grams(rows.select("key", "text")).join(positions, "gram")
    diagonal = (F.col("place") - F.col("at")).alias("start")
    votes = votes.groupBy("key", "template", diagonal).agg(F.count("*").alias("votes"))
    beside = Window.partitionBy("key", "template").orderBy("start").rangeBetween(-gap, gap)
    flexible = F.array(*[F.lit(len(x) >= LONG) for x in lists])
    nearby = F.when(
        F.element_at(flexible, F.col("template") + 1), F.sum("votes").over(beside)
    ).otherwise(F.col("votes"))
    least = F.element_at(F.array(*[F.lit(n) for n in need]), F.col("template") + 1)
    found = votes.withColumn("nearby", nearby).filter(F.col("nearby") >= least)
    found = found.groupBy("key").agg(
        F.collect_list(F.struct("template", "start", "votes")).alias("found")
    )
    joined = rows.join(store(found, "license-votes"), "key", "left")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, spans = batch.column("text"), [], []
            for _, _, data, offsets in runs(texts):
                sizes.extend(np.diff(words(lower(data), offsets, ALNUM)[2]).tolist())
            for i, candidates in enumerate(batch.column("found")):
                if candidates.is_valid:
                    own = text_words(texts[i].as_py())
                    spans.append(sorted(_verified(own, candidates.as_py(), lists, gap, share)))
                else:
                    spans.append([])
            base = [[s for s in x if s[0] < len(PHRASES)] for x in spans]
            starts = [[s[1] for s in x] for x in base]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(sizes, pa.int64()),
                    "n_base": pa.array([len(x) for x in base], pa.int64()),
                    "first_word": pa.array([min(x, default=None) for x in starts], pa.int64()),
                    "last_word": pa.array([max(x, default=None) for x in starts], pa.int64()),
                    "base_labels": [",".join(sorted({names[s[0]] for s in x})) for x in base],
                    "labels": [",".join(sorted({names[s[0]] for s in x})) for x in spans],
                    "score": pa.array([max([0.0, *(s[3] for s in x)]) for x in spans]),
                    "spans": pa.array(
                        [
                            [
                                {"label": names[t], "start": a, "end": b, "share": p}
                                for t, a, b, p in x
                            ]
                            for x in spans
                        ],
                        SPAN,
                    ),
                }
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, "
        "spans array<struct<label: string, start: int, end: int, share: double>>"
    )
    return joined.mapInArrow(verified, schema)
