"""The stages of the pipeline against plain Python, and the whole of it."""

import pathlib

import pytest

import corpus_pipeline as P
from odd_texts import TEXTS
from scoreframe.llm.common import documents
from scoreframe.llm.queries import TOKENIZER
from test_dedup import by_force, normal
from test_scans import check_sequences, cut, leaks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What every stage returned, by name, `documents` included."""
    docs = documents(spark, folder)
    found = {"documents": docs.collect()}
    for name, stage in P.STAGES:
        docs = P.store(stage(spark, docs, folder), name.replace(" ", "-"))
        found[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return found


def texts_of(rows):
    return {r.doc_id: r.text for r in rows}


def test_stage_names():
    assert [name for name, _ in P.STAGES] == [
        "toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing",
    ]


def test_toxic_documents_go_and_clean_ones_stay(spark, folder, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = texts_of(stages["toxicity"])
    lost = [r for r in stages["documents"] if r.doc_id not in kept]
    wrong = [r.doc_id for r in lost if labels.get(r.doc_id) == 0]
    assert len(wrong) <= 0.05 * sum(v == 0 for v in labels.values())
    assert {r.doc_id: r.text for r in stages["documents"] if r.doc_id in kept} == kept


def test_one_of_each_group_of_copies_stays(stages):
    first = {}
    for i, text in sorted(texts_of(stages["toxicity"]).items()):
        first.setdefault(normal(text), i)
    assert sorted(texts_of(stages["exact dedup"])) == sorted(first.values())


def test_one_of_each_group_of_near_copies_stays(stages):
    rows = texts_of(stages["exact dedup"]).items()
    smallest = by_force(rows, 80, 5)
    kept = sorted(texts_of(stages["n-gram Jaccard join"]))
    assert kept == sorted(i for i, (_, label) in smallest.items() if label == i)


def test_documents_with_benchmark_items_go(spark, folder, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before, after = texts_of(stages["n-gram Jaccard join"]), texts_of(stages["benchmark decontamination"])
    leaked = set(leaks(before.items(), items))
    gone = set(before) - set(after)
    assert leaked <= gone and len(gone - leaked) <= 0.02 * len(before)


def test_the_rest_is_packed(spark, folder, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = stages["best-fit packing"]
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    texts = texts_of(stages["benchmark decontamination"])
    assert got == sorted((i, *part) for i, t in texts.items() for part in cut(tokenizer, t, 4096))
    check_sequences(rows, 4096)


def test_whole_run(spark, folder, stages):
    rows = P.run(spark, folder).select("doc_id", "piece", "ids_crc32").collect()
    expected = [(r.doc_id, r.piece, r.ids_crc32) for r in stages["best-fit packing"]]
    assert sorted(map(tuple, rows)) == sorted(expected)


def test_odd_rows_pass_every_stage(spark, folder, odd, nothing):
    docs = odd
    for name, stage in P.STAGES[:-1]:
        docs = P.store(stage(spark, docs, folder), "odd")
        assert docs.columns == odd.columns, name
    left = docs.collect()
    # Copies have gone; null ids stay, as do texts without words, but for equal ones.
    assert len(left) < len(TEXTS) and sum(r.doc_id is None for r in left) == 2
    assert {3, 7} <= {r.doc_id for r in left} and 6 not in {r.doc_id for r in left}
    assert P.STAGES[-1][1](spark, docs, folder).count() >= len(left)
    for _, stage in P.STAGES:
        assert stage(spark, nothing, folder).count() == 0


def test_tables_of_earlier_stages_go(spark, folder, monkeypatch):
    """Only the last stage's table is on disk after a run."""
    monkeypatch.setattr(
        P, "STAGES", [(f"step {n}", lambda spark, docs, folder: docs.filter("doc_id > 2")) for n in range(3)]
    )
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"), "scoreframe")
    before = set(root.glob("*"))
    assert P.run(spark, folder).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(root.glob("*")) - before] == ["step-2"]
