"""The query of document similarity on rows of its own."""

import pytest

import __spark_entry__ as entry
import brute

TEXTS = {
    1: "one two three four five six\nseven eight nine ten eleven\nthe third line goes away\nlast one here",
    2: '{"a": 1, "b": "two"}',
    3: '{"a": 1,\n"b": 2\n, "c": 3}',
    4: "a\nb\n" + "what is left out is most of this text " * 3,
    5: "",
    6: None,
}


def test_document_similarity_has_all_python_metrics(spark, tmp_path):
    rows = [(i, text, "en", "s", len(text or "")) for i, text in TEXTS.items()]
    frame = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    scored = entry.queries()["document_similarity"](spark, str(tmp_path))
    found = {r.sample_idx: r for r in scored.collect()}
    assert sorted(found) == sorted(TEXTS)
    names = ("rouge_l", "bleu", "char_f1", "fuzzy_match", "json_validity")
    assert sorted(scored.columns) == sorted((*names, "dataset", "sample_idx"))
    for i, text in TEXTS.items():
        if text is None:
            assert all(found[i][name] is None for name in names)
            continue
        part = "\n".join(x for n, x in enumerate(text.split("\n")) if n % 3 != 2)
        for name in ("char_f1", "fuzzy_match"):
            expected = getattr(brute, name)(part, text)
            assert found[i][name] == pytest.approx(expected, abs=1e-6), (name, i)
    assert [found[i].json_validity for i in (1, 2, 3, 5)] == [0, 1, 0, 0]
