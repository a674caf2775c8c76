"""Dataset files: reading, defaults, discovery, faults, samples."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scoreframe import (
    dataset_info,
    discover_datasets,
    explode_samples,
    failed_datasets,
    read_datasets,
    valid_datasets,
)

DOCUMENT = {
    "instruction": "Nenne die Hauptstadt.",
    "output_length": 3,
    "metrics": ["exact_match"],
    "few_shots": [
        {"input": "Peru", "output": "Lima"},
        {"input": "Kenia", "output": "Nairobi"},
    ],
    "samples": [
        {"input": "Island 🇮🇸", "output": "Reykjavík"},
        {"input": "Japan", "output": "東京"},
    ],
}


def without(*names):
    return {k: v for k, v in DOCUMENT.items() if k not in names}


FILES = {
    "full.json": DOCUMENT,
    "deep/er/full.json": DOCUMENT | {"instruction": "other"},
    "with space ü 50%+.v2.json": DOCUMENT,
    "null_instruction.json": DOCUMENT | {"instruction": None},
    "no_instruction.json": without("instruction"),
    "no_shots.json": without("few_shots", "output_length"),
    "no_metrics.json": without("metrics"),
    "no_samples.json": without("samples"),
    "empty.json": DOCUMENT | {"samples": []},
    "null_samples.json": DOCUMENT | {"samples": None},
    "half_sample.json": DOCUMENT | {"samples": [{"input": "a"}]},
    "half_shot.json": DOCUMENT | {"few_shots": [{"output": "a"}]},
    "strange_metric.json": DOCUMENT | {"metrics": ["exact_match", "magic"]},
    "array.json": [DOCUMENT],
    "pretty.json": json.dumps(DOCUMENT, indent=2),
    "broken.json": json.dumps(DOCUMENT)[:-1],
    "single_quotes.json": str(without("output_length")),
    "trailing.json": json.dumps(DOCUMENT) + " x",
    "not_text.json": b'{"instruction": "\xff\xfe", "samples": [], "metrics": []}',
    "bom.json": b"\xef\xbb\xbf" + json.dumps(DOCUMENT).encode(),
    "other.txt": DOCUMENT,
}
DISCOVERED = {
    "full",
    "with space ü 50%+.v2",
    "null_instruction",
    "no_shots",
    "empty",
    "null_samples",
    "half_sample",
    "half_shot",
    "strange_metric",
    "pretty",
}


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("datasets")
    for name, content in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        if isinstance(content, (dict, list)):
            content = json.dumps(content, ensure_ascii=False)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return root


def test_one_file(spark, place):
    row = read_datasets(spark, str(place / "full.json")).first()
    assert (row.dataset, row.instruction, row.output_length) == ("full", "Nenne die Hauptstadt.", 3)
    assert row.metrics == ["exact_match"]
    assert [s.asDict() for s in row.few_shots] == DOCUMENT["few_shots"]
    assert [s.asDict() for s in row.samples] == DOCUMENT["samples"]


def test_directory_is_read_recursively(spark, place):
    rows = read_datasets(spark, str(place)).select("dataset", "file_path").collect()
    assert len(rows) == len(FILES) - 1
    assert {r.dataset for r in rows} == {
        name.rsplit("/", 1)[-1].removesuffix(".json") for name in FILES if name.endswith(".json")
    }
    assert {r.file_path.removeprefix("file:").removeprefix("//") for r in rows} == {
        str(place / name) for name in FILES if name.endswith(".json")
    }


def test_defaults_for_missing_fields(spark, place):
    found = read_datasets(spark, str(place))
    rows = {r.dataset: r for r in dataset_info(found).collect()}
    assert rows["no_instruction"].instruction == ""
    assert rows["null_instruction"].instruction is None
    assert (rows["no_shots"].few_shot_total, rows["no_shots"].output_length) == (0, None)
    assert rows["no_metrics"].metrics == []
    assert rows["no_samples"].sample_total == 0


def test_discovery(spark, place):
    rows = discover_datasets(spark, str(place)).collect()
    assert {r.dataset for r in rows} == DISCOVERED
    assert len(rows) == len(DISCOVERED) + 1  # two files are named "full"


def test_missing_path(spark, place):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_datasets(spark, str(place / "nowhere")).collect()


def test_faulty_datasets_are_reported(spark, place):
    found = read_datasets(spark, str(place))
    errors = {r.dataset: r.error for r in failed_datasets(found, "m").collect()}
    assert errors == {
        "null_instruction": "instruction is null",
        "null_samples": "samples is not a list of pairs",
        "half_sample": "a sample lacks input or output",
        "strange_metric": "Unsupported metric: magic",
        **dict.fromkeys(
            ["array", "broken", "single_quotes", "trailing", "not_text", "bom"],
            "not a JSON object",
        ),
    }
    valid = {r.dataset for r in valid_datasets(found).collect()}
    assert valid.isdisjoint(errors) and len(valid | set(errors)) == len(FILES) - 2


def test_faults_depend_on_what_is_used(spark, place):
    found = read_datasets(spark, str(place))
    errors = {r.dataset: r.error for r in failed_datasets(found, "m", 1, ["bleu"]).collect()}
    assert errors["half_shot"] == "a few-shot example lacks a side"
    assert "strange_metric" not in errors


def test_samples_in_order_and_spread(spark, tmp_path):
    many = DOCUMENT | {"samples": [{"input": f"i{n}", "output": f"o{n}"} for n in range(500)]}
    (tmp_path / "many.json").write_text(json.dumps(many))
    (tmp_path / "none.json").write_text(json.dumps(DOCUMENT | {"samples": []}))
    samples = explode_samples(read_datasets(spark, str(tmp_path)), [], partitions=8)
    rows = samples.orderBy("sample_idx").collect()
    assert [(r.dataset, r.sample_idx, r.input, r.reference) for r in rows] == [
        ("many", n, f"i{n}", f"o{n}") for n in range(500)
    ]
    used = samples.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == 8
