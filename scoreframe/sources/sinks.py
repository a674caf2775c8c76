"""Writing results: per-sample JSON, flat CSV and the summary document."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results_json(results: DataFrame, path: str, run_id: str) -> None:
    """Per-sample or per-dataset results as JSON lines below `run_id=/model=/dataset=`.

    The rebalance hint gathers the rows of a small dataset in few files and splits a
    large one over many tasks.
    """
    places = [name for name in ("model", "dataset") if name in results.columns]
    results.hint("rebalance", *places).write.mode("overwrite").partitionBy(*places).json(
        f"{path}/run_id={run_id}"
    )


def write_results_csv(report: DataFrame, path: str) -> None:
    """The flat report with a header line; quotes inside a field are doubled."""
    report.write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def write_summary(document: DataFrame, path: str) -> bool:
    """The summary document as JSON lines; nothing is written without a dataset."""
    if document.isEmpty():
        return False
    document.write.mode("overwrite").json(path)
    return True
