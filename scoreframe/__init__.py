"""Batch evaluation of model output on Spark: prompts, predictions, scores, summaries."""

from scoreframe.functions.registry import Metric, list_metrics, metric, metrics, register_metric
from scoreframe.operators.endpoint import chat_completion
from scoreframe.operators.fingerprint import function_fingerprint
from scoreframe.operators.ledger import attempts, current_answers, generate_to
from scoreframe.operators.merge import active, lookup, merge_scores, retract
from scoreframe.operators.predictions import attach_predictions, generate, parse_responses
from scoreframe.operators.prompts import build_prompts, request_table
from scoreframe.operators.ranks import running_totals
from scoreframe.operators.rules import rule_predictions
from scoreframe.operators.score import declared_metrics, long_scores, score
from scoreframe.operators.score_table import ScoreTable
from scoreframe.operators.summary import (
    detailed_metrics,
    pivot_scores,
    result_rows,
    sample_scores,
    summarize,
    summary_document,
    unscored_datasets,
    wide_summary,
)
from scoreframe.plans.evaluate import Run, evaluate
from scoreframe.session import remove_stored, shared_path, ship, spread, store
from scoreframe.sources.datasets import (
    dataset_info,
    discover_datasets,
    explode_samples,
    failed_datasets,
    read_datasets,
    valid_datasets,
)
from scoreframe.sources.ranges import read_sample_ranges
from scoreframe.sources.sinks import write_results_csv, write_results_json, write_summary

__all__ = [
    "Metric",
    "Run",
    "ScoreTable",
    "active",
    "attach_predictions",
    "attempts",
    "build_prompts",
    "chat_completion",
    "current_answers",
    "dataset_info",
    "declared_metrics",
    "detailed_metrics",
    "discover_datasets",
    "evaluate",
    "explode_samples",
    "failed_datasets",
    "function_fingerprint",
    "generate",
    "generate_to",
    "list_metrics",
    "long_scores",
    "lookup",
    "merge_scores",
    "metric",
    "metrics",
    "parse_responses",
    "pivot_scores",
    "read_datasets",
    "read_sample_ranges",
    "register_metric",
    "remove_stored",
    "request_table",
    "result_rows",
    "retract",
    "rule_predictions",
    "running_totals",
    "sample_scores",
    "score",
    "ship",
    "shared_path",
    "spread",
    "store",
    "summarize",
    "summary_document",
    "unscored_datasets",
    "valid_datasets",
    "wide_summary",
    "write_results_csv",
    "write_results_json",
    "write_summary",
]
