"""Scoring: every metric of every pair in one pass, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.arrow import checked_udf, time_spent
from scoreframe.functions.native import Layers, Text
from scoreframe.functions.registry import Metric, list_metrics, metrics as resolve
from scoreframe.session import ship


def declared_metrics(datasets: DataFrame) -> list[str]:
    """Registered metric names any dataset declares, one small job.

    Give the dataset table rather than its samples. The result is no longer than the
    registry; unknown names are reported by `failed_datasets`.
    """
    named = datasets.select(F.explode("metrics").alias("name"))
    rows = named.filter(F.col("name").isin(list_metrics())).distinct().collect()
    return sorted(row["name"] for row in rows)


def score(
    pairs: DataFrame,
    metrics: Sequence[str | Metric],
    only_declared: bool = False,
    prediction: str = "prediction",
    reference: str = "reference",
    errors: str | None = None,
    seconds: str | None = None,
) -> DataFrame:
    """Add one double column per metric, named after it.

    With `only_declared` each row is scored by just those metrics its array column
    `metrics` names; the others stay NULL and cost nothing: shared forms are built only
    where a metric using them is asked for, and Python functions get NULL inputs, because
    a UDF inside a condition would run for every row.

    With `errors` a column of that name maps the Python metrics that raised on a row to
    their messages, and their scores there are NULL; without it an exception fails the job.

    The plan is a few projections: first the text forms several metrics share, then the
    scores. Python metrics all read the raw text and so run in one `ArrowEvalPython`.
    """
    ship(pairs.sparkSession)
    chosen = resolve(metrics)
    if seconds and not errors:
        raise ValueError("times need a column for errors")
    names = [m.name for m in chosen]
    if len(set(names)) < len(names):
        raise ValueError("a metric may be given only once")
    parts = [part for m in chosen for part, _ in m.parts]
    plain = {m.name: m for m in chosen if not m.parts}
    # A composite reads the column of a metric that is scored anyway with the same
    # parameters; its other parts get a column of their own, dropped at the end.
    hidden = {f"__part_{p.name}": p for p in parts if plain.get(p.name) != p}

    def scored_column(name: str, m: Metric) -> Column:
        value = F.col(quoted(name))
        return value["score"] if errors and m.function else value

    def part_column(p: Metric) -> Column:
        return scored_column(p.name if plain.get(p.name) == p else f"__part_{p.name}", p)

    def users(m: Metric) -> set[str]:
        """Names that make this metric run: its own, and those of composites over it."""
        return {m.name} | {c.name for c in chosen if any(p.name == m.name for p, _ in c.parts)}

    def asked(names: set[str]) -> Column:
        return F.arrays_overlap("metrics", F.array(*[F.lit(n) for n in sorted(names)]))

    shared: Layers = ({}, {})
    views = (
        Text(F.col(prediction), "prediction", shared),
        Text(F.col(reference), "reference", shared),
    )
    form_users: dict[str, set[str]] = {}

    def column(m: Metric) -> Column:
        if not m.takes_text:
            inputs = [F.col(prediction), F.col(reference)]
            if only_declared:
                inputs = [F.when(asked(users(m)), c) for c in inputs]
            if errors and m.function:
                return checked_udf(m.function)(*inputs)
            return m.build(*map(Text, inputs)).cast("double")
        for view in views:
            view.touched.clear()
        value = m.build(*views).cast("double")
        for form in views[0].touched | views[1].touched:
            form_users.setdefault(form, set()).update(users(m))
        return F.when(asked(users(m)), value) if only_declared else value

    scores = {name: column(m) for name, m in {**plain, **hidden}.items()}
    formed = pairs
    for layer in shared:
        forms = {n: F.when(asked(form_users[n]), c) if only_declared else c for n, c in layer.items()}
        formed = formed.select("*", *[c.alias(n) for n, c in forms.items()])
    scored = formed.select(
        *[F.col(quoted(c)) for c in pairs.columns], *[c.alias(n) for n, c in scores.items()]
    )
    if not only_declared and not parts and not errors:
        return scored

    def final(m: Metric) -> Column:
        value = m.combine(part_column) if m.parts else scored_column(m.name, m)
        if only_declared:
            value = F.when(F.array_contains("metrics", m.name), value)
        return value.alias(m.name)

    found = [final(m) for m in chosen]
    python: dict[str, Metric] = {}
    if errors:
        python = {n: m for n, m in {**plain, **hidden}.items() if m.function}
        found.append(_raised(python).alias(errors))
    whole = scored.select(*[F.col(quoted(c)) for c in pairs.columns], *found, *_measured(seconds, python))
    if not seconds:
        return whole
    length = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in (prediction, reference))
    many = F.array_size("metrics") if only_declared else F.lit(len(chosen))
    weight = (length + 1) * F.greatest(many, F.lit(1))
    after = F.hash(*[F.col(quoted(n)) for n in names], F.map_keys(F.col(quoted(errors))))
    spent = time_spent(weight, F.col(quoted(seconds)), after)
    return whole.withColumn(seconds, spent)


def _measured(name: str | None, metrics: dict[str, Metric]) -> list[Column]:
    """The time Python metrics took on a row, as column `name`; no column without a name."""
    if not name:
        return []
    spent = [F.coalesce(F.col(quoted(c))["seconds"], F.lit(0.0)) for c in metrics]
    return [sum(spent, F.lit(0.0)).alias(name)]


def _raised(metrics: dict[str, Metric]) -> Column:
    """The errors among columns of struct(score, error), by the name of the metric.

    A metric scored on its own and as a part of another is one entry.
    """
    found: dict[str, list[Column]] = {}
    for column, m in metrics.items():
        found.setdefault(m.name, []).append(F.col(quoted(column))["error"])
    none = F.create_map().cast("map<string,string>")
    pairs = [F.struct(F.lit(n), F.coalesce(*errors)) for n, errors in found.items()]
    if not pairs:
        return none
    raised = F.filter(F.array(*pairs), lambda pair: pair["col2"].isNotNull())
    return F.map_from_entries(raised)


def long_scores(scored: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """One row per pair and metric; metrics a row was not scored by are left out."""
    names = list(metrics)
    keys = [k for k in ("model", "dataset", "file_path", "sample_idx") if k in scored.columns]
    return (
        scored.select(*keys, *[quoted(n) for n in names])
        .unpivot(keys, [F.col(quoted(n)) for n in names], "metric", "score")
        .filter(F.col("score").isNotNull())
    )


def quoted(name: str) -> str:
    """A column name as Spark reads it whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"
