"""Keyed score tables: upsert, soft delete, and reading the current state.

A row is keyed by model, dataset, sample and metric. All joins are on the full key,
and change logs are collapsed with combinable aggregates before the join, so a key
with very many versions never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.session import store_sized, stored_bytes

KEY = ("model", "dataset", "sample_idx", "metric")
COLUMNS = (*KEY, "score", "created_at", "updated_at", "is_builtin", "is_active")


# A collapsed log up to this size in storage goes to the tasks.
SMALL_BYTES = 64 * 1024 * 1024


def merge_scores(
    current: DataFrame, changes: DataFrame, small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """Apply `changes` (key, score, updated_at, seq, is_builtin) to the `current` rows.

    The latest change by `(updated_at, seq)` gives the value; a new row is created at
    its first change. `created_at` of an existing row stays. A builtin write marks the
    row builtin for good, any other write leaves the origin as it is. Writing to a
    retracted row does not bring it back.

    The log is read once: collapsed to a row per key, it meets the current table in one
    full outer join. With `small_bytes` above 0 the collapsed log is stored in the shared
    folder first, and if it takes no more than that, it is sent to the tasks instead, and
    the current table is not shuffled. Rows are the same either way.
    """
    version = F.struct("updated_at", "seq")
    latest = changes.groupBy(*KEY).agg(
        F.max_by("score", version).alias("new_score"),
        F.min("updated_at").alias("first_at"),
        F.max("updated_at").alias("last_at"),
        F.bool_or("is_builtin").alias("any_builtin"),
    )
    if small_bytes <= 0:
        return _applied(current.join(latest, list(KEY), "full_outer"))
    latest, path = store_sized(latest, "latest-changes")
    if stored_bytes(current.sparkSession, path) > small_bytes:
        return _applied(current.join(latest, list(KEY), "full_outer"))
    known = current.select(*KEY).join(F.broadcast(latest.select(*KEY)), list(KEY), "left_semi")
    # There are no more known keys than changes, so this side is as small.
    new = latest.join(F.broadcast(known), list(KEY), "left_anti")
    return _applied(current.join(F.broadcast(latest), list(KEY), "left")).unionByName(
        _applied(new, current)
    )


def _applied(joined: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """The new state of rows with their latest change, either of which may be missing.

    With `like` the rows are new, and the columns of that state table are NULL in them.
    """
    if like is not None:
        state = [f for f in like.schema.fields if f.name not in KEY]
        joined = joined.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in state])
    written = F.col("last_at").isNotNull()
    return joined.select(
        *KEY,
        F.when(written, F.col("new_score")).otherwise(F.col("score")).alias("score"),
        F.coalesce("created_at", "first_at").alias("created_at"),
        F.coalesce("last_at", "updated_at").alias("updated_at"),
        (F.coalesce("is_builtin", F.lit(False)) | F.coalesce("any_builtin", F.lit(False))).alias(
            "is_builtin"
        ),
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
    )


def retract(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Mark the rows with these keys inactive; keys without a row change nothing."""
    gone = keys.select(*KEY).distinct().withColumn("retracted", F.lit(True))
    return (
        current.join(gone, list(KEY), "left")
        .withColumn("is_active", F.col("is_active") & F.col("retracted").isNull())
        .select(*COLUMNS)
    )


def active(
    current: DataFrame,
    include_inactive: bool = False,
    builtin_only: bool = False,
    custom_only: bool = False,
) -> DataFrame:
    """Active rows, optionally of one origin; with both origins asked for, builtin wins."""
    rows = current if include_inactive else current.filter("is_active")
    if builtin_only:
        return rows.filter(F.col("is_builtin"))
    if custom_only:
        return rows.filter(~F.col("is_builtin"))
    return rows


def lookup(current: DataFrame, key: Mapping[str, Any]) -> DataFrame:
    """The active row with this key, no row if there is none."""
    rows = active(current)
    for name in KEY:
        rows = rows.filter(F.col(name) == F.lit(key[name]))
    return rows
