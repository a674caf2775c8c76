"""Exact dedup: documents grouped by a 128-bit content hash, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import SPACE, known
from scoreframe.session import store


def content(text: str | Column) -> Column:
    """A text with every run of ASCII white space as one space; null is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), SPACE, " ")


def md5(body: Column) -> Column:
    return F.unhex(F.md5(body))


def text_groups(rows: DataFrame) -> DataFrame:
    """Of `rows` (doc_id, hash, body): one row per distinct text.

    Rows meet by hash and bytes together, so two texts of equal hash stay apart. Copies
    are combined before the shuffle: each task sends a text once, however often it holds it.
    """
    return rows.groupBy("hash", "body").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    content_hash: Callable[[Column], Column] = md5,
) -> DataFrame:
    """The group of equal texts of every row of `docs`, and whether the row stays.

    Texts are equal when identical after `content`. Returns doc_id, keep_id (the smallest
    id of the group), group_size (its rows), kept, text_sha256. Null and empty texts form
    one group. Rows with equal id and text are all marked as kept. Null ids count as larger
    than any other; a group without any id has a null keep_id and keeps all its rows. An
    empty table gives an empty result. Other columns of `docs` are not looked at.

    Where a hash holds a single text, which the byte comparison has shown, rows find their
    group by hash alone; only rows of a collided hash are joined by their whole text.
    """
    body = content(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    rows = rows.withColumn("hash", content_hash(F.col("body")))
    groups = text_groups(rows).withColumn("text_sha256", F.sha2("body", 256))
    groups = store(groups.drop("body"), "text-groups")
    collided = groups.groupBy("hash").count().filter("count > 1").select("hash")
    if collided.isEmpty():
        found = rows.drop("body").join(groups, "hash")
    else:
        collided = store(collided, "collided")
        single = groups.join(collided, "hash", "left_anti")
        found = rows.drop("body").join(single, "hash")
        several = rows.join(collided, "hash", "left_semi")
        several = several.join(text_groups(several), ["hash", "body"])
        several = several.withColumn("text_sha256", F.sha2("body", 256)).drop("body")
        found = found.unionByName(several)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one whole row of each group of equal texts, the one of the smallest id.

    Of rows with equal id and text one stays. Null ids count as larger than any other.
    """
    key, body = "__document", "__content"
    rows = docs.withColumns({key: known(doc_id), body: md5(content(text))})
    groups = text_groups(
        docs.select(known(doc_id).alias("doc_id"), content(text).alias("body")).withColumn(
            "hash", md5(F.col("body"))
        )
    )
    kept = store(groups.select(F.col("keep_id").alias(key), F.col("hash").alias(body)), "kept")
    left = rows.join(kept, [key, body], "left_semi").dropDuplicates([key, body])
    return left.drop(key, body)
