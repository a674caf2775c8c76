"""A stored score table: merges rewrite only what they touch, look-ups read one row group."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.operators.merge import COLUMNS, KEY, SMALL_BYTES, lookup, merge_scores, retract
from scoreframe.session import store

HASH, BUCKET, BUCKETS = "key_hash", "bucket", "buckets"


class ScoreTable:
    """The rows of `merge_scores` as Parquet files below `path`, dealt out by their key.

    A row lives in one of `buckets` partitions, by a hash of its key; files are sorted by
    that hash and have a Bloom filter of it. `schema` is that of the state table. All users
    of a table must give the same number of buckets, which is part of its folders' names.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str | T.StructType, buckets: int = 64
    ):
        parsed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        own = [T.StructField(HASH, T.LongType())]
        own += [T.StructField(name, T.IntegerType()) for name in (BUCKETS, BUCKET)]
        self.spark, self.path, self.buckets = spark, path, buckets
        self.state = T.StructType([parsed[name] for name in COLUMNS])
        self.stored = T.StructType([*self.state.fields, *own])

    def write(self, state: DataFrame) -> None:
        """Replace the whole table by `state`."""
        self._save(state, "static")

    def rows(self) -> DataFrame:
        """The state table."""
        return self._read().select(*COLUMNS)

    def merge(self, changes: DataFrame, small_bytes: int = SMALL_BYTES) -> list[int]:
        """Apply `changes` as `merge_scores` does; returns the buckets it has rewritten.

        Only partitions that a change falls into are read and written: the new state of
        those is stored first and then takes their place, when the writing job commits.
        A merge that failed can be called again with the same changes.
        """
        touched = self._touched(changes)
        if touched:
            current = self._read().filter(F.col(BUCKET).isin(touched)).select(*COLUMNS)
            self._save(store(merge_scores(current, changes, small_bytes), "merged"), "dynamic")
        return touched

    def retract(self, keys: DataFrame) -> list[int]:
        """Mark the rows with these keys inactive, in the partitions they fall into."""
        touched = self._touched(keys)
        if touched:
            current = self._read().filter(F.col(BUCKET).isin(touched)).select(*COLUMNS)
            self._save(store(retract(current, keys), "retracted"), "dynamic")
        return touched

    def lookup(self, key: Mapping[str, Any]) -> DataFrame:
        """The active row with this key, no row if there is none.

        The hash of the key is a constant of the plan: it names the partition, and row
        groups whose range or Bloom filter excludes it are not read.
        """
        hashed = self._hash({n: F.lit(key[n]).cast(self.state[n].dataType) for n in KEY})
        found = self._read().filter((F.col(BUCKET) == self._bucket(hashed)) & (F.col(HASH) == hashed))
        return lookup(found, key).select(*COLUMNS)

    def _touched(self, changes: DataFrame) -> list[int]:
        """The buckets of these keys; there are no more of them than of buckets."""
        hashed = self._hash({n: F.col(n).cast(self.state[n].dataType) for n in KEY})
        rows = changes.select(self._bucket(hashed).alias(BUCKET)).distinct().collect()
        return sorted(row[BUCKET] for row in rows)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path).filter(
            F.col(BUCKETS) == self.buckets
        )

    def _save(self, state: DataFrame, overwrite: str) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.state.fields]
        hashed = self._hash({name: F.col(name) for name in KEY})
        placed = state.select(*columns).withColumn(HASH, hashed)
        placed = placed.withColumn(BUCKETS, F.lit(self.buckets))
        placed = placed.withColumn(BUCKET, self._bucket(F.col(HASH)))
        dealt = placed.repartition(BUCKET).sortWithinPartitions(BUCKET, HASH)
        (
            dealt.write.mode("overwrite")
            .option("partitionOverwriteMode", overwrite)
            .option(f"parquet.bloom.filter.enabled#{HASH}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .partitionBy(BUCKETS, BUCKET)
            .parquet(self.path)
        )

    def _hash(self, key: Mapping[str, Column]) -> Column:
        return F.xxhash64(*[key[name] for name in KEY])

    def _bucket(self, hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(self.buckets)).cast("int")
