"""A cleaning pipeline for training documents: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
the columns of `documents`; the last returns the packed pieces. A table is written to the
shared folder after every stage and read again, so a lost executor repeats one stage at most;
the table of the stage before then goes.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.common import documents, held, known
from scoreframe.llm.exact import without_copies
from scoreframe.llm.jaccard import jaccard_components
from scoreframe.llm.latent import find_contamination
from scoreframe.llm.packing import pack
from scoreframe.llm.toxicity import score_toxicity
from scoreframe.session import discard, store

TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model rejects go; texts without words stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, ~held("doc_id", 5, 0))
    return scored.filter(F.col("toxicity") < TOXIC).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, that of the smallest id stays."""
    return without_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates (five words, 0.8), the smallest id stays."""
    found = jaccard_components(docs, percent=80, words=5)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = keep.select(known("doc_id").alias("__document")).distinct()
    rows = docs.withColumn("__document", known("doc_id"))
    return rows.join(keep, "__document", "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or paraphrased, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark).filter("contaminated")
    leaked = found.select(known("doc_id").alias("__document")).distinct()
    rows = docs.withColumn("__document", known("doc_id"))
    return rows.join(leaked, "__document", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left as token pieces in sequences of at most 4096."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

# The learned and the search stages have no SQL form; tests/llm compares each stage with a
# brute-force version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over `documents`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        last, docs = docs, store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(last)
    return docs
